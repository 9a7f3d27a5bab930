"""Folders below a path, through the file system that Spark reads it with."""

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), where


def exists(spark: SparkSession, path: str) -> bool:
    system, where = _at(spark, path)
    return system.exists(where)


def names(spark: SparkSession, path: str) -> list[str]:
    """The names of what lies in a folder, in order; none if it is not there."""
    system, where = _at(spark, path)
    if not system.exists(where):
        return []
    return sorted(status.getPath().getName() for status in system.listStatus(where))


def mark(spark: SparkSession, path: str) -> None:
    """An empty file. That it is there says that what it stands for is complete."""
    system, where = _at(spark, path)
    system.create(where, True).close()


def remove(spark: SparkSession, path: str) -> None:
    system, where = _at(spark, path)
    system.delete(where, True)

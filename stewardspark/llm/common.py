"""Helpers the operators share: shared folders, global order, components."""

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: What separates words: space, tab, line feed, vertical tab, form feed, return.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

_OWN_FOLDERS: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names, which all executors reach.

    Where it is unset, as in tests, one local folder per application is made.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    application = spark.sparkContext.applicationId
    return _OWN_FOLDERS.setdefault(application, f"/tmp/run-llm-{uuid.uuid4().hex}")


def new_path(spark: SparkSession, purpose: str) -> str:
    return f"{shared_folder(spark)}/llm-{purpose}-{uuid.uuid4().hex}"


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written to the shared folder and read again: its lineage ends there."""
    spark = df.sparkSession
    path = new_path(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, everything else as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def by_partition(partition: Column, values: dict[int, int]) -> Column:
    """The value of a row's partition, from a list as long as the partitions are many."""
    if not values:
        return F.lit(0).cast("long")
    listed = [values.get(i, 0) for i in range(max(values) + 1)]
    return F.element_at(F.array(*[F.lit(v).cast("long") for v in listed]), partition + 1)


def ranked(df: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """``df`` with each row's place, from 0, in the order of all rows.

    Rows are dealt out by range and numbered in their partition; only the number
    of rows of each partition goes through the driver.
    """
    dealt = df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    window = Window.partitionBy("_part").orderBy(*order)
    placed = stored(dealt.withColumn("_place", F.row_number().over(window)), "ranked")
    sizes = {r["_part"]: r["n"] for r in placed.groupBy("_part").agg(F.count("*").alias("n")).collect()}
    before, total = {}, 0
    for part in sorted(sizes):
        before[part] = total
        total += sizes[part]
    rank = by_partition(F.col("_part"), before) + F.col("_place") - 1
    return placed.withColumn(name, rank).drop("_part", "_place")


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count("*").alias("n"),
        F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h"),
    ).first()
    return row["n"], row["h"]


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b): the smallest node reachable.

    Large-star and small-star rounds until the edges are stars. A round is a
    grouped minimum, reduced before the shuffle, and a join of the minima back,
    which adaptive execution splits at a node with many neighbours. The minima, one
    for each node, have no bound that would allow a broadcast. Each round is written
    to the shared folder, so a lost executor repeats one round at most.
    """
    edges = stored(
        edges.filter("a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        "edges",
    )
    state = _state(edges)
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        least = least.select(F.col("a").alias("u"), F.least("a", "m").alias("m")).hint("merge")
        large = both.join(least, both["a"] == least["u"]).filter("b > a")
        large = large.select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        least = least.select(F.col("a").alias("u"), "m").hint("merge")
        joined = large.join(least, large["a"] == least["u"])
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            joined.select("a", F.col("m").alias("b"))
        )
        edges = stored(small.filter("a <> b").distinct(), "edges")
        before, state = state, _state(edges)
        if state == before:
            nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
            roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component"))
            return nodes.unionByName(roots.distinct())
    raise RuntimeError("components did not settle")

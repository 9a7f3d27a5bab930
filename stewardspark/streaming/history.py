"""The ids of all records that have landed, in files by a hash of the id.

Whether a record has landed before is looked up in the files its id can be in. Their
number follows the number of ids, so a file keeps its size and what a batch of
records reads follows the records in it, not all that ever landed.

A generation is a folder ``generation-<number>-<buckets>`` below ``<landing>/_history``.
New ids are added to the last one; when it has too many for its buckets, or too many
small files, a new one is made of all. A generation counts once its mark is there,
so a job that is cut off leaves the one before. Ids that are added twice do no harm.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stewardspark.sources import folders

SEEN_SCHEMA = "id string, reasons string, ingest_stream string, ingest_batch bigint"
DONE_SCHEMA = "ingest_stream string, ingest_batch bigint, n bigint"
ROWS_PER_BUCKET = 250_000
MOST_ADDITIONS = 50
_COMPLETE, _DONE = "_COMPLETE", "_done"


def bucket_of(record_id: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(record_id), F.lit(buckets)).cast("int")


class IdHistory:
    """The ids below one landing folder. One stream at a time adds to it."""

    def __init__(self, spark: SparkSession, landing: str, rows_per_bucket: int = ROWS_PER_BUCKET):
        self.spark, self.landing, self.rows_per_bucket = spark, landing, rows_per_bucket
        self.root = f"{landing}/_history"

    def _generation(self) -> tuple[int, int, str] | None:
        """Number, buckets and path of the last complete generation."""
        found = []
        for name in folders.names(self.spark, self.root):
            number, buckets = map(int, name.split("-")[1:])
            found.append((number, buckets, f"{self.root}/{name}"))
        for generation in sorted(found, reverse=True):
            if folders.exists(self.spark, f"{generation[2]}/{_COMPLETE}"):
                return generation
        return None

    def _landed(self) -> set[tuple[str, int]]:
        """The micro-batches that have a folder: names only, no file is opened."""
        return {
            (stream.partition("=")[2], int(batch.partition("=")[2]))
            for stream in folders.names(self.spark, self.landing)
            if stream.startswith("ingest_stream=")
            for batch in folders.names(self.spark, f"{self.landing}/{stream}")
            if batch.startswith("ingest_batch=")
        }

    def _write(self, rows: DataFrame, path: str, buckets: int, done: DataFrame) -> None:
        rows = rows.select("*", bucket_of(F.col("id"), buckets).alias("bucket"))
        rows = rows.repartition("bucket").sortWithinPartitions("bucket", "id")
        rows.write.mode("append").partitionBy("bucket").parquet(path)
        done.coalesce(1).write.mode("append").parquet(f"{path}/{_DONE}")

    def update(self) -> int:
        """Add what has landed since the last time; the number of micro-batches added."""
        spark, last = self.spark, self._generation()
        known, additions = [], 0
        if last:
            done = spark.read.schema(DONE_SCHEMA).parquet(f"{last[2]}/{_DONE}")
            known = done.collect()
            additions = len(done.inputFiles())
        new = sorted(self._landed() - {(row.ingest_stream, row.ingest_batch) for row in known})
        if not new:
            return 0
        paths = [f"{self.landing}/ingest_stream={s}/ingest_batch={b}" for s, b in new]
        reader = spark.read.schema(SEEN_SCHEMA).option("basePath", self.landing)
        rows = reader.parquet(*paths).select("id", "reasons", "ingest_stream", "ingest_batch")
        counts = rows.groupBy("ingest_stream", "ingest_batch").agg(F.count("*").alias("n"))
        counts = {(r.ingest_stream, r.ingest_batch): r.n for r in counts.collect()}
        done = [(*batch, counts.get(batch, 0)) for batch in new]
        total = sum(row.n for row in known) + sum(counts.values())
        if last and additions < MOST_ADDITIONS and total <= 2 * last[1] * self.rows_per_bucket:
            self._write(rows, last[2], last[1], spark.createDataFrame(done, DONE_SCHEMA))
            return len(new)
        buckets = 1
        while buckets * self.rows_per_bucket < total:
            buckets *= 2
        number = last[0] + 1 if last else 0
        path = f"{self.root}/generation-{number}-{buckets}"
        if folders.exists(spark, path):  # left by a job that was cut off
            folders.remove(spark, path)
        if last:
            old = spark.read.schema(SEEN_SCHEMA).parquet(last[2]).select(*rows.columns)
            rows = rows.unionByName(old.distinct())
            done += [tuple(row) for row in known]
        self._write(rows, path, buckets, spark.createDataFrame(done, DONE_SCHEMA))
        folders.mark(spark, f"{path}/{_COMPLETE}")
        for name in folders.names(spark, self.root):
            if int(name.split("-")[1]) < number - 1:  # readers may still hold the one before
                folders.remove(spark, f"{self.root}/{name}")
        return len(new)

    def near(self, records: DataFrame) -> DataFrame:
        """What has landed in the files that the ids of ``records`` can be in."""
        spark, last = self.spark, self._generation()
        if not last:
            return spark.createDataFrame([], SEEN_SCHEMA)
        _, buckets, path = last
        wanted = records.select(bucket_of(F.col("id"), buckets).alias("b")).distinct().collect()
        present = set(folders.names(spark, path))
        paths = [f"{path}/{name}" for name in sorted(f"bucket={row.b}" for row in wanted) if name in present]
        if not paths:
            return spark.createDataFrame([], SEEN_SCHEMA)
        return spark.read.schema(SEEN_SCHEMA).parquet(*paths)

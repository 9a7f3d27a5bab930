"""Ingest of violation records, in batch and as a stream, under one rule.

A record needs six fields and may carry four more, all read as text. It is
accepted when the required fields are there, its line number is a whole number,
and its team and sprint exist. Severity and category are stored as they come. Accepted
and rejected records are both kept; rejected ones say why.

A record may carry a ``request_id``. Its id is then the SHA-256 of that, so a
record delivered twice is stored once. The whole digest is kept: a shorter one
would give different records the same id at some billions of rows. Without a
``request_id`` every delivery is a violation of its own.
"""

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from stewardspark.operators.quality import with_faults
from stewardspark.schemas import TABLES
from stewardspark.sources.parquet_tables import apply_defaults
from stewardspark.streaming.history import IdHistory

REQUIRED = ["team_id", "sprint_id", "policy_id", "policy_name", "category", "severity"]
OPTIONAL = ["description", "file_path", "line_number", "tool"]
FEED_SCHEMA = "request_id string, " + ", ".join(f"{c} string" for c in REQUIRED + OPTIONAL)

ACCEPTED, REJECTED = "accepted", "rejected"
_VIOLATIONS = TABLES["policy_violations"]
LANDING_SCHEMA = (
    ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in _VIOLATIONS.schema)
    + ", reasons string, status string, ingest_stream string, ingest_batch bigint"
)


# State beyond an executor's memory goes to its disk, and a checkpoint uploads
# changes instead of whole snapshots.
STATE_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming"
    ".state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def stream_session(spark: SparkSession, state_partitions: int | None = None) -> SparkSession:
    """A session to read and start the stream in.

    A stream keeps the number of state partitions it was first started with. It
    comes from a session of its own, so that it does not follow a setting made
    for batch queries: one partition per core unless stated.
    """
    session = spark.newSession()
    partitions = state_partitions or spark.sparkContext.defaultParallelism
    session.conf.set("spark.sql.shuffle.partitions", str(partitions))
    for name, value in STATE_SETTINGS.items():
        session.conf.set(name, value)
    return session


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """Records from JSON lines. An unreadable line becomes a record without fields."""
    return spark.read.schema(FEED_SCHEMA).json(path)


def stream_feed(spark: SparkSession, path: str, batch_bytes: int | None = None) -> DataFrame:
    """Records from JSON files as they arrive below ``path``.

    ``batch_bytes`` splits a long backlog into micro-batches of about that size.
    """
    reader = spark.readStream.schema(FEED_SCHEMA)
    if batch_bytes:
        reader = reader.option("maxBytesPerTrigger", batch_bytes)
    return reader.json(path)


def with_id(records: DataFrame) -> DataFrame:
    """Records with their id.

    Call it on records as they were read, before any shuffle: a task that is run
    again then gives the same rows the same ids.
    """
    stated = F.when(F.col("request_id").isNotNull(), F.sha2(F.col("request_id"), 256))
    return records.withColumn("id", stated.otherwise(F.expr("uuid()")))


def judge(records: DataFrame, teams: DataFrame, sprints: DataFrame) -> DataFrame:
    """Records with their id in the form of the violations table, with ``status`` and ``reasons``."""
    line = F.regexp_replace("line_number", r"\.0+$", "").try_cast("int")
    bad_line = F.when(F.col("line_number").isNotNull() & line.isNull(), "bad line_number")
    checked = with_faults(
        records, teams, sprints, REQUIRED, _VIOLATIONS.references, bad_line
    )
    status = F.when(F.col("faults") == "", ACCEPTED).otherwise(REJECTED)
    typed = checked.withColumns({"line_number": line, "reasons": F.col("faults")})
    return apply_defaults(typed, _VIOLATIONS, "reasons", status.alias("status"))


def one_per_id(judged: DataFrame) -> DataFrame:
    """One row per id: an accepted one before rejected ones, then the least by content.

    The choice does not depend on the order of rows. Spark drops all but the first
    of an id in each task before the shuffle, so a record that is delivered very
    often does not gather in one task.
    """
    rest = [column for column in judged.columns if column not in ("id", "status")]
    order = Window.partitionBy("id").orderBy("status", *rest)
    first = judged.withColumn("_copy", F.row_number().over(order)).filter(F.col("_copy") == 1)
    return first.drop("_copy")


def _unseen(judged: DataFrame, seen: DataFrame) -> DataFrame:
    """``judged`` without rows that ``seen`` has under the same id and reasons."""
    return judged.join(seen.select("id", "reasons"), ["id", "reasons"], "left_anti").select(
        *judged.columns
    )


def ingest_batch(
    records: DataFrame, teams: DataFrame, sprints: DataFrame, stored: DataFrame | None = None
) -> DataFrame:
    """Judge a batch; leave out repeats within it and accepted records already ``stored``.

    Of the copies of a record an accepted one counts, so a corrected delivery beats
    a faulty one. Ids are looked for in all of ``stored``: a repeat may name another
    sprint than its first delivery. Only the ids are read.
    """
    judged = one_per_id(judge(with_id(records), teams, sprints))
    if stored is None:
        return judged
    return _unseen(judged, stored.select("id", F.lit("").alias("reasons")))


def start_ingest_stream(
    feed: DataFrame,
    teams: DataFrame,
    sprints: DataFrame,
    landing: str,
    checkpoint: str,
    files_per_batch: int | None = None,
    horizon: str = "7 days",
    history_every: int = 100,
) -> StreamingQuery:
    """Judge a stream of records and write them below ``landing``.

    An accepted record is left out if an accepted one with its id has landed, at any
    time and under any checkpoint; a rejected one if it was rejected for the same
    reasons. A record that was rejected and comes again corrected is accepted. Copies
    that arrive within ``horizon`` of the first are found in the state store, keyed by
    id and reasons, from which a key goes once the horizon has passed. Older ones are
    found in the history of ids, of which a micro-batch reads only the files that its
    ids can be in. The history takes up what has landed when the stream starts and after
    every ``history_every`` micro-batches; these must pass within the horizon.

    A micro-batch is reduced to one row per id as a batch is, so that adaptive execution
    can split a sprint that holds most of the feed. Of copies with one outcome but
    unlike content that come in one micro-batch, any one counts.

    Each micro-batch replaces a folder of its own, so a batch that is run again
    after a failure leaves no duplicates. The folder also bears the id of the
    stream, which its checkpoint keeps: a stream that starts over with another
    checkpoint never replaces what is there. ``files_per_batch`` gathers small
    batches into that many files per status instead of one per shuffle partition.
    """
    history = IdHistory(feed.sparkSession, landing)
    history.update()
    since = 0

    def store(batch: DataFrame, number: int) -> None:
        nonlocal since
        session = batch.sparkSession
        stream = session.sparkContext.getLocalProperty("sql.streaming.queryId")
        if since >= history_every:
            history.update()
            since = 0
        since += 1
        # Kept, so that its files are found and its rows written from one run of the state.
        judged = one_per_id(batch).persist()
        try:
            other = (F.col("ingest_stream") != stream) | (F.col("ingest_batch") != number)
            fresh = _unseen(judged, history.near(judged).filter(other))
            if files_per_batch:
                fresh = fresh.repartition(files_per_batch)
            folder = f"{landing}/ingest_stream={stream}/ingest_batch={number}"
            static = fresh.write.mode("overwrite").option("partitionOverwriteMode", "static")
            static.partitionBy("status").parquet(folder)
        finally:
            judged.unpersist()

    judged = judge(with_id(feed), teams, sprints).withColumn("_arrived", F.current_timestamp())
    first = judged.withWatermark("_arrived", horizon).dropDuplicatesWithinWatermark(["id", "reasons"])
    return (
        first.drop("_arrived").writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_landing(spark: SparkSession, landing: str) -> DataFrame:
    """All records stored by the stream, with their status; none before it had any input."""
    try:
        return spark.read.schema(LANDING_SCHEMA).parquet(landing)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LANDING_SCHEMA)


def accepted(judged: DataFrame) -> DataFrame:
    """The rows to store as violations."""
    return judged.filter(F.col("status") == ACCEPTED).select(*_VIOLATIONS.columns)


def with_landed(stored: DataFrame, landed: DataFrame) -> DataFrame:
    """Stored violations together with the accepted ones the stream has landed, once each."""
    fresh = accepted(landed).join(stored.select("id"), "id", "left_anti")
    return stored.unionByName(fresh.select(*_VIOLATIONS.columns))

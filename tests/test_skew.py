"""A third of all rows under one key: results stay whole and work stays spread."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from stewardspark.operators import aggregates, kpis, quality, reads, selection, summaries
from stewardspark.sources import parquet_tables as pt
from stewardspark.streaming import ingest

ROWS = 60_000


@pytest.fixture(scope="module")
def hot(spark):
    """Violations and alerts of which a third share team, sprint and time stamp."""
    hot_row = F.col("n") % 3 == 0
    number = (1 + F.col("n") % 40).cast("string")
    rows = spark.range(ROWS).withColumnRenamed("id", "n").repartition(8)
    keyed = rows.select(
        F.format_string("%08d", "n").alias("id"),
        F.when(hot_row, "t1").otherwise(F.concat(F.lit("t"), number)).alias("team_id"),
        F.when(hot_row, "s1").otherwise(F.concat(F.lit("s"), number)).alias("sprint_id"),
        F.when(hot_row, F.lit("2025-10-01").cast("timestamp_ntz"))
        .otherwise(F.timestamp_seconds("n").cast("timestamp_ntz"))
        .alias("at"),
    )
    violations = keyed.selectExpr(
        "id", "team_id", "sprint_id", "'P' AS policy_id", "'security' AS category",
        "'high' AS severity", "sha2(id, 512) AS description", "at AS detected_at",
    )
    alerts = keyed.selectExpr(
        "id", "team_id", "sprint_id", "'quality_gate' AS alert_type", "'high' AS severity",
        "'x' AS title", "'m' AS message", "0 AS acknowledged", "at AS created_at",
    )
    dims = spark.range(1, 41).select(F.col("id").cast("string").alias("n"))
    return {
        "violations": pt.apply_defaults(violations, pt.TABLES["policy_violations"]),
        "alerts": pt.apply_defaults(alerts, pt.TABLES["alerts"]),
        "teams": dims.selectExpr(
            "concat('t', n) AS id", "concat('Team ', n) AS name", "3 AS size",
        ),
        "sprints": dims.selectExpr(
            "concat('s', n) AS id", "concat('Sprint ', n) AS name", "CAST(n AS INT) AS number",
        ),
    }


HOT_COUNT = ROWS // 3 + sum(1 for n in range(ROWS) if n % 3 and n % 40 == 0)


def test_counts_stay_whole(hot):
    trend = summaries.violation_trend(hot["violations"], hot["teams"], hot["sprints"])
    assert trend.agg(F.sum("violations")).first()[0] == ROWS
    first = trend.filter("number = 1 AND team = 'Team 1'").first()
    assert first.violations == HOT_COUNT
    severe = aggregates.violations_by_severity(hot["violations"], "s1").collect()
    assert severe == [("high", HOT_COUNT)]


def test_a_sort_splits_rows_of_one_time_stamp(spark, hot):
    read = reads.violations_recent(hot["violations"], hot["teams"], limit=3)
    assert [r.id for r in read.collect()] == ["00000000", "00000003", "00000006"]
    whole = reads.alerts_filtered(hot["alerts"], hot["teams"])
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(coalesce, "false")
    try:
        sizes = [
            r.n
            for r in whole.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()
        ]
    finally:
        spark.conf.unset(coalesce)
    assert sum(sizes) == ROWS
    assert max(sizes) < ROWS // 4


def test_top_alerts_of_the_hot_sprint(hot):
    top = selection.active_alerts(hot["alerts"], hot["teams"])
    assert top.count() == 40 * selection.SHOWN_ALERTS
    assert [r.id for r in top.filter("sprint_id = 's1'").orderBy("id").collect()][:2] == [
        "00000000", "00000003",
    ]


def test_a_large_sprint_is_written_by_several_tasks(spark, hot, tmp_path):
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    spark.conf.set(size, "512KB")
    try:
        pt.write_table(hot["violations"], str(tmp_path), "policy_violations")
    finally:
        spark.conf.unset(size)

    def files(sprint):
        return list(Path(tmp_path, "policy_violations", f"sprint_id={sprint}").glob("*.parquet"))

    assert len(files("s1")) > 2
    assert len(files("s2")) < len(files("s1"))
    assert pt.read_table(spark, str(tmp_path), "policy_violations").count() == ROWS


def test_team_scope_keeps_every_row(hot):
    assert kpis.team_scope(hot["violations"], hot["teams"], "Team 1").count() == HOT_COUNT


def test_one_request_delivered_very_often_is_stored_once(spark, hot):
    records = spark.range(ROWS).select(
        F.when(F.col("id") % 3 == 0, "again").otherwise(F.col("id").cast("string")).alias(
            "request_id"
        ),
        F.lit("t1").alias("team_id"),
        F.lit("s1").alias("sprint_id"),
        *[F.lit("x").alias(c) for c in ("policy_id", "policy_name", "category", "severity")],
        *[F.lit(None).cast("string").alias(c) for c in ingest.OPTIONAL],
    )
    judged = ingest.ingest_batch(records, hot["teams"], hot["sprints"])
    counts = {r.status: r["count"] for r in judged.groupBy("status").count().collect()}
    assert counts == {"accepted": ROWS - ROWS // 3 + 1}
    again = ingest.ingest_batch(records, hot["teams"], hot["sprints"], ingest.accepted(judged))
    assert again.count() == 0


def test_a_very_frequent_id_is_one_duplicate(hot):
    often = hot["violations"].withColumn(
        "id", F.when(F.col("team_id") == "t1", "same").otherwise(F.col("id"))
    )
    found = quality.pk_duplicates({"policy_violations": often}).collect()
    assert found == [("policy_violations", "same", HOT_COUNT)]
    orphans = quality.fk_orphans(
        {"policy_violations": hot["violations"]},
        hot["teams"].filter("id <> 't1'"),
        hot["sprints"],
    ).collect()
    assert orphans == [("policy_violations", "team_id", "t1", HOT_COUNT)]

"""Alerts over streams of facts against the batch form over the same rows."""

import random

import pytest
from pyspark.sql import functions as F

from stewardspark.operators.alerting import threshold_alerts
from stewardspark.plans import registry
from stewardspark.streaming import alerts, ingest
from stewardspark.tables import Tables

TABLES_READ = sorted({table for table, *_ in alerts.READINGS.values()})


def facts_of(make, rnd, number):
    def rows(name, n, **columns):
        listed = [
            {"id": f"{name}{number}-{i}", "team_id": rnd.choice(["t1", "t2", "t3", "ghost"]),
             "sprint_id": rnd.choice(["s1", "s2", "s99"]), **{c: v() for c, v in columns.items()}}
            for i in range(n)
        ]
        return make(name, *listed)

    return {
        "token_usage": rows("token_usage", 12, total_tokens=lambda: rnd.randint(0, 900_000)),
        "compliance_scores": rows(
            "compliance_scores", 30, score=lambda: rnd.choice([None, 40.0, 59.0, 61.0, 90.0]),
            category=lambda: rnd.choice(["security", "testing"]),
        ),
        "code_quality_metrics": rows(
            "code_quality_metrics", 9, sonarqube_score=lambda: rnd.choice([70.0, 79.5, 80.0, 95.0])
        ),
        "security_incidents": rows(
            "security_incidents", 4, incident_type=lambda: rnd.choice(["pii_exposure", "weak_crypto"])
        ),
        "adoption_metrics": rows(
            "adoption_metrics", 6, adoption_rate_pct=lambda: rnd.choice([50.0, 74.0, 80.0])
        ),
    }


def run(spark, small, folder):
    session = ingest.stream_session(spark, state_partitions=2)
    streams = {
        name: session.readStream.schema(small[name].schema).option("maxFilesPerTrigger", 1)
        .parquet(f"{folder}/{name}")
        for name in TABLES_READ
    }
    query = alerts.start_alert_stream(
        streams, small["teams"], small["sprints"], f"{folder}/log", f"{folder}/checkpoint"
    )
    query.awaitTermination()


def content(df):
    return sorted(map(tuple, df.select(*alerts.ALERT_COLUMNS).collect()))


def batch(spark, small, folder):
    stored = {n: spark.read.schema(small[n].schema).parquet(f"{folder}/{n}") for n in TABLES_READ}
    return content(threshold_alerts(Tables.of(**{**dict(small.items()), **stored})))


@pytest.mark.parametrize("seed", [1, 2])
def test_the_stream_gives_the_alerts_of_the_batch(spark, make, small, folder, seed):
    rnd = random.Random(seed)
    assert alerts.current_alerts(spark, f"{folder}/log").count() == 0
    for number in range(3):
        for name, df in facts_of(make, rnd, number).items():
            df.repartition(2).write.mode("append").parquet(f"{folder}/{name}")
        run(spark, small, folder)
        now = alerts.current_alerts(spark, f"{folder}/log")
        assert content(now) == batch(spark, small, folder)
        assert now.count() == now.select("id").distinct().count() > 0


def test_a_batch_run_again_adds_nothing(spark, make, small, folder, tmp_path):
    for name, df in facts_of(make, random.Random(3), 0).items():
        df.coalesce(1).write.parquet(f"{folder}/{name}")
    run(spark, small, folder)
    once = alerts.read_alert_log(spark, f"{folder}/log").count()
    commits = sorted((tmp_path / "checkpoint" / "commits").glob("*"))
    for path in commits:
        path.rename(tmp_path / f"done{path.name}")
    run(spark, small, folder)
    assert alerts.read_alert_log(spark, f"{folder}/log").count() == once
    run(spark, small, folder)
    assert content(alerts.current_alerts(spark, f"{folder}/log")) == batch(spark, small, folder)


def test_an_alert_goes_when_it_is_no_longer_due_and_keeps_when_it_was_raised(spark, make, small, folder):
    for name in TABLES_READ:
        small[name].limit(0).write.parquet(f"{folder}/{name}")

    def reading(number, score):
        row = {"id": f"q{number}", "team_id": "t1", "sprint_id": "s1", "sonarqube_score": score}
        make("code_quality_metrics", row).write.mode("append").parquet(f"{folder}/code_quality_metrics")
        run(spark, small, folder)
        return [tuple(r) for r in alerts.current_alerts(spark, f"{folder}/log").select("id", "raised_at").collect()]

    (first,) = reading(1, 70.0)
    assert first[0] == "quality_gate:t1:s1"
    assert reading(2, 100.0) == []
    assert reading(3, 0.0) == [first]


def test_stream_files_grow_with_the_facts(spark, folder):
    rows = spark.range(0, 60_000, 1, 8).selectExpr("CAST(id AS STRING) AS id", "uuid() AS team_id")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        stream = registry._as_stream(ingest.stream_session(spark), rows, f"{folder}/facts")
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    files = spark.read.parquet(f"{folder}/facts").groupBy(F.input_file_name()).count().collect()
    assert len(files) > 8 and max(f["count"] for f in files) < 60_000 // 8
    batches = []
    stream.writeStream.foreachBatch(lambda batch, number: batches.append(batch.count())).option(
        "checkpointLocation", f"{folder}/checkpoint"
    ).trigger(availableNow=True).start().awaitTermination()
    assert stream.columns == ["team_id"] and len(batches) == 2 and sum(batches) == 60_000

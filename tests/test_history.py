"""Copies in the stream: found in the state, in the history, and at what cost."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from stewardspark.streaming import history, ingest
from stewardspark.streaming.history import IdHistory
from tests.test_ingest import GOOD, write_feed


def start(spark, small, folder, checkpoint="checkpoint", **options):
    session = ingest.stream_session(spark, state_partitions=2)
    feed = ingest.stream_feed(session, f"{folder}/feed", options.pop("batch_bytes", None))
    ingest.start_ingest_stream(
        feed, small["teams"], small["sprints"], f"{folder}/landing", f"{folder}/{checkpoint}", **options
    ).awaitTermination()
    return ingest.read_landing(spark, f"{folder}/landing")


def records(numbers, **changed):
    return [{"request_id": f"r{i}", **GOOD, **changed} for i in numbers]


def test_copies_within_the_horizon_come_from_the_state(spark, small, tmp_path, monkeypatch):
    monkeypatch.setattr(IdHistory, "near", lambda self, df: spark.createDataFrame([], history.SEEN_SCHEMA))
    write_feed(tmp_path / "feed" / "1.json", records(range(10)))
    assert start(spark, small, tmp_path).count() == 10
    write_feed(tmp_path / "feed" / "2.json", records(range(5, 15)))
    assert start(spark, small, tmp_path).count() == 15
    # Without the state these would have landed again.
    assert start(spark, small, tmp_path, checkpoint="other").count() == 30


def test_copies_beyond_the_horizon_come_from_the_history(spark, small, tmp_path):
    faulty = records(range(20, 22), team_id="ghost")
    for number, some in enumerate([records(range(10)) + faulty, records(range(20, 25)), records(range(30))]):
        write_feed(tmp_path / "feed" / f"{number}.json", some)
        landed = start(spark, small, tmp_path, horizon="0 seconds", history_every=1)
    assert landed.filter("status = 'accepted'").count() == 30
    assert landed.filter("status = 'rejected'").count() == 2
    assert landed.filter("status = 'accepted'").select("id").distinct().count() == 30
    # Everything once more, under a new checkpoint and in several micro-batches.
    size = (tmp_path / "feed" / "1.json").stat().st_size
    again = start(spark, small, tmp_path, checkpoint="other", batch_bytes=size)
    assert again.filter("status = 'accepted'").count() == 30


def landed_batch(spark, landing, stream, number, ids):
    rows = spark.createDataFrame([(i, "") for i in ids], "id string, reasons string")
    rows = rows.withColumn("status", F.lit("accepted"))
    rows.write.partitionBy("status").parquet(f"{landing}/ingest_stream={stream}/ingest_batch={number}")


def bytes_read(df):
    return sum(Path(f.removeprefix("file://")).stat().st_size for f in df.inputFiles())


def test_what_a_batch_reads_does_not_grow_with_history(spark, tmp_path):
    landing = str(tmp_path)
    asked = spark.createDataFrame([(f"a-{i}",) for i in range(3)], "id string")
    sizes, whole = [], []
    for step, many in enumerate((400, 1600, 6400)):
        landed_batch(spark, landing, "a", step, [f"{'abc'[step]}-{i}" for i in range(many)])
        ids = IdHistory(spark, landing, rows_per_bucket=100)
        assert ids.update() == 1
        near = ids.near(asked)
        sizes.append(bytes_read(near))
        whole.append(bytes_read(spark.read.parquet(ids._generation()[2])))
        assert near.join(asked, "id").count() == 3
    assert whole[2] > 8 * whole[0]
    assert max(sizes) < 2 * min(sizes)
    assert IdHistory(spark, landing).update() == 0


@pytest.mark.parametrize("cut", ["_write", "mark"])
def test_a_cut_off_rebuild_leaves_the_generation_before(spark, tmp_path, monkeypatch, cut):
    landing = str(tmp_path)
    landed_batch(spark, landing, "a", 0, [f"x-{i}" for i in range(50)])
    IdHistory(spark, landing, 100).update()
    landed_batch(spark, landing, "a", 1, [f"y-{i}" for i in range(500)])

    def stop(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(IdHistory if cut == "_write" else history.folders, cut, stop)
        with pytest.raises(RuntimeError):
            IdHistory(spark, landing, 100).update()
    ids = IdHistory(spark, landing, 100)
    everything = spark.createDataFrame([(f"x-{i}",) for i in range(50)], "id string")
    assert ids.near(everything).count() == 50
    assert ids.update() == 1
    assert ids._generation()[:2] == (1, 8)
    assert spark.read.parquet(ids._generation()[2]).count() == 550


def test_many_small_additions_are_put_together(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(history, "MOST_ADDITIONS", 2)
    landing = str(tmp_path)
    ids = IdHistory(spark, landing)
    for number in range(5):
        landed_batch(spark, landing, "a", number, [f"{number}-{i}" for i in range(3)])
        ids.update()
    assert ids._generation()[0] == 2
    assert len([p for p in Path(ids.root).iterdir()]) == 2
    assert ids.near(spark.createDataFrame([("0-1",)], "id string")).count() == 15

"""Stored sums against the figures worked out from all facts."""

import random

import pytest
from pyspark.sql import functions as F

from stewardspark.operators import kpis, rollups
from stewardspark.tables import Tables

COLUMNS = {"compliance_scores": "score", "token_usage": "cost_usd", "adoption_metrics": "adoption_rate_pct"}
FACTS = [table for table, _ in rollups.FIGURES.values()]


def some(make, rnd, key):
    out = {}
    for table in rnd.sample(FACTS, rnd.randint(1, 5)):
        rows = [
            {"id": f"{key}-{i}", "team_id": rnd.choice(["t1", "t2", None]), "sprint_id": rnd.choice(["s1", "s2", "s3"]),
             **({COLUMNS[table]: rnd.choice([None, 0.1, 33.3, 1234.567891])} if table in COLUMNS else {})}
            for i in range(rnd.randint(0, 12))
        ]
        out[table] = make(table, *rows)
    return out


def rounded(df):
    return sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in row) for row in df.collect())


@pytest.mark.parametrize("team", [None, "Alpha"])
def test_sums_equal_the_figures_of_all_facts(spark, make, small, folder, team):
    rnd = random.Random(20)
    everything = {name: small[name].limit(0) for name in FACTS}

    def check():
        sums = rollups.read_sums(spark, folder)
        got = rollups.kpi_deltas(sums, small["teams"], small["sprints"], team)
        tables = Tables.of(**{**dict(small.items()), **everything})
        expected = kpis.kpi_deltas(tables, team)
        assert got.columns == expected.columns
        assert rounded(got) == rounded(expected)

    check()
    sent = {}
    for number in range(4):
        key = f"b{number}"
        sent[key] = some(make, rnd, key)
        assert rollups.add_batch(spark, folder, key, sent[key])
        for name, df in sent[key].items():
            everything[name] = everything[name].unionByName(df)
        if number == 2:
            assert rollups.fold(spark, folder) == 3
    # Sent again, folded in already or not.
    assert not rollups.add_batch(spark, folder, "b0", sent["b0"])
    assert rollups.add_batch(spark, folder, "b3", sent["b3"])
    check()
    # Every reading of the third batch was wrong by 5.
    old = {t: df for t, df in sent["b2"].items() if t in COLUMNS}
    new = {t: df.withColumn(COLUMNS[t], F.col(COLUMNS[t]) + 5) for t, df in old.items()}
    rollups.add_batch(spark, folder, "correction", new, old)
    for name in old:
        kept = everything[name].filter(~F.col("id").startswith("b2-"))
        everything[name] = kept.unionByName(new[name])
    check()
    assert rollups.fold(spark, folder) == 2
    check()
    assert rollups.fold(spark, folder) == 0


def test_a_fold_that_is_cut_off_changes_nothing(spark, make, small, folder, monkeypatch):
    rollups.add_batch(spark, folder, "one", {"policy_violations": small["policy_violations"]})
    before = rounded(rollups.read_sums(spark, folder))

    def stop(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(rollups.folders, "mark", stop)
        with pytest.raises(RuntimeError):
            rollups.fold(spark, folder)
    assert rounded(rollups.read_sums(spark, folder)) == before
    assert rollups.fold(spark, folder) == 1
    assert rounded(rollups.read_sums(spark, folder)) == before


def test_keys_are_folder_names(spark, folder):
    with pytest.raises(ValueError):
        rollups.add_batch(spark, folder, "../x", {})

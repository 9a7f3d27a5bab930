import time
from datetime import datetime, timezone
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from stewardspark.operators import quality
from stewardspark.plans import registry
from stewardspark.schemas import TABLES
from stewardspark.session import CLEANUP, new_folder, shared_folder
from stewardspark.sources import folders
from stewardspark.sources import parquet_tables as pt
from stewardspark.sources import testdata
from stewardspark.tables import Tables
from tests.conftest import SMALL


def utc_now():
    return datetime.now(timezone.utc).replace(tzinfo=None)


def test_write_and_read_back(spark, small, folder):
    pt.full_refresh(small, folder)
    stored = pt.load_tables(spark, folder)
    assert list(stored) == list(TABLES)
    for name in TABLES:
        assert stored[name].columns == TABLES[name].columns
        assert [f.dataType for f in stored[name].schema] == [
            f.dataType for f in TABLES[name].schema
        ]
        assert sorted(map(str, stored[name].collect())) == sorted(
            map(str, small[name].collect())
        )
    pt.full_refresh(small, folder)
    assert pt.load_tables(spark, folder)["alerts"].count() == 16
    pt.write_table(small["alerts"].limit(2), folder, "alerts")
    assert pt.read_table(spark, folder, "alerts").count() == 18


def test_sprint_filters_prune_partitions(spark, small, folder):
    pt.write_table(small["policy_violations"], folder, "policy_violations")
    stored = pt.read_table(spark, folder, "policy_violations")
    plan = stored.filter(F.col("sprint_id") == "s1")._jdf.queryExecution().executedPlan()
    assert "PartitionFilters: [isnotnull(sprint_id" in plan.toString()


def test_defaults_fill_absent_columns_only(spark, small):
    spec = TABLES["policy_violations"]
    given = small["policy_violations"].drop("resolved", "detected_at", "resolved_at")
    before = utc_now()
    row = pt.apply_defaults(given, spec).first()
    assert (row.resolved, row.resolved_at) == (0, None)
    assert abs((row.detected_at - before).total_seconds()) < 600
    explicit = given.withColumn("resolved", F.lit(None).cast("int"))
    assert pt.apply_defaults(explicit, spec).first().resolved is None


@pytest.mark.parametrize("zone", ["UTC", "Asia/Tokyo"])
def test_now_is_utc_in_every_session_zone(spark, small, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        row = pt.apply_defaults(small["teams"].drop("created_at"), TABLES["teams"]).first()
        assert abs((row.created_at - utc_now()).total_seconds()) < 600
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_run_query_binds_values(small):
    by_place = pt.run_query(
        small,
        """SELECT id FROM policy_violations WHERE sprint_id = ? AND severity = ?
           ORDER BY detected_at DESC, id LIMIT ?""",
        ("s1", "high", 1),
    )
    assert [r.id for r in by_place.collect()] == ["v2"]
    by_name = pt.run_query(
        small, "SELECT count(*) AS n FROM alerts WHERE severity = :s", {"s": "high"}
    )
    assert by_name.first().n == 10
    hostile = pt.run_query(small, "SELECT id FROM teams WHERE name = ?", ("x' OR '1'='1",))
    assert hostile.count() == 0
    assert pt.run_query(small, "SELECT * FROM sprints ORDER BY number").count() == 5


def test_a_query_may_use_table_names_as_its_own(spark, small):
    def rows(sql, *params):
        df = pt.run_query(small, sql, params)
        return df.columns, [tuple(r) for r in df.collect()]

    assert rows("SELECT COUNT(*) AS alerts FROM alerts") == (["alerts"], [(16,)])
    assert rows("SELECT sprints.n FROM (SELECT count(*) AS n FROM alerts) sprints") == (["n"], [(16,)])
    assert rows("SELECT count(*) AS `teams` FROM `Teams` alerts;") == (["teams"], [(3,)])
    columns, found = rows(
        """-- high ones of WITH
        WITH alerts AS (SELECT * FROM alerts WHERE severity = ?), teams AS (SELECT 'alerts' AS name)
        SELECT count(*) AS n, max(teams.name) AS name FROM alerts, teams""",
        "high",
    )
    assert (columns, found) == (["n", "name"], [(10, "alerts")])
    with_order = "WITH t AS (SELECT * FROM teams) SELECT id FROM t ORDER BY id DESC LIMIT 2"
    assert rows(with_order)[1] == [("t3",), ("t2",)]
    assert rows("SELECT 1 AS one") == (["one"], [(1,)])
    assert not [t for t in spark.catalog.listTables() if t.name.startswith(("alerts_", "teams_"))]


def test_strings_come_through_the_rebalance_as_they_were(spark):
    """Marks, separators, NULLs, empty strings and bytes that are no UTF-8."""
    rows = spark.createDataFrame(
        [(1, "a", None, "x,y", "s"), (2, "", ",", "\u00e9\x01", None), (3, None, None, None, "s"),
         (4, "\x02n", "\x02\x01\x02x", "\x01\x01", "\x02")],
        "n int, a string, b string, c string, s string",
    )
    rows = rows.unionByName(
        spark.sql("SELECT 5 n, CAST(x'e2' AS STRING) a, CAST(x'82ac' AS STRING) b, '' c, 's' s")
    )

    def found(df):
        return sorted(map(str, df.select(*[F.hex(column) for column in df.columns]).collect()))

    for columns in (("s",), ()):
        out = pt.rebalanced(rows, columns)
        assert out.schema == rows.schema
        assert found(out) == found(rows)
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "concat_ws" in plan.split("RebalancePartitions")[1]


def test_orders_find_their_team_once_for_all_refreshes(spark, folder, monkeypatch):
    asked, source = [], testdata.source

    def counted(session, sf_dir, name):
        asked.append(name)
        return source(session, sf_dir, name)

    monkeypatch.setattr(testdata, "source", counted)
    tables = registry._stored_tables(spark, SMALL)
    stored = {name: tables[name] for name in TABLES}
    assert asked.count("customer") == asked.count("orders") == 1
    monkeypatch.undo()
    for name, df in testdata.derive_tables(spark, SMALL).items():
        assert stored[name].columns == df.columns
        assert sorted(map(str, stored[name].collect())) == sorted(map(str, df.collect()))


# Snapshots


def shuffle_files(spark):
    found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {found.apply(i).getName() for i in range(found.length()) if "shuffle_" in found.apply(i).getName()}


def test_a_refresh_leaves_no_shuffle_files(spark, small, folder):
    """Their room on disk is free before the next refresh, and the session's setting is as it was."""
    before, setting = shuffle_files(spark), spark.conf.get(CLEANUP, None)
    pt.full_refresh(Tables.of(**{name: small[name] for name in TABLES}), folder)
    for _ in range(50):
        left = shuffle_files(spark) - before
        if not left:
            break
        time.sleep(0.2)
    assert not left
    assert spark.conf.get(CLEANUP, None) == setting


def counts(spark, root):
    return {name: df.count() for name, df in pt.load_tables(spark, root).items()}


def test_a_snapshot_replaces_all_tables_at_once(spark, small, folder):
    pt.full_refresh(small, folder)
    before = pt.load_tables(spark, folder)["alerts"]
    only = Tables.of(**{name: df.limit(1) for name, df in small.items()})
    pt.snapshot_refresh(only, folder)
    assert set(counts(spark, folder).values()) == {1}
    assert before.count() == 16
    pt.write_table(small["alerts"].limit(2), folder, "alerts")
    assert pt.read_table(spark, folder, "alerts").count() == 3
    pt.snapshot_refresh(small, folder)
    assert counts(spark, folder) == {name: df.count() for name, df in small.items()}


@pytest.mark.parametrize("lost", ["teams", "sprints", "alerts", "token_usage"])
def test_a_refresh_cut_off_changes_no_table(spark, small, folder, monkeypatch, lost):
    first = pt.snapshot_refresh(small, folder)
    only = Tables.of(**{name: df.limit(1) for name, df in small.items()})
    write = pt.write_table

    def cut_off(df, root, name, mode="append"):
        if name == lost:
            raise RuntimeError("lost")
        write(df, root, name, mode)

    with monkeypatch.context() as patch:
        patch.setattr(pt, "write_table", cut_off)
        with pytest.raises(RuntimeError):
            pt.snapshot_refresh(only, folder)
    assert counts(spark, folder) == {name: df.count() for name, df in small.items()}
    last = pt.snapshot_refresh(only, folder)
    assert set(counts(spark, folder).values()) == {1}
    dropped = pt.drop_old_snapshots(spark, folder, keep=1)
    assert first in dropped and last not in dropped
    assert folders.names(spark, f"{folder}/_versions") == [last]
    assert set(counts(spark, folder).values()) == {1}
    assert pt.drop_old_snapshots(spark, folder, keep=1) == []


class NamedSession:
    """A session as far as its settings go."""

    def __init__(self, **settings):
        settings = {f"spark.{key.replace('_', '.')}": value for key, value in settings.items()}
        self.conf = SimpleNamespace(get=settings.get)


def test_shared_folder_is_the_one_the_cluster_names(spark):
    assert shared_folder(spark).startswith("/tmp/")
    cluster = NamedSession(master="yarn", checkpoint_dir="s3a://shared/work/")
    assert shared_folder(cluster) == "s3a://shared/work"
    assert new_folder(cluster, "x").startswith("s3a://shared/work/x-")
    local = NamedSession(master="local[2]", checkpoint_dir="/shared")
    assert shared_folder(local) == "/shared"
    for master in ("yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            shared_folder(NamedSession(master=master))


# Data quality


def bad_violations(make):
    good = {"team_id": "t1", "sprint_id": "s1", "policy_id": "P", "category": "security",
            "severity": "low"}
    return make(
        "policy_violations",
        {"id": "1", **good},
        {"id": "1", **good},
        {"id": "2", **good, "team_id": "ghost"},
        {"id": "3", **good, "severity": None},
        {"id": None, **good},
        {"id": None, **good, "sprint_id": None},
        {"id": "4", **good, "category": "cooking", "severity": "warning"},
    )


def test_planted_faults_are_found(make, small):
    frames = {"policy_violations": bad_violations(make)}
    assert quality.pk_duplicates(frames).collect() == [("policy_violations", "1", 2)]
    nulls = {r.column_name: r.null_count for r in quality.null_counts(frames).collect()}
    assert nulls == {"id": 2, "team_id": 0, "sprint_id": 1, "policy_id": 0, "category": 0,
                     "severity": 1}
    orphans = quality.fk_orphans(frames, small["teams"], small["sprints"]).collect()
    assert orphans == [("policy_violations", "team_id", "ghost", 1)]
    wrong = quality.domain_check(frames).collect()
    assert sorted((r.column_name, r.value) for r in wrong) == [
        ("category", "cooking"), ("severity", "warning"),
    ]
    assert quality.domain_check({"alerts": small["alerts"]}).count() == 0
    odd = quality.domain_check({"policy_violations": small["policy_violations"]}).collect()
    assert [(r.value, r.row_count) for r in odd] == [("odd", 1)]
    assert [r.id for r in quality.pii_type_rule(small["security_incidents"]).collect()] == ["i2"]


def test_refused_rows(make, small):
    refused = quality.refused_rows(
        bad_violations(make), "policy_violations", small["teams"], small["sprints"]
    )
    assert sorted(str((r.id, r.faults)) for r in refused.collect()) == sorted(
        map(
            str,
            [
                ("2", "unknown team_id"),
                ("3", "missing severity"),
                (None, "missing id"),
                (None, "missing id; missing sprint_id"),
            ],
        )
    )
    # Alerts may name no team, or an unknown one.
    alerts = quality.refused_rows(small["alerts"], "alerts", small["teams"], small["sprints"])
    assert alerts.count() == 0


def test_empty_tables_have_no_faults(make, small):
    frames = {name: small[name].limit(0) for name in TABLES}
    assert quality.pk_duplicates(frames).count() == 0
    assert all(r.null_count == 0 for r in quality.null_counts(frames).collect())


def test_derivation_sizes(spark):
    tables = testdata.derive_tables(spark, SMALL)
    lines = testdata.source(spark, SMALL, "lineitem")
    orders = testdata.source(spark, SMALL, "orders")
    assert tables["token_usage"].count() == lines.count()
    assert tables["compliance_scores"].count() == orders.count()
    assert tables["adoption_metrics"].count() == orders.count()


def test_overwrite_is_whole_under_a_dynamic_setting(spark, small, tmp_path):
    root, setting = str(tmp_path / "root"), "spark.sql.sources.partitionOverwriteMode"
    alerts = small["alerts"]
    pt.write_table(alerts, root, "alerts")
    spark.conf.set(setting, "dynamic")
    try:
        pt.write_table(alerts.filter("sprint_id = 's2'"), root, "alerts", mode="overwrite")
    finally:
        spark.conf.unset(setting)
    assert {r.sprint_id for r in pt.read_table(spark, root, "alerts").collect()} == {"s2"}


def test_an_empty_partition_value_is_refused(make, tmp_path):
    row = make("alerts", {"id": "a", "sprint_id": "", "severity": "high"})
    with pytest.raises(Exception, match="empty sprint_id"):
        pt.write_table(row, str(tmp_path / "root"), "alerts")


def test_sql_names_in_any_case_and_a_callers_views(spark, small):
    spark.range(3).createOrReplaceTempView("teams")
    rows = pt.run_query(small, "SELECT count(*) AS n, 'alerts' AS word FROM TEAMS t").collect()
    assert (rows[0].n, rows[0].word) == (3, "alerts")
    assert pt.run_query(small, "SELECT teams.name FROM teams WHERE teams.id = ?", ["t1"]).count() == 1
    assert spark.table("teams").columns == ["id"]
    spark.catalog.dropTempView("teams")

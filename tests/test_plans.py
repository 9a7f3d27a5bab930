"""What the plans must look like to hold at scale."""

import re

import pytest

from stewardspark.operators import selection
from stewardspark.plans import registry
from stewardspark.sources import testdata
from tests.conftest import SMALL

# These write files or run a stream on call; their parts are planned elsewhere.
WRITING = {
    "L01_load_tables", "L03_write_table", "L04_full_refresh", "L04_snapshot_refresh",
    "ST01_ingest_stream", "ST01_redelivered_feed",
    "D02_alert_stream", "Q20_from_stored_sums",
}


def executed_plan(df) -> str:
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.split("== Initial Plan ==")[0]


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - WRITING))
def test_no_cross_join_and_no_python(spark, name):
    df = registry.queries()[name](spark, SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    assert not re.search(r"Python|Pandas|ArrowEval", plan)


def test_each_fact_of_the_deltas_is_read_once(spark):
    plan = executed_plan(registry.queries()["Q20_kpi_deltas"](spark, SMALL))
    # Two facts come from line items, three from orders. The list of sprints, which a
    # deployment has as a table, is here made from one more scan of nothing but dates.
    scans = re.findall(r"FileScan parquet \[(l_[^\]]*)\]", plan)
    dates = [scan for scan in scans if re.fullmatch(r"l_shipdate#\d+", scan)]
    assert len(dates) == 1 and len(scans) - len(dates) == 2
    assert len(re.findall(r"FileScan parquet \[o_", plan)) == 3


def test_alerts_are_limited_before_the_shuffle(spark):
    plan = executed_plan(registry.queries()["Q26_active_alerts"](spark, SMALL))
    assert plan.index("Final") < plan.index("Exchange") < plan.index("Partial")
    assert plan.count("WindowGroupLimit") == 2


def test_latest_violations_need_no_global_sort(spark):
    plan = executed_plan(registry.queries()["Q05_violations_recent"](spark, SMALL))
    assert "TakeOrderedAndProject" in plan
    assert "rangepartitioning" not in plan


def test_team_lookup_follows_the_aggregation(spark):
    plan = executed_plan(registry.queries()["Q04_compliance_heatmap"](spark, SMALL))
    assert "BroadcastHashJoin [team_id" in plan
    tables = testdata.derive_tables(spark, SMALL)
    one = selection.active_alerts(tables["alerts"], tables["teams"], "sprint-100")
    assert "TakeOrderedAndProject" in executed_plan(one)


def test_large_teams_are_not_broadcast(spark):
    """Nothing forces a broadcast: beyond the threshold the joins shuffle."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        df = registry.queries()["Q04_compliance_heatmap"](spark, SMALL)
        expected = df.count()
        assert "Broadcast" not in executed_plan(df)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
    assert registry.queries()["Q04_compliance_heatmap"](spark, SMALL).count() == expected


def test_detail_scans_read_only_what_they_need(spark):
    plan = executed_plan(registry.queries()["Q15_kpi_violation_count"](spark, SMALL))
    scan = re.search(r"FileScan parquet \[(l_[^\]]*)\]", plan).group(1)
    assert "l_extendedprice" not in scan and "l_quantity" not in scan

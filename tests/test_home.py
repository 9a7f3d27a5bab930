import pytest
from pyspark.sql import functions as F

from stewardspark.operators import kpis
from stewardspark.plans.home import overview
from stewardspark.sources import parquet_tables as pt


def test_overview_of_the_latest_sprint(small):
    page = overview(small)
    figures = page["figures"].collect()
    assert [(r.sprint_id, r.violations, r.prev_violations) for r in figures] == [("s12", 0, 0)]
    assert page["heatmap"].count() == 0
    assert page["alerts"].count() == 0


def test_the_team_narrows_the_figures_only(small):
    page = overview(small, "Sprint 1", "Beta")
    assert [r.violations for r in page["figures"].collect()] == [1]
    assert [r.violation_band for r in page["figure_bands"].collect()] == ["green"]
    assert page["figure_texts"].first().violations_text == "1"
    assert page["heatmap"].count() == 2
    assert page["severities"].collect() == [("critical", 1), ("high", 2), ("low", 1)]
    assert page["alerts"].count() == 8
    assert page["trend"].count() == 4


def test_an_unknown_sprint_is_refused(small):
    with pytest.raises(ValueError):
        overview(small, "Sprint 99")


def test_one_sprint_equals_its_row_among_all(small):
    for team in (None, "Alpha"):
        every = kpis.kpi_deltas(small, team)
        for sprint_id in ("s1", "s2", "s3", "s10"):
            one = kpis.kpi_deltas(small, team, sprint_id).collect()
            assert one == every.filter(F.col("sprint_id") == sprint_id).collect()
    assert kpis.kpi_deltas(small, None, "nothing").count() == 0


def test_only_two_sprints_are_read(spark, small, folder):
    pt.full_refresh(small, folder)
    page = overview(pt.load_tables(spark, folder), "Sprint 2")
    assert [r.delta_violations for r in page["figures"].collect()] == [-3]
    plan = page["figures"]._jdf.queryExecution().executedPlan().toString()
    filters = [line for line in plan.split("PartitionFilters: [")[1:]]
    pruned = [text for text in filters if "sprint_id" in text.split("]")[0]]
    # teams and sprints are not partitioned
    assert len(pruned) >= 5
    for name in ("severities", "heatmap", "alerts"):
        plan = page[name]._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(sprint_id" in plan

import re

import pytest
from pyspark.sql import functions as F

from stewardspark import fixed_values as fv
from stewardspark.operators import (
    aggregates,
    alerting,
    kpis,
    policies,
    reads,
    reshape,
    selection,
    summaries,
    text_scan,
)
from stewardspark.sources import testdata
from stewardspark.sources.dimensions import policy_dim, role_policies
from tests.conftest import SMALL


def ids(df):
    return [row.id for row in df.collect()]


@pytest.fixture(scope="module")
def derived(spark):
    return testdata.derive_tables(spark, SMALL)


# Detail reads


def test_lists(small):
    assert ids(reads.teams_list(small["teams"])) == ["t1", "t2", "t3"]
    assert ids(reads.sprints_list(small["sprints"])) == ["s1", "s2", "s3", "s10", "s12"]


def test_detail_reads_join_filter_and_sort(small):
    scores, teams = small["compliance_scores"], small["teams"]
    everything = reads.compliance_scores(scores, teams)
    assert ids(everything) == ["c5", "c4", "c3", "c2", "c1"]
    assert everything.columns == [*scores.columns, "team_name"]
    assert ids(reads.compliance_scores(scores, teams, sprint_id="", team_id=None)) == ids(
        everything
    )
    assert ids(reads.compliance_scores(scores, teams, "s1", "t1")) == ["c2", "c1"]
    assert ids(reads.token_usage_detail(small["token_usage"], teams, "s2")) == ["u3", "u2"]
    assert ids(reads.security_incidents(small["security_incidents"], teams, severity="critical")) \
        == ["i3"]
    assert ids(reads.adoption_detail(small["adoption_metrics"], teams, "s1")) == ["d1", "d2"]
    assert ids(reads.code_quality_detail(small["code_quality_metrics"], teams)) == ["q1", "q2"]
    assert ids(reads.lifecycle_detail(small["lifecycle_metrics"], teams, "s1")) == ["l1", "l2"]


def test_violations_limit(small):
    violations, teams = small["policy_violations"], small["teams"]
    assert ids(reads.violations_recent(violations, teams, limit=3)) == ["v2", "v5", "v1"]
    assert len(ids(reads.violations_recent(violations, teams, limit=500))) == 6
    assert ids(reads.violations_recent(violations, teams, "s1", "t1", "high", 1)) == ["v2"]
    for limit in (0, 501, -1):
        with pytest.raises(ValueError):
            reads.violations_recent(violations, teams, limit=limit)


def test_alert_flag_has_three_states(small):
    def count(**kw):
        return reads.alerts_filtered(small["alerts"], small["teams"], **kw).count()

    assert (count(), count(acknowledged=False), count(acknowledged=True)) == (15, 14, 1)
    assert count(sprint_id="s2", acknowledged=False) == 3


# Aggregates


def test_heatmap_rounds_and_pivot_does_not(small):
    scores, teams = small["compliance_scores"], small["teams"]
    heat = aggregates.compliance_heatmap(scores, teams, "s1").collect()
    assert sorted(heat) == [("Alpha", "security", 60.0), ("Beta", "testing", 75.0)]
    wide = reshape.heatmap_pivot(scores, teams, "s1").collect()
    assert [row.team for row in wide] == ["Alpha", "Beta"]
    assert wide[0]["Security"] == pytest.approx(59.995)
    assert (wide[0]["Testing"], wide[0]["Testing text"]) == (0.0, "0%")
    assert wide[0]["Security text"] == "60%"
    assert wide[1]["Docs"] == 0.0


def test_one_sprint_is_a_slice_of_every_sprint(derived):
    scores, teams = derived["compliance_scores"], derived["teams"]
    sprint = "sprint-100"
    every = aggregates.compliance_heatmap(scores, teams).filter(F.col("sprint_id") == sprint)
    one = aggregates.compliance_heatmap(scores, teams, sprint)
    assert one.count() == 8
    assert sorted(one.collect()) == sorted(every.drop("sprint_id").collect())
    usage = derived["token_usage"]
    every = aggregates.token_summary(usage, teams).filter(F.col("sprint_id") == sprint)
    one = aggregates.token_summary(usage, teams, sprint)
    assert one.collect() == every.drop("sprint_id").collect()
    alerts = derived["alerts"]
    every = selection.active_alerts(alerts, teams).filter(F.col("sprint_id") == sprint)
    assert sorted(ids(selection.active_alerts(alerts, teams, sprint))) == sorted(ids(every))
    for kpi in (
        kpis.avg_compliance, kpis.violation_count, kpis.token_cost, kpis.adoption_rate,
        kpis.incident_count,
    ):
        every = kpi(derived).filter(F.col("sprint_id") == sprint).drop("sprint_id")
        assert kpi(derived, sprint).collect() == every.collect()


def test_pivot_equals_the_long_form(derived):
    scores, teams = derived["compliance_scores"], derived["teams"]
    long = aggregates.mean_scores(scores, teams)
    wide = reshape.heatmap_pivot(scores, teams)
    labels = {label: category for category, label in fv.SHORT_CATEGORY_LABELS.items()}
    again = wide.unpivot(["sprint_id", "team"], list(labels), "label", "score").filter("score > 0")
    names = {
        (r.sprint_id, r.team, labels[r.label], r.score) for r in again.collect()
    }
    assert names == {(r.sprint_id, r.team, r.category, r.score) for r in long.collect()}


def test_same_named_teams_share_a_group(small, make):
    teams = make(
        "teams",
        {"id": "t1", "name": "One", "size": 1},
        {"id": "t2", "name": "One", "size": 1},
    )
    heat = aggregates.mean_scores(
        small["compliance_scores"].withColumn("category", F.lit("security")), teams, "s1"
    )
    row = heat.first()
    assert heat.count() == 1
    assert row.score == pytest.approx((59.99 + 60 + 75) / 3)


def test_token_summary_sorts_on_the_rounded_cost(small):
    rows = aggregates.token_summary(small["token_usage"], small["teams"], "s2").collect()
    assert rows == [("Beta", "gpt-4o", 719999, 0.3), ("Alpha", "gpt-4o", 1800000, 0.2)]


def test_trend_follows_sprint_numbers(small):
    trend = aggregates.compliance_trend(
        small["compliance_scores"], small["teams"], small["sprints"]
    )
    assert [(r.sprint, r.team) for r in trend.collect()] == [
        ("Sprint 1", "Alpha"), ("Sprint 1", "Beta"), ("Sprint 2", "Alpha"), ("Sprint 10", "Beta"),
    ]


def test_severity_counts_in_rank_order(small):
    one = aggregates.violations_by_severity(small["policy_violations"], "s1").collect()
    assert one == [("critical", 1), ("high", 2), ("low", 1)]


# Figures and their changes


def test_figures_of_empty_sprints_are_zero(small):
    assert kpis.avg_compliance(small, "s3").collect() == [(0.0,)]
    assert kpis.violation_count(small, "s3").collect() == [(0,)]
    assert kpis.token_cost(small, "s3").collect() == [(0.0,)]
    assert kpis.adoption_rate(small, "s1").collect() == [(50.0,)]
    assert kpis.incident_count(small, "s1").collect() == [(2,)]
    assert kpis.violation_count(small).orderBy("sprint_id").collect() == [
        ("s1", 4), ("s10", 1), ("s12", 0), ("s2", 1), ("s3", 0),
    ]


def test_a_gap_in_the_numbers_means_no_previous_sprint(small):
    rows = kpis.sprint_previous(small["sprints"]).collect()
    assert {r.sprint_id: r.previous_sprint_id for r in rows} == {
        "s1": None, "s2": "s1", "s3": "s2", "s10": None, "s12": None,
    }


def test_deltas(small):
    rows = {r.sprint_id: r for r in kpis.kpi_deltas(small).collect()}
    assert len(rows) == 5
    assert (rows["s1"].violations, rows["s1"].delta_violations) == (4, 4)
    assert (rows["s2"].prev_violations, rows["s2"].delta_violations) == (4, -3)
    assert (rows["s3"].token_cost, rows["s3"].delta_token_cost) == (0.0, -0.5)
    assert rows["s10"].prev_avg_compliance == 0.0
    scoped = {r.sprint_id: r.violations for r in kpis.kpi_deltas(small, "Beta").collect()}
    assert scoped == {"s1": 1, "s2": 0, "s3": 0, "s10": 1, "s12": 0}


def test_deltas_telescope(derived):
    total = kpis.kpi_deltas(derived).agg(F.sum("delta_violations").alias("t")).first().t
    latest = selection.latest_sprint(derived["sprints"]).first().id
    assert total == kpis.violation_count(derived, latest).first()[0] > 0


def test_directions(small):
    rows = {r.sprint_id: r for r in kpis.kpi_direction(kpis.kpi_deltas(small)).collect()}
    assert rows["s2"].compliance_delta_text == "↑ 41.3% vs prev sprint"
    assert rows["s2"].violations_delta_text == "↓ 3 vs prev sprint"
    assert (rows["s2"].violations_flag, rows["s1"].violations_flag) == ("positive", "negative")
    # Nothing changed: compliance shows up and good, the others down and good.
    unchanged = rows["s12"]
    assert unchanged.compliance_delta_text == "↑ 0.0% vs prev sprint"
    assert unchanged.violations_delta_text == "↓ 0 vs prev sprint"
    assert unchanged.cost_delta_text == "↓ $0.00 vs prev"
    assert (unchanged.cost_flag, unchanged.compliance_flag) == ("positive", "positive")
    assert rows["s1"].cost_text == "$1.50K"
    assert rows["s1"].adoption_text == "50%"


def test_band_edges(spark):
    df = spark.createDataFrame(
        [(20, 3), (21, 4), (10, 0), (11, 1)], "violations bigint, incidents bigint"
    )
    rows = kpis.with_bands(df).collect()
    assert [(r.violation_band, r.incident_band, r.incident_flag) for r in rows] == [
        ("amber", "amber", "neutral"),
        ("red", "red", "negative"),
        ("green", "green", "neutral"),
        ("amber", "amber", "neutral"),
    ]


def test_scopes(small):
    rows = {(r.scope, r.sprint_id): r for r in kpis.kpis_by_scope(small).collect()}
    # The score of an unlisted team counts for all teams only.
    assert rows["All Teams", "s1"].avg_compliance == pytest.approx((59.99 + 60 + 75 + 0) / 4)
    assert rows["Alpha", "s1"].violations == 3
    assert rows["Gamma", "s1"].token_cost == 1500.0
    fact = small["policy_violations"]
    assert kpis.team_scope(fact, small["teams"], fv.ALL_TEAMS) is fact
    assert kpis.team_scope(fact, small["teams"], "Beta").count() == 2


# Top-k and lookup


def test_active_alerts(small):
    first = selection.active_alerts(small["alerts"], small["teams"], "s1")
    assert ids(first) == ["a11", "a01", "a02", "a03", "a04", "a05", "a06", "a07"]
    assert first.first().text == "**Beta** — m11"
    # warning ranks behind medium and ties with info
    assert ids(selection.active_alerts(small["alerts"], small["teams"], "s2")) == [
        "a14", "a13", "a15",
    ]
    assert selection.active_alerts(small["alerts"], small["teams"]).count() == 8 + 3


def test_latest_sprint(small):
    assert ids(selection.latest_sprint(small["sprints"])) == ["s12"]
    assert ids(selection.sprint_named(small["sprints"], "Sprint 10")) == ["s10"]


# Declared reports


def test_token_budget_edges(small):
    rows = summaries.token_budget(small["token_usage"], small["teams"]).collect()
    got = {(r.team, r.sprint_id): (r.pct, r.status) for r in rows}
    assert got["Alpha", "s1"] == (80.0, "alert")
    assert got["Alpha", "s2"] == (100.0, "escalate")
    assert got["Beta", "s2"][1] == "ok"


def test_threshold_alerts(small):
    rows = {r.id: r for r in alerting.threshold_alerts(small).collect()}
    assert set(rows) == {
        "token_budget:t1:s1",
        "token_budget:t1:s2",
        "compliance_drop:t1:s1:security",
        "quality_gate:t1:s1",
        "security_incident:t1:s1",
        "adoption_milestone:t1:s1",
    }
    assert rows["token_budget:t1:s1"].message == "Alpha has consumed 80% of sprint token budget"
    assert rows["token_budget:t1:s1"].severity == "warning"
    assert rows["adoption_milestone:t1:s1"].message == "Alpha reached 80% AI adoption rate"
    assert rows["quality_gate:t1:s1"].message.endswith("quality gate in Sprint 1")


def test_policy_evaluation(small):
    df = policies.policy_evaluation(
        small["policy_violations"], small["code_quality_metrics"], small["teams"]
    )
    got = {(r.team, r.sprint_id, r.policy_id): (r.measure, r.status) for r in df.collect()}
    # Alpha and Beta in s1, Alpha in s2, Beta in s10, Gamma in s3
    assert len(got) == 5 * 19
    assert got["Alpha", "s1", "SEC-001"] == (1.0, "fail")
    assert got["Alpha", "s1", "SEC-003"] == (2.0, "pass")
    assert got["Alpha", "s1", "CS-001"] == (79.0, "fail")
    assert got["Alpha", "s1", "CS-002"] == (15.0, "pass")
    assert got["Alpha", "s1", "TS-001"] == (70.0, "pass")
    assert got["Alpha", "s1", "CS-004"] == (59.0, "fail")
    assert got["Beta", "s1", "CS-001"] == (None, "no_data")
    assert got["Gamma", "s3", "SEC-001"] == (0.0, "pass")
    assert got["Gamma", "s3", "CS-002"] == (16.0, "fail")
    assert got["Gamma", "s3", "DP-002"] == (None, "no_data")


def test_roles(spark, small):
    matrix = policies.role_policy_matrix(
        small["policy_violations"], policy_dim(spark), role_policies(spark)
    )
    rows = {r.policy_id: r for r in matrix.collect()}
    assert len(rows) == 19
    assert rows["SEC-003"].asDict() == {
        "policy_id": "SEC-003", "developer": 1, "tech_lead": 0, "security_team": 1,
        "management": 0, "violations": 3,
    }
    mismatch = policies.role_mismatch(
        small["policy_violations"], policy_dim(spark), role_policies(spark)
    )
    assert sorted((r.found_in, r.role, r.policy_id) for r in mismatch.collect()) == [
        ("applies_to", "developer", "DP-003"),
        ("applies_to", "developer", "PF-001"),
        ("role_list", "security_team", "DM-001"),
        ("role_list", "security_team", "SEC-002"),
        ("role_list", "security_team", "SEC-003"),
        ("role_list", "security_team", "SEC-004"),
        ("role_list", "tech_lead", "CS-002"),
    ]


def test_violation_trend_keeps_sprints_that_fell_to_zero(small):
    trend = summaries.violation_trend(
        small["policy_violations"], small["teams"], small["sprints"]
    )
    got = {(r.team, r.number): (r.violations, r.previous, r.change) for r in trend.collect()}
    assert got == {
        ("Alpha", 1): (3, 0, 3),
        ("Alpha", 2): (1, 3, -2),
        ("Alpha", 3): (0, 1, -1),
        ("Beta", 1): (1, 0, 1),
        ("Beta", 2): (0, 1, -1),
        ("Beta", 10): (1, 0, 1),
    }


def test_cost_rollup(small):
    rows = summaries.cost_rollup(small["token_usage"], small["teams"]).collect()
    total = next(r for r in rows if r.level == 7)
    assert total.total_cost == 1500.6
    assert next(r for r in rows if r.level == 3 and r.sprint_id == "s2").total_cost == 0.5
    assert summaries.daily_consumption(small["token_usage"]).count() == 4


def test_ratios_without_a_base_are_null(small):
    rows = summaries.quality_scorecard(
        small["code_quality_metrics"], small["teams"]
    ).collect()
    got = {r.team: (r.ai_line_share, r.flagged_per_1k_ai_lines) for r in rows}
    assert got == {"Alpha": (None, None), "Gamma": (0.25, 2.0)}


def test_adoption_security_lifecycle_adherence(small):
    adoption = summaries.adoption_roi(small["adoption_metrics"]).first()
    assert (adoption.mean_adoption_pct, adoption.weighted_adoption_pct) == (50.0, 60.0)
    assert (adoption.active_share, adoption.roi_usd) == (0.6, 750.5)
    security = summaries.security_summary(small["security_incidents"]).collect()
    assert sum(r.incidents for r in security) == 3
    assert sum(r.secrets for r in security) == 1
    personal = summaries.pii_incidents(small["security_incidents"]).collect()
    assert sorted(personal) == [("email", 1, 1), ("ssn", 1, 0)]
    lifecycle = summaries.lifecycle_summary(small["lifecycle_metrics"], small["teams"]).first()
    assert (lifecycle.monitored_pct, lifecycle.defect_leakage) == (50.0, 0.25)
    assert lifecycle.mean_test_automation_pct == 60.0
    adherence = summaries.compliance_adherence(small["compliance_scores"], small["teams"])
    got = {r.team: (r.rules_passed, r.total_rules) for r in adherence.collect()}
    assert got == {"Alpha": (19, 30), "Beta": (10, 20)}


def test_text_scan(spark):
    hexes = "0123456789" * 4
    text = (
        "a.b+c@mail.example.org x@y a@b.c_d@e.f +1 (555) 123-4567 "
        f'123-45-6789 4111111111111111 token = "{hexes}" token = "short"'
    )
    docs = spark.createDataFrame([(1, text), (2, "nothing"), (3, None)], "doc_id int, text string")
    got = {(r.doc_id, r.kind): r.hits for r in text_scan.pii_secret_scan(docs).collect()}
    # digits within the secret are no card
    assert got == {
        (1, "email"): 3, (1, "phone"): 1, (1, "ssn"): 1, (1, "credit_card"): 1, (1, "secret"): 1,
    }


def test_text_scan_equals_python_on_whole_texts(spark):
    plain = {
        **fv.TEXT_PATTERNS,
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    }
    documents = testdata.source(spark, SMALL, "documents")
    expected = {}
    for row in documents.collect():
        for kind, pattern in plain.items():
            hits = len(re.findall(pattern, row.text))
            if hits:
                expected[row.doc_id, kind] = hits
    got = {(r.doc_id, r.kind): r.hits for r in text_scan.pii_secret_scan(documents).collect()}
    assert got == expected and expected


def test_text_scan_of_a_very_long_run(spark):
    docs = spark.range(1).select(
        F.col("id").alias("doc_id"),
        F.expr("concat(repeat('ab12', 300000), ' a@b', repeat('.c', 100000))").alias("text"),
    )
    assert [(r.kind, r.hits) for r in text_scan.pii_secret_scan(docs).collect()] == [("email", 1)]

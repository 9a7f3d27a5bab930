from decimal import Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stewardspark import fixed_values as fv
from stewardspark.functions import calendar, measures, scalars
from stewardspark.operators.usage import with_token_cost
from stewardspark.sources.dimensions import (
    model_price_dim,
    policy_dim,
    policy_roles,
    read_policy_file,
    role_policies,
)


def column(spark, values, kind, function):
    df = spark.createDataFrame([(value,) for value in values], f"x {kind}")
    return [row.y for row in df.select(function(F.col("x")).alias("y")).collect()]


def test_severity_ranks(spark):
    names = ["critical", "high", "medium", "low", "info", "warning", "other"]
    assert column(spark, names, "string", scalars.severity_rank) == [1, 2, 3, 4, 5, 5, 5]
    assert column(
        spark, names, "string", lambda c: scalars.severity_rank(c, "alerts")
    ) == [1, 2, 3, 4, 4, 4, 4]


def test_severity_colors_and_alert_classes(spark):
    assert column(spark, ["high", "warning", None], "string", scalars.severity_color) == [
        "#D85A30", "#888780", "#888780",
    ]
    names = ["critical", "high", "warning", "medium", "low", "info", "other"]
    assert column(spark, names, "string", scalars.alert_class) == [
        "alert-critical", "alert-high", "alert-warning", "alert-warning", "alert-info",
        "alert-info", "alert-info",
    ]
    assert column(spark, ["high", "low", "other"], "string", scalars.alert_icon) == [
        "🟠", "🔵", "ℹ️",
    ]


def test_band_edges_belong_to_the_upper_band(spark):
    scores = [59.99, 60.0, 74.99, 75.0, 90.0, -1.0, None]
    assert column(spark, scores, "double", scalars.compliance_band) == [
        "critical", "needs_improvement", "needs_improvement", "good", "excellent", "critical",
        None,
    ]
    assert column(spark, scores, "double", scalars.compliance_color)[:5] == [
        "#E24B4A", "#BA7517", "#BA7517", "#1D9E75", "#639922",
    ]


def test_number_and_currency_texts(spark):
    numbers = [999.0, 1000.0, 999999.0, 1000000.0, -1500.0, 0.0, None]
    assert column(spark, numbers, "double", scalars.format_number) == [
        "999.0", "1.0K", "1000.0K", "1.0M", "-1.5K", "0.0", None,
    ]
    assert column(spark, numbers, "double", scalars.format_currency) == [
        "$999.00", "$1.00K", "$1000.00K", "$1.00M", "$-1.50K", "$0.00", None,
    ]


NUMBERS = [0.25, 0.75, 72.5, 73.5, 2.325, 1.005, 0.15, 0.35, 0.005, 0.015, 9.995, 99.95, 0.5, 1.5,
           999.999, -1.5, -0.04, 1e15 + 0.5, 123456789.125, 1e-300, 0.0]


@pytest.mark.parametrize("decimals", [0, 1, 2])
def test_texts_are_rounded_by_the_exact_value(spark, decimals):
    shown = column(spark, NUMBERS, "double", lambda c: scalars.fixed_text(c, decimals))
    assert shown == [f"{value:.{decimals}f}" for value in NUMBERS]


@settings(max_examples=10, deadline=None)
@given(
    st.lists(
        st.one_of(
            st.floats(-1e9, 1e9, allow_nan=False),
            st.integers(-(10**6), 10**6).map(lambda n: n / 1000),
            st.integers(-(10**6), 10**6).map(lambda n: n / 64),
        ),
        min_size=20,
        max_size=200,
    )
)
def test_random_texts_are_rounded_by_the_exact_value(spark, numbers):
    numbers = [n for n in numbers if n or str(n) == "0.0"]
    for decimals in (0, 1, 2):
        shown = column(spark, numbers, "double", lambda c: scalars.fixed_text(c, decimals))
        assert shown == [f"{value:.{decimals}f}" for value in numbers]


def test_labels(spark):
    names = ["documentation", "dependency_management", "unknown"]
    assert column(spark, names, "string", scalars.category_label) == [
        "Documentation", "Dependencies", "unknown",
    ]
    short = column(spark, names, "string", lambda c: scalars.category_label(c, "short"))
    assert short == ["Docs", "Dependencies", "unknown"]
    assert column(spark, ["ML Ops", "x"], "string", scalars.team_color) == ["#378ADD", None]


def test_alert_and_violation_texts(spark):
    df = spark.createDataFrame([(kind,) for kind in fv.ALERT_TEMPLATES] + [("x",)], "kind string")
    message = scalars.alert_message(
        F.col("kind"), F.lit("Alpha"), F.lit(81), F.lit(60), F.lit("security"), F.lit(7)
    )
    assert [row.m for row in df.select(message.alias("m")).collect()] == [
        "Alpha has consumed 81% of sprint token budget",
        "Alpha compliance dropped below 60% in security",
        "PII exposure detected in Alpha codebase",
        "Alpha failed SonarQube quality gate in Sprint 7",
        "Alpha reached 81% AI adoption rate",
        None,
    ]
    assert column(spark, ["P"], "string", scalars.violation_text) == [
        "Violation of P detected in AI-generated code"
    ]


def test_products_are_truncated_as_doubles(spark):
    df = spark.range(1)
    row = df.select(
        measures.sprint_velocity(F.lit(100), F.lit(15.0)).alias("velocity"),
        measures.roi_usd(F.lit(100), F.lit(114)).alias("roi"),
        measures.active_developers(F.lit(12), F.lit(0.58)).alias("active"),
        measures.adoption_rate_pct(F.lit(0.58)).alias("pct"),
        measures.rules_passed(F.lit(15), F.lit(120.0)).alias("all_rules"),
        measures.rules_passed(F.lit(15), F.lit(-3.0)).alias("no_rules"),
        measures.rules_passed(F.lit(13), F.lit(82.0)).alias("some_rules"),
        measures.ai_lines(F.lit(5000), F.lit(0.83)).alias("ai"),
        measures.human_lines(F.lit(5000), F.lit(2490)).alias("human"),
    ).first()
    assert row.asDict() == {
        "velocity": int(100 * (1 + 15 / 100)),
        "roi": 3500.0,
        "active": int(12 * 0.58),
        "pct": 58.0,
        "all_rules": 15,
        "no_rules": 0,
        "some_rules": int(13 * 82 / 100),
        "ai": int(5000 * 0.83 * 0.6),
        "human": 2510,
    }


def test_usd_sum_does_not_depend_on_the_order(spark):
    cents = [0.1] * 10 + [1e9, -1e9, 0.0001]
    df = spark.createDataFrame([(c,) for c in cents], "usd double")
    for parts in (1, 3, 7):
        total = df.repartition(parts).agg(measures.usd_sum(F.col("usd")).alias("t")).first().t
        assert total == 1.0001


def test_token_cost(spark):
    usage = spark.createDataFrame(
        [
            ("a", "claude-opus-4", 1000, 500),
            ("b", "claude-opus-4", 0, 500),
            ("c", "claude-opus-4", -5, 500),
            ("d", "gpt-4o", 10, -40),
            ("e", "unknown", 10, 10),
            ("f", "claude-haiku-4", 50, 0),
        ],
        "id string, model string, input_tokens int, output_tokens int",
    )
    priced = with_token_cost(usage, model_price_dim(spark))
    got = {r.id: (r.output_tokens, r.total_tokens, r.cost_usd) for r in priced.collect()}
    assert got == {
        "a": (500, 1500, 0.0525),
        "d": (0, 0, 0.0),
        "e": (10, 20, None),
        "f": (0, 50, 0.0001),
    }


def test_calendar_arithmetic_equals_the_range_join(spark):
    sprints = calendar.sprint_calendar(spark, "2025-10-01", 6)
    first, last = sprints.orderBy("number").collect()[0], sprints.orderBy("number").collect()[-1]
    assert (first.id, first.name, str(first.start_date), str(first.end_date)) == (
        "sprint-1", "Sprint 1", "2025-10-01", "2025-10-14",
    )
    assert (last.number, str(last.end_date)) == (6, "2025-12-23")
    days = spark.range(84).select(
        F.date_add(F.lit("2025-10-01").cast("date"), F.col("id").cast("int")).alias("day")
    )
    assigned = days.withColumn("number", calendar.sprint_number(F.col("day"), "2025-10-01"))
    ranged = days.join(sprints, days.day.between(sprints.start_date, sprints.end_date))
    assert sorted(assigned.collect()) == sorted(ranged.select("day", "number").collect())
    seen = calendar.sprint_calendar_of(days.limit(20), "2025-10-01")
    assert [r.id for r in seen.orderBy("number").collect()] == ["sprint-1", "sprint-2"]


def test_policy_and_price_dimensions(spark, tmp_path):
    policies = policy_dim(spark)
    assert policies.count() == 19
    assert policies.filter("threshold = 0").count() == 8
    assert policy_roles(policies).count() == 34
    assert role_policies(spark).groupBy("role").count().orderBy("role").collect() == [
        ("developer", 16), ("security_team", 7), ("tech_lead", 14),
    ]
    price = model_price_dim(spark).filter("model = 'gpt-4o'").first()
    assert price.input_cost_per_1k == Decimal("0.005")


def test_policy_file(spark, tmp_path):
    pytest.importorskip("yaml")
    path = tmp_path / "policies.yaml"
    path.write_text(
        "policies:\n"
        "  - {id: X-1, name: N, description: D, category: security, severity: low,\n"
        "     applies_to: [developer], threshold: 3, tool: t}\n"
        "token_budgets: {per_developer_per_sprint: 10, per_team_per_sprint_multiplier: 1.5,\n"
        "  alert_threshold_pct: 70, escalation_threshold_pct: 90}\n"
        "roles:\n"
        "  developer: {policies: [X-1]}\n"
        "  management: {dashboard_access: [token_cost]}\n"
    )
    read = read_policy_file(str(path))
    row = policy_dim(spark, read.policies).first()
    assert (row.idx, row.id, row.applies_to, row.threshold) == (0, "X-1", ["developer"], 3.0)
    assert role_policies(spark, read.role_policies).collect() == [("developer", "X-1")]
    assert read.token_budget == {
        "per_developer": 10, "multiplier": "1.5", "alert_pct": 70, "escalation_pct": 90,
    }

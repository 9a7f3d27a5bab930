"""Days by the stored bounds of periods, against brute force."""

import random
from datetime import date, timedelta

import pytest

from stewardspark.functions import calendar

FIRST = date(2024, 1, 1)
PERIODS = "id string, number int, start_date date, end_date date"


def day(n):
    return FIRST + timedelta(days=n)


def brute(d, periods, on_gap):
    """The period that began last among those that hold the day, or the last day before it."""
    while d >= day(-60):
        held = [(a, n, i) for i, n, a, b in periods if a and b and a <= d <= b]
        if held or on_gap == "none":
            return max(held)[2] if held else None
        d -= timedelta(days=1)
    return None


@pytest.mark.parametrize("on_gap", calendar.GAPS)
def test_days_equal_brute_force(spark, on_gap):
    rnd = random.Random(6)
    for _ in range(6):
        periods = []
        for i in range(rnd.randint(0, 9)):
            start = rnd.randint(0, 80)
            periods.append((f"p{i}", rnd.choice([i, 1]), day(start), day(start + rnd.randint(-2, 20))))
        periods += [("open", 50, day(3), None), ("none", 51, None, day(9))]
        days = [(i, day(rnd.randint(-5, 120))) for i in range(200)] + [(200, None)]
        facts = spark.createDataFrame(days, "period int, day date")
        got = calendar.with_period(facts, "day", spark.createDataFrame(periods, PERIODS), on_gap)
        assert got.columns == ["period", "day", "period_id"]
        assert sorted(map(tuple, got.collect())) == [
            (i, d, brute(d, periods, on_gap) if d else None) for i, d in days
        ]


def test_it_is_a_join_by_equality(spark):
    periods = spark.createDataFrame([("p", 1, day(0), day(9))], PERIODS)
    facts = spark.range(100).selectExpr("date_add(DATE '2024-01-01', CAST(id AS INT)) AS day")
    for on_gap in calendar.GAPS:
        df = calendar.with_period(facts, "day", periods, on_gap)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan
        assert df.filter("period_id = 'p'").count() == (10 if on_gap == "none" else 100)


def test_an_unknown_rule_is_refused(spark):
    with pytest.raises(ValueError):
        calendar.period_days(spark.createDataFrame([], PERIODS), "next")

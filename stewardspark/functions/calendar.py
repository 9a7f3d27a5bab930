"""Sprints: fixed periods of days counted from a base date, or periods with bounds of their own."""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stewardspark.fixed_values import SPRINT_DAYS


def _base(base: str) -> Column:
    return F.lit(base).cast("date")


def sprint_number(day: Column, base: str, days: int = SPRINT_DAYS) -> Column:
    """Number of the period a day falls in, 1 for the one starting on ``base``."""
    offset = F.datediff(day.cast("date"), _base(base))
    return (F.floor(offset / days) + 1).cast("int")


def sprint_id(number: Column) -> Column:
    return F.concat(F.lit("sprint-"), number.cast("string"))


def _periods(numbers: DataFrame, base: str, days: int) -> DataFrame:
    number = F.col("number")
    return numbers.select(
        sprint_id(number).alias("id"),
        F.concat(F.lit("Sprint "), number.cast("string")).alias("name"),
        number,
        F.date_add(_base(base), (number - 1) * days).alias("start_date"),
        F.date_add(_base(base), number * days - 1).alias("end_date"),
    )


def sprint_calendar(
    spark: SparkSession, base: str, periods: int, days: int = SPRINT_DAYS
) -> DataFrame:
    """``periods`` sprints in a row; both ends of a sprint belong to it."""
    numbers = spark.range(1, periods + 1).select(F.col("id").cast("int").alias("number"))
    return _periods(numbers, base, days)


def sprint_calendar_of(days_seen: DataFrame, base: str, days: int = SPRINT_DAYS) -> DataFrame:
    """The sprints from ``base`` up to the last day in a one-column DataFrame."""
    last = F.max(F.col(days_seen.columns[0])).alias("last")
    numbers = (
        days_seen.agg(last)
        .select(sprint_number(F.col("last"), base, days).alias("n"))
        .filter(F.col("n") >= 1)
        .select(F.explode(F.sequence(F.lit(1), F.col("n"))).alias("number"))
    )
    return _periods(numbers, base, days)


GAPS = ("none", "previous")


def period_days(periods: DataFrame, on_gap: str = "none", until: Column | None = None) -> DataFrame:
    """One row (day, period_id) per day that one of ``periods`` (id, number, start_date, end_date) holds.

    Both ends belong to a period. Where periods overlap the one that began last counts,
    of those the one with the larger number, then id. A period without a bound, or one
    that ends before it begins, holds no day. A day in a gap has no row, or with
    ``on_gap="previous"`` goes to the period of the last day before the gap; after the
    last period that goes on up to the day ``until``. Days before the first period have
    no row.

    The result is as long as the calendar has days, whatever the facts hold, so the
    running order over it, in one task, is short.
    """
    if on_gap not in GAPS:
        raise ValueError(f"on_gap is one of {GAPS}")
    bounds = [F.col(c).cast("date") for c in ("start_date", "end_date")]
    whole = periods.filter(bounds[0] <= bounds[1])
    each = whole.select("id", "number", bounds[0].alias("start"), F.explode(F.sequence(*bounds)).alias("day"))
    held = each.groupBy("day").agg(F.max(F.struct("start", "number", "id")).alias("last"))
    held = held.select("day", F.col("last.id").alias("period_id"))
    if on_gap == "none":
        return held
    following = F.lead("day").over(Window.orderBy("day"))
    last = F.coalesce(F.date_sub(following, 1), F.greatest("day", until.cast("date")) if until is not None else "day")
    return held.withColumn("last", last).select(
        F.explode(F.sequence("day", "last")).alias("day"), "period_id"
    )


def with_period(facts: DataFrame, day: str, periods: DataFrame, on_gap: str = "none") -> DataFrame:
    """``facts`` with the ``period_id`` their ``day`` falls in by the periods' own bounds, or NULL.

    The periods are unfolded into days, so this is a join by equality: Spark broadcasts
    the days by their size, and splits a day that holds too many facts if it shuffles.
    """
    until = facts.agg(F.max(F.col(day).cast("date"))).scalar() if on_gap == "previous" else None
    days = period_days(periods, on_gap, until).withColumnRenamed("day", "_day")
    joined = facts.join(days, F.col(day).cast("date") == F.col("_day"), "left")
    return joined.select(*[facts[c] for c in facts.columns], "period_id")

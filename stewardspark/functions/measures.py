"""Arithmetic of the derived measures.

Products of counts and rates stay in doubles and are truncated, so that
100 * (1 + 15 / 100) gives 114 and not 115. Money is exact: prices become whole
micro-USD, and every sum of USD is a sum of whole micro-USD.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from stewardspark import fixed_values as fv

MICRO = 1_000_000


def truncated(value: Column) -> Column:
    return value.cast("int")


def clamp_pct(value: Column) -> Column:
    return F.least(F.lit(100.0), F.greatest(F.lit(0.0), value.cast("double")))


def usd_sum(usd: Column) -> Column:
    """Sum of a USD column, the same in whatever order rows are added.

    A double sum depends on the order of rows, which differs from run to run on
    a cluster. Whole micro-USD in a bigint add up exactly, and unlike a cast to
    DECIMAL they cost no object per row.
    """
    return F.sum(F.rint(usd * MICRO).cast("bigint")) / F.lit(float(MICRO))


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, NULL when the whole is zero."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def token_cost_usd(
    input_tokens: Column, output_tokens: Column, input_price: Column, output_price: Column
) -> Column:
    """Cost of one usage row, rounded half up to four decimals, at least 0.

    Prices are USD per 1000 tokens, as whole micro-USD.
    """
    # Tokens times micro-USD per 1000 tokens is nano-USD; 100 000 of them make
    # one unit of the fourth decimal.
    nano = input_tokens.cast("bigint") * input_price + output_tokens.cast("bigint") * output_price
    units = F.floor((F.greatest(F.lit(0), nano) + 50_000) / 100_000)
    return units.cast("double") / F.lit(10_000.0)


def rules_passed(total_rules: Column, score: Column) -> Column:
    return truncated(total_rules * clamp_pct(score) / F.lit(100.0))


def active_developers(size: Column, rate: Column) -> Column:
    return truncated(size.cast("double") * rate)


def adoption_rate_pct(rate: Column) -> Column:
    return F.round(rate * F.lit(100.0), 1)


def sprint_velocity(baseline: Column, gain_pct: Column) -> Column:
    return truncated(baseline.cast("double") * (F.lit(1.0) + gain_pct / F.lit(100.0)))


def roi_usd(baseline: Column, velocity: Column) -> Column:
    return ((velocity - baseline) * fv.ROI_USD_PER_POINT).cast("double")


def ai_lines(total_lines: Column, rate: Column) -> Column:
    return truncated(total_lines.cast("double") * rate * F.lit(fv.AI_LINE_SHARE))


def human_lines(total_lines: Column, ai: Column) -> Column:
    return truncated(total_lines.cast("double") - ai)

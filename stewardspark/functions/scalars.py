"""Ranks, labels, bands and display text."""

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

from stewardspark import fixed_values as fv


def lookup(key: Column, values: dict[str, str], default: Column | None = None) -> Column:
    """``values[key]``, or ``default`` (else NULL) for any other key."""
    pairs = [F.lit(part) for pair in values.items() for part in pair]
    found = F.try_element_at(F.create_map(*pairs), key)
    return found if default is None else F.coalesce(found, default)


def severity_rank(severity: Column, variant: str = "violations") -> Column:
    """Sort rank of a severity, 1 first.

    Violations rank critical, high, medium, low and then all others. Alerts rank
    only critical, high and medium; warning, low and info tie behind them.
    """
    ranked = {"violations": 4, "alerts": 3}[variant]
    rank = F.lit(ranked + 1)
    for position in range(ranked, 0, -1):
        rank = F.when(severity == fv.SEVERITIES[position - 1], position).otherwise(rank)
    return rank


def severity_color(severity: Column) -> Column:
    return lookup(severity, fv.SEVERITY_COLORS, F.lit(fv.DEFAULT_COLOR))


def _band(score: Column, part: int) -> Column:
    *upper, lowest = fv.COMPLIANCE_BANDS
    value = F.lit(lowest[part])
    for band in reversed(upper):
        value = F.when(score >= band[0], band[part]).otherwise(value)
    return F.when(score.isNotNull(), value)


def compliance_band(score: Column) -> Column:
    """excellent, good, needs_improvement or critical."""
    return _band(score, 1)


def compliance_color(score: Column) -> Column:
    return _band(score, 2)


def fixed_text(value: Column, decimals: int) -> Column:
    """``value`` with 0 to 2 decimals, rounded by its exact binary value.

    2.325 is stored as slightly more than that and shows as 2.33; 0.25 is stored
    exactly, and such a tie goes to the even digit. Spark's rounding of a double
    works on its shortest decimal form and cannot tell the two apart, hence the
    way through a decimal with 19 digits behind the point.
    """
    value = value.cast("double")
    size = F.abs(value)
    whole = F.floor(size).cast("bigint")
    # The part behind the point in units of 2^-62. Scaling by a power of two is
    # exact, and a double near a tie of two decimals has no finer bits.
    units = ((size - whole) * float(2**62)).cast("bigint").cast("decimal(19,0)")
    part = (units / F.lit(2**62).cast("decimal(19,0)")).cast("decimal(20,19)")
    rounded = F.bround(whole.cast("decimal(18,0)") + part, decimals)
    return F.concat(F.when(value < 0, "-").otherwise(""), rounded.cast("string"))


def format_number(n: Column, decimals: int = 1, prefix: str = "") -> Column:
    """1234567 -> 1.2M, 1500 -> 1.5K, 7 -> 7.0; the sign follows the prefix."""
    n = n.cast("double")
    millions, thousands = F.abs(n) >= 1_000_000, F.abs(n) >= 1_000
    shown = F.when(millions, n / 1_000_000).when(thousands, n / 1_000).otherwise(n)
    suffix = F.when(millions, "M").when(thousands, "K").otherwise("")
    return F.concat(F.lit(prefix), fixed_text(shown, decimals), suffix)


def format_currency(n: Column) -> Column:
    """-1500 -> $-1.50K"""
    return format_number(n, 2, "$")


def category_label(category: Column, style: str = "long") -> Column:
    """Display name of a category; unknown categories keep their key."""
    labels = {"long": fv.CATEGORY_LABELS, "short": fv.SHORT_CATEGORY_LABELS}[style]
    return lookup(category, labels, category)


def alert_class(severity: Column) -> Column:
    return lookup(severity, fv.ALERT_CLASSES, F.lit(fv.DEFAULT_ALERT_CLASS))


def alert_icon(severity: Column) -> Column:
    return lookup(severity, fv.ALERT_ICONS, F.lit(fv.DEFAULT_ALERT_ICON))


def team_color(team_name: Column, colors: dict[str, str] | None = None) -> Column:
    """Colour of a team, NULL for a team without one."""
    return lookup(team_name, colors or fv.TEAM_COLORS)


def fill(template: str, **values: Column) -> Column:
    """A text template with ``{name}`` places filled from columns."""
    parts = []
    for text, name, _, _ in string.Formatter().parse(template):
        if text:
            parts.append(F.lit(text))
        if name:
            parts.append(values[name].cast("string"))
    return F.concat(*parts)


def violation_text(policy_name: Column) -> Column:
    return fill(fv.VIOLATION_TEXT, policy=policy_name)


def _by_alert_type(alert_type: Column, value) -> Column:
    chosen = F.lit(None).cast("string")
    for name, template in fv.ALERT_TEMPLATES.items():
        chosen = F.when(alert_type == name, value(template)).otherwise(chosen)
    return chosen


def alert_severity(alert_type: Column) -> Column:
    return _by_alert_type(alert_type, lambda template: F.lit(template[0]))


def alert_title(alert_type: Column) -> Column:
    return _by_alert_type(alert_type, lambda template: F.lit(template[1]))


def alert_message(
    alert_type: Column,
    team: Column,
    pct: Column,
    threshold: Column,
    category: Column,
    sprint: Column,
) -> Column:
    """The message of an alert; NULL for an unknown alert type."""
    values = dict(team=team, pct=pct, threshold=threshold, category=category, sprint=sprint)
    return _by_alert_type(alert_type, lambda template: fill(template[2], **values))

"""The five headline figures of a sprint, their changes, bands and texts.

Each fact is reduced to one row per sprint before anything is joined, so the
joins here are between tables as long as the list of sprints.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stewardspark import fixed_values as fv
from stewardspark.functions import measures, scalars
from stewardspark.tables import Tables


def team_scope(fact: DataFrame, teams: DataFrame, team: str | None = None) -> DataFrame:
    """Rows of the named team; all rows for None or "All Teams"."""
    if not team or team == fv.ALL_TEAMS:
        return fact
    ids = teams.filter(F.col("name") == team).select(F.col("id").alias("team_id"))
    return fact.join(ids, "team_id", "left_semi").select(*fact.columns)


def _chosen(tables: Tables, name: str, team: str | None) -> DataFrame:
    return team_scope(tables[name], tables["teams"], team)


def _figures() -> dict[str, tuple[str, Column]]:
    """Figure -> the table it comes from and how it is worked out there."""
    return {
        "avg_compliance": ("compliance_scores", F.avg("score")),
        "violations": ("policy_violations", F.count("*")),
        "token_cost": ("token_usage", measures.usd_sum(F.col("cost_usd"))),
        # A plain mean of the readings, whatever the size of the teams.
        "adoption_rate": ("adoption_metrics", F.avg("adoption_rate_pct")),
        "incidents": ("security_incidents", F.count("*")),
    }


def _or_zero(*names: str) -> list[Column]:
    return [F.coalesce(F.col(name), F.lit(0)).alias(name) for name in names]


def every_sprint(
    tables: Tables, names: list[str], team: str | None = None, only: list[str] | None = None
) -> DataFrame:
    """The named figures of each sprint, or of those in ``only``.

    They are 0 where a sprint has no rows. With ``only``, just the partitions of
    these sprints are read.
    """
    result = tables["sprints"].select(F.col("id").alias("sprint_id"))
    if only is not None:
        result = result.filter(F.col("sprint_id").isin(only))
    for name in names:
        table, value = _figures()[name]
        rows = _chosen(tables, table, team)
        if only is not None:
            rows = rows.filter(F.col("sprint_id").isin(only))
        per_sprint = rows.groupBy("sprint_id").agg(value.alias(name))
        result = result.join(per_sprint, "sprint_id", "left")
    return result.select("sprint_id", *_or_zero(*names))


def _kpi(tables: Tables, name: str, sprint_id: str | None, team: str | None) -> DataFrame:
    """One figure: of the given sprint in one row, or of every sprint."""
    if not sprint_id:
        return every_sprint(tables, [name], team)
    table, value = _figures()[name]
    rows = _chosen(tables, table, team).filter(F.col("sprint_id") == sprint_id)
    return rows.agg(value.alias(name)).select(*_or_zero(name))


def avg_compliance(tables: Tables, sprint_id=None, team=None) -> DataFrame:
    return _kpi(tables, "avg_compliance", sprint_id, team)


def violation_count(tables: Tables, sprint_id=None, team=None) -> DataFrame:
    return _kpi(tables, "violations", sprint_id, team)


def token_cost(tables: Tables, sprint_id=None, team=None) -> DataFrame:
    return _kpi(tables, "token_cost", sprint_id, team)


def adoption_rate(tables: Tables, sprint_id=None, team=None) -> DataFrame:
    return _kpi(tables, "adoption_rate", sprint_id, team)


def incident_count(tables: Tables, sprint_id=None, team=None) -> DataFrame:
    return _kpi(tables, "incidents", sprint_id, team)


def sprint_previous(sprints: DataFrame) -> DataFrame:
    """Each sprint with the one numbered one less, NULL if that is missing.

    A gap in the numbers means no previous sprint, so this is a join on the
    number and not a ``lag``.
    """
    before = sprints.groupBy((F.col("number") + 1).alias("number")).agg(
        F.min("id").alias("previous_sprint_id")
    )
    return (
        sprints.select(F.col("id").alias("sprint_id"), "name", "number")
        .join(before, "number", "left")
        .select("sprint_id", "name", "number", "previous_sprint_id")
    )


COMPARED = ["avg_compliance", "violations", "token_cost"]


def kpi_deltas(
    tables: Tables, team: str | None = None, sprint_id: str | None = None
) -> DataFrame:
    """The five figures of every sprint, with the previous sprint's and the change.

    The previous figures come from the same aggregates; Spark reuses their
    shuffles, so each fact is read once. With ``sprint_id`` the result is that
    sprint's row, and of each fact only the sprint and the one before are read;
    the previous one is looked up in the list of sprints first.
    """
    order = sprint_previous(tables["sprints"])
    only = None
    if sprint_id:
        order = order.filter(F.col("sprint_id") == sprint_id)
        found = order.first()
        only = [sprint_id]
        if found is not None and found.previous_sprint_id is not None:
            only.append(found.previous_sprint_id)
    now = every_sprint(tables, list(_figures()), team, only)
    return with_changes(order, now, every_sprint(tables, COMPARED, team, only))


def with_changes(order: DataFrame, now: DataFrame, before: DataFrame) -> DataFrame:
    """The figures ``now`` of the sprints in ``order``, with those of the sprint before."""
    before = before.select(
        F.col("sprint_id").alias("previous_sprint_id"),
        *[F.col(name).alias(f"prev_{name}") for name in COMPARED],
    )
    previous = [f"prev_{name}" for name in COMPARED]
    joined = order.join(now, "sprint_id").join(before, "previous_sprint_id", "left")
    return joined.select(
        "sprint_id",
        F.col("name").alias("sprint"),
        "number",
        *_figures(),
        *_or_zero(*previous),
    ).select(
        "*",
        *[(F.col(n) - F.col(f"prev_{n}")).alias(f"delta_{n}") for n in COMPARED],
    )


def kpi_direction(deltas: DataFrame) -> DataFrame:
    """Display texts of the figures, their arrows and whether a change is good.

    A compliance change of zero counts as up and good. Violations and cost are
    bad when they rise; an unchanged value shows as down.
    """
    compliance, violations, cost = (F.col(f"delta_{name}") for name in COMPARED)

    def arrow(up: Column) -> Column:
        return F.when(up, "↑").otherwise("↓")

    return deltas.select(
        "sprint_id",
        F.concat(scalars.fixed_text(F.col("avg_compliance"), 1), F.lit("%")).alias(
            "compliance_text"
        ),
        F.concat(
            arrow(compliance >= 0),
            F.lit(" "),
            scalars.fixed_text(F.abs(compliance), 1),
            F.lit("% vs prev sprint"),
        ).alias("compliance_delta_text"),
        F.when(compliance >= 0, "positive").otherwise("negative").alias("compliance_flag"),
        scalars.compliance_color(F.col("avg_compliance")).alias("compliance_color"),
        F.col("violations").cast("string").alias("violations_text"),
        F.concat(
            arrow(violations > 0),
            F.lit(" "),
            F.abs(violations).cast("string"),
            F.lit(" vs prev sprint"),
        ).alias("violations_delta_text"),
        F.when(violations > 0, "negative").otherwise("positive").alias("violations_flag"),
        scalars.format_currency(F.col("token_cost")).alias("cost_text"),
        F.concat(
            arrow(cost > 0), F.lit(" "), scalars.format_currency(F.abs(cost)), F.lit(" vs prev")
        ).alias("cost_delta_text"),
        F.when(cost > 0, "negative").otherwise("positive").alias("cost_flag"),
        F.concat(scalars.fixed_text(F.col("adoption_rate"), 0), F.lit("%")).alias(
            "adoption_text"
        ),
        F.col("incidents").cast("string").alias("incidents_text"),
    )


def _traffic_light(count: Column, red_above: int, amber_above: int) -> Column:
    return (
        F.when(count > red_above, "red").when(count > amber_above, "amber").otherwise("green")
    )


def with_bands(counts: DataFrame) -> DataFrame:
    """Bands and colours for columns ``violations`` and ``incidents``."""
    violations = _traffic_light(F.col("violations"), 20, 10)
    incidents = _traffic_light(F.col("incidents"), 3, 0)
    return counts.select(
        "*",
        violations.alias("violation_band"),
        scalars.lookup(violations, fv.KPI_COLORS).alias("violation_color"),
        incidents.alias("incident_band"),
        scalars.lookup(incidents, fv.KPI_COLORS).alias("incident_color"),
        F.when(F.col("incidents") > 3, "negative").otherwise("neutral").alias("incident_flag"),
    )


def kpi_bands(tables: Tables) -> DataFrame:
    """Violations and incidents per team and sprint, with their bands."""
    keys = ["team_id", "sprint_id"]
    violations = tables["policy_violations"].groupBy(*keys).agg(F.count("*").alias("violations"))
    incidents = tables["security_incidents"].groupBy(*keys).agg(F.count("*").alias("incidents"))
    counts = violations.join(incidents, keys, "full").na.fill(0, ["violations", "incidents"])
    return with_bands(counts)


def kpis_by_scope(tables: Tables) -> DataFrame:
    """Compliance, violations and cost per sprint for every choice of the team filter.

    The choices are each team and "All Teams". Rows of teams that are not listed
    count for "All Teams" alone. Every group of the team's own rows counts twice,
    once for each scope, after the fact rows have been aggregated.
    """
    keys = ["team_id", "sprint_id"]
    names = tables["teams"].select(F.col("id").alias("team_id"), F.col("name").alias("team"))

    def scoped(fact: str, *partial: Column) -> DataFrame:
        groups = tables[fact].groupBy(*keys).agg(*partial).join(names, "team_id", "left")
        scopes = F.explode(F.array("team", F.lit(fv.ALL_TEAMS))).alias("scope")
        return groups.select("*", scopes).filter(F.col("scope").isNotNull()).groupBy(
            "scope", "sprint_id"
        )

    compliance = scoped(
        "compliance_scores", F.sum("score").alias("s"), F.count("score").alias("n")
    ).agg(F.try_divide(F.sum("s"), F.sum("n")).alias("avg_compliance"))
    violations = scoped("policy_violations", F.count("*").alias("n")).agg(
        F.sum("n").alias("violations")
    )
    cost = scoped("token_usage", measures.usd_sum(F.col("cost_usd")).alias("usd")).agg(
        measures.usd_sum(F.col("usd")).alias("token_cost")
    )
    on = ["scope", "sprint_id"]
    return (
        compliance.join(violations, on, "full")
        .join(cost, on, "full")
        .select(
            *on,
            *_or_zero(*COMPARED),
        )
    )

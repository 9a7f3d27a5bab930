"""Alert rows made from the facts by thresholds."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stewardspark import fixed_values as fv
from stewardspark.functions import scalars
from stewardspark.operators.summaries import PER_TEAM_AND_SPRINT, token_budget
from stewardspark.tables import Tables


def threshold_alerts(
    tables: Tables,
    per_developer: int = fv.TOKENS_PER_DEVELOPER,
    compliance_below: int = fv.COMPLIANCE_ALERT_BELOW,
    milestone_pct: int = fv.ADOPTION_MILESTONE_PCT,
    policies: list[tuple] | None = None,
) -> DataFrame:
    """One alert per type, team and sprint (and category, for compliance) that is due.

    The five sources are unlike each other, so each is reduced to the groups that
    are due; names, texts and ids are added once, after the union. The quality gate's
    limit is that of ``policies``; where these have none, no such alert is due.
    """
    limit = F.lit(quality_limit(policies))
    nothing = F.lit(None).cast("string")

    def due(groups: DataFrame, alert_type: str, pct: Column = nothing, category: Column = nothing):
        return groups.select(
            *PER_TEAM_AND_SPRINT,
            F.lit(alert_type).alias("alert_type"),
            pct.cast("string").alias("pct"),
            category.alias("category"),
        )

    def means(table: str, column: str, *more: str) -> DataFrame:
        return tables[table].groupBy(*PER_TEAM_AND_SPRINT, *more).agg(F.avg(column).alias("mean"))

    whole_pct = F.floor("pct").cast("bigint")
    budget = token_budget(tables["token_usage"], tables["teams"], per_developer)
    scores = means("compliance_scores", "score", "category")
    quality = means("code_quality_metrics", "sonarqube_score")
    adoption = means("adoption_metrics", "adoption_rate_pct")
    exposures = (
        tables["security_incidents"]
        .filter(F.col("incident_type") == "pii_exposure")
        .groupBy(*PER_TEAM_AND_SPRINT)
        .agg(F.count("*").alias("n"))
    )
    all_due = reduce(
        DataFrame.unionByName,
        [
            due(budget.filter(F.col("status") != "ok"), "token_budget", whole_pct),
            due(
                scores.filter(F.col("mean") < compliance_below),
                "compliance_drop",
                category=F.col("category"),
            ),
            due(quality.filter(F.col("mean") < limit), "quality_gate"),
            due(exposures, "security_incident"),
            due(
                adoption.filter(F.col("mean") >= milestone_pct),
                "adoption_milestone",
                F.floor("mean").cast("bigint"),
            ),
        ],
    )
    return alert_rows(all_due, tables["teams"], tables["sprints"], compliance_below)


def quality_limit(policies: list[tuple] | None = None) -> float | None:
    """The quality gate's threshold in ``policies``, or in the built-in list if that is None."""
    limits = [p[6] for p in (fv.POLICIES if policies is None else policies) if p[0] == fv.QUALITY_GATE]
    return float(limits[0]) if limits and limits[0] is not None else None


def alert_rows(due: DataFrame, teams: DataFrame, sprints: DataFrame, compliance_below: int, *more: str):
    """Alerts from ``due`` (team_id, sprint_id, alert_type, pct, category and ``more``)."""
    teams = teams.select(F.col("id").alias("team_id"), F.col("name").alias("team"))
    sprints = sprints.select(F.col("id").alias("sprint_id"), "number")
    kind = F.col("alert_type")
    return (
        due.join(teams, "team_id")
        .join(sprints, "sprint_id")
        .select(
            F.concat_ws(":", "alert_type", "team_id", "sprint_id", "category").alias("id"),
            "team_id",
            "sprint_id",
            "alert_type",
            scalars.alert_severity(kind).alias("severity"),
            scalars.alert_title(kind).alias("title"),
            scalars.alert_message(
                kind,
                F.col("team"),
                F.col("pct"),
                F.lit(compliance_below),
                F.col("category"),
                F.col("number"),
            ).alias("message"),
            F.lit(fv.ALERT_SOURCE).alias("source"),
            F.lit(0).alias("acknowledged"),
            *more,
        )
    )

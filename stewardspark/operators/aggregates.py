"""Reports per team and sprint.

All of them aggregate the fact by its own keys first and only then look up team
and sprint names. The lookup joins then see one row per group instead of one per
fact row, and a team or sprint with very many rows shrinks before any shuffle.

With ``sprint_id`` a report covers that sprint; without, every sprint at once,
with the sprint as an extra column.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stewardspark.functions import measures, scalars


def one_or_every_sprint(fact: DataFrame, sprint_id: str | None) -> tuple[DataFrame, list[str]]:
    """The fact rows to report on, and the sprint columns to group by."""
    if sprint_id:
        return fact.filter(F.col("sprint_id") == sprint_id), []
    return fact, ["sprint_id"]


def with_team(groups: DataFrame, teams: DataFrame) -> DataFrame:
    """Replace ``team_id`` by the team's name; groups of unknown teams go."""
    names = teams.select(F.col("id").alias("team_id"), F.col("name").alias("team"))
    return groups.join(names, "team_id").drop("team_id")


def with_sprint(groups: DataFrame, sprints: DataFrame) -> DataFrame:
    """Add the sprint's name and number; groups of unknown sprints go."""
    names = sprints.select(
        F.col("id").alias("sprint_id"), F.col("name").alias("sprint"), "number"
    )
    return groups.join(names, "sprint_id")


def _sum_and_count(fact: DataFrame, keys: list[str]) -> DataFrame:
    return fact.groupBy(*keys).agg(
        F.sum("score").alias("score_sum"), F.count("score").alias("score_count")
    )


def _mean_of_sums() -> Column:
    return F.try_divide(F.sum("score_sum"), F.sum("score_count")).alias("score")


def mean_scores(scores, teams, sprint_id=None) -> DataFrame:
    """Unrounded mean score per team and category."""
    chosen, sprint = one_or_every_sprint(scores, sprint_id)
    sums = _sum_and_count(chosen, [*sprint, "team_id", "category"])
    return (
        with_team(sums, teams)
        .groupBy(*sprint, "team", "category")
        .agg(_mean_of_sums())
    )


def compliance_heatmap(scores, teams, sprint_id=None) -> DataFrame:
    """Mean score per team and category, to one decimal."""
    return mean_scores(scores, teams, sprint_id).withColumn("score", F.round("score", 1))


def token_summary(usage, teams, sprint_id=None) -> DataFrame:
    """Tokens and cost per team and model, dearest first."""
    chosen, sprint = one_or_every_sprint(usage, sprint_id)
    sums = chosen.groupBy(*sprint, "team_id", "model").agg(
        F.sum("total_tokens").alias("tokens"), measures.usd_sum(F.col("cost_usd")).alias("cost")
    )
    return (
        with_team(sums, teams)
        .groupBy(*sprint, "team", "model")
        .agg(
            F.sum("tokens").alias("total_tokens"),
            F.round(measures.usd_sum(F.col("cost")), 2).alias("total_cost"),
        )
        .orderBy(F.col("total_cost").desc_nulls_last(), *sprint, "team", "model")
    )


def compliance_trend(scores, teams, sprints) -> DataFrame:
    """Mean score per sprint and team, in the order of sprint numbers."""
    sums = _sum_and_count(scores, ["sprint_id", "team_id"])
    return (
        with_sprint(with_team(sums, teams), sprints)
        .groupBy("sprint", "team", "number")
        .agg(_mean_of_sums())
        .orderBy("number", "team")
        .select("sprint", "team", "score")
    )


def violations_by_severity(violations, sprint_id=None) -> DataFrame:
    """Violations per severity, worst first."""
    chosen, sprint = one_or_every_sprint(violations, sprint_id)
    rank = scalars.severity_rank(F.col("severity"))
    return (
        chosen.groupBy(*sprint, "severity")
        .agg(F.count("*").alias("count"))
        .orderBy(*sprint, rank, "severity")
    )

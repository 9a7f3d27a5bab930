"""Top-k alerts and the choice of a sprint."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stewardspark.functions import scalars
from stewardspark.operators.reads import with_team_name

SHOWN_ALERTS = 8


def active_alerts(alerts, teams, sprint_id=None, n: int = SHOWN_ALERTS) -> DataFrame:
    """The ``n`` gravest unacknowledged alerts of one sprint, or of each sprint.

    For each sprint, every task keeps only its own first ``n`` rows per sprint
    before the shuffle, so a sprint with very many alerts moves few rows.
    """
    open_alerts = alerts.filter(F.col("acknowledged") == 0)
    rank = scalars.severity_rank(F.col("severity"), "alerts")
    text = F.concat(F.lit("**"), "team_name", F.lit("** — "), "message").alias("text")
    if sprint_id:
        chosen = open_alerts.filter(F.col("sprint_id") == sprint_id)
        return with_team_name(chosen, teams).orderBy(rank, "id").limit(n).select("*", text)
    first = Window.partitionBy("sprint_id").orderBy(rank, "id")
    return (
        with_team_name(open_alerts, teams)
        .withColumn("position", F.row_number().over(first))
        .filter(F.col("position") <= n)
        .drop("position")
        .select("*", text)
    )


def latest_sprint(sprints: DataFrame) -> DataFrame:
    """The sprint with the highest number."""
    return sprints.orderBy(F.col("number").desc_nulls_last(), "id").limit(1)


def sprint_named(sprints: DataFrame, name: str) -> DataFrame:
    return sprints.filter(F.col("name") == name)

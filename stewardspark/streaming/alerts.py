"""Threshold alerts kept up to date over streams of facts.

Each fact is reduced to readings of one form; their sums and counts per alert type,
team, sprint and category are the stream's state, one row a group however many facts
come. After each micro-batch the groups that changed are judged, and the outcome is
written under the alert's id. An alert is due or not; the last outcome counts, and the
first time it was due is when it was raised. A micro-batch that is run again replaces
its own folder, so nothing is raised twice.
"""

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from stewardspark import fixed_values as fv
from stewardspark.operators.alerting import alert_rows, quality_limit
from stewardspark.operators.summaries import team_budget

# alert type -> (fact table, which rows, what is summed, category)
READINGS = {
    "token_budget": ("token_usage", "true", "total_tokens", "NULL"),
    "compliance_drop": ("compliance_scores", "true", "score", "category"),
    "quality_gate": ("code_quality_metrics", "true", "sonarqube_score", "NULL"),
    "security_incident": ("security_incidents", "incident_type = 'pii_exposure'", "1", "NULL"),
    "adoption_milestone": ("adoption_metrics", "true", "adoption_rate_pct", "NULL"),
}
GROUP = ["alert_type", "team_id", "sprint_id", "category"]
ALERT_COLUMNS = [
    "id", "team_id", "sprint_id", "alert_type", "severity", "title", "message", "source", "acknowledged",
]
LOG_SCHEMA = (
    ", ".join(f"{c} {'int' if c == 'acknowledged' else 'string'}" for c in ALERT_COLUMNS)
    + ", due boolean, judged_at timestamp, alert_stream string, alert_batch bigint"
)


def readings(facts: dict[str, DataFrame]) -> DataFrame:
    """The fact tables, streams or not, as rows of ``GROUP`` and an amount."""
    return reduce(
        DataFrame.unionByName,
        [
            facts[table].filter(rows).selectExpr(
                f"'{kind}' AS alert_type", "team_id", "sprint_id",
                f"CAST({category} AS STRING) AS category", f"CAST({amount} AS DOUBLE) AS amount",
            )
            for kind, (table, rows, amount, category) in READINGS.items()
        ],
    )


def group_sums(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*GROUP).agg(F.sum("amount").alias("total"), F.count("amount").alias("n"))


def judged(
    sums: DataFrame,
    teams: DataFrame,
    sprints: DataFrame,
    per_developer: int = fv.TOKENS_PER_DEVELOPER,
    compliance_below: int = fv.COMPLIANCE_ALERT_BELOW,
    milestone_pct: int = fv.ADOPTION_MILESTONE_PCT,
    policies: list[tuple] | None = None,
) -> DataFrame:
    """Alert rows of all groups in ``sums``, with ``due``: the rules of ``threshold_alerts``."""
    budgets = teams.select(F.col("id").alias("team_id"), team_budget(per_developer).alias("budget"))
    kind, mean = F.col("alert_type"), F.col("total") / F.col("n")
    pct = 100.0 * F.col("total") / F.col("budget")
    due = (
        F.when(kind == "token_budget", pct >= fv.BUDGET_ALERT_PCT)
        .when(kind == "compliance_drop", mean < compliance_below)
        .when(kind == "quality_gate", mean < F.lit(quality_limit(policies)))
        .when(kind == "security_incident", F.col("n") > 0)
        .when(kind == "adoption_milestone", mean >= milestone_pct)
    )
    shown = F.when(kind == "token_budget", F.floor(pct)).when(kind == "adoption_milestone", F.floor(mean))
    groups = sums.join(budgets, "team_id").select(
        *GROUP, shown.cast("bigint").cast("string").alias("pct"), F.coalesce(due, F.lit(False)).alias("due")
    )
    return alert_rows(groups, teams, sprints, compliance_below, "due")


def start_alert_stream(
    facts: dict[str, DataFrame], teams: DataFrame, sprints: DataFrame, landing: str, checkpoint: str, **limits
) -> StreamingQuery:
    """Keep the alerts of streams of the five fact tables in a log below ``landing``.

    The state is one sum and count per alert type, team, sprint and category. Rows of
    teams or sprints that are not listed raise nothing; their sums are kept, and judged
    when a fact of the group comes after they were listed. ``limits`` are those of
    ``judged``.
    """

    def store(batch: DataFrame, number: int) -> None:
        stream = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        rows = judged(batch, teams, sprints, **limits).withColumn("judged_at", F.current_timestamp())
        folder = f"{landing}/alert_stream={stream}/alert_batch={number}"
        rows.write.mode("overwrite").parquet(folder)

    return (
        group_sums(readings(facts)).writeStream.outputMode("update").foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_alert_log(spark: SparkSession, landing: str) -> DataFrame:
    """Every outcome as it was written; none before the stream had any input."""
    try:
        return spark.read.schema(LOG_SCHEMA).parquet(landing)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LOG_SCHEMA)


def current_alerts(spark: SparkSession, landing: str) -> DataFrame:
    """The alerts that are due now, once each, with when they were first raised.

    The last outcome of an id counts. The log is as long as groups have changed, not as
    facts have come, and is reduced in each task before the shuffle.
    """
    log = read_alert_log(spark, landing)
    last = F.max_by(F.struct(*ALERT_COLUMNS[1:], "due"), F.struct("judged_at", "alert_batch")).alias("last")
    raised = F.min(F.when(F.col("due"), F.col("judged_at"))).alias("raised_at")
    per_alert = log.groupBy("id").agg(last, raised)
    return per_alert.filter("last.due").select("id", *[f"last.{c}" for c in ALERT_COLUMNS[1:]], "raised_at")

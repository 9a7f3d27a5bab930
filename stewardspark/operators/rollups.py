"""The headline figures kept as partial sums, so that new facts alone are read.

A batch of new facts is reduced to a sum and a count per figure, team and sprint and
stored under its key. Figures of any sprint and team come from these rows, however many
facts there are. A correction is a batch that takes away the rows as they were and adds
them as they are. A batch that is delivered again replaces itself. ``fold`` adds up what
has been stored, so that the number of batches does not matter either.

Amounts are summed in whole millionths: sums are exact, whatever is added or taken away
in whatever order.
"""

import re
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stewardspark.functions.measures import MICRO
from stewardspark.operators.kpis import sprint_previous, team_scope, with_changes
from stewardspark.sources import folders

# figure -> (fact table, what is summed; rows are counted where that is None)
FIGURES = {
    "avg_compliance": ("compliance_scores", "score"),
    "violations": ("policy_violations", None),
    "token_cost": ("token_usage", "cost_usd"),
    "adoption_rate": ("adoption_metrics", "adoption_rate_pct"),
    "incidents": ("security_incidents", None),
}
KEYS = ["figure", "team_id", "sprint_id"]
SUMS_SCHEMA = "figure string, team_id string, sprint_id string, total bigint, n bigint"
_COMPLETE, _FOLDED = "_COMPLETE", "_folded"


def partial_sums(facts: Mapping[str, DataFrame], sign: int = 1) -> list[DataFrame]:
    """Sums and counts of the fact tables given, of those that have a figure."""
    parts = []
    for figure, (table, column) in FIGURES.items():
        if table in facts:
            amount = F.rint(F.col(column) * MICRO).cast("bigint") if column else F.lit(0).cast("bigint")
            sums = facts[table].groupBy("team_id", "sprint_id").agg(
                (F.coalesce(F.sum(amount), F.lit(0)) * sign).alias("total"),
                (F.count(column or "*") * sign).alias("n"),
            )
            parts.append(sums.select(F.lit(figure).alias("figure"), "team_id", "sprint_id", "total", "n"))
    return parts


def _added_up(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*KEYS).agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


def _generation(spark: SparkSession, root: str) -> tuple[int, str] | None:
    numbers = [int(n.split("-")[1]) for n in folders.names(spark, root) if n.startswith("generation-")]
    for number in sorted(numbers, reverse=True):
        path = f"{root}/generation-{number}"
        if folders.exists(spark, f"{path}/{_COMPLETE}"):
            return number, path
    return None


def _folded(spark: SparkSession, root: str) -> set[str]:
    last = _generation(spark, root)
    if last is None:
        return set()
    return {row.key for row in spark.read.schema("key string").parquet(f"{last[1]}/{_FOLDED}").collect()}


def add_batch(
    spark: SparkSession,
    root: str,
    key: str,
    added: Mapping[str, DataFrame],
    removed: Mapping[str, DataFrame] | None = None,
) -> bool:
    """Store the sums of a batch under its ``key``; False if they are folded in already.

    ``added`` and ``removed`` hold the batch's rows by table. With the same key the
    same rows must come: what was stored under it is replaced.
    """
    if not re.fullmatch(r"[\w-]+", key, re.ASCII):
        raise ValueError("a key is made of letters, digits, _ and -")
    if key in _folded(spark, root):
        return False
    parts = partial_sums(added) + partial_sums(removed or {}, -1)
    if not parts:
        parts = [spark.createDataFrame([], SUMS_SCHEMA)]
    rows = _added_up(reduce(DataFrame.unionByName, parts))
    rows.coalesce(1).write.mode("overwrite").parquet(f"{root}/batches/batch={key}")
    return True


def read_sums(spark: SparkSession, root: str) -> DataFrame:
    """The sums of all batches, one row per figure, team and sprint."""
    last, folded = _generation(spark, root), _folded(spark, root)
    names = folders.names(spark, f"{root}/batches")
    paths = [f"{root}/batches/{n}" for n in names if n.partition("=")[2] not in folded]
    paths += [last[1]] if last else []
    if not paths:
        return spark.createDataFrame([], SUMS_SCHEMA)
    return _added_up(spark.read.schema(SUMS_SCHEMA).parquet(*paths).select(*KEYS, "total", "n"))


def fold(spark: SparkSession, root: str) -> int:
    """Add up all batches into one generation; how many were folded in.

    It counts once it is complete, so a fold that is cut off changes nothing. Batches
    folded in by the one before are removed; this one's stay for who is reading them.
    """
    last, folded = _generation(spark, root), _folded(spark, root)
    keys = {name.partition("=")[2] for name in folders.names(spark, f"{root}/batches")}
    path = f"{root}/generation-{last[0] + 1 if last else 0}"
    read_sums(spark, root).coalesce(1).write.mode("overwrite").parquet(path)
    rows = spark.createDataFrame([(key,) for key in sorted(keys | folded)], "key string")
    rows.coalesce(1).write.mode("overwrite").parquet(f"{path}/{_FOLDED}")
    folders.mark(spark, f"{path}/{_COMPLETE}")
    for key in keys & folded:
        folders.remove(spark, f"{root}/batches/batch={key}")
    return len(keys - folded)


def figures(sums: DataFrame, teams: DataFrame, sprints: DataFrame, team: str | None = None) -> DataFrame:
    """The five figures of every sprint from stored sums, as ``kpis.every_sprint`` gives them."""

    def of(figure: str, column: str):
        return F.sum(F.when(F.col("figure") == figure, F.col(column)))

    def value(figure: str):
        if FIGURES[figure][1] is None:
            return of(figure, "n")
        amount = of(figure, "total") / F.lit(float(MICRO))
        return amount if figure == "token_cost" else F.try_divide(amount, of(figure, "n"))

    rows = team_scope(sums, teams, team).groupBy("sprint_id")
    per_sprint = rows.agg(*[value(figure).alias(figure) for figure in FIGURES])
    listed = sprints.select(F.col("id").alias("sprint_id")).join(per_sprint, "sprint_id", "left")
    return listed.select("sprint_id", *[F.coalesce(f, F.lit(0)).alias(f) for f in FIGURES])


def kpi_deltas(sums: DataFrame, teams: DataFrame, sprints: DataFrame, team: str | None = None) -> DataFrame:
    """``kpis.kpi_deltas`` of every sprint, from stored sums."""
    now = figures(sums, teams, sprints, team)
    return with_changes(sprint_previous(sprints), now, now)

"""Data quality: what a database would refuse, found as rows.

Parquet enforces no key, reference or NOT NULL, so each rule is a query over the
stored tables. ``frames`` maps table names to DataFrames; a table may be checked
under the rules of another one, as a feed is under those of its target.
"""

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stewardspark import fixed_values as fv
from stewardspark.schemas import TABLES, TableSpec


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _rules(name: str, rules: dict[str, str] | None) -> TableSpec:
    return TABLES[(rules or {}).get(name, name)]


def pk_duplicates(frames: dict[str, DataFrame]) -> DataFrame:
    """Ids that occur more than once, with their number of rows."""
    return _union(
        [
            df.filter(F.col("id").isNotNull())
            .groupBy("id")
            .agg(F.count("*").alias("row_count"))
            .filter(F.col("row_count") > 1)
            .select(F.lit(name).alias("table_name"), "id", "row_count")
            for name, df in frames.items()
        ]
    )


def null_counts(frames: dict[str, DataFrame], rules: dict[str, str] | None = None) -> DataFrame:
    """NULLs in each required column; one pass over each table."""
    parts = []
    for name, df in frames.items():
        required = _rules(name, rules).required
        nulls = df.agg(
            *[
                F.coalesce(F.sum(F.col(c).isNull().cast("int")), F.lit(0)).alias(c)
                for c in required
            ]
        )
        long = nulls.unpivot([], list(required), "column_name", "null_count")
        parts.append(long.select(F.lit(name).alias("table_name"), "column_name", "null_count"))
    return _union(parts)


def fk_orphans(
    frames: dict[str, DataFrame],
    teams: DataFrame,
    sprints: DataFrame,
    rules: dict[str, str] | None = None,
) -> DataFrame:
    """Team and sprint ids that do not exist, with their number of rows.

    Rows are counted per pair of ids first, in one scan of a table; only the distinct
    ids are looked up.
    """
    known = {"teams": teams, "sprints": sprints}
    parts = []
    for name, df in frames.items():
        references = _rules(name, rules).references
        if not references:
            continue
        ids = _union(
            [
                known[target].select(F.lit(column).alias("column_name"), F.col("id").alias("key"))
                for column, target in references.items()
            ]
        )
        used = _values_counted(df, list(references), "key").filter(F.col("key").isNotNull())
        used = used.groupBy("column_name", "key").agg(F.sum("row_count").alias("row_count"))
        parts.append(
            used.join(ids, ["column_name", "key"], "left_anti").select(
                F.lit(name).alias("table_name"), "column_name", "key", "row_count"
            )
        )
    return _union(parts)


def _values_counted(df: DataFrame, columns: list[str], value: str) -> DataFrame:
    """(column_name, value, row_count): the columns' values, from one grouped scan."""
    counted = df.groupBy(*columns).agg(F.count("*").alias("row_count"))
    each = [F.struct(F.lit(c).alias("column_name"), F.col(c).alias(value)) for c in columns]
    return counted.select(F.inline(F.array(*each)), "row_count")


def domain_check(frames: dict[str, DataFrame], rules: dict[str, str] | None = None) -> DataFrame:
    """Categories and severities outside the known lists, with their number of rows.

    One scan of each table that has such columns.
    """
    parts = []
    for name, df in frames.items():
        spec = _rules(name, rules)
        severities = fv.ALERT_SEVERITIES if spec.name == "alerts" else fv.SEVERITIES
        allowed = {"category": fv.CATEGORIES, "severity": severities}
        columns = [column for column in allowed if column in spec.columns]
        if not columns:
            continue
        unknown = F.lit(False)
        for column in columns:
            outside = ~F.col("value").isin(allowed[column])
            unknown = unknown | ((F.col("column_name") == column) & outside)
        values = _values_counted(df, columns, "value").filter(unknown)
        values = values.groupBy("column_name", "value").agg(F.sum("row_count").alias("row_count"))
        parts.append(
            values.select(F.lit(name).alias("table_name"), "column_name", "value", "row_count")
        )
    return _union(parts)


def with_faults(
    rows: DataFrame,
    teams: DataFrame,
    sprints: DataFrame,
    required: Iterable[str],
    references: dict[str, str],
    *more: Column,
) -> DataFrame:
    """Rows with a text ``faults`` that names what is missing or unknown, else empty.

    ``more`` are further faults of a row, each a text or NULL.
    """
    known = {"teams": teams, "sprints": sprints}
    missing = [F.when(F.col(c).isNull(), f"missing {c}") for c in required]
    unknown = []
    looked_up = rows
    for column, target in references.items():
        ids = known[target].select(F.col("id").alias(column)).distinct()
        found = ids.withColumn(f"known_{column}", F.lit(True))
        looked_up = looked_up.join(found, column, "left")
        absent = F.col(column).isNotNull() & F.col(f"known_{column}").isNull()
        unknown.append(F.when(absent, f"unknown {column}"))
    faults = F.concat_ws("; ", *missing, *more, *unknown).alias("faults")
    return looked_up.select(*rows.columns, faults)


def refused_rows(df: DataFrame, name: str, teams: DataFrame, sprints: DataFrame) -> DataFrame:
    """Rows that lack a required value or name an unknown team or sprint, with why.

    Take them out of a table before it is stored; ``pk_duplicates`` finds the ids
    that repeat.
    """
    spec = TABLES[name]
    judged = with_faults(df, teams, sprints, spec.required, spec.references)
    return judged.filter(F.col("faults") != "")


def pii_type_rule(incidents: DataFrame) -> DataFrame:
    """Incidents that name a kind of personal data though their type has none."""
    personal = F.col("incident_type").like("%pii%") | F.col("incident_type").like("%data%")
    return incidents.filter(F.col("pii_type").isNotNull() & ~personal)

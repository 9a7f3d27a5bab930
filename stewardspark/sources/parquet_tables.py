"""Reading, writing and refreshing the ten tables as Parquet, and SQL over them.

Fact tables are partitioned by sprint, the column nearly every question filters.

The tables lie below a root, or in a snapshot below ``<root>/_versions``. Which snapshot
counts is said by the marks in ``<root>/_published``: the last one. Reading and writing
look there first, so all ten tables change at one moment.
"""

import re
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from stewardspark.schemas import TABLES, TableSpec
from stewardspark.session import shuffles_dropped
from stewardspark.sources import folders
from stewardspark.tables import Tables


def current_root(spark: SparkSession, root: str) -> str:
    """Where the tables lie: the snapshot published last, else ``root`` itself."""
    published = folders.names(spark, f"{root}/_published")
    return f"{root}/_versions/{published[-1]}" if published else root


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return _read(spark, current_root(spark, root), name)


def _read(spark: SparkSession, place: str, name: str) -> DataFrame:
    spec = TABLES[name]
    return spark.read.schema(spec.schema).parquet(f"{place}/{name}").select(*spec.columns)


def load_tables(spark: SparkSession, root: str) -> Tables:
    """The ten tables below ``root``, each with its declared types, all of one snapshot."""
    place = current_root(spark, root)
    return Tables({name: lambda name=name: _read(spark, place, name) for name in TABLES})


def apply_defaults(df: DataFrame, spec: TableSpec, *more: Column | str) -> DataFrame:
    """``df`` with all columns of the table, and those in ``more``.

    A column that ``df`` lacks is filled with its default, or NULL without one. A
    column that is there keeps its values, NULLs included.
    """

    given = set(df.columns)

    def value(column: str) -> str:
        source = f"`{column}`" if column in given else spec.defaults.get(column, "NULL")
        kind = spec.schema[column].dataType.simpleString()
        return f"CAST({source} AS {kind}) AS `{column}`"

    return df.select(*[F.expr(value(column)) for column in spec.columns], *more)


#: Between strings that travel as one, and before a letter that stands for what they may not hold.
_NEXT, _MARK = "\x01", "\x02"


def rebalanced(rows: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """The same rows, those alike in ``columns`` together as far as they fit one task.

    The other strings travel as one: a row then has one field of changing width instead of
    one for each string, and what rows say again and again compresses better. What comes out
    is byte for byte what went in, NULLs and empty strings included.
    """
    texts = [f.name for f in rows.schema if f.dataType == StringType() and f.name not in columns]
    rest = [F.col(column) for column in rows.columns if column not in texts]
    mark, following, null = F.lit(_MARK), F.lit(_NEXT), F.lit(f"{_MARK}n")
    marked = [F.replace(F.replace(text, mark, F.lit(f"{_MARK}m")), following, F.lit(f"{_MARK}x"))
              for text in map(F.col, texts)]
    together = F.concat_ws(_NEXT, *[F.coalesce(text, null) for text in marked])
    moved = rows.select(*rest, together.alias("_texts")).hint("rebalance", *map(F.col, columns))
    # Splitting goes through Java's strings, which would change bytes that are no UTF-8.
    apart = moved.withColumn("_parts", F.when(F.is_valid_utf8("_texts"), F.split("_texts", _NEXT)))
    out = {}
    for i, text in enumerate(texts):
        slow = F.substring_index(F.substring_index("_texts", _NEXT, i + 1), _NEXT, -1)
        own = F.when(F.col("_parts").isNull(), slow).otherwise(F.get("_parts", F.lit(i)))
        plain = F.replace(F.replace(own, F.lit(f"{_MARK}x"), following), F.lit(f"{_MARK}m"), mark)
        out[text] = F.when(own != null, F.when(F.contains(own, mark), plain).otherwise(own))
    return apart.select(*[out.get(column, F.col(column)).alias(column) for column in rows.columns])


def write_table(df: DataFrame, root: str, name: str, mode: str = "append") -> None:
    """Add rows to a table, or replace it with ``mode="overwrite"``.

    ``rebalanced`` brings the rows of a sprint together, so that a sprint gets few
    large files, and lets adaptive execution split a sprint that is too large for
    one task. What is written does not change. ``overwrite`` replaces the whole table
    whatever the session's setting. An empty partition value is refused: a path
    cannot hold it, and it would be read back as NULL.
    """
    spec = TABLES[name]
    rows = apply_defaults(df, spec)
    for column in spec.partition_by:
        refused = F.raise_error(F.lit(f"{name}: empty {column}"))
        value = F.when(F.col(column) == "", refused).otherwise(F.col(column))
        rows = rows.withColumn(column, value)
    writer = rebalanced(rows, spec.partition_by).write.mode(mode).option("partitionOverwriteMode", "static")
    place = current_root(df.sparkSession, root)
    writer.partitionBy(*spec.partition_by).parquet(f"{place}/{name}")


def full_refresh(tables: Tables, root: str) -> None:
    """Replace all ten tables, the referenced ones first.

    Each table is replaced as a whole, but not all ten at one moment, for which there is
    ``snapshot_refresh``. Load the tables again afterwards: a DataFrame from before still names the old files.

    The tables that refer to them are written side by side: each job ends with a
    few long tasks, and the other jobs fill the cores left free by then. What a table's
    rows took on disk to be shuffled is free again once it is written, not when the
    driver next collects garbage.
    """

    def refresh(name: str) -> None:
        write_table(tables[name], root, name, mode="overwrite")

    referenced = {target for spec in TABLES.values() for target in spec.references.values()}
    dropped = shuffles_dropped(tables["teams"].sparkSession)
    with dropped, ThreadPoolExecutor(max_workers=len(TABLES)) as pool:
        for names in (referenced, TABLES.keys() - referenced):
            list(pool.map(refresh, sorted(names)))


def snapshot_refresh(tables: Tables, root: str) -> str:
    """Replace all ten tables at one moment; the name of the snapshot.

    They are written to a folder of their own and then published by one mark. A refresh
    that is cut off, at whichever table, publishes nothing: readers stay with the
    snapshot before, which a DataFrame made earlier goes on reading in any case. What
    is left of it goes with ``drop_old_snapshots``.
    """
    spark = tables["teams"].sparkSession
    numbers = [int(name.split("-")[0]) for name in folders.names(spark, f"{root}/_versions")]
    name = f"{max(numbers, default=0) + 1:012d}-{uuid.uuid4().hex}"
    full_refresh(tables, f"{root}/_versions/{name}")
    folders.mark(spark, f"{root}/_published/{name}")
    return name


def drop_old_snapshots(spark: SparkSession, root: str, keep: int = 2) -> list[str]:
    """Remove all but the last ``keep`` published snapshots, and unpublished ones before those."""
    if keep < 1:
        raise ValueError("at least one snapshot stays")
    published = folders.names(spark, f"{root}/_published")
    kept = published[-keep:]
    gone = [n for n in folders.names(spark, f"{root}/_versions") if kept and n < kept[0]]
    for name in gone:
        folders.remove(spark, f"{root}/_published/{name}")
        folders.remove(spark, f"{root}/_versions/{name}")
    return gone


_STARTS_WITH_CTE = re.compile(r"(?:\s|--[^\n]*(?:\n|$)|/\*.*?\*/)*WITH\b", re.IGNORECASE | re.DOTALL)


def run_query(tables: Tables, sql: str, params: tuple | list | dict = ()) -> DataFrame:
    """Run the text of one query over the tables with values bound to ``?`` or ``:name``.

    The text stays as it is: the tables stand before it as common table expressions, so
    aliases, column names and expressions of its own may bear a table's name, which
    then means what SQL says. They read views with names of their own, gone when the
    text has been read, so a caller's views are neither used nor replaced. Only tables
    whose name occurs in the text are looked up.
    """
    if not isinstance(params, dict):
        params = list(params)
    mark = uuid.uuid4().hex
    named = [name for name in tables if re.search(rf"\b{name}\b", sql, re.IGNORECASE)]
    text, spark = sql.strip().rstrip(";"), SparkSession.active()
    try:
        for name in named:
            tables[name].createOrReplaceTempView(f"{name}_{mark}")
            spark = tables[name].sparkSession
        if named:
            before = ", ".join(f"{name} AS (SELECT * FROM {name}_{mark})" for name in named)
            own = f"SELECT * FROM (\n{text}\n)" if _STARTS_WITH_CTE.match(text) else text
            text = f"WITH {before}\n{own}"
        return spark.sql(text, args=params or None)
    finally:
        for name in named:
            spark.catalog.dropTempView(f"{name}_{mark}")


def row_and_null_counts(tables: Tables) -> DataFrame:
    """Rows and NULL cells of each table, one pass over each."""
    counts = None
    for name in tables:
        df = tables[name]
        nulls = sum((F.col(column).isNull().cast("int") for column in df.columns), F.lit(0))
        one = df.agg(
            F.lit(name).alias("table_name"),
            F.count("*").alias("row_count"),
            F.coalesce(F.sum(nulls), F.lit(0)).alias("null_count"),
        )
        counts = one if counts is None else counts.unionByName(one)
    return counts

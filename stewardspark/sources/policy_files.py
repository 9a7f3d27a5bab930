"""Policy files, read by Spark: one policy a line as JSON, or a whole YAML document.

Each row is checked; those that fail are set apart with their reasons and text, so that
one faulty policy stops neither the others nor the report.
"""

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stewardspark import fixed_values as fv
from stewardspark.sources.dimensions import POLICY_COLUMNS, PolicyFile, parse_policy_text

_FIELDS = (
    "id string, name string, description string, category string, severity string, "
    "applies_to array<string>, threshold double, tool string"
)
REQUIRED = ["id", "name", "category", "severity"]
#: A policy list is written by hand; where one is needed on the driver it has at most so many rows.
MOST_POLICIES = 10_000


def read_policy_lines(spark: SparkSession, path: str) -> DataFrame:
    """Judged rows of a file or folder with one policy a line, as JSON. Empty lines are passed over."""
    return judge_policies(spark.read.text(path))


def read_policy_document(spark: SparkSession, path: str) -> tuple[DataFrame, PolicyFile]:
    """Judged rows of a YAML (or JSON) document, and the rest of it: roles and token budget.

    The document is a setting of some pages, so it goes through the driver whole.
    """
    documents = spark.read.text(path, wholetext=True).limit(2).collect()
    if len(documents) != 1:
        raise ValueError(f"{path} is {len(documents) or 'no'} documents, not one")
    parsed = parse_policy_text(documents[0].value)
    lines = [(json.dumps(dict(zip(POLICY_COLUMNS[1:], row, strict=True))),) for row in parsed.policies]
    return judge_policies(spark.createDataFrame(lines, "value string")), parsed


def judge_policies(lines: DataFrame) -> DataFrame:
    """Policies from ``lines`` (value), with ``reasons``, '' if there are none, and their ``line``.

    Refused are lines that are no JSON of the right types, rows without a required
    field or with an empty one, severities and categories outside the lists, negative
    thresholds, and ids given to unlike rows. A row that is there twice counts once.
    """
    value = F.trim("value")
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    parsed = F.from_json(value, f"{_FIELDS}, _corrupt string", options)
    rows = lines.filter(value != "").select(value.alias("line"), parsed.alias("p")).select("line", "p.*")
    rows = rows.dropDuplicates(POLICY_COLUMNS[1:] + ["_corrupt"])

    def fault(when: Column, text: str) -> Column:
        return F.when(when, text)

    copies = F.count("*").over(Window.partitionBy("id"))
    reasons = F.concat_ws(
        "; ",
        fault(F.col("_corrupt").isNotNull(), "unreadable"),
        *[
            fault(F.col("_corrupt").isNull() & (F.coalesce(F.trim(c), F.lit("")) == ""), f"missing {c}")
            for c in REQUIRED
        ],
        fault(~F.col("severity").isin(fv.SEVERITIES), "unknown severity"),
        fault(~F.col("category").isin(list(fv.CATEGORIES)), "unknown category"),
        fault(F.col("threshold") < 0, "negative threshold"),
        fault(F.col("id").isNotNull() & (copies > 1), "id given twice"),
    )
    return rows.withColumn("reasons", reasons).drop("_corrupt")


def accepted_policies(judged: DataFrame) -> DataFrame:
    """The policies without a fault, numbered from 0 in ``idx`` by id: a short list."""
    number = F.row_number().over(Window.orderBy("id")) - 1
    kept = judged.filter("reasons = ''").select(number.alias("idx"), *POLICY_COLUMNS[1:])
    return kept.withColumn("applies_to", F.coalesce("applies_to", F.array().cast("array<string>")))


def refused_policies(judged: DataFrame) -> DataFrame:
    return judged.filter("reasons <> ''").select("id", "reasons", "line")


def policy_list(policies: DataFrame) -> list[tuple]:
    """``policies`` as the reports take them that need their thresholds beforehand."""
    rows = policies.select(POLICY_COLUMNS[1:]).orderBy("id").limit(MOST_POLICIES + 1).collect()
    if len(rows) > MOST_POLICIES:
        raise ValueError(f"more than {MOST_POLICIES} policies")
    return [tuple(row) for row in rows]

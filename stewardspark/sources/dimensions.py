"""Small dimensions that come from configuration: policies, roles, prices.

They are made from Arrow tables, which Spark plans as local relations with a
known size. No join below carries a broadcast hint: Spark itself compares that
size with ``spark.sql.autoBroadcastJoinThreshold`` and shuffles a larger side.
"""

from decimal import Decimal
from pathlib import Path
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stewardspark import fixed_values as fv
from stewardspark.functions.measures import MICRO

POLICY_COLUMNS = [
    "idx", "id", "name", "description", "category", "severity", "applies_to", "threshold", "tool",
]


def policy_dim(spark: SparkSession, policies: list[tuple] | None = None) -> DataFrame:
    """One row per policy in file order, numbered from 0 in ``idx``."""
    rows = [(idx, *policy) for idx, policy in enumerate(policies or fv.POLICIES)]
    schema = pa.schema(
        [
            ("idx", pa.int32()),
            ("id", pa.string()),
            ("name", pa.string()),
            ("description", pa.string()),
            ("category", pa.string()),
            ("severity", pa.string()),
            ("applies_to", pa.list_(pa.string())),
            ("threshold", pa.float64()),
            ("tool", pa.string()),
        ]
    )
    columns = [list(column) for column in zip(*rows)]
    return spark.createDataFrame(pa.table(columns, schema=schema))


class PolicyFile(NamedTuple):
    policies: list[tuple]  # for policy_dim
    role_policies: dict[str, list[str]]  # for role_policies
    token_budget: dict  # keyword arguments of token_budget


def read_policy_file(path: str) -> PolicyFile:
    """The contents of a YAML policy file on the driver, unchecked.

    ``policy_files`` reads one wherever Spark can, and checks its rows.
    """
    return parse_policy_text(Path(path).read_text(encoding="utf-8"))


def parse_policy_text(text: str) -> PolicyFile:
    try:
        import yaml
    except ImportError as error:
        raise ImportError("reading a policy file needs the yaml package") from error
    content = yaml.safe_load(text)
    budget = content.get("token_budgets") or {}
    arguments = {
        "per_developer": budget.get("per_developer_per_sprint"),
        "multiplier": budget.get("per_team_per_sprint_multiplier"),
        "alert_pct": budget.get("alert_threshold_pct"),
        "escalation_pct": budget.get("escalation_threshold_pct"),
    }
    arguments = {name: value for name, value in arguments.items() if value is not None}
    if "multiplier" in arguments:
        arguments["multiplier"] = str(arguments["multiplier"])
    return PolicyFile(
        [tuple(policy.get(c) for c in POLICY_COLUMNS[1:]) for policy in content["policies"]],
        {role: rights.get("policies", []) for role, rights in content.get("roles", {}).items()},
        arguments,
    )


def policy_roles(policies: DataFrame) -> DataFrame:
    """One row per policy and role it applies to."""
    return policies.select(
        F.col("id").alias("policy_id"), F.explode("applies_to").alias("role")
    )


def role_policies(
    spark: SparkSession, roles: dict[str, list[str]] | None = None
) -> DataFrame:
    """One row per role and policy listed for it."""
    roles = fv.ROLE_POLICIES if roles is None else roles
    pairs = [(role, policy) for role, listed in roles.items() for policy in listed]
    return spark.createDataFrame(
        pa.table(
            [[role for role, _ in pairs], [policy for _, policy in pairs]],
            schema=pa.schema([("role", pa.string()), ("policy_id", pa.string())]),
        )
    )


def model_price_dim(
    spark: SparkSession, prices: dict[str, tuple[str, str]] | None = None
) -> DataFrame:
    """USD per 1000 input and output tokens of each model."""
    prices = prices or fv.MODEL_PRICES
    usd = pa.decimal128(9, 6)
    schema = pa.schema(
        [("model", pa.string()), ("input_cost_per_1k", usd), ("output_cost_per_1k", usd)]
    )
    columns = [
        list(prices),
        [Decimal(price[0]) for price in prices.values()],
        [Decimal(price[1]) for price in prices.values()],
    ]
    arrays = [pa.array(column, type=kind) for column, kind in zip(columns, schema.types)]
    return spark.createDataFrame(pa.table(arrays, schema=schema))


def micro_prices(prices: DataFrame) -> DataFrame:
    """Prices in whole micro-USD, for exact integer cost arithmetic."""
    return prices.select(
        "model",
        (F.col("input_cost_per_1k") * MICRO).cast("bigint").alias("input_price"),
        (F.col("output_cost_per_1k") * MICRO).cast("bigint").alias("output_price"),
    )

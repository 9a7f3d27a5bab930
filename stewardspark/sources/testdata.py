"""The ten tables derived from the order, line item and event tables.

FIXTURES.md section 2 states the same derivation column by column. Every fact is
a projection of whole input tables, so its size grows with them. Customers and
suppliers grow too, hence no broadcast hint: Spark picks the join by size, and
adaptive execution splits a supplier or customer that holds too many rows.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stewardspark.functions import calendar, measures
from stewardspark.operators.usage import with_token_cost
from stewardspark.schemas import TABLES
from stewardspark.sources.dimensions import model_price_dim, policy_dim
from stewardspark.sources.parquet_tables import apply_defaults
from stewardspark.tables import Tables

BASE_DATE = "1995-01-01"

SOURCES = {
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": """c_custkey bigint, c_name string, c_nationkey int, c_acctbal double,
        c_mktsegment string""",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "orders": """o_orderkey bigint, o_custkey bigint, o_orderstatus string,
        o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string""",
    "lineitem": """l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int,
        l_quantity double, l_extendedprice double, l_discount double, l_tax double,
        l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz""",
    "events": """event_id bigint, ts timestamp_ntz, user_id bigint, event_type string,
        value double, props string""",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
}


def source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SOURCES[name]).parquet(f"{sf_dir}/{name}.parquet")


def _pick(number: str, *values: str) -> str:
    cases = " ".join(f"WHEN {i} THEN '{value}'" for i, value in enumerate(values))
    return f"CASE {number} {cases} END"


def _team(nationkey: str) -> str:
    return f"concat('team-', CAST({nationkey} AS STRING))"


def _sprint(day: str) -> str:
    days = f"datediff(CAST({day} AS DATE), DATE '{BASE_DATE}')"
    return f"concat('sprint-', CAST(CAST(floor({days} / 14) AS INT) + 1 AS STRING))"


def sprint_of(day: Column) -> Column:
    return calendar.sprint_id(calendar.sprint_number(day, BASE_DATE))


def _teams(spark, sf_dir):
    return source(spark, sf_dir, "nation").selectExpr(
        f"{_team('n_nationkey')} AS id",
        "n_name AS name",
        "5 + (n_nationkey * 7) % 11 AS size",
        """CASE WHEN n_nationkey % 5 = 0 THEN NULL
           ELSE concat('Lead ', CAST(n_nationkey AS STRING)) END AS lead""",
        "CAST(NULL AS timestamp_ntz) AS created_at",
    )


def _lines(spark, sf_dir):
    suppliers = source(spark, sf_dir, "supplier")
    lines = source(spark, sf_dir, "lineitem")
    return lines.join(suppliers, F.expr("l_suppkey = s_suppkey")).selectExpr(
        "*",
        "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS id",
        f"{_team('s_nationkey')} AS team_id",
        f"{_sprint('l_shipdate')} AS sprint_id",
    )


def placed_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders and the nation of their customer."""
    customers = source(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    orders = source(spark, sf_dir, "orders").drop("o_totalprice")
    return orders.join(customers, F.expr("o_custkey = c_custkey")).drop("c_custkey")


def store_placed_orders(spark: SparkSession, sf_dir: str, path: str) -> DataFrame:
    """``placed_orders`` from files below ``path``, for whoever derives several tables.

    Customers grow with the orders, and beyond the broadcast threshold each use of the
    join shuffles both. Sorting a task's rows brings near keys together again.
    """
    placed_orders(spark, sf_dir).sortWithinPartitions("o_orderkey").write.parquet(path)
    return spark.read.parquet(path)


def _orders(spark, sf_dir, placed=None):
    placed = placed_orders(spark, sf_dir) if placed is None else placed
    return placed.selectExpr(
        "*",
        "CAST(o_orderkey AS STRING) AS id",
        f"{_team('c_nationkey')} AS team_id",
        f"{_sprint('o_orderdate')} AS sprint_id",
    )


def sprints_in_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sprints up to the last shipment, which no order is dated after."""
    days = source(spark, sf_dir, "lineitem").select("l_shipdate")
    return calendar.sprint_calendar_of(days, BASE_DATE)


def irregular_sprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many sprints, but of 7 to 21 days, with gaps between some and overlaps of others."""
    return sprints_in_use(spark, sf_dir).selectExpr(
        "id", "name", "number",
        "date_add(start_date, number * 5 % 7) AS start_date",
        "date_add(start_date, number * 5 % 7 + 6 + number * 11 % 15) AS end_date",
    )


def _policies(spark):
    return policy_dim(spark).selectExpr(
        "idx", "id AS policy_id", "name AS policy_name", "category", "severity"
    )


def _policy_violations(spark, sf_dir):
    lines = _lines(spark, sf_dir).filter("l_returnflag = 'R'")
    policies = _policies(spark)
    tool = _pick(
        "l_suppkey % 6", "bandit", "gitleaks", "semgrep", "sonarqube", "custom_pii_scanner",
        "safety",
    )
    return lines.join(policies, F.expr("l_partkey % 19 = idx")).selectExpr(
        "id", "team_id", "sprint_id", "policy_id", "policy_name", "category", "severity",
        "concat('Violation of ', policy_name, ' detected in AI-generated code') AS description",
        "concat('src/mod_', CAST(l_partkey % 15 AS STRING), '.py') AS file_path",
        "CAST(10 + l_partkey % 491 AS INT) AS line_number",
        f"{tool} AS tool",
        "CASE l_linestatus WHEN 'F' THEN 1 ELSE 0 END AS resolved",
        "l_shipdate AS detected_at",
    )


def _compliance_scores(spark, sf_dir, placed=None):
    category = _pick(
        "o_orderkey % 8", "security", "coding_standards", "data_privacy",
        "dependency_management", "architecture", "testing", "documentation", "performance",
    )
    scores = _orders(spark, sf_dir, placed).selectExpr(
        "id", "team_id", "sprint_id",
        f"{category} AS category",
        "CAST(50 + (o_custkey * 7 + o_orderkey) % 51 AS DOUBLE) AS score",
        "CAST(8 + o_orderkey % 8 AS INT) AS total_rules",
        "o_orderdate AS computed_at",
    )
    passed = measures.rules_passed(F.col("total_rules"), F.col("score"))
    return scores.withColumn("rules_passed", passed)


def _code_quality_metrics(spark, sf_dir, placed=None):
    return _orders(spark, sf_dir, placed).selectExpr(
        "id", "team_id", "sprint_id",
        "CAST(60 + o_orderkey % 41 AS DOUBLE) AS sonarqube_score",
        "CAST(4 + o_custkey % 16 AS DOUBLE) AS complexity_avg",
        "CAST(o_custkey % 13 AS DOUBLE) AS duplication_pct",
        "CAST(45 + o_orderkey % 50 AS DOUBLE) AS test_coverage_pct",
        "CAST(40 + o_custkey % 55 AS DOUBLE) AS docstring_coverage_pct",
        "CAST(30 + (o_custkey + o_orderkey) % 65 AS DOUBLE) AS type_hint_coverage_pct",
        "CAST(o_custkey % 4000 AS INT) AS ai_generated_lines",
        "CAST(1000 + o_orderkey % 5000 AS INT) AS human_authored_lines",
        "CAST(o_orderkey % 9 AS INT) AS flagged_ai_snippets",
        "CAST(2 + o_orderkey % 14 AS INT) AS bugs_found",
        "CAST(5 + o_orderkey % 36 AS INT) AS code_smells",
        "CAST(o_orderkey % 6 AS INT) AS vulnerabilities",
        "o_orderdate AS computed_at",
    )


def raw_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token usage before totals and costs are worked out."""
    model = _pick(
        "l_partkey % 4", "claude-sonnet-4", "claude-opus-4", "gpt-4o", "claude-haiku-4"
    )
    return _lines(spark, sf_dir).selectExpr(
        "id", "team_id", "sprint_id",
        "CAST(l_shipdate AS DATE) AS date",
        f"{model} AS model",
        "CAST(l_quantity AS INT) * 100 AS input_tokens",
        "CAST(l_quantity AS INT) * 10 * (3 + l_linenumber % 5) AS output_tokens",
        "CAST(1 + l_suppkey % 10 AS INT) AS developer_count",
    )


def _token_usage(spark, sf_dir):
    return with_token_cost(raw_usage(spark, sf_dir), model_price_dim(spark))


def raw_adoption(
    spark: SparkSession, sf_dir: str, placed: DataFrame | None = None
) -> DataFrame:
    """Adoption readings before head counts, velocity and return are worked out."""
    return _orders(spark, sf_dir, placed).selectExpr(
        "id", "team_id", "sprint_id",
        "5 + (c_nationkey * 7) % 11 AS total_developers",
        "CAST(15 + (o_custkey * 3 + o_orderkey * 5) % 80 AS DOUBLE) / 100.0D AS adoption_rate",
        "CAST(3 + (o_custkey + o_orderkey) % 33 AS DOUBLE) AS productivity_gain_pct",
        """CAST((5 + (c_nationkey * 7) % 11) * (4 + o_orderkey % 4) AS INT)
           AS baseline_velocity_points""",
        "o_orderdate AS computed_at",
    )


def _adoption_metrics(spark, sf_dir, placed=None):
    size, rate = F.col("total_developers"), F.col("adoption_rate")
    baseline, gain = F.col("baseline_velocity_points"), F.col("productivity_gain_pct")
    velocity = measures.sprint_velocity(baseline, gain)
    return raw_adoption(spark, sf_dir, placed).select(
        "id", "team_id", "sprint_id", "total_developers", "productivity_gain_pct",
        "baseline_velocity_points", "computed_at",
        measures.active_developers(size, rate).alias("ai_active_developers"),
        measures.adoption_rate_pct(rate).alias("adoption_rate_pct"),
        velocity.alias("sprint_velocity_points"),
        measures.roi_usd(baseline, velocity).alias("roi_estimate_usd"),
    )


def _security_incidents(spark, sf_dir, placed=None):
    incident_type = _pick(
        "o_custkey % 7", "pii_exposure", "hardcoded_secret", "insecure_dependency",
        "sql_injection", "unauthorized_access", "data_leak", "weak_crypto",
    )
    pii_type = _pick(
        "o_orderkey % 6", "email", "phone", "ssn", "credit_card", "address", "name"
    )
    detected_by = _pick(
        "o_orderkey % 5", "gitleaks", "bandit", "semgrep", "custom_scanner", "manual_review"
    )
    return _orders(spark, sf_dir, placed).selectExpr(
        "id", "team_id", "sprint_id",
        f"{incident_type} AS incident_type",
        """CASE o_orderpriority WHEN '1-URGENT' THEN 'critical' WHEN '2-HIGH' THEN 'high'
           WHEN '3-MEDIUM' THEN 'medium' WHEN '5-LOW' THEN 'low' ELSE 'info' END AS severity""",
        f"""CASE WHEN o_custkey % 7 IN (0, 5) OR o_orderkey % 101 = 0
           THEN {pii_type} END AS pii_type""",
        f"{detected_by} AS detected_by",
        """CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'P' THEN 'investigating'
           ELSE 'resolved' END AS status""",
        "o_orderdate AS detected_at",
    )


def _lifecycle_metrics(spark, sf_dir):
    stage = _pick(
        "l_partkey % 6", "requirements", "design", "development", "testing", "deployment",
        "monitoring",
    )
    return _lines(spark, sf_dir).filter("l_returnflag = 'N'").selectExpr(
        "id", "team_id", "sprint_id",
        f"{stage} AS stage",
        "CASE l_linestatus WHEN 'F' THEN 1 ELSE 0 END AS is_monitored",
        "CAST(50 + l_partkey % 51 AS DOUBLE) AS compliance_pct",
        "CAST(l_suppkey % 101 AS DOUBLE) AS ai_coverage_pct",
        "CAST(l_orderkey % 101 AS DOUBLE) AS test_automation_pct",
        "CAST(l_quantity AS INT) AS defects_found",
        "CASE WHEN l_linenumber = 1 THEN CAST(l_quantity AS INT) ELSE 0 END AS defects_leaked",
        "CAST(75 + l_partkey % 26 AS DOUBLE) AS pipeline_pass_rate",
        "l_shipdate AS computed_at",
    )


def _alerts(spark, sf_dir, placed=None):
    kinds = {
        "alert_type": ["token_budget", "compliance_drop", "security_incident", "quality_gate",
                       "adoption_milestone"],
        "severity": ["warning", "high", "critical", "medium", "info"],
        "title": ["Token budget threshold reached", "Compliance score dropped",
                  "New security incident", "Quality gate failure", "Adoption milestone"],
    }
    return _orders(spark, sf_dir, placed).selectExpr(
        "id",
        "CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE team_id END AS team_id",
        "sprint_id",
        *[f"{_pick('o_custkey % 5', *values)} AS {name}" for name, values in kinds.items()],
        "concat('alert ', id) AS message",
        "'governance_engine' AS source",
        "CASE o_orderstatus WHEN 'F' THEN 1 ELSE 0 END AS acknowledged",
        "o_orderdate AS created_at",
    )


_DERIVED = {
    "teams": _teams,
    "sprints": lambda spark, sf_dir: sprints_in_use(spark, sf_dir),
    "policy_violations": _policy_violations,
    "compliance_scores": _compliance_scores,
    "code_quality_metrics": _code_quality_metrics,
    "token_usage": _token_usage,
    "adoption_metrics": _adoption_metrics,
    "security_incidents": _security_incidents,
    "lifecycle_metrics": _lifecycle_metrics,
    "alerts": _alerts,
}


#: Tables that hold a row for each order.
_OF_ORDERS = (
    "compliance_scores", "code_quality_metrics", "adoption_metrics", "security_incidents", "alerts",
)


def derive_tables(spark: SparkSession, sf_dir: str, placed: DataFrame | None = None) -> Tables:
    """The ten tables; ``placed`` are stored ``placed_orders``, else each table joins its own."""

    def derived(name: str) -> DataFrame:
        given = (spark, sf_dir, placed) if name in _OF_ORDERS else (spark, sf_dir)
        return apply_defaults(_DERIVED[name](*given), TABLES[name])

    return Tables({name: lambda name=name: derived(name) for name in TABLES})


def feed_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sprints of the feed but its last, which is left unknown."""
    days = source(spark, sf_dir, "events").select(F.expr("ts - INTERVAL 14 DAYS").alias("day"))
    return calendar.sprint_calendar_of(days, BASE_DATE)


def violation_feed(spark: SparkSession, events: DataFrame) -> DataFrame:
    """Violation records as a producer would send them, faulty ones included.

    ``events`` may be a stream. Some records name an unknown team or sprint, lack
    a severity, use a severity outside the list, or hold a line number that is no
    whole number.
    """
    keyed = events.withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    policies = _policies(spark).withColumnRenamed("severity", "policy_severity")
    tool = _pick(
        "user_id % 6", "bandit", "gitleaks", "semgrep", "sonarqube", "custom_pii_scanner",
        "safety",
    )
    return keyed.join(policies, F.expr("k % 19 = idx")).selectExpr(
        "CAST(event_id AS STRING) AS request_id",
        """concat('team-', CAST(user_id % CASE event_type WHEN 'view' THEN 27 ELSE 25 END
           AS STRING)) AS team_id""",
        f"{_sprint('ts')} AS sprint_id",
        "policy_id", "policy_name", "category",
        """CASE WHEN event_type = 'signup' AND k % 2 = 1 THEN NULL
           WHEN event_type = 'purchase' AND k % 10 = 0 THEN 'blocker'
           ELSE policy_severity END AS severity""",
        "CAST(NULL AS STRING) AS description",
        "concat('src/mod_', CAST(k % 15 AS STRING), '.py') AS file_path",
        """CASE event_type WHEN 'click' THEN CAST(CAST(value AS DECIMAL(18, 2)) AS STRING)
           ELSE CAST(CAST(value AS BIGINT) AS STRING) END AS line_number""",
        f"{tool} AS tool",
        "concat_ws('-', user_id, k) AS sender_key",
        "ts AS detected_at",
    )


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table as a file stream."""
    return (
        spark.readStream.schema(SOURCES["events"])
        .option("pathGlobFilter", "events.parquet")
        .parquet(sf_dir)
    )

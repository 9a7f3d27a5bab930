"""The registered queries: one per operator, each over whole tables.

report on one sprint run here without that choice, for every sprint at once.
"""

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stewardspark import fixed_values as fv
from stewardspark.functions import calendar, measures, scalars
from stewardspark.operators import (
    aggregates,
    alerting,
    kpis,
    policies,
    quality,
    reads,
    reshape,
    rollups,
    selection,
    summaries,
    text_scan,
)
from stewardspark.operators.usage import with_token_cost
from stewardspark.schemas import TABLES
from stewardspark.session import new_folder
from stewardspark.sources import dimensions, parquet_tables, policy_files, testdata
from stewardspark.streaming import alerts, ingest
from stewardspark.tables import Tables

Query = Callable[[SparkSession, str], DataFrame]

# The derived tables hold many more tokens per developer than a real team uses
# at small scale and many fewer violations per row; this budget gives all three
# outcomes on the tables the results are checked on.
DEVELOPER_BUDGET = 5000

# Colours for four of the derived teams, whose names differ from the listed ones.
DERIVED_TEAM_COLORS = {
    "NATION_0": "#534AB7",
    "NATION_1": "#1D9E75",
    "NATION_2": "#D85A30",
    "NATION_3": "#378ADD",
}

VIOLATIONS_SQL = """
    SELECT t.name AS team, pv.category, COUNT(*) AS violations
    FROM policy_violations pv JOIN teams t ON pv.team_id = t.id
    WHERE pv.severity = ? AND pv.resolved = ?
    GROUP BY t.name, pv.category
"""

_QUERIES: dict[str, Query] = {}


def _register(name: str):
    def add(query):
        _QUERIES[name] = query
        return query

    return add


def _on_tables(name: str, build: Callable[[Tables], DataFrame]) -> None:
    _QUERIES[name] = lambda spark, sf_dir: build(testdata.derive_tables(spark, sf_dir))


def _counted(df: DataFrame, **columns) -> DataFrame:
    """Rows per distinct value of the given expressions."""
    results = df.select(*[column.alias(name) for name, column in columns.items()])
    return results.groupBy(*columns).agg(F.count("*").alias("n"))


# Detail reads

_QUERIES["Q01_teams_list"] = lambda spark, sf_dir: reads.teams_list(
    testdata.derive_tables(spark, sf_dir)["teams"]
)
_QUERIES["Q02_sprints_list"] = lambda spark, sf_dir: reads.sprints_list(
    testdata.sprints_in_use(spark, sf_dir)
)
_on_tables(
    "Q03_compliance_scores",
    lambda t: reads.compliance_scores(t["compliance_scores"], t["teams"]),
)
_on_tables(
    "Q05_violations_recent",
    lambda t: reads.violations_recent(t["policy_violations"], t["teams"]),
)
_on_tables(
    "Q05_violations_recent_critical",
    lambda t: reads.violations_recent(
        t["policy_violations"], t["teams"], severity="critical", limit=500
    ),
)
_on_tables(
    "Q06_token_usage_detail",
    lambda t: reads.token_usage_detail(t["token_usage"], t["teams"]),
)
_on_tables(
    "Q08_adoption_detail",
    lambda t: reads.adoption_detail(t["adoption_metrics"], t["teams"]),
)
_on_tables(
    "Q09_security_incidents",
    lambda t: reads.security_incidents(t["security_incidents"], t["teams"]),
)
_on_tables(
    "Q10_code_quality_detail",
    lambda t: reads.code_quality_detail(t["code_quality_metrics"], t["teams"]),
)
_on_tables(
    "Q11_lifecycle_detail",
    lambda t: reads.lifecycle_detail(t["lifecycle_metrics"], t["teams"]),
)
_on_tables(
    "Q12_alerts_filtered", lambda t: reads.alerts_filtered(t["alerts"], t["teams"])
)
_on_tables(
    "Q12_alerts_unacknowledged",
    lambda t: reads.alerts_filtered(t["alerts"], t["teams"], acknowledged=False),
)

# Aggregates

_on_tables(
    "Q04_compliance_heatmap",
    lambda t: aggregates.compliance_heatmap(t["compliance_scores"], t["teams"]),
)
_on_tables(
    "Q07_token_summary", lambda t: aggregates.token_summary(t["token_usage"], t["teams"])
)
_on_tables("Q14_kpi_avg_compliance", kpis.avg_compliance)
_on_tables("Q15_kpi_violation_count", kpis.violation_count)
_on_tables("Q16_kpi_token_cost", kpis.token_cost)
_on_tables("Q17_kpi_adoption_rate", kpis.adoption_rate)
_on_tables("Q18_kpi_incident_count", kpis.incident_count)
_on_tables(
    "Q23_compliance_trend",
    lambda t: aggregates.compliance_trend(t["compliance_scores"], t["teams"], t["sprints"]),
)
_on_tables(
    "Q24_violations_by_severity",
    lambda t: aggregates.violations_by_severity(t["policy_violations"]),
)

# Comparison with the previous sprint, bands, scopes

_QUERIES["Q19_sprint_previous"] = lambda spark, sf_dir: kpis.sprint_previous(
    testdata.sprints_in_use(spark, sf_dir)
)
_on_tables("Q20_kpi_deltas", kpis.kpi_deltas)


@_register("Q20_from_stored_sums")
def _from_stored_sums(spark, sf_dir):
    """The same figures from sums stored batch by batch, with a correction and batches sent twice."""
    root = new_folder(spark, "sums")
    tables = testdata.derive_tables(spark, sf_dir)
    facts = {name: tables[name] for name, _ in rollups.FIGURES.values()}
    half = {name: [df.filter(F.pmod(F.crc32("id"), F.lit(2)) == i) for i in (0, 1)] for name, df in facts.items()}
    wrong = half["compliance_scores"][0].withColumn("score", F.col("score") + 7)
    first = {name: parts[0] for name, parts in half.items()} | {"compliance_scores": wrong}
    rollups.add_batch(spark, root, "first", first)
    rollups.add_batch(
        spark, root, "correction", {"compliance_scores": half["compliance_scores"][0]}, {"compliance_scores": wrong}
    )
    rollups.fold(spark, root)
    rollups.add_batch(spark, root, "first", first)
    for _ in range(2):
        rollups.add_batch(spark, root, "second", {name: parts[1] for name, parts in half.items()})
    return rollups.kpi_deltas(rollups.read_sums(spark, root), tables["teams"], tables["sprints"])


_on_tables("Q21_kpi_direction", lambda t: kpis.kpi_direction(kpis.kpi_deltas(t)))
_on_tables("Q25_kpi_bands", kpis.kpi_bands)
_on_tables("Q28_team_scope", kpis.kpis_by_scope)

# Top-k, lookup, reshape

_on_tables(
    "Q26_active_alerts", lambda t: selection.active_alerts(t["alerts"], t["teams"])
)
_QUERIES["Q27_latest_sprint"] = lambda spark, sf_dir: selection.latest_sprint(
    testdata.sprints_in_use(spark, sf_dir)
)
_on_tables(
    "Q22_heatmap_pivot",
    lambda t: reshape.heatmap_pivot(t["compliance_scores"], t["teams"]),
)

# Scalar functions over fact columns

_on_tables(
    "F01_severity_rank",
    lambda t: _counted(
        t["alerts"],
        severity=F.col("severity"),
        violation_rank=scalars.severity_rank(F.col("severity")),
        alert_rank=scalars.severity_rank(F.col("severity"), "alerts"),
    ),
)
_on_tables(
    "F02_severity_color",
    lambda t: _counted(
        t["alerts"],
        severity=F.col("severity"),
        color=scalars.severity_color(F.col("severity")),
    ),
)
_on_tables(
    "F03_compliance_band",
    lambda t: _counted(
        t["compliance_scores"],
        band=scalars.compliance_band(F.col("score")),
        color=scalars.compliance_color(F.col("score")),
    ),
)
_on_tables(
    "F04_format_number",
    lambda t: _counted(
        t["token_usage"], shown=scalars.format_number(F.col("total_tokens"))
    ),
)
_on_tables(
    "F05_format_currency",
    lambda t: _counted(
        t["adoption_metrics"], shown=scalars.format_currency(F.col("roi_estimate_usd"))
    ),
)
_on_tables(
    "F06_category_label",
    lambda t: _counted(
        t["compliance_scores"],
        category=F.col("category"),
        label=scalars.category_label(F.col("category")),
        short_label=scalars.category_label(F.col("category"), "short"),
    ),
)
_on_tables(
    "F07_alert_class",
    lambda t: _counted(
        t["alerts"],
        severity=F.col("severity"),
        alert_class=scalars.alert_class(F.col("severity")),
        icon=scalars.alert_icon(F.col("severity")),
    ),
)
_on_tables(
    "F08_team_color",
    lambda t: _counted(
        reads.with_team_name(t["security_incidents"], t["teams"]),
        team_name=F.col("team_name"),
        color=scalars.team_color(F.col("team_name"), DERIVED_TEAM_COLORS),
    ),
)

# Derived measures


@_register("M01_token_cost")
def _token_cost(spark, sf_dir):
    usage = testdata.raw_usage(spark, sf_dir)
    priced = with_token_cost(usage, dimensions.model_price_dim(spark))
    return priced.select("id", "model", "total_tokens", "cost_usd")


_on_tables(
    "M02_rules_passed",
    lambda t: t["compliance_scores"].select(
        "id",
        "total_rules",
        measures.clamp_pct(F.col("score")).alias("score"),
        measures.rules_passed(F.col("total_rules"), F.col("score")).alias("rules_passed"),
    ),
)


@_register("M03_adoption_rate")
def _adoption_rate(spark, sf_dir):
    return testdata.raw_adoption(spark, sf_dir).select(
        "id",
        measures.active_developers(F.col("total_developers"), F.col("adoption_rate")).alias(
            "ai_active_developers"
        ),
        measures.adoption_rate_pct(F.col("adoption_rate")).alias("adoption_rate_pct"),
    )


@_register("M04_velocity_roi")
def _velocity_roi(spark, sf_dir):
    baseline = F.col("baseline_velocity_points")
    velocity = measures.sprint_velocity(baseline, F.col("productivity_gain_pct"))
    return testdata.raw_adoption(spark, sf_dir).select(
        "id",
        velocity.alias("sprint_velocity_points"),
        measures.roi_usd(baseline, velocity).alias("roi_estimate_usd"),
    )


def _line_split(t: Tables) -> DataFrame:
    total = F.col("ai_generated_lines") + F.col("human_authored_lines")
    ai = measures.ai_lines(total, F.col("docstring_coverage_pct") / F.lit(100.0))
    return t["code_quality_metrics"].select(
        "id",
        total.alias("total_lines"),
        ai.alias("ai_lines"),
        measures.human_lines(total, ai).alias("human_lines"),
    )


_on_tables("M05_line_split", _line_split)


@_register("M06_sprint_calendar")
def _sprint_calendar(spark, sf_dir):
    """Every sprint with the line items shipped in it."""
    sprints = testdata.sprints_in_use(spark, sf_dir)
    shipped = testdata.source(spark, sf_dir, "lineitem").select(
        testdata.sprint_of(F.col("l_shipdate")).alias("id")
    )
    counts = shipped.groupBy("id").agg(F.count("*").alias("shipments"))
    return sprints.join(counts, "id", "left").na.fill(0, ["shipments"])


@_register("M06_irregular_calendar")
def _irregular_calendar(spark, sf_dir):
    """Line items per sprint by stored bounds, days in gaps apart and with the sprint before."""
    shipped = testdata.source(spark, sf_dir, "lineitem")
    days = shipped.groupBy(F.col("l_shipdate").cast("date").alias("day")).agg(F.count("*").alias("n"))
    sprints = testdata.irregular_sprints(spark, sf_dir)
    within = calendar.with_period(days, "day", sprints).withColumnRenamed("period_id", "sprint_id")
    both = calendar.with_period(within, "day", sprints, on_gap="previous")
    return both.groupBy("sprint_id", F.col("period_id").alias("sprint_or_before")).agg(
        F.sum("n").alias("shipments"), F.min("day").alias("first_day"), F.max("day").alias("last_day")
    )


def _alert_texts(t: Tables) -> DataFrame:
    number = F.col("id").cast("bigint")
    named = reads.with_team_name(t["alerts"], t["teams"])
    numbered = named.join(
        t["sprints"].select(F.col("id").alias("sprint_id"), "number"), "sprint_id"
    )
    kind = F.col("alert_type")
    return numbered.select(
        "id",
        scalars.alert_severity(kind).alias("severity"),
        scalars.alert_title(kind).alias("title"),
        scalars.alert_message(
            kind,
            F.col("team_name"),
            75 + number % 36,
            60 + number % 21,
            F.when(number % 2 == 0, "security").otherwise("data_privacy"),
            F.col("number"),
        ).alias("message"),
    )


_on_tables("M07_alert_message", _alert_texts)
_on_tables(
    "M08_violation_text",
    lambda t: _counted(
        t["policy_violations"], text=scalars.violation_text(F.col("policy_name"))
    ),
)

# Load, write, refresh, SQL


def _stored_tables(spark, sf_dir):
    """The ten tables for whoever writes all of them: orders find their team once."""
    path = new_folder(spark, "placed-orders")
    return testdata.derive_tables(spark, sf_dir, testdata.store_placed_orders(spark, sf_dir, path))


@_register("L01_load_tables")
def _load_tables(spark, sf_dir):
    root = new_folder(spark, "load")
    parquet_tables.full_refresh(_stored_tables(spark, sf_dir), root)
    return parquet_tables.row_and_null_counts(parquet_tables.load_tables(spark, root))


_on_tables(
    "L02_run_query",
    lambda t: parquet_tables.run_query(t, VIOLATIONS_SQL, ("critical", 0)),
)


@_register("L03_write_table")
def _write_table(spark, sf_dir):
    """Open and resolved violations written one after the other."""
    root = new_folder(spark, "write")
    violations = testdata.derive_tables(spark, sf_dir)["policy_violations"]
    for resolved in (0, 1):
        part = violations.filter(F.col("resolved") == resolved)
        parquet_tables.write_table(part, root, "policy_violations")
    stored = parquet_tables.read_table(spark, root, "policy_violations")
    return stored.groupBy("sprint_id", "resolved").agg(F.count("*").alias("n"))


@_register("L04_full_refresh")
def _full_refresh(spark, sf_dir):
    """Two refreshes in a row leave one copy of each row."""
    root = new_folder(spark, "refresh")
    tables = _stored_tables(spark, sf_dir)
    parquet_tables.full_refresh(tables, root)
    parquet_tables.full_refresh(tables, root)
    counts = parquet_tables.row_and_null_counts(parquet_tables.load_tables(spark, root))
    return counts.select("table_name", "row_count")


@_register("L04_snapshot_refresh")
def _snapshot_refresh(spark, sf_dir):
    """A snapshot of a part, one of everything, and rows added to that."""
    root = new_folder(spark, "snapshots")
    tables = _stored_tables(spark, sf_dir)
    open_ones = {**tables, "policy_violations": tables["policy_violations"].filter("resolved = 0")}
    parquet_tables.snapshot_refresh(Tables.of(**open_ones), root)
    parquet_tables.snapshot_refresh(Tables.of(**open_ones), root)
    resolved = tables["policy_violations"].filter("resolved = 1")
    parquet_tables.write_table(resolved, root, "policy_violations")
    parquet_tables.drop_old_snapshots(spark, root, keep=1)
    counts = parquet_tables.row_and_null_counts(parquet_tables.load_tables(spark, root))
    return counts.select("table_name", "row_count")


def _apply_defaults(t: Tables) -> DataFrame:
    """Incidents without a status column, and with NULL in place of some."""
    spec = TABLES["security_incidents"]
    incidents = t["security_incidents"]
    absent = parquet_tables.apply_defaults(incidents.drop("status"), spec)
    resolved = F.col("status") == "resolved"
    given = incidents.withColumn("status", F.when(~resolved, F.col("status")))
    kept = parquet_tables.apply_defaults(given, spec)
    both = absent.select(F.lit("absent").alias("input"), "status").unionByName(
        kept.select(F.lit("given").alias("input"), "status")
    )
    return both.groupBy("input", "status").agg(F.count("*").alias("n"))


_on_tables("L05_apply_defaults", _apply_defaults)
_QUERIES["L06_policy_dim"] = lambda spark, sf_dir: policies.violations_per_role(
    testdata.derive_tables(spark, sf_dir)["policy_violations"], dimensions.policy_dim(spark)
)


def _policy_lines(spark: SparkSession) -> DataFrame:
    """The policies as lines of a file, some of them spoilt."""
    names = dimensions.POLICY_COLUMNS[1:]
    rows = [dict(zip(names, policy, strict=True)) for policy in fv.POLICIES]
    spoilt = {
        "PF-001": {"severity": "urgent"}, "DC-001": {"name": ""}, "TS-002": {"threshold": "many"},
        "AR-002": {"category": "design", "threshold": -1},
    }
    lines = [json.dumps(row | spoilt.get(row["id"], {})) for row in rows]
    lines += [json.dumps(rows[0]), json.dumps(rows[1] | {"threshold": 9}), "", "SEC-001: {", "[]"]
    return spark.createDataFrame([(line,) for line in lines], "value string")


@_register("L06_policy_file")
def _policy_file(spark, sf_dir):
    """Violations per policy of a file and role, and of policies that were refused."""
    path = new_folder(spark, "policies")
    _policy_lines(spark).write.text(path)
    judged = policy_files.read_policy_lines(spark, path)
    violations = testdata.derive_tables(spark, sf_dir)["policy_violations"]
    kept = policies.violations_per_role(violations, policy_files.accepted_policies(judged))
    refused = policies.violations_of_refused(violations, policy_files.refused_policies(judged))
    return kept.withColumn("reasons", F.lit("")).unionByName(refused, allowMissingColumns=True)


def _as_stream(session: SparkSession, rows: DataFrame, path: str) -> DataFrame:
    """``rows`` without their ids as a stream of two micro-batches, by way of files below ``path``.

    Four slices are written by as many tasks as adaptive execution finds fit for their
    size, so the files grow in number with the rows, and each micro-batch takes half.
    """
    part = rows.withColumn("slice", F.pmod(F.xxhash64("id"), F.lit(4))).drop("id")
    part.hint("rebalance", F.col("slice")).write.partitionBy("slice").parquet(path)
    schema = part.drop("slice").schema
    files = len(session.read.schema(schema).parquet(path).inputFiles())
    stream = session.readStream.schema(schema).option("maxFilesPerTrigger", max(1, (files + 1) // 2))
    return stream.option("recursiveFileLookup", "true").parquet(path)


@_register("D02_alert_stream")
def _alert_stream(spark, sf_dir):
    """The same alerts from streams of the facts, in several micro-batches, started twice."""
    root = new_folder(spark, "facts")
    tables = testdata.derive_tables(spark, sf_dir)
    session = ingest.stream_session(spark)
    facts = {}
    for name in sorted({table for table, *_ in alerts.READINGS.values()}):
        facts[name] = _as_stream(session, tables[name], f"{root}/{name}")
    own = testdata.derive_tables(session, sf_dir)
    for _ in range(2):
        alerts.start_alert_stream(
            facts, own["teams"], own["sprints"], f"{root}/log", f"{root}/checkpoint",
            per_developer=DEVELOPER_BUDGET,
        ).awaitTermination()
    return alerts.current_alerts(spark, f"{root}/log").drop("raised_at")


@_register("D02_alerts_by_policy_file")
def _alerts_by_policy_file(spark, sf_dir):
    """Alerts with the limits of a policy file, in which the quality gate is at 90."""
    path = new_folder(spark, "policies")
    gate = F.regexp_replace("value", '"threshold": 80', '"threshold": 90')
    _policy_lines(spark).select(gate).write.text(path)
    judged = policy_files.read_policy_lines(spark, path)
    listed = policy_files.policy_list(policy_files.accepted_policies(judged))
    tables = testdata.derive_tables(spark, sf_dir)
    return alerting.threshold_alerts(tables, DEVELOPER_BUDGET, policies=listed)


_QUERIES["L07_model_price_dim"] = lambda spark, sf_dir: summaries.price_use(
    testdata.derive_tables(spark, sf_dir)["token_usage"], dimensions.model_price_dim(spark)
)

# Data quality, over the ten tables and the raw feed

FEED_RULES = {"violation_feed": "policy_violations"}


def _checked(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    events = testdata.source(spark, sf_dir, "events")
    feed = testdata.violation_feed(spark, events).withColumnRenamed("sender_key", "id")
    return {**testdata.derive_tables(spark, sf_dir), "violation_feed": feed}


@_register("DQ01_pk_duplicates")
def _pk_duplicates(spark, sf_dir):
    return quality.pk_duplicates(_checked(spark, sf_dir))


@_register("DQ02_not_null")
def _not_null(spark, sf_dir):
    return quality.null_counts(_checked(spark, sf_dir), FEED_RULES)


@_register("DQ03_fk_orphans")
def _fk_orphans(spark, sf_dir):
    frames = _checked(spark, sf_dir)
    return quality.fk_orphans(frames, frames["teams"], frames["sprints"], FEED_RULES)


@_register("DQ04_domain_check")
def _domain_check(spark, sf_dir):
    return quality.domain_check(_checked(spark, sf_dir), FEED_RULES)


_on_tables(
    "DQ05_pii_type_rule",
    lambda t: quality.pii_type_rule(t["security_incidents"]).select(
        "id", "incident_type", "pii_type"
    ),
)

# Ingest

_INGESTED = [
    "id", "team_id", "sprint_id", "policy_id", "policy_name", "category", "severity",
    "file_path", "line_number", "tool", "resolved", "reasons", "status",
]


@_register("Q13_ingest_violations")
def _ingest_violations(spark, sf_dir):
    events = testdata.source(spark, sf_dir, "events")
    feed = testdata.violation_feed(spark, events)
    teams = testdata.derive_tables(spark, sf_dir)["teams"]
    judged = ingest.ingest_batch(feed, teams, testdata.feed_calendar(spark, sf_dir))
    return judged.select(*_INGESTED)


@_register("ST01_ingest_stream")
def _ingest_stream(spark, sf_dir):
    landing, checkpoint = new_folder(spark, "landing"), new_folder(spark, "stream")
    session = ingest.stream_session(spark)
    feed = testdata.violation_feed(session, testdata.event_stream(session, sf_dir))
    teams = testdata.derive_tables(session, sf_dir)["teams"]
    query = ingest.start_ingest_stream(
        feed, teams, testdata.feed_calendar(session, sf_dir), landing, checkpoint
    )
    query.awaitTermination()
    return ingest.read_landing(spark, landing).select(*_INGESTED)


@_register("ST01_redelivered_feed")
def _redelivered_feed(spark, sf_dir):
    """The whole feed twice, the second time under a checkpoint that knows nothing of the first."""
    landing = new_folder(spark, "landing")
    for _ in range(2):
        session = ingest.stream_session(spark)
        feed = testdata.violation_feed(session, testdata.event_stream(session, sf_dir))
        teams = testdata.derive_tables(session, sf_dir)["teams"]
        sprints = testdata.feed_calendar(session, sf_dir)
        checkpoint = new_folder(spark, "stream")
        ingest.start_ingest_stream(feed, teams, sprints, landing, checkpoint).awaitTermination()
    return ingest.read_landing(spark, landing).select(*_INGESTED)


# Reports that are declared over the tables

_on_tables(
    "D01_token_budget",
    lambda t: summaries.token_budget(t["token_usage"], t["teams"], DEVELOPER_BUDGET),
)
_on_tables(
    "D02_threshold_alerts", lambda t: alerting.threshold_alerts(t, DEVELOPER_BUDGET)
)
_on_tables(
    "D03_policy_evaluation",
    lambda t: policies.policy_evaluation(
        t["policy_violations"], t["code_quality_metrics"], t["teams"], sprints=t["sprints"]
    ),
)


@_register("D04_role_policy_matrix")
def _role_policy_matrix(spark, sf_dir):
    violations = testdata.derive_tables(spark, sf_dir)["policy_violations"]
    return policies.role_policy_matrix(
        violations, dimensions.policy_dim(spark), dimensions.role_policies(spark)
    )


@_register("D05_role_mismatch")
def _role_mismatch(spark, sf_dir):
    violations = testdata.derive_tables(spark, sf_dir)["policy_violations"]
    return policies.role_mismatch(
        violations, dimensions.policy_dim(spark), dimensions.role_policies(spark)
    )


_on_tables(
    "D06_violation_trend",
    lambda t: summaries.violation_trend(t["policy_violations"], t["teams"], t["sprints"]),
)
_on_tables(
    "D07_cost_rollup", lambda t: summaries.cost_rollup(t["token_usage"], t["teams"])
)
_on_tables("D07_daily_consumption", lambda t: summaries.daily_consumption(t["token_usage"]))
_on_tables(
    "D08_quality_scorecard",
    lambda t: summaries.quality_scorecard(t["code_quality_metrics"], t["teams"]),
)
_on_tables("D09_adoption_roi", lambda t: summaries.adoption_roi(t["adoption_metrics"]))
_on_tables(
    "D10_security_summary", lambda t: summaries.security_summary(t["security_incidents"])
)
_on_tables("D10_pii_incidents", lambda t: summaries.pii_incidents(t["security_incidents"]))
_on_tables(
    "D11_lifecycle_summary",
    lambda t: summaries.lifecycle_summary(t["lifecycle_metrics"], t["teams"]),
)
_QUERIES["D12_pii_secret_scan"] = lambda spark, sf_dir: text_scan.pii_secret_scan(
    testdata.source(spark, sf_dir, "documents")
)


@_register("D12_dictionary_scan")
def _dictionary_scan(spark, sf_dir):
    """Openings and middles of the benchmark's items wherever documents hold them."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    words = text_scan.words_of(F.col("text"))
    phrases = [
        items.select(F.lit(kind).alias("kind"), F.array_join(F.slice(words, first, length), " ").alias("phrase"))
        for kind, first, length in (("opening", 1, 3), ("middle", 4, 2))
    ]
    return text_scan.dictionary_scan(
        testdata.source(spark, sf_dir, "documents"), phrases[0].unionByName(phrases[1])
    )


@_register("D12_unmarked_secrets")
def _unmarked_secrets(spark, sf_dir):
    found = text_scan.unmarked_secrets(testdata.source(spark, sf_dir, "documents"))
    return found.select("doc_id", "token", F.round("bits", 6).alias("bits"))


_on_tables(
    "D13_compliance_adherence",
    lambda t: summaries.compliance_adherence(t["compliance_scores"], t["teams"]),
)


# One sprint, team or kind alone, as a page asks for it

CHOSEN_SPRINT, CHOSEN_TEAM, CHOSEN_TEAM_ID = "sprint-60", "NATION_3", "team-3"

_on_tables(
    "Q03_one_sprint_and_team",
    lambda t: reads.compliance_scores(
        t["compliance_scores"], t["teams"], CHOSEN_SPRINT, CHOSEN_TEAM_ID
    ),
)
_on_tables(
    "Q04_one_sprint",
    lambda t: aggregates.compliance_heatmap(t["compliance_scores"], t["teams"], CHOSEN_SPRINT),
)
_on_tables(
    "Q04_empty_sprint_name",
    lambda t: aggregates.compliance_heatmap(t["compliance_scores"], t["teams"], ""),
)
_on_tables(
    "Q06_one_sprint_and_team",
    lambda t: reads.token_usage_detail(
        t["token_usage"], t["teams"], CHOSEN_SPRINT, CHOSEN_TEAM_ID
    ),
)
_on_tables(
    "Q07_one_sprint",
    lambda t: aggregates.token_summary(t["token_usage"], t["teams"], CHOSEN_SPRINT),
)
_on_tables(
    "Q09_one_team_critical",
    lambda t: reads.security_incidents(
        t["security_incidents"], t["teams"], team_id=CHOSEN_TEAM_ID, severity="critical"
    ),
)
_on_tables(
    "Q12_one_sprint_acknowledged",
    lambda t: reads.alerts_filtered(t["alerts"], t["teams"], CHOSEN_SPRINT, True),
)
_on_tables("Q14_one_sprint", lambda t: kpis.avg_compliance(t, CHOSEN_SPRINT))
_on_tables("Q14_unknown_team", lambda t: kpis.avg_compliance(t, CHOSEN_SPRINT, "NOBODY"))
_on_tables("Q15_one_sprint", lambda t: kpis.violation_count(t, CHOSEN_SPRINT))
_on_tables("Q16_one_sprint", lambda t: kpis.token_cost(t, CHOSEN_SPRINT))
_on_tables("Q17_one_sprint", lambda t: kpis.adoption_rate(t, CHOSEN_SPRINT))
_on_tables("Q18_one_sprint", lambda t: kpis.incident_count(t, CHOSEN_SPRINT))
_on_tables("Q20_one_sprint", lambda t: kpis.kpi_deltas(t, sprint_id=CHOSEN_SPRINT))
_on_tables("Q20_first_sprint", lambda t: kpis.kpi_deltas(t, sprint_id="sprint-1"))
_on_tables(
    "Q24_one_sprint",
    lambda t: aggregates.violations_by_severity(t["policy_violations"], CHOSEN_SPRINT),
)
_on_tables(
    "Q26_one_sprint",
    lambda t: selection.active_alerts(t["alerts"], t["teams"], CHOSEN_SPRINT),
)
_on_tables("Q28_one_team", lambda t: kpis.token_cost(t, team=CHOSEN_TEAM))
_on_tables("Q28_all_teams", lambda t: kpis.token_cost(t, team="All Teams"))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)

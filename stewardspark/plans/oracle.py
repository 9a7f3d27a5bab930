"""DuckDB SQL for each registered query, over the same Parquet tables.

The SQL states the derivation of FIXTURES.md and the meaning of each operator a
second time, independent of the Spark code.
"""

import re

from stewardspark import fixed_values as fv
from stewardspark.schemas import TABLES


def _text(value) -> str:
    return "NULL" if value is None else "'" + str(value).replace("'", "''") + "'"


def _pick(number: str, *values: str) -> str:
    cases = " ".join(f"WHEN {i} THEN {_text(value)}" for i, value in enumerate(values))
    return f"CASE {number} {cases} END"


def _map(column: str, values: dict, default: str = "NULL") -> str:
    cases = " ".join(f"WHEN {_text(k)} THEN {_text(v)}" for k, v in values.items())
    return f"CASE {column} {cases} ELSE {default} END"


def _sprint(day: str) -> str:
    days = f"date_diff('day', DATE '1995-01-01', CAST({day} AS DATE))"
    return f"concat('sprint-', CAST(CAST(floor({days} / 14) AS INT) + 1 AS VARCHAR))"


def _calendar(last: str) -> str:
    return f"""
        SELECT concat('sprint-', CAST(i + 1 AS VARCHAR)) AS id,
          concat('Sprint ', CAST(i + 1 AS VARCHAR)) AS name, CAST(i + 1 AS INT) AS number,
          CAST(DATE '1995-01-01' + CAST(14 * i AS INT) AS DATE) AS start_date,
          CAST(DATE '1995-01-01' + CAST(14 * i + 13 AS INT) AS DATE) AS end_date
        FROM (SELECT unnest(range({last})) AS i)"""


def _usd(column: str) -> str:
    return f"CAST(sum(CAST({column} AS DECIMAL(18, 6))) AS DOUBLE)"


def _show(value: str, decimals: int) -> str:
    return f"printf('%.{decimals}f', {value})"


def _short(value: str, decimals: int, prefix: str = "") -> str:
    value = f"CAST({value} AS DOUBLE)"
    return f"""concat('{prefix}', CASE
        WHEN abs({value}) >= 1000000 THEN concat({_show(f'{value} / 1000000', decimals)}, 'M')
        WHEN abs({value}) >= 1000 THEN concat({_show(f'{value} / 1000', decimals)}, 'K')
        ELSE {_show(value, decimals)} END)"""


_CATEGORY_OF_ORDER = _pick(
    "o_orderkey % 8", "security", "coding_standards", "data_privacy", "dependency_management",
    "architecture", "testing", "documentation", "performance",
)
_MODEL = _pick("l_partkey % 4", "claude-sonnet-4", "claude-opus-4", "gpt-4o", "claude-haiku-4")
_TOOLS = ("bandit", "gitleaks", "semgrep", "sonarqube", "custom_pii_scanner", "safety")
_INCIDENTS = (
    "pii_exposure", "hardcoded_secret", "insecure_dependency", "sql_injection",
    "unauthorized_access", "data_leak", "weak_crypto",
)

_POLICY_VALUES = ", ".join(
    f"({idx}, {_text(p[0])}, {_text(p[1])}, {_text(p[3])}, {_text(p[4])}, {p[6]})"
    for idx, p in enumerate(fv.POLICIES)
)
_APPLIES_VALUES = ", ".join(
    f"({_text(p[0])}, {_text(role)})" for p in fv.POLICIES for role in p[5]
)
_LISTED_VALUES = ", ".join(
    f"({_text(p)}, {_text(role)})" for role, listed in fv.ROLE_POLICIES.items() for p in listed
)
_PRICE_VALUES = ", ".join(
    f"({_text(m)}, CAST({i} AS DECIMAL(9, 6)), CAST({o} AS DECIMAL(9, 6)))"
    for m, (i, o) in fv.MODEL_PRICES.items()
)
_LINE_ID = "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey)"

# Name -> SQL. Later entries may use earlier ones.
_PARTS = {
    "teams": """
        SELECT concat('team-', CAST(n_nationkey AS VARCHAR)) AS id, n_name AS name,
          5 + (n_nationkey * 7) % 11 AS size,
          CASE WHEN n_nationkey % 5 = 0 THEN NULL
            ELSE concat('Lead ', CAST(n_nationkey AS VARCHAR)) END AS lead,
          CAST(NULL AS TIMESTAMP) AS created_at
        FROM nation""",
    "sprints": _calendar(
        """(SELECT CAST(floor(date_diff('day', DATE '1995-01-01',
           CAST(max(l_shipdate) AS DATE)) / 14) AS INT) + 1 FROM lineitem)"""
    ),
    "policies": f"""
        SELECT * FROM (VALUES {_POLICY_VALUES}) v(idx, id, name, category, severity, threshold)""",
    "refused_policies": """
        SELECT * FROM (VALUES ('PF-001', 'unknown severity'), ('DC-001', 'missing name'),
          ('TS-002', 'unreadable'), ('AR-002', 'unknown category; negative threshold'),
          ('SEC-002', 'id given twice'), ('SEC-002', 'id given twice'),
          (NULL, 'unreadable'), (NULL, 'unreadable')) v(policy_id, reasons)""",
    "applies": f"SELECT * FROM (VALUES {_APPLIES_VALUES}) v(policy_id, role)",
    "listed": f"SELECT * FROM (VALUES {_LISTED_VALUES}) v(policy_id, role)",
    "prices": f"SELECT * FROM (VALUES {_PRICE_VALUES}) v(model, p_in, p_out)",
    "lines": f"""
        SELECT *, {_LINE_ID} AS id, concat('team-', CAST(s_nationkey AS VARCHAR)) AS team_id,
          {_sprint('l_shipdate')} AS sprint_id
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey""",
    "ord": f"""
        SELECT *, CAST(o_orderkey AS VARCHAR) AS id,
          concat('team-', CAST(c_nationkey AS VARCHAR)) AS team_id,
          {_sprint('o_orderdate')} AS sprint_id
        FROM orders JOIN customer ON o_custkey = c_custkey""",
    "policy_violations": f"""
        SELECT l.id, l.team_id, l.sprint_id, p.id AS policy_id, p.name AS policy_name,
          p.category, p.severity,
          concat('Violation of ', p.name, ' detected in AI-generated code') AS description,
          concat('src/mod_', CAST(l_partkey % 15 AS VARCHAR), '.py') AS file_path,
          CAST(10 + l_partkey % 491 AS INT) AS line_number,
          {_pick('l_suppkey % 6', *_TOOLS)} AS tool,
          CASE l_linestatus WHEN 'F' THEN 1 ELSE 0 END AS resolved,
          CAST(NULL AS TIMESTAMP) AS resolved_at, l_shipdate AS detected_at
        FROM lines l JOIN policies p ON p.idx = l_partkey % 19 WHERE l_returnflag = 'R'""",
    "compliance_scores": f"""
        SELECT *, CAST(trunc(total_rules * score / 100.0::DOUBLE) AS INT) AS rules_passed
        FROM (SELECT id, team_id, sprint_id, {_CATEGORY_OF_ORDER} AS category,
            CAST(50 + (o_custkey * 7 + o_orderkey) % 51 AS DOUBLE) AS score,
            CAST(8 + o_orderkey % 8 AS INT) AS total_rules, o_orderdate AS computed_at
          FROM ord)""",
    "code_quality_metrics": """
        SELECT id, team_id, sprint_id,
          CAST(60 + o_orderkey % 41 AS DOUBLE) AS sonarqube_score,
          CAST(4 + o_custkey % 16 AS DOUBLE) AS complexity_avg,
          CAST(o_custkey % 13 AS DOUBLE) AS duplication_pct,
          CAST(45 + o_orderkey % 50 AS DOUBLE) AS test_coverage_pct,
          CAST(40 + o_custkey % 55 AS DOUBLE) AS docstring_coverage_pct,
          CAST(30 + (o_custkey + o_orderkey) % 65 AS DOUBLE) AS type_hint_coverage_pct,
          CAST(o_custkey % 4000 AS INT) AS ai_generated_lines,
          CAST(1000 + o_orderkey % 5000 AS INT) AS human_authored_lines,
          CAST(o_orderkey % 9 AS INT) AS flagged_ai_snippets,
          CAST(2 + o_orderkey % 14 AS INT) AS bugs_found,
          CAST(5 + o_orderkey % 36 AS INT) AS code_smells,
          CAST(o_orderkey % 6 AS INT) AS vulnerabilities, o_orderdate AS computed_at
        FROM ord""",
    "raw_usage": f"""
        SELECT id, team_id, sprint_id, CAST(l_shipdate AS DATE) AS date, {_MODEL} AS model,
          CAST(l_quantity AS INT) * 100 AS input_tokens,
          CAST(l_quantity AS INT) * 10 * (3 + l_linenumber % 5) AS output_tokens,
          CAST(1 + l_suppkey % 10 AS INT) AS developer_count
        FROM lines""",
    "token_usage": """
        SELECT u.id, team_id, sprint_id, date, u.model, input_tokens, output_tokens,
          input_tokens + output_tokens AS total_tokens,
          CAST(round((CAST(input_tokens AS DECIMAL(18, 0)) * p_in
            + CAST(output_tokens AS DECIMAL(18, 0)) * p_out)
            * CAST(0.001 AS DECIMAL(4, 3)), 4) AS DOUBLE) AS cost_usd,
          developer_count
        FROM raw_usage u JOIN prices p ON u.model = p.model WHERE input_tokens > 0""",
    "raw_adoption": """
        SELECT id, team_id, sprint_id, 5 + (c_nationkey * 7) % 11 AS total_developers,
          CAST(15 + (o_custkey * 3 + o_orderkey * 5) % 80 AS DOUBLE) / 100.0::DOUBLE AS rate,
          CAST(3 + (o_custkey + o_orderkey) % 33 AS DOUBLE) AS productivity_gain_pct,
          CAST((5 + (c_nationkey * 7) % 11) * (4 + o_orderkey % 4) AS INT)
            AS baseline_velocity_points,
          o_orderdate AS computed_at
        FROM ord""",
    "adoption_metrics": """
        SELECT id, team_id, sprint_id, total_developers,
          CAST(trunc(total_developers * rate) AS INT) AS ai_active_developers,
          round(rate * 100.0::DOUBLE, 1) AS adoption_rate_pct,
          CAST(NULL AS DOUBLE) AS ai_assisted_commits_pct,
          CAST(NULL AS DOUBLE) AS avg_time_saved_hrs, productivity_gain_pct,
          CAST(trunc(baseline_velocity_points
            * (1.0::DOUBLE + productivity_gain_pct / 100.0::DOUBLE)) AS INT)
            AS sprint_velocity_points,
          baseline_velocity_points,
          CAST((CAST(trunc(baseline_velocity_points
            * (1.0::DOUBLE + productivity_gain_pct / 100.0::DOUBLE)) AS INT)
            - baseline_velocity_points) * 250 AS DOUBLE) AS roi_estimate_usd,
          computed_at
        FROM raw_adoption""",
    "security_incidents": f"""
        SELECT id, team_id, sprint_id, {_pick('o_custkey % 7', *_INCIDENTS)} AS incident_type,
          CASE o_orderpriority WHEN '1-URGENT' THEN 'critical' WHEN '2-HIGH' THEN 'high'
            WHEN '3-MEDIUM' THEN 'medium' WHEN '5-LOW' THEN 'low' ELSE 'info' END AS severity,
          CAST(NULL AS VARCHAR) AS description, CAST(NULL AS VARCHAR) AS affected_file,
          CASE WHEN o_custkey % 7 IN (0, 5) OR o_orderkey % 101 = 0 THEN
            {_pick('o_orderkey % 6', 'email', 'phone', 'ssn', 'credit_card', 'address', 'name')}
            END AS pii_type,
          {_pick('o_orderkey % 5', 'gitleaks', 'bandit', 'semgrep', 'custom_scanner',
                 'manual_review')} AS detected_by,
          CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'P' THEN 'investigating'
            ELSE 'resolved' END AS status,
          CAST(NULL AS TIMESTAMP) AS resolved_at, o_orderdate AS detected_at
        FROM ord""",
    "lifecycle_metrics": f"""
        SELECT id, team_id, sprint_id,
          {_pick('l_partkey % 6', 'requirements', 'design', 'development', 'testing',
                 'deployment', 'monitoring')} AS stage,
          CASE l_linestatus WHEN 'F' THEN 1 ELSE 0 END AS is_monitored,
          CAST(50 + l_partkey % 51 AS DOUBLE) AS compliance_pct,
          CAST(l_suppkey % 101 AS DOUBLE) AS ai_coverage_pct,
          CAST(l_orderkey % 101 AS DOUBLE) AS test_automation_pct,
          CAST(l_quantity AS INT) AS defects_found,
          CASE WHEN l_linenumber = 1 THEN CAST(l_quantity AS INT) ELSE 0 END AS defects_leaked,
          CAST(75 + l_partkey % 26 AS DOUBLE) AS pipeline_pass_rate, l_shipdate AS computed_at
        FROM lines WHERE l_returnflag = 'N'""",
    "alerts": f"""
        SELECT id, CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE team_id END AS team_id, sprint_id,
          {_pick('o_custkey % 5', 'token_budget', 'compliance_drop', 'security_incident',
                 'quality_gate', 'adoption_milestone')} AS alert_type,
          {_pick('o_custkey % 5', 'warning', 'high', 'critical', 'medium', 'info')} AS severity,
          {_pick('o_custkey % 5', 'Token budget threshold reached', 'Compliance score dropped',
                 'New security incident', 'Quality gate failure', 'Adoption milestone')} AS title,
          concat('alert ', id) AS message, 'governance_engine' AS source,
          CASE o_orderstatus WHEN 'F' THEN 1 ELSE 0 END AS acknowledged,
          o_orderdate AS created_at
        FROM ord""",
    "feed_sprints": _calendar(
        """(SELECT CAST(floor(date_diff('day', DATE '1995-01-01',
           CAST(max(ts) AS DATE)) / 14) AS INT) FROM events)"""
    ),
    "violation_feed": f"""
        SELECT CAST(event_id AS VARCHAR) AS request_id, concat_ws('-', user_id, k) AS id,
          concat('team-', CAST(user_id % CASE event_type WHEN 'view' THEN 27 ELSE 25 END
            AS VARCHAR)) AS team_id,
          {_sprint('ts')} AS sprint_id, p.id AS policy_id, p.name AS policy_name, p.category,
          CASE WHEN event_type = 'signup' AND k % 2 = 1 THEN NULL
            WHEN event_type = 'purchase' AND k % 10 = 0 THEN 'blocker'
            ELSE p.severity END AS severity,
          concat('src/mod_', CAST(k % 15 AS VARCHAR), '.py') AS file_path,
          CASE event_type WHEN 'click' THEN CAST(CAST(value AS DECIMAL(18, 2)) AS VARCHAR)
            ELSE CAST(CAST(trunc(value) AS BIGINT) AS VARCHAR) END AS line_number,
          {_pick('user_id % 6', *_TOOLS)} AS tool
        FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events) e
        JOIN policies p ON p.idx = e.k % 19""",
    "kpi": f"""
        SELECT s.id AS sprint_id, s.name AS sprint, s.number,
          coalesce(c.v, 0) AS avg_compliance, coalesce(v.v, 0) AS violations,
          coalesce(u.v, 0) AS token_cost, coalesce(a.v, 0) AS adoption_rate,
          coalesce(i.v, 0) AS incidents
        FROM sprints s
        LEFT JOIN (SELECT sprint_id, avg(score) AS v FROM compliance_scores GROUP BY 1) c
          ON c.sprint_id = s.id
        LEFT JOIN (SELECT sprint_id, count(*) AS v FROM policy_violations GROUP BY 1) v
          ON v.sprint_id = s.id
        LEFT JOIN (SELECT sprint_id, {_usd('cost_usd')} AS v FROM token_usage GROUP BY 1) u
          ON u.sprint_id = s.id
        LEFT JOIN (SELECT sprint_id, avg(adoption_rate_pct) AS v FROM adoption_metrics
          GROUP BY 1) a ON a.sprint_id = s.id
        LEFT JOIN (SELECT sprint_id, count(*) AS v FROM security_incidents GROUP BY 1) i
          ON i.sprint_id = s.id""",
    "deltas": """
        SELECT k.*, coalesce(p.avg_compliance, 0) AS prev_avg_compliance,
          coalesce(p.violations, 0) AS prev_violations,
          coalesce(p.token_cost, 0) AS prev_token_cost,
          k.avg_compliance - coalesce(p.avg_compliance, 0) AS delta_avg_compliance,
          k.violations - coalesce(p.violations, 0) AS delta_violations,
          k.token_cost - coalesce(p.token_cost, 0) AS delta_token_cost
        FROM kpi k LEFT JOIN kpi p ON p.number = k.number - 1""",
    "per_policy": "SELECT policy_id, count(*) AS n FROM policy_violations GROUP BY 1",
    "budget": """
        SELECT u.team_id, t.name AS team, u.sprint_id,
          CAST(sum(total_tokens) AS BIGINT) AS tokens,
          CAST(any_value(t.size) * 5000 * 1.2 AS DOUBLE) AS budget
        FROM token_usage u JOIN teams t ON u.team_id = t.id
        GROUP BY u.team_id, t.name, u.sprint_id""",
}


def _with(body: str) -> str:
    """``body`` preceded by the parts it uses, directly or through other parts."""
    needed: set[str] = set()
    texts = [body]
    while texts:
        text = texts.pop()
        for name in _PARTS:
            if name not in needed and re.search(rf"\b(FROM|JOIN)\s+{name}\b", text):
                needed.add(name)
                texts.append(_PARTS[name])
    ordered = [f"{name} AS ({_PARTS[name]})" for name in _PARTS if name in needed]
    return f"WITH {', '.join(ordered)} {body}" if ordered else body


def _detail(table: str, where: str = "", tail: str = "") -> str:
    columns = ", ".join(f"f.{column}" for column in TABLES[table].columns)
    return f"""SELECT {columns}, t.name AS team_name
        FROM {table} f JOIN teams t ON f.team_id = t.id {where} {tail}"""


def _kpi_only(column: str) -> str:
    return f"SELECT sprint_id, {column} FROM kpi"


def _counts_and_nulls(table: str) -> str:
    nulls = " + ".join(f"count(*) - count({column})" for column in TABLES[table].columns)
    return f"""SELECT '{table}' AS table_name, count(*) AS row_count,
        CAST({nulls} AS BIGINT) AS null_count FROM {table}"""


_CHECKED = {**{name: name for name in TABLES}, "violation_feed": "policy_violations"}


def _duplicates(table: str) -> str:
    return f"""SELECT '{table}' AS table_name, id, count(*) AS row_count FROM {table}
        WHERE id IS NOT NULL GROUP BY id HAVING count(*) > 1"""


def _null_counts(table: str, rules: str) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{table}' AS table_name, '{column}' AS column_name,
        count(*) - count({column}) AS null_count FROM {table}"""
        for column in TABLES[rules].required
    )


def _orphans(table: str, rules: str) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{table}' AS table_name, '{column}' AS column_name, {column} AS key,
        count(*) AS row_count FROM {table}
        WHERE {column} IS NOT NULL AND {column} NOT IN (SELECT id FROM {target})
        GROUP BY {column}"""
        for column, target in TABLES[rules].references.items()
    )


def _domains(table: str, rules: str) -> str:
    severities = fv.ALERT_SEVERITIES if rules == "alerts" else fv.SEVERITIES
    return " UNION ALL ".join(
        f"""SELECT '{table}' AS table_name, '{column}' AS column_name, {column} AS value,
        count(*) AS row_count FROM {table}
        WHERE {column} NOT IN ({', '.join(_text(a) for a in allowed)}) GROUP BY {column}"""
        for column, allowed in (("category", fv.CATEGORIES), ("severity", severities))
        if column in TABLES[rules].columns
    )


def _union(parts) -> str:
    return " UNION ALL ".join(part for part in parts if part)


_BAND = (
    "CASE WHEN score >= 90 THEN {} WHEN score >= 75 THEN {} "
    "WHEN score >= 60 THEN {} ELSE {} END"
)
_BAND_NAMES = _BAND.format("'excellent'", "'good'", "'needs_improvement'", "'critical'")
_BAND_COLORS = _BAND.format("'#639922'", "'#1D9E75'", "'#BA7517'", "'#E24B4A'")

_SHORT = sorted(fv.SHORT_CATEGORY_LABELS.items())
_PIVOT = ", ".join(
    f"""coalesce(max(CASE WHEN category = '{c}' THEN score END), 0) AS "{label}",
    concat({_show(f"coalesce(max(CASE WHEN category = '{c}' THEN score END), 0)", 0)}, '%')
    AS "{label} text" """
    for c, label in _SHORT
)

_ALERT_TITLE = _map("alert_type", {k: v[1] for k, v in fv.ALERT_TEMPLATES.items()})
_ALERT_SEVERITY = _map("alert_type", {k: v[0] for k, v in fv.ALERT_TEMPLATES.items()})


def _message(team: str, pct: str, threshold: str, category: str, sprint: str) -> str:
    return f"""CASE alert_type
        WHEN 'token_budget' THEN concat({team}, ' has consumed ', {pct}, '% of sprint token budget')
        WHEN 'compliance_drop' THEN concat({team}, ' compliance dropped below ', {threshold},
          '% in ', {category})
        WHEN 'security_incident' THEN concat('PII exposure detected in ', {team}, ' codebase')
        WHEN 'quality_gate' THEN concat({team}, ' failed SonarQube quality gate in Sprint ',
          {sprint})
        WHEN 'adoption_milestone' THEN concat({team}, ' reached ', {pct}, '% AI adoption rate')
        END"""


_INGEST = """
    SELECT id, team_id, sprint_id, policy_id, policy_name, category, severity, file_path,
      line_number, tool, resolved, reasons,
      CASE WHEN reasons = '' THEN 'accepted' ELSE 'rejected' END AS status
    FROM (
      SELECT sha256(request_id) AS id, team_id, sprint_id, policy_id, policy_name, category,
        severity, file_path,
        CASE WHEN regexp_full_match(line_number, '[0-9]+([.]0+)?')
          THEN CAST(CAST(line_number AS DOUBLE) AS INT) END AS line_number,
        tool, 0 AS resolved,
        concat_ws('; ',
          CASE WHEN severity IS NULL THEN 'missing severity' END,
          CASE WHEN NOT regexp_full_match(line_number, '[0-9]+([.]0+)?')
            THEN 'bad line_number' END,
          CASE WHEN team_id NOT IN (SELECT id FROM teams) THEN 'unknown team_id' END,
          CASE WHEN sprint_id NOT IN (SELECT id FROM feed_sprints) THEN 'unknown sprint_id' END
        ) AS reasons
      FROM violation_feed)"""


# DuckDB's regex engine needs no guard against long runs and knows no look-behind.
_TEXT_PATTERNS = {
    **fv.TEXT_PATTERNS,
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
}


def _evaluation() -> str:
    measures = " ".join(
        f"WHEN '{policy}' THEN q.{column}"
        for policy, (column, _) in fv.MEASURED_POLICIES.items()
    )
    counted = [
        p[0] for p in fv.POLICIES
        if p[0] not in fv.MEASURED_POLICIES and p[0] not in fv.UNMEASURED_POLICIES
    ]
    in_counted = ", ".join(_text(p) for p in counted)
    at_least = ", ".join(_text(p) for p, (_, d) in fv.MEASURED_POLICIES.items() if d == "min")
    means = ", ".join(f"avg({c}) AS {c}" for c, _ in fv.MEASURED_POLICIES.values())
    return f"""
        SELECT team, sprint_id, policy_id, threshold, measure,
          CASE WHEN measure IS NULL THEN 'no_data'
            WHEN policy_id IN ({at_least}) THEN
              CASE WHEN measure >= threshold THEN 'pass' ELSE 'fail' END
            WHEN measure <= threshold THEN 'pass' ELSE 'fail' END AS status
        FROM (
          SELECT t.name AS team, pairs.sprint_id, p.id AS policy_id,
            CAST(p.threshold AS DOUBLE) AS threshold,
            CASE WHEN p.id IN ({in_counted}) THEN CAST(coalesce(v.n, 0) AS DOUBLE)
              ELSE CASE p.id {measures} END END AS measure
          FROM (SELECT t.id AS team_id, s.id AS sprint_id FROM teams t CROSS JOIN sprints s
            UNION SELECT team_id, sprint_id FROM policy_violations
            UNION SELECT team_id, sprint_id FROM code_quality_metrics) pairs
          CROSS JOIN (SELECT * FROM policies) p
          JOIN teams t ON t.id = pairs.team_id
          LEFT JOIN (SELECT team_id, sprint_id, policy_id, count(*) AS n FROM policy_violations
            GROUP BY ALL) v ON v.team_id = pairs.team_id AND v.sprint_id = pairs.sprint_id
            AND v.policy_id = p.id
          LEFT JOIN (SELECT team_id, sprint_id, {means} FROM code_quality_metrics
            GROUP BY ALL) q ON q.team_id = pairs.team_id AND q.sprint_id = pairs.sprint_id)"""


def _scoped(table: str, value: str) -> str:
    return f"""
        SELECT coalesce(t.name, '?') AS scope, f.sprint_id, {value} AS v
        FROM {table} f JOIN teams t ON f.team_id = t.id GROUP BY ALL
        UNION ALL SELECT 'All Teams', sprint_id, {value} FROM {table} f GROUP BY ALL"""


_BODIES = {
    "Q01_teams_list": "SELECT * FROM teams",
    "Q02_sprints_list": "SELECT * FROM sprints",
    "Q03_compliance_scores": _detail("compliance_scores"),
    "Q05_violations_recent": _detail(
        "policy_violations", tail="ORDER BY f.detected_at DESC, f.id LIMIT 50"
    ),
    "Q05_violations_recent_critical": _detail(
        "policy_violations", "WHERE f.severity = 'critical'",
        "ORDER BY f.detected_at DESC, f.id LIMIT 500",
    ),
    "Q06_token_usage_detail": _detail("token_usage"),
    "Q08_adoption_detail": _detail("adoption_metrics"),
    "Q09_security_incidents": _detail("security_incidents"),
    "Q10_code_quality_detail": _detail("code_quality_metrics"),
    "Q11_lifecycle_detail": _detail("lifecycle_metrics"),
    "Q12_alerts_filtered": _detail("alerts"),
    "Q12_alerts_unacknowledged": _detail("alerts", "WHERE f.acknowledged = 0"),
    "Q04_compliance_heatmap": """
        SELECT f.sprint_id, t.name AS team, f.category, round(avg(f.score), 1) AS score
        FROM compliance_scores f JOIN teams t ON f.team_id = t.id GROUP BY ALL""",
    "Q07_token_summary": """
        SELECT f.sprint_id, t.name AS team, f.model,
          CAST(sum(f.total_tokens) AS BIGINT) AS total_tokens,
          CAST(round(sum(CAST(f.cost_usd AS DECIMAL(18, 4))), 2) AS DOUBLE) AS total_cost
        FROM token_usage f JOIN teams t ON f.team_id = t.id GROUP BY ALL""",
    "Q14_kpi_avg_compliance": _kpi_only("avg_compliance"),
    "Q15_kpi_violation_count": _kpi_only("violations"),
    "Q16_kpi_token_cost": _kpi_only("token_cost"),
    "Q17_kpi_adoption_rate": _kpi_only("adoption_rate"),
    "Q18_kpi_incident_count": _kpi_only("incidents"),
    "Q23_compliance_trend": """
        SELECT s.name AS sprint, t.name AS team, avg(f.score) AS score
        FROM compliance_scores f JOIN teams t ON f.team_id = t.id
        JOIN sprints s ON f.sprint_id = s.id GROUP BY s.name, t.name, s.number""",
    "Q24_violations_by_severity": """
        SELECT sprint_id, severity, count(*) AS count FROM policy_violations GROUP BY ALL""",
    "Q19_sprint_previous": """
        SELECT s.id AS sprint_id, s.name, s.number, p.id AS previous_sprint_id
        FROM sprints s LEFT JOIN sprints p ON p.number = s.number - 1""",
    "Q20_kpi_deltas": "SELECT * FROM deltas",
    "Q20_from_stored_sums": "SELECT * FROM deltas",
    "Q21_kpi_direction": f"""
        SELECT sprint_id,
          concat({_show('avg_compliance', 1)}, '%') AS compliance_text,
          concat(CASE WHEN delta_avg_compliance >= 0 THEN '↑' ELSE '↓' END, ' ',
            {_show('abs(delta_avg_compliance)', 1)}, '% vs prev sprint') AS compliance_delta_text,
          CASE WHEN delta_avg_compliance >= 0 THEN 'positive' ELSE 'negative' END
            AS compliance_flag,
          {_BAND_COLORS.replace('score', 'avg_compliance')} AS compliance_color,
          CAST(violations AS VARCHAR) AS violations_text,
          concat(CASE WHEN delta_violations > 0 THEN '↑' ELSE '↓' END, ' ',
            CAST(abs(delta_violations) AS VARCHAR), ' vs prev sprint') AS violations_delta_text,
          CASE WHEN delta_violations > 0 THEN 'negative' ELSE 'positive' END AS violations_flag,
          {_short('token_cost', 2, '$')} AS cost_text,
          concat(CASE WHEN delta_token_cost > 0 THEN '↑' ELSE '↓' END, ' ',
            {_short('abs(delta_token_cost)', 2, '$')}, ' vs prev') AS cost_delta_text,
          CASE WHEN delta_token_cost > 0 THEN 'negative' ELSE 'positive' END AS cost_flag,
          concat({_show('adoption_rate', 0)}, '%') AS adoption_text,
          CAST(incidents AS VARCHAR) AS incidents_text
        FROM deltas""",
    "Q25_kpi_bands": """
        SELECT *,
          CASE WHEN violations > 20 THEN 'red' WHEN violations > 10 THEN 'amber'
            ELSE 'green' END AS violation_band,
          CASE WHEN violations > 20 THEN '#E24B4A' WHEN violations > 10 THEN '#BA7517'
            ELSE '#639922' END AS violation_color,
          CASE WHEN incidents > 3 THEN 'red' WHEN incidents > 0 THEN 'amber'
            ELSE 'green' END AS incident_band,
          CASE WHEN incidents > 3 THEN '#E24B4A' WHEN incidents > 0 THEN '#BA7517'
            ELSE '#639922' END AS incident_color,
          CASE WHEN incidents > 3 THEN 'negative' ELSE 'neutral' END AS incident_flag
        FROM (SELECT coalesce(v.team_id, i.team_id) AS team_id,
            coalesce(v.sprint_id, i.sprint_id) AS sprint_id,
            coalesce(v.n, 0) AS violations, coalesce(i.n, 0) AS incidents
          FROM (SELECT team_id, sprint_id, count(*) AS n FROM policy_violations GROUP BY ALL) v
          FULL JOIN (SELECT team_id, sprint_id, count(*) AS n FROM security_incidents
            GROUP BY ALL) i ON i.team_id = v.team_id AND i.sprint_id = v.sprint_id)""",
    "Q28_team_scope": f"""
        SELECT scope, sprint_id, coalesce(c.v, 0) AS avg_compliance,
          coalesce(v.v, 0) AS violations, coalesce(u.v, 0) AS token_cost
        FROM ({_scoped('compliance_scores', 'avg(f.score)')}) c
        FULL JOIN ({_scoped('policy_violations', 'count(*)')}) v USING (scope, sprint_id)
        FULL JOIN ({_scoped('token_usage', _usd('f.cost_usd'))}) u USING (scope, sprint_id)""",
    "Q26_active_alerts": f"""
        SELECT * EXCLUDE (position), concat('**', team_name, '** — ', message) AS text
        FROM (SELECT *, row_number() OVER (PARTITION BY sprint_id ORDER BY
            CASE severity WHEN 'critical' THEN 1 WHEN 'high' THEN 2 WHEN 'medium' THEN 3
            ELSE 4 END, id) AS position
          FROM ({_detail('alerts', 'WHERE f.acknowledged = 0')}))
        WHERE position <= 8""",
    "Q27_latest_sprint": "SELECT * FROM sprints ORDER BY number DESC LIMIT 1",
    "Q22_heatmap_pivot": f"""
        SELECT sprint_id, team, {_PIVOT}
        FROM (SELECT f.sprint_id, t.name AS team, f.category, avg(f.score) AS score
          FROM compliance_scores f JOIN teams t ON f.team_id = t.id GROUP BY ALL)
        GROUP BY sprint_id, team""",
    "F01_severity_rank": """
        SELECT severity,
          CASE severity WHEN 'critical' THEN 1 WHEN 'high' THEN 2 WHEN 'medium' THEN 3
            WHEN 'low' THEN 4 ELSE 5 END AS violation_rank,
          CASE severity WHEN 'critical' THEN 1 WHEN 'high' THEN 2 WHEN 'medium' THEN 3
            ELSE 4 END AS alert_rank,
          count(*) AS n
        FROM alerts GROUP BY ALL""",
    "F02_severity_color": f"""
        SELECT severity, {_map('severity', fv.SEVERITY_COLORS, "'#888780'")} AS color,
          count(*) AS n FROM alerts GROUP BY ALL""",
    "F03_compliance_band": f"""
        SELECT {_BAND_NAMES} AS band, {_BAND_COLORS} AS color, count(*) AS n
        FROM compliance_scores GROUP BY ALL""",
    "F04_format_number": f"""
        SELECT {_short('total_tokens', 1)} AS shown, count(*) AS n
        FROM token_usage GROUP BY ALL""",
    "F05_format_currency": f"""
        SELECT {_short('roi_estimate_usd', 2, '$')} AS shown, count(*) AS n
        FROM adoption_metrics GROUP BY ALL""",
    "F06_category_label": f"""
        SELECT category, {_map('category', fv.CATEGORY_LABELS)} AS label,
          {_map('category', fv.SHORT_CATEGORY_LABELS)} AS short_label, count(*) AS n
        FROM compliance_scores GROUP BY ALL""",
    "F07_alert_class": f"""
        SELECT severity, {_map('severity', fv.ALERT_CLASSES, "'alert-info'")} AS alert_class,
          {_map('severity', fv.ALERT_ICONS, _text(fv.DEFAULT_ALERT_ICON))} AS icon,
          count(*) AS n
        FROM alerts GROUP BY ALL""",
    "F08_team_color": """
        SELECT t.name AS team_name,
          CASE t.name WHEN 'NATION_0' THEN '#534AB7' WHEN 'NATION_1' THEN '#1D9E75'
            WHEN 'NATION_2' THEN '#D85A30' WHEN 'NATION_3' THEN '#378ADD' END AS color,
          count(*) AS n
        FROM security_incidents f JOIN teams t ON f.team_id = t.id GROUP BY ALL""",
    "M01_token_cost": "SELECT id, model, total_tokens, cost_usd FROM token_usage",
    "M02_rules_passed": """
        SELECT id, total_rules, least(100, greatest(0, score)) AS score, rules_passed
        FROM compliance_scores""",
    "M03_adoption_rate": """
        SELECT id, ai_active_developers, adoption_rate_pct FROM adoption_metrics""",
    "M04_velocity_roi": """
        SELECT id, sprint_velocity_points, roi_estimate_usd FROM adoption_metrics""",
    "M05_line_split": """
        SELECT id, total_lines, ai_lines, CAST(trunc(total_lines - ai_lines) AS INT) AS human_lines
        FROM (SELECT id, ai_generated_lines + human_authored_lines AS total_lines,
            CAST(trunc(CAST(ai_generated_lines + human_authored_lines AS DOUBLE)
              * (docstring_coverage_pct / 100.0::DOUBLE) * 0.6::DOUBLE) AS INT) AS ai_lines
          FROM code_quality_metrics)""",
    "M06_sprint_calendar": """
        SELECT s.*, (SELECT count(*) FROM lineitem
          WHERE CAST(l_shipdate AS DATE) BETWEEN s.start_date AND s.end_date) AS shipments
        FROM sprints s""",
    "M06_irregular_calendar": """
        SELECT sprint_id, coalesce(sprint_id, before) AS sprint_or_before,
          CAST(sum(n) AS BIGINT) AS shipments, min(day) AS first_day, max(day) AS last_day
        FROM (
          SELECT day, any_value(n) AS n,
            arg_max(id, (first, number)) FILTER (day BETWEEN first AND last) AS sprint_id,
            arg_max(id, (last, first, number)) FILTER (last < day) AS before
          FROM (SELECT CAST(l_shipdate AS DATE) AS day, count(*) AS n FROM lineitem GROUP BY 1),
            (SELECT id, number, CAST(start_date + number * 5 % 7 AS DATE) AS first,
               CAST(start_date + number * 5 % 7 + 6 + number * 11 % 15 AS DATE) AS last FROM sprints)
          GROUP BY day)
        GROUP BY ALL""",
    "M07_alert_message": f"""
        SELECT a.id, {_ALERT_SEVERITY} AS severity, {_ALERT_TITLE} AS title,
          {_message('t.name', '75 + CAST(a.id AS BIGINT) % 36', '60 + CAST(a.id AS BIGINT) % 21',
                    "CASE WHEN CAST(a.id AS BIGINT) % 2 = 0 THEN 'security' "
                    "ELSE 'data_privacy' END",
                    's.number')} AS message
        FROM alerts a JOIN teams t ON a.team_id = t.id JOIN sprints s ON a.sprint_id = s.id""",
    "M08_violation_text": """
        SELECT concat('Violation of ', policy_name, ' detected in AI-generated code') AS text,
          count(*) AS n FROM policy_violations GROUP BY ALL""",
    "L01_load_tables": _union(_counts_and_nulls(table) for table in TABLES),
    "L02_run_query": """
        SELECT t.name AS team, f.category, count(*) AS violations
        FROM policy_violations f JOIN teams t ON f.team_id = t.id
        WHERE f.severity = 'critical' AND f.resolved = 0 GROUP BY ALL""",
    "L03_write_table": """
        SELECT sprint_id, resolved, count(*) AS n FROM policy_violations GROUP BY ALL""",
    "L04_full_refresh": _union(
        f"SELECT '{table}' AS table_name, count(*) AS row_count FROM {table}" for table in TABLES
    ),
    "L04_snapshot_refresh": _union(
        f"SELECT '{table}' AS table_name, count(*) AS row_count FROM {table}" for table in TABLES
    ),
    "L05_apply_defaults": """
        SELECT 'absent' AS input, 'open' AS status, count(*) AS n FROM security_incidents
        UNION ALL
        SELECT 'given', nullif(status, 'resolved'), count(*) FROM security_incidents
        GROUP BY ALL""",
    "L06_policy_dim": """
        SELECT a.policy_id, a.role, p.category, p.severity,
          CAST(p.threshold AS DOUBLE) AS threshold, coalesce(n, 0) AS violations
        FROM applies a JOIN policies p ON p.id = a.policy_id
        LEFT JOIN per_policy v ON v.policy_id = a.policy_id""",
    "L06_policy_file": """
        SELECT a.policy_id, a.role, p.category, p.severity,
          CAST(p.threshold AS DOUBLE) AS threshold, coalesce(n, 0) AS violations, '' AS reasons
        FROM applies a JOIN policies p ON p.id = a.policy_id
        LEFT JOIN per_policy v ON v.policy_id = a.policy_id
        WHERE a.policy_id NOT IN (SELECT policy_id FROM refused_policies WHERE policy_id IS NOT NULL)
        UNION ALL
        SELECT r.policy_id, NULL, NULL, NULL, NULL, coalesce(n, 0), r.reasons
        FROM refused_policies r LEFT JOIN per_policy v ON v.policy_id = r.policy_id""",
    "L07_model_price_dim": """
        SELECT p.model, CAST(p_in AS DOUBLE) AS input_cost_per_1k,
          CAST(p_out AS DOUBLE) AS output_cost_per_1k,
          CAST(coalesce(sum(input_tokens), 0) AS BIGINT) AS input_tokens,
          CAST(coalesce(sum(output_tokens), 0) AS BIGINT) AS output_tokens
        FROM prices p LEFT JOIN token_usage u ON u.model = p.model GROUP BY ALL""",
    "DQ01_pk_duplicates": _union(_duplicates(table) for table in _CHECKED),
    "DQ02_not_null": _union(_null_counts(table, rules) for table, rules in _CHECKED.items()),
    "DQ03_fk_orphans": _union(_orphans(table, rules) for table, rules in _CHECKED.items()),
    "DQ04_domain_check": _union(_domains(table, rules) for table, rules in _CHECKED.items()),
    "DQ05_pii_type_rule": """
        SELECT id, incident_type, pii_type FROM security_incidents
        WHERE pii_type IS NOT NULL
          AND NOT (contains(incident_type, 'pii') OR contains(incident_type, 'data'))""",
    "Q13_ingest_violations": _INGEST,
    "ST01_ingest_stream": _INGEST,
    "ST01_redelivered_feed": _INGEST,
    "D01_token_budget": """
        SELECT *, 100.0::DOUBLE * tokens / budget AS pct,
          CASE WHEN 100.0::DOUBLE * tokens / budget >= 100 THEN 'escalate'
            WHEN 100.0::DOUBLE * tokens / budget >= 80 THEN 'alert' ELSE 'ok' END AS status
        FROM budget""",
    "D02_threshold_alerts": f"""
        SELECT concat_ws(':', alert_type, team_id, sprint_id, category) AS id, team_id, sprint_id,
          alert_type, {_ALERT_SEVERITY} AS severity, {_ALERT_TITLE} AS title,
          {_message('t.name', 'pct', '60', 'category', 's.number')} AS message,
          'governance_engine' AS source, 0 AS acknowledged
        FROM (
          SELECT team_id, sprint_id, 'token_budget' AS alert_type,
            CAST(floor(100.0::DOUBLE * tokens / budget) AS BIGINT) AS pct,
            CAST(NULL AS VARCHAR) AS category
          FROM budget WHERE 100.0::DOUBLE * tokens / budget >= 80
          UNION ALL SELECT team_id, sprint_id, 'compliance_drop', NULL, category
          FROM compliance_scores GROUP BY ALL HAVING avg(score) < 60
          UNION ALL SELECT team_id, sprint_id, 'quality_gate', NULL, NULL
          FROM code_quality_metrics GROUP BY ALL HAVING avg(sonarqube_score) < 80
          UNION ALL SELECT DISTINCT team_id, sprint_id, 'security_incident', NULL, NULL
          FROM security_incidents WHERE incident_type = 'pii_exposure'
          UNION ALL SELECT team_id, sprint_id, 'adoption_milestone',
            CAST(floor(avg(adoption_rate_pct)) AS BIGINT), NULL
          FROM adoption_metrics GROUP BY team_id, sprint_id HAVING avg(adoption_rate_pct) >= 75) d
        JOIN teams t ON t.id = d.team_id JOIN sprints s ON s.id = d.sprint_id""",
    "D02_alert_stream": f"""
        SELECT concat_ws(':', alert_type, team_id, sprint_id, category) AS id, team_id, sprint_id,
          alert_type, {_ALERT_SEVERITY} AS severity, {_ALERT_TITLE} AS title,
          {_message('t.name', 'pct', '60', 'category', 's.number')} AS message,
          'governance_engine' AS source, 0 AS acknowledged
        FROM (
          SELECT team_id, sprint_id, 'token_budget' AS alert_type,
            CAST(floor(100.0::DOUBLE * tokens / budget) AS BIGINT) AS pct,
            CAST(NULL AS VARCHAR) AS category
          FROM budget WHERE 100.0::DOUBLE * tokens / budget >= 80
          UNION ALL SELECT team_id, sprint_id, 'compliance_drop', NULL, category
          FROM compliance_scores GROUP BY ALL HAVING avg(score) < 60
          UNION ALL SELECT team_id, sprint_id, 'quality_gate', NULL, NULL
          FROM code_quality_metrics GROUP BY ALL HAVING avg(sonarqube_score) < 80
          UNION ALL SELECT DISTINCT team_id, sprint_id, 'security_incident', NULL, NULL
          FROM security_incidents WHERE incident_type = 'pii_exposure'
          UNION ALL SELECT team_id, sprint_id, 'adoption_milestone',
            CAST(floor(avg(adoption_rate_pct)) AS BIGINT), NULL
          FROM adoption_metrics GROUP BY team_id, sprint_id HAVING avg(adoption_rate_pct) >= 75) d
        JOIN teams t ON t.id = d.team_id JOIN sprints s ON s.id = d.sprint_id""",
    "D02_alerts_by_policy_file": f"""
        SELECT concat_ws(':', alert_type, team_id, sprint_id, category) AS id, team_id, sprint_id,
          alert_type, {_ALERT_SEVERITY} AS severity, {_ALERT_TITLE} AS title,
          {_message('t.name', 'pct', '60', 'category', 's.number')} AS message,
          'governance_engine' AS source, 0 AS acknowledged
        FROM (
          SELECT team_id, sprint_id, 'token_budget' AS alert_type,
            CAST(floor(100.0::DOUBLE * tokens / budget) AS BIGINT) AS pct,
            CAST(NULL AS VARCHAR) AS category
          FROM budget WHERE 100.0::DOUBLE * tokens / budget >= 80
          UNION ALL SELECT team_id, sprint_id, 'compliance_drop', NULL, category
          FROM compliance_scores GROUP BY ALL HAVING avg(score) < 60
          UNION ALL SELECT team_id, sprint_id, 'quality_gate', NULL, NULL
          FROM code_quality_metrics GROUP BY ALL HAVING avg(sonarqube_score) < 90
          UNION ALL SELECT DISTINCT team_id, sprint_id, 'security_incident', NULL, NULL
          FROM security_incidents WHERE incident_type = 'pii_exposure'
          UNION ALL SELECT team_id, sprint_id, 'adoption_milestone',
            CAST(floor(avg(adoption_rate_pct)) AS BIGINT), NULL
          FROM adoption_metrics GROUP BY team_id, sprint_id HAVING avg(adoption_rate_pct) >= 75) d
        JOIN teams t ON t.id = d.team_id JOIN sprints s ON s.id = d.sprint_id""",
    "D03_policy_evaluation": _evaluation(),
    "D04_role_policy_matrix": """
        SELECT p.id AS policy_id,
          CAST(count(*) FILTER (l.role = 'developer') AS INT) AS developer,
          CAST(count(*) FILTER (l.role = 'tech_lead') AS INT) AS tech_lead,
          CAST(count(*) FILTER (l.role = 'security_team') AS INT) AS security_team,
          CAST(count(*) FILTER (l.role = 'management') AS INT) AS management,
          coalesce(any_value(v.n), 0) AS violations
        FROM policies p LEFT JOIN listed l ON l.policy_id = p.id
        LEFT JOIN per_policy v ON v.policy_id = p.id GROUP BY p.id""",
    "D05_role_mismatch": """
        SELECT m.policy_id, m.role, m.found_in, coalesce(v.n, 0) AS violations
        FROM (SELECT *, 'applies_to' AS found_in FROM (SELECT * FROM applies
            EXCEPT SELECT * FROM listed)
          UNION ALL SELECT *, 'role_list' FROM (SELECT * FROM listed
            EXCEPT SELECT * FROM applies)) m
        LEFT JOIN per_policy v ON v.policy_id = m.policy_id""",
    "D06_violation_trend": """
        SELECT s.id AS sprint_id, s.number, team, violations, previous,
          violations - previous AS change
        FROM (SELECT coalesce(a.number, b.number + 1) AS number, coalesce(a.team, b.team) AS team,
            coalesce(a.n, 0) AS violations, coalesce(b.n, 0) AS previous
          FROM (SELECT s.number, t.name AS team, count(*) AS n FROM policy_violations f
            JOIN teams t ON t.id = f.team_id JOIN sprints s ON s.id = f.sprint_id GROUP BY ALL) a
          FULL JOIN (SELECT s.number, t.name AS team, count(*) AS n FROM policy_violations f
            JOIN teams t ON t.id = f.team_id JOIN sprints s ON s.id = f.sprint_id GROUP BY ALL) b
          ON a.team = b.team AND a.number = b.number + 1) x
        JOIN sprints s ON s.number = x.number""",
    "D07_cost_rollup": f"""
        SELECT f.sprint_id, t.name AS team, f.model,
          CAST(GROUPING_ID(f.sprint_id, t.name, f.model) AS INT) AS level,
          CAST(sum(f.total_tokens) AS BIGINT) AS total_tokens, {_usd('f.cost_usd')} AS total_cost
        FROM token_usage f JOIN teams t ON f.team_id = t.id
        GROUP BY ROLLUP (f.sprint_id, t.name, f.model)""",
    "D07_daily_consumption": f"""
        SELECT date, model, CAST(sum(input_tokens) AS BIGINT) AS input_tokens,
          CAST(sum(output_tokens) AS BIGINT) AS output_tokens,
          CAST(sum(total_tokens) AS BIGINT) AS total_tokens, {_usd('cost_usd')} AS cost_usd
        FROM token_usage GROUP BY ALL""",
    "D08_quality_scorecard": """
        SELECT *, CAST(ai_generated_lines AS DOUBLE)
            / nullif(ai_generated_lines + human_authored_lines, 0) AS ai_line_share,
          CAST(flagged_ai_snippets * 1000 AS DOUBLE) / nullif(ai_generated_lines, 0)
            AS flagged_per_1k_ai_lines
        FROM (SELECT t.name AS team, f.sprint_id, avg(sonarqube_score) AS sonarqube_score,
            avg(complexity_avg) AS complexity_avg, avg(duplication_pct) AS duplication_pct,
            avg(test_coverage_pct) AS test_coverage_pct,
            avg(docstring_coverage_pct) AS docstring_coverage_pct,
            avg(type_hint_coverage_pct) AS type_hint_coverage_pct,
            CAST(sum(ai_generated_lines) AS BIGINT) AS ai_generated_lines,
            CAST(sum(human_authored_lines) AS BIGINT) AS human_authored_lines,
            CAST(sum(flagged_ai_snippets) AS BIGINT) AS flagged_ai_snippets,
            CAST(sum(bugs_found) AS BIGINT) AS bugs_found,
            CAST(sum(code_smells) AS BIGINT) AS code_smells,
            CAST(sum(vulnerabilities) AS BIGINT) AS vulnerabilities
          FROM code_quality_metrics f JOIN teams t ON f.team_id = t.id GROUP BY ALL)""",
    "D09_adoption_roi": f"""
        SELECT sprint_id, avg(adoption_rate_pct) AS mean_adoption_pct,
          sum(adoption_rate_pct * total_developers) / sum(total_developers)
            AS weighted_adoption_pct,
          CAST(sum(ai_active_developers) AS DOUBLE) / sum(total_developers) AS active_share,
          avg(productivity_gain_pct) AS mean_productivity_gain_pct,
          {_usd('roi_estimate_usd')} AS roi_usd
        FROM adoption_metrics GROUP BY sprint_id""",
    "D10_security_summary": """
        SELECT incident_type, severity, status, count(*) AS incidents,
          count(pii_type) AS with_pii_type,
          count(*) FILTER (incident_type = 'hardcoded_secret') AS secrets
        FROM security_incidents GROUP BY ALL""",
    "D10_pii_incidents": """
        SELECT pii_type, count(*) AS incidents,
          count(*) FILTER (status <> 'resolved') AS unresolved
        FROM security_incidents WHERE pii_type IS NOT NULL GROUP BY ALL""",
    "D11_lifecycle_summary": """
        SELECT t.name AS team, f.sprint_id, count(*) AS stages,
          CAST(sum(is_monitored) * 100 AS DOUBLE) / count(*) AS monitored_pct,
          CAST(sum(defects_leaked) AS DOUBLE) / nullif(sum(defects_found), 0) AS defect_leakage,
          avg(test_automation_pct) AS mean_test_automation_pct,
          avg(pipeline_pass_rate) AS mean_pipeline_pass_rate
        FROM lifecycle_metrics f JOIN teams t ON f.team_id = t.id GROUP BY ALL""",
    "D12_pii_secret_scan": "SELECT * FROM ("
    + _union(
        f"""SELECT doc_id, '{kind}' AS kind,
        CAST(len(regexp_extract_all(text, {_text(pattern)})) AS INT) AS hits FROM documents"""
        for kind, pattern in _TEXT_PATTERNS.items()
    )
    + ") WHERE hits > 0",
    "D12_dictionary_scan": r"""
        SELECT doc_id, kind, count(*) AS hits
        FROM (
          SELECT doc_id, unnest(list_transform(range(1, len(w) - n + 2),
            lambda i: array_to_string(w[i:i + n - 1], ' '))) AS phrase, n
          FROM (SELECT doc_id, regexp_extract_all(lower(text),
              '[\p{L}\p{N}]+(?:[''-][\p{L}\p{N}]+)*') AS w FROM documents),
            (SELECT unnest([2, 3]) AS n)
          WHERE len(w) >= n) d
        JOIN (
          SELECT DISTINCT kind, array_to_string(w[f:f + n - 1], ' ') AS phrase, n
          FROM (SELECT regexp_extract_all(lower(text),
              '[\p{L}\p{N}]+(?:[''-][\p{L}\p{N}]+)*') AS w FROM benchmark),
            (SELECT * FROM (VALUES ('opening', 1, 3), ('middle', 4, 2)) v(kind, f, n))) p
        USING (phrase, n)
        GROUP BY ALL""",
    "D12_unmarked_secrets": """
        SELECT doc_id, token, round(bits, 6) AS bits
        FROM (
          SELECT doc_id, token, list_sum(list_transform(list_distinct(string_split(token, '')),
            lambda c: -log2((length(token) - length(replace(token, c, ''))) / length(token))
              * ((length(token) - length(replace(token, c, ''))) / length(token)))) AS bits
          FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9+/_=-]+')) AS token
            FROM documents)
          WHERE regexp_full_match(token, '[A-Za-z0-9+/_-]{20,200}={0,2}')
            AND regexp_matches(token, '[0-9]') AND regexp_matches(token, '[A-Za-z]'))
        WHERE bits >= 3.2""",
    "D13_compliance_adherence": """
        SELECT t.name AS team, CAST(sum(rules_passed) AS BIGINT) AS rules_passed,
          CAST(sum(total_rules) AS BIGINT) AS total_rules,
          CAST(sum(rules_passed) * 100 AS DOUBLE) / sum(total_rules) AS adherence_pct
        FROM compliance_scores f JOIN teams t ON f.team_id = t.id GROUP BY ALL""",
}


def _slice(name: str, where: str, without: str = "") -> str:
    """Some rows of the whole query's SQL."""
    columns = f"* EXCLUDE ({without})" if without else "*"
    return f"SELECT {columns} FROM ({_BODIES[name]}) WHERE {where}"


_SPRINT = "sprint_id = 'sprint-60'"
_TEAM_COST = """
    SELECT s.id AS sprint_id, coalesce(c.v, 0) AS token_cost
    FROM sprints s LEFT JOIN (
      SELECT f.sprint_id, {usd} AS v FROM token_usage f
      {join} GROUP BY f.sprint_id) c ON c.sprint_id = s.id"""

_BODIES |= {
    "Q03_one_sprint_and_team": _slice(
        "Q03_compliance_scores", f"{_SPRINT} AND team_id = 'team-3'"
    ),
    "Q04_one_sprint": _slice("Q04_compliance_heatmap", _SPRINT, "sprint_id"),
    "Q04_empty_sprint_name": _BODIES["Q04_compliance_heatmap"],
    "Q06_one_sprint_and_team": _slice(
        "Q06_token_usage_detail", f"{_SPRINT} AND team_id = 'team-3'"
    ),
    "Q07_one_sprint": _slice("Q07_token_summary", _SPRINT, "sprint_id"),
    "Q09_one_team_critical": _slice(
        "Q09_security_incidents", "team_id = 'team-3' AND severity = 'critical'"
    ),
    "Q12_one_sprint_acknowledged": _slice("Q12_alerts_filtered", f"{_SPRINT} AND acknowledged = 1"),
    "Q14_one_sprint": _slice("Q14_kpi_avg_compliance", _SPRINT, "sprint_id"),
    "Q14_unknown_team": "SELECT CAST(0 AS DOUBLE) AS avg_compliance",
    "Q15_one_sprint": _slice("Q15_kpi_violation_count", _SPRINT, "sprint_id"),
    "Q16_one_sprint": _slice("Q16_kpi_token_cost", _SPRINT, "sprint_id"),
    "Q17_one_sprint": _slice("Q17_kpi_adoption_rate", _SPRINT, "sprint_id"),
    "Q18_one_sprint": _slice("Q18_kpi_incident_count", _SPRINT, "sprint_id"),
    "Q20_one_sprint": _slice("Q20_kpi_deltas", _SPRINT),
    "Q20_first_sprint": _slice("Q20_kpi_deltas", "sprint_id = 'sprint-1'"),
    "Q24_one_sprint": _slice("Q24_violations_by_severity", _SPRINT, "sprint_id"),
    "Q26_one_sprint": _slice("Q26_active_alerts", _SPRINT),
    "Q28_one_team": _TEAM_COST.format(
        usd=_usd("f.cost_usd"), join="JOIN teams t ON f.team_id = t.id AND t.name = 'NATION_3'"
    ),
    "Q28_all_teams": _TEAM_COST.format(usd=_usd("f.cost_usd"), join=""),
}


def oracle_sql() -> dict[str, str]:
    return {name: _with(body) for name, body in _BODIES.items()}

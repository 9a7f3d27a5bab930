import sys
from datetime import date, datetime
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from stewardspark.schemas import TABLES  # noqa: E402
from stewardspark.tables import Tables  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def folder(tmp_path):
    return str(tmp_path)


@pytest.fixture(scope="session")
def make(spark):
    """make("alerts", {...}, {...}): rows of a table, absent columns NULL."""

    def build(name, *rows):
        spec = TABLES[name]
        data = [tuple(row.get(column) for column in spec.columns) for row in rows]
        return spark.createDataFrame(data, spec.schema)

    return build


def day(number: int) -> datetime:
    return datetime(2025, 10, number)


@pytest.fixture(scope="session")
def small(make):
    """Hand-written tables: three teams, sprints 1, 2, 3, 10 and 12, and odd rows."""
    teams = make(
        "teams",
        {"id": "t1", "name": "Alpha", "size": 10},
        {"id": "t2", "name": "Beta", "size": 5, "lead": "Bo"},
        {"id": "t3", "name": "Gamma", "size": 2},
    )
    sprints = make(
        "sprints",
        *[
            {
                "id": f"s{n}",
                "name": f"Sprint {n}",
                "number": n,
                "start_date": date(2025, 1, n),
                "end_date": date(2025, 2, n),
            }
            for n in (10, 1, 2, 3, 12)
        ],
    )

    def score(i, team, sprint, category, value, rules=10, passed=5):
        return {
            "id": f"c{i}", "team_id": team, "sprint_id": sprint, "category": category,
            "score": value, "total_rules": rules, "rules_passed": passed,
            "computed_at": day(i),
        }

    scores = make(
        "compliance_scores",
        score(1, "t1", "s1", "security", 59.99),
        score(2, "t1", "s1", "security", 60.0),
        score(3, "t2", "s1", "testing", 75.0),
        score(4, "t1", "s2", "security", 90.0, 10, 9),
        score(5, "t2", "s10", "documentation", 80.0),
        score(6, "nobody", "s1", "security", 0.0),
    )

    def violation(i, team, sprint, policy, severity, resolved=0):
        return {
            "id": f"v{i}", "team_id": team, "sprint_id": sprint, "policy_id": policy,
            "policy_name": policy.lower(), "category": "security", "severity": severity,
            "resolved": resolved, "detected_at": day(1 + i % 3),
        }

    violations = make(
        "policy_violations",
        violation(1, "t1", "s1", "SEC-001", "critical"),
        violation(2, "t1", "s1", "SEC-003", "high"),
        violation(3, "t1", "s1", "SEC-003", "high"),
        violation(4, "t2", "s1", "SEC-003", "low", 1),
        violation(5, "t1", "s2", "SEC-001", "odd"),
        violation(6, "t2", "s10", "PF-001", "medium"),
    )
    usage = make(
        "token_usage",
        *[
            {
                "id": f"u{i}", "team_id": team, "sprint_id": sprint, "date": date(2025, 10, i),
                "model": model, "input_tokens": tokens, "output_tokens": 0,
                "total_tokens": tokens, "cost_usd": cost,
            }
            for i, (team, sprint, model, tokens, cost) in enumerate(
                [
                    ("t1", "s1", "gpt-4o", 1440000, 0.1),
                    ("t1", "s2", "gpt-4o", 1800000, 0.2),
                    ("t2", "s2", "gpt-4o", 719999, 0.3),
                    ("t3", "s1", "gpt-4o", 5, 1500.0),
                ],
                start=1,
            )
        ],
    )

    def alert(i, team, severity, acknowledged=0, sprint="s1"):
        return {
            "id": f"a{i:02d}", "team_id": team, "sprint_id": sprint, "alert_type": "token_budget",
            "severity": severity, "title": "x", "message": f"m{i}",
            "acknowledged": acknowledged, "created_at": day(1),
        }

    alerts = make(
        "alerts",
        *[alert(i, "t1", "high") for i in range(1, 11)],
        alert(11, "t2", "critical"),
        alert(12, None, "critical"),
        alert(13, "t2", "warning", sprint="s2"),
        alert(14, "t2", "medium", sprint="s2"),
        alert(15, "t2", "info", sprint="s2"),
        alert(16, "t2", "critical", acknowledged=1, sprint="s2"),
    )
    incidents = make(
        "security_incidents",
        {"id": "i1", "team_id": "t1", "sprint_id": "s1", "incident_type": "pii_exposure",
         "severity": "high", "pii_type": "email", "status": "open", "detected_at": day(1)},
        {"id": "i2", "team_id": "t1", "sprint_id": "s1", "incident_type": "weak_crypto",
         "severity": "high", "pii_type": "ssn", "status": "resolved", "detected_at": day(1)},
        {"id": "i3", "team_id": "t2", "sprint_id": "s2", "incident_type": "hardcoded_secret",
         "severity": "critical", "status": "resolved", "detected_at": day(2)},
    )
    adoption = make(
        "adoption_metrics",
        {"id": "d1", "team_id": "t1", "sprint_id": "s1", "total_developers": 10,
         "ai_active_developers": 8, "adoption_rate_pct": 80.0, "roi_estimate_usd": 500.0},
        {"id": "d2", "team_id": "t2", "sprint_id": "s1", "total_developers": 5,
         "ai_active_developers": 1, "adoption_rate_pct": 20.0, "roi_estimate_usd": 250.5},
    )
    quality = make(
        "code_quality_metrics",
        {"id": "q1", "team_id": "t1", "sprint_id": "s1", "sonarqube_score": 79.0,
         "complexity_avg": 15.0, "docstring_coverage_pct": 70.0, "type_hint_coverage_pct": 59.0,
         "test_coverage_pct": 70.0, "ai_generated_lines": 0, "human_authored_lines": 0,
         "flagged_ai_snippets": 3},
        {"id": "q2", "team_id": "t3", "sprint_id": "s3", "sonarqube_score": 80.0,
         "complexity_avg": 16.0, "ai_generated_lines": 500, "human_authored_lines": 1500,
         "flagged_ai_snippets": 1},
    )
    lifecycle = make(
        "lifecycle_metrics",
        {"id": "l1", "team_id": "t1", "sprint_id": "s1", "stage": "design", "is_monitored": 1,
         "defects_found": 4, "defects_leaked": 1, "test_automation_pct": 50.0,
         "pipeline_pass_rate": 90.0},
        {"id": "l2", "team_id": "t1", "sprint_id": "s1", "stage": "testing", "is_monitored": 0,
         "defects_found": 0, "defects_leaked": 0, "test_automation_pct": 70.0,
         "pipeline_pass_rate": 80.0},
    )
    return Tables.of(
        teams=teams, sprints=sprints, policy_violations=violations, compliance_scores=scores,
        code_quality_metrics=quality, token_usage=usage, adoption_metrics=adoption,
        security_incidents=incidents, lifecycle_metrics=lifecycle, alerts=alerts,
    )


"""Column types, required columns, keys and defaults of the ten tables.

Event times carry no zone in the data, hence ``timestamp_ntz``: results do not
change with the session time zone.
"""

from dataclasses import dataclass, field

from pyspark.sql.types import (
    DateType,
    DoubleType,
    IntegerType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
)

_TYPES = {
    "string": StringType(),
    "int": IntegerType(),
    "double": DoubleType(),
    "date": DateType(),
    "timestamp_ntz": TimestampNTZType(),
}


@dataclass(frozen=True)
class TableSpec:
    name: str
    schema: StructType
    required: tuple[str, ...]
    # column -> SQL expression used when the column is absent on insert
    defaults: dict[str, str] = field(default_factory=dict)
    # column -> table whose id it must hold
    references: dict[str, str] = field(default_factory=dict)
    partition_by: tuple[str, ...] = ()

    @property
    def columns(self) -> list[str]:
        return self.schema.names


# Wall-clock time in UTC without a zone, as the stored event times are.
NOW_UTC = "convert_timezone('UTC', localtimestamp())"

_TEAM_AND_SPRINT = {"team_id": "teams", "sprint_id": "sprints"}


def _spec(name, columns, required, defaults=None, references=None):
    named = [column.split() for column in columns.split(",")]
    schema = StructType([StructField(column, _TYPES[kind]) for column, kind in named])
    return TableSpec(
        name,
        schema,
        tuple(required.split()),
        defaults or {},
        references or {},
        ("sprint_id",) if "sprint_id" in schema.names else (),
    )


TABLES = {
    spec.name: spec
    for spec in [
        _spec(
            "teams",
            "id string, name string, size int, lead string, created_at timestamp_ntz",
            "id name size",
            {"created_at": NOW_UTC},
        ),
        _spec(
            "sprints",
            "id string, name string, number int, start_date date, end_date date",
            "id name number start_date end_date",
        ),
        _spec(
            "policy_violations",
            """id string, team_id string, sprint_id string, policy_id string,
            policy_name string, category string, severity string, description string,
            file_path string, line_number int, tool string, resolved int,
            resolved_at timestamp_ntz, detected_at timestamp_ntz""",
            "id team_id sprint_id policy_id category severity",
            {"resolved": "0", "detected_at": NOW_UTC},
            _TEAM_AND_SPRINT,
        ),
        _spec(
            "compliance_scores",
            """id string, team_id string, sprint_id string, category string, score double,
            total_rules int, rules_passed int, computed_at timestamp_ntz""",
            "id team_id sprint_id category score",
            {"computed_at": NOW_UTC},
            _TEAM_AND_SPRINT,
        ),
        _spec(
            "code_quality_metrics",
            """id string, team_id string, sprint_id string, sonarqube_score double,
            complexity_avg double, duplication_pct double, test_coverage_pct double,
            docstring_coverage_pct double, type_hint_coverage_pct double,
            ai_generated_lines int, human_authored_lines int, flagged_ai_snippets int,
            bugs_found int, code_smells int, vulnerabilities int, computed_at timestamp_ntz""",
            "id team_id sprint_id",
            {
                "ai_generated_lines": "0",
                "human_authored_lines": "0",
                "flagged_ai_snippets": "0",
                "bugs_found": "0",
                "code_smells": "0",
                "vulnerabilities": "0",
                "computed_at": NOW_UTC,
            },
            _TEAM_AND_SPRINT,
        ),
        _spec(
            "token_usage",
            """id string, team_id string, sprint_id string, date date, model string,
            input_tokens int, output_tokens int, total_tokens int, cost_usd double,
            developer_count int""",
            "id team_id sprint_id date model",
            {
                "input_tokens": "0",
                "output_tokens": "0",
                "total_tokens": "0",
                "cost_usd": "0.0D",
                "developer_count": "1",
            },
            _TEAM_AND_SPRINT,
        ),
        _spec(
            "adoption_metrics",
            """id string, team_id string, sprint_id string, total_developers int,
            ai_active_developers int, adoption_rate_pct double, ai_assisted_commits_pct double,
            avg_time_saved_hrs double, productivity_gain_pct double,
            sprint_velocity_points int, baseline_velocity_points int, roi_estimate_usd double,
            computed_at timestamp_ntz""",
            "id team_id sprint_id",
            {"computed_at": NOW_UTC},
            _TEAM_AND_SPRINT,
        ),
        _spec(
            "security_incidents",
            """id string, team_id string, sprint_id string, incident_type string,
            severity string, description string, affected_file string, pii_type string,
            detected_by string, status string, resolved_at timestamp_ntz,
            detected_at timestamp_ntz""",
            "id team_id sprint_id incident_type severity",
            {"status": "'open'", "detected_at": NOW_UTC},
            _TEAM_AND_SPRINT,
        ),
        _spec(
            "lifecycle_metrics",
            """id string, team_id string, sprint_id string, stage string, is_monitored int,
            compliance_pct double, ai_coverage_pct double, test_automation_pct double,
            defects_found int, defects_leaked int, pipeline_pass_rate double,
            computed_at timestamp_ntz""",
            "id team_id sprint_id stage",
            {
                "is_monitored": "0",
                "compliance_pct": "0.0D",
                "ai_coverage_pct": "0.0D",
                "test_automation_pct": "0.0D",
                "defects_found": "0",
                "defects_leaked": "0",
                "pipeline_pass_rate": "0.0D",
                "computed_at": NOW_UTC,
            },
            _TEAM_AND_SPRINT,
        ),
        # Alerts may lack a team or sprint, and neither has to exist.
        _spec(
            "alerts",
            """id string, team_id string, sprint_id string, alert_type string,
            severity string, title string, message string, source string,
            acknowledged int, created_at timestamp_ntz""",
            "id alert_type severity title",
            {"acknowledged": "0", "created_at": NOW_UTC},
        ),
    ]
}

"""Detail reads: fact rows with their team's name, filtered and sorted.

A filter counts only when its value is given; None and the empty string mean no
filter. Every sort ends in ``id``: the order is then total, and the range
partitioning of the sort can split a time stamp that very many rows share.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_LIMIT = 500


def with_team_name(fact: DataFrame, teams: DataFrame) -> DataFrame:
    """Rows of known teams, with ``team_name`` after the fact's own columns."""
    names = teams.select(F.col("id").alias("team_id"), F.col("name").alias("team_name"))
    return fact.join(names, "team_id").select(*fact.columns, "team_name")


def where_given(df: DataFrame, **values) -> DataFrame:
    for column, value in values.items():
        if value:
            df = df.filter(F.col(column) == value)
    return df


def _newest_first(df: DataFrame, time_column: str) -> DataFrame:
    return df.orderBy(F.col(time_column).desc_nulls_last(), "id")


def teams_list(teams: DataFrame) -> DataFrame:
    return teams.orderBy("name", "id")


def sprints_list(sprints: DataFrame) -> DataFrame:
    return sprints.orderBy("number", "id")


def compliance_scores(scores, teams, sprint_id=None, team_id=None) -> DataFrame:
    chosen = where_given(scores, sprint_id=sprint_id, team_id=team_id)
    return _newest_first(with_team_name(chosen, teams), "computed_at")


def violations_recent(
    violations, teams, sprint_id=None, team_id=None, severity=None, limit=50
) -> DataFrame:
    """The ``limit`` latest violations."""
    if not 1 <= limit <= MAX_LIMIT:
        raise ValueError(f"limit must lie between 1 and {MAX_LIMIT}, not {limit}")
    chosen = where_given(violations, sprint_id=sprint_id, team_id=team_id, severity=severity)
    return _newest_first(with_team_name(chosen, teams), "detected_at").limit(limit)


def token_usage_detail(usage, teams, sprint_id=None, team_id=None) -> DataFrame:
    chosen = where_given(usage, sprint_id=sprint_id, team_id=team_id)
    return _newest_first(with_team_name(chosen, teams), "date")


def adoption_detail(adoption, teams, sprint_id=None) -> DataFrame:
    chosen = where_given(adoption, sprint_id=sprint_id)
    return _newest_first(with_team_name(chosen, teams), "computed_at")


def security_incidents(incidents, teams, sprint_id=None, team_id=None, severity=None) -> DataFrame:
    chosen = where_given(incidents, sprint_id=sprint_id, team_id=team_id, severity=severity)
    return _newest_first(with_team_name(chosen, teams), "detected_at")


def code_quality_detail(quality, teams, sprint_id=None) -> DataFrame:
    chosen = where_given(quality, sprint_id=sprint_id)
    return _newest_first(with_team_name(chosen, teams), "computed_at")


def lifecycle_detail(lifecycle, teams, sprint_id=None) -> DataFrame:
    chosen = where_given(lifecycle, sprint_id=sprint_id)
    return _newest_first(with_team_name(chosen, teams), "computed_at")


def alerts_filtered(alerts, teams, sprint_id=None, acknowledged: bool | None = None) -> DataFrame:
    """Alerts of known teams; ``acknowledged`` None keeps both kinds."""
    chosen = where_given(alerts, sprint_id=sprint_id)
    if acknowledged is not None:
        chosen = chosen.filter(F.col("acknowledged") == int(acknowledged))
    return _newest_first(with_team_name(chosen, teams), "created_at")

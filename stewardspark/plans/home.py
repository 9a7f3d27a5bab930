"""All parts of the overview page for one sprint and one choice of team."""

from pyspark.sql import DataFrame

from stewardspark import fixed_values as fv
from stewardspark.operators import aggregates, kpis, reshape, selection
from stewardspark.tables import Tables


def overview(
    tables: Tables, sprint: str | None = None, team: str = fv.ALL_TEAMS
) -> dict[str, DataFrame]:
    """The page's tables by name, each lazy.

    ``sprint`` is a sprint's name, the latest one by default. The choice of team
    narrows the headline figures only; heatmap, trend, severities and alerts
    always show all teams. Just the trend reads more than the partitions of the
    sprint and the one before it.
    """
    sprints, teams = tables["sprints"], tables["teams"]
    chosen = selection.sprint_named(sprints, sprint) if sprint else selection.latest_sprint(sprints)
    found = chosen.first()
    if found is None:
        raise ValueError(f"there is no sprint {sprint!r}")
    sprint_id, scores = found.id, tables["compliance_scores"]
    figures = kpis.kpi_deltas(tables, team, sprint_id)
    return {
        "figures": figures,
        "figure_texts": kpis.kpi_direction(figures),
        "figure_bands": kpis.with_bands(figures.select("violations", "incidents")),
        "heatmap": reshape.heatmap_pivot(scores, teams, sprint_id),
        "trend": aggregates.compliance_trend(scores, teams, sprints),
        "severities": aggregates.violations_by_severity(tables["policy_violations"], sprint_id),
        "alerts": selection.active_alerts(tables["alerts"], teams, sprint_id),
    }

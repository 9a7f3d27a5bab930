"""Summaries per team and sprint: cost, quality, adoption, security, lifecycle."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stewardspark import fixed_values as fv
from stewardspark.functions import measures
from stewardspark.operators.aggregates import with_sprint, with_team

PER_TEAM_AND_SPRINT = ["team_id", "sprint_id"]


def team_budget(per_developer: int, multiplier: str = fv.TEAM_BUDGET_MULTIPLIER) -> Column:
    """Tokens that a team of ``size`` may use in a sprint."""
    factor = F.lit(multiplier).cast("decimal(9,3)")
    return (F.col("size") * F.lit(per_developer) * factor).cast("double")


def token_budget(
    usage,
    teams,
    per_developer: int = fv.TOKENS_PER_DEVELOPER,
    multiplier: str = fv.TEAM_BUDGET_MULTIPLIER,
    alert_pct: float = fv.BUDGET_ALERT_PCT,
    escalation_pct: float = fv.BUDGET_ESCALATION_PCT,
) -> DataFrame:
    """Tokens used against the budget of each team and sprint."""
    used = usage.groupBy(*PER_TEAM_AND_SPRINT).agg(F.sum("total_tokens").alias("tokens"))
    sizes = teams.select(F.col("id").alias("team_id"), F.col("name").alias("team"), "size")
    budget = team_budget(per_developer, multiplier)
    pct = measures.ratio(F.col("tokens") * F.lit(100.0), F.col("budget"))
    return (
        used.join(sizes, "team_id")
        .withColumn("budget", budget)
        .withColumn("pct", pct)
        .select(
            "team_id", "team", "sprint_id", "tokens", "budget", "pct",
            F.when(F.col("pct") >= escalation_pct, "escalate")
            .when(F.col("pct") >= alert_pct, "alert")
            .otherwise("ok")
            .alias("status"),
        )
    )


def violation_trend(violations, teams, sprints) -> DataFrame:
    """Violations per sprint and team with the change to the sprint before.

    Each count serves twice: for its own sprint, and as the previous value of
    the next sprint. So a sprint without violations after one with some shows,
    and the fact is read once.
    """
    counts = violations.groupBy(*PER_TEAM_AND_SPRINT).agg(F.count("*").alias("n"))
    numbered = with_sprint(with_team(counts, teams), sprints)
    zero = F.lit(0).cast("bigint")
    both = F.array(
        F.struct(
            F.col("number").alias("number"), F.col("n").alias("now"), zero.alias("before")
        ),
        F.struct(
            (F.col("number") + 1).alias("number"), zero.alias("now"), F.col("n").alias("before")
        ),
    )
    known = sprints.select(F.col("id").alias("sprint_id"), "number")
    return (
        numbered.select("team", F.inline(both))
        .groupBy("team", "number")
        .agg(F.sum("now").alias("violations"), F.sum("before").alias("previous"))
        .join(known, "number")
        .select(
            "sprint_id", "number", "team", "violations", "previous",
            (F.col("violations") - F.col("previous")).alias("change"),
        )
    )


def cost_rollup(usage, teams) -> DataFrame:
    """Tokens and cost by sprint, team and model, with subtotals.

    ``level`` is 0 for a single model, 1 for a team, 3 for a sprint, 7 for all.
    The rollup multiplies rows, so it runs over groups and not over fact rows.
    """
    groups = usage.groupBy(*PER_TEAM_AND_SPRINT, "model").agg(
        F.sum("total_tokens").alias("tokens"), measures.usd_sum(F.col("cost_usd")).alias("cost")
    )
    return (
        with_team(groups, teams)
        .rollup("sprint_id", "team", "model")
        .agg(
            F.grouping_id().cast("int").alias("level"),
            F.sum("tokens").alias("total_tokens"),
            measures.usd_sum(F.col("cost")).alias("total_cost"),
        )
    )


def daily_consumption(usage) -> DataFrame:
    """Tokens and cost per day and model."""
    return usage.groupBy("date", "model").agg(
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
        F.sum("total_tokens").alias("total_tokens"),
        measures.usd_sum(F.col("cost_usd")).alias("cost_usd"),
    )


def price_use(usage, prices) -> DataFrame:
    """Prices of each model with the tokens it was used for."""
    used = usage.groupBy("model").agg(
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
    )
    return prices.join(used, "model", "left").select(
        "model",
        F.col("input_cost_per_1k").cast("double").alias("input_cost_per_1k"),
        F.col("output_cost_per_1k").cast("double").alias("output_cost_per_1k"),
        F.coalesce("input_tokens", F.lit(0)).alias("input_tokens"),
        F.coalesce("output_tokens", F.lit(0)).alias("output_tokens"),
    )


def quality_scorecard(quality, teams) -> DataFrame:
    """Mean quality measures, AI line share and flagged snippets per 1000 AI lines."""
    means = [
        "sonarqube_score", "complexity_avg", "duplication_pct", "test_coverage_pct",
        "docstring_coverage_pct", "type_hint_coverage_pct",
    ]
    sums = [
        "ai_generated_lines", "human_authored_lines", "flagged_ai_snippets", "bugs_found",
        "code_smells", "vulnerabilities",
    ]
    ai, human = F.col("ai_generated_lines"), F.col("human_authored_lines")
    groups = quality.groupBy(*PER_TEAM_AND_SPRINT).agg(
        *[F.avg(c).alias(c) for c in means], *[F.sum(c).alias(c) for c in sums]
    )
    return with_team(groups, teams).select(
        "team", "sprint_id", *means, *sums,
        measures.ratio(ai, ai + human).alias("ai_line_share"),
        measures.ratio(F.col("flagged_ai_snippets") * 1000, ai).alias("flagged_per_1k_ai_lines"),
    )


def adoption_roi(adoption) -> DataFrame:
    """Adoption per sprint, as a plain mean and weighted by team size, and its return."""
    size = F.col("total_developers")
    return adoption.groupBy("sprint_id").agg(
        F.avg("adoption_rate_pct").alias("mean_adoption_pct"),
        measures.ratio(F.sum(F.col("adoption_rate_pct") * size), F.sum(size)).alias(
            "weighted_adoption_pct"
        ),
        measures.ratio(F.sum("ai_active_developers"), F.sum(size)).alias("active_share"),
        F.avg("productivity_gain_pct").alias("mean_productivity_gain_pct"),
        measures.usd_sum(F.col("roi_estimate_usd")).alias("roi_usd"),
    )


def security_summary(incidents) -> DataFrame:
    """Incidents by type, severity and status."""
    return incidents.groupBy("incident_type", "severity", "status").agg(
        F.count("*").alias("incidents"),
        F.count("pii_type").alias("with_pii_type"),
        F.count(F.when(F.col("incident_type") == "hardcoded_secret", 1)).alias("secrets"),
    )


def pii_incidents(incidents) -> DataFrame:
    """Exposures of personal data by kind, with those still open."""
    return (
        incidents.filter(F.col("pii_type").isNotNull())
        .groupBy("pii_type")
        .agg(
            F.count("*").alias("incidents"),
            F.count(F.when(F.col("status") != "resolved", 1)).alias("unresolved"),
        )
    )


def lifecycle_summary(lifecycle, teams) -> DataFrame:
    """Monitored share, defect leakage, mean automation and pass rate."""
    groups = lifecycle.groupBy(*PER_TEAM_AND_SPRINT).agg(
        F.sum("is_monitored").alias("monitored"),
        F.count("*").alias("stages"),
        F.sum("defects_leaked").alias("defects_leaked"),
        F.sum("defects_found").alias("defects_found"),
        F.avg("test_automation_pct").alias("mean_test_automation_pct"),
        F.avg("pipeline_pass_rate").alias("mean_pipeline_pass_rate"),
    )
    return with_team(groups, teams).select(
        "team", "sprint_id", "stages",
        measures.ratio(F.col("monitored") * 100, F.col("stages")).alias("monitored_pct"),
        measures.ratio(F.col("defects_leaked"), F.col("defects_found")).alias("defect_leakage"),
        "mean_test_automation_pct", "mean_pipeline_pass_rate",
    )


def compliance_adherence(scores, teams) -> DataFrame:
    """Share of rules adhered to per team, in percent."""
    groups = scores.groupBy("team_id").agg(
        F.sum("rules_passed").alias("passed"), F.sum("total_rules").alias("total")
    )
    return (
        with_team(groups, teams)
        .groupBy("team")
        .agg(F.sum("passed").alias("rules_passed"), F.sum("total").alias("total_rules"))
        .withColumn(
            "adherence_pct",
            measures.ratio(F.col("rules_passed") * 100, F.col("total_rules")),
        )
    )

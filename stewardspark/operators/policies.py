"""Policies against roles, violations and quality measures."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stewardspark import fixed_values as fv
from stewardspark.operators.aggregates import with_team
from stewardspark.sources.dimensions import policy_roles


def _violations_per_policy(violations: DataFrame) -> DataFrame:
    return violations.groupBy("policy_id").agg(F.count("*").alias("violations"))


def violations_per_role(violations: DataFrame, policies: DataFrame) -> DataFrame:
    """Each policy and role it applies to, with the violations of the policy."""
    facts = policies.select(F.col("id").alias("policy_id"), "category", "severity", "threshold")
    return (
        policy_roles(policies)
        .join(facts, "policy_id")
        .join(_violations_per_policy(violations), "policy_id", "left")
        .select(
            "policy_id", "role", "category", "severity", "threshold",
            F.coalesce("violations", F.lit(0)).alias("violations"),
        )
    )


def violations_of_refused(violations: DataFrame, refused: DataFrame) -> DataFrame:
    """Policies of a file that were refused (id, reasons), with the violations that name them."""
    counts = _violations_per_policy(violations)
    return refused.join(counts, refused["id"] == counts["policy_id"], "left").select(
        F.col("id").alias("policy_id"), "reasons", F.coalesce("violations", F.lit(0)).alias("violations")
    )


def role_policy_matrix(violations, policies, listed, roles=None) -> DataFrame:
    """One row per policy: 1 under each role that lists it, and its violations.

    ``listed`` holds role and policy_id.
    """
    roles = roles or fv.ROLES
    flags = listed.groupBy("policy_id").pivot("role", roles).agg(F.lit(1))
    return (
        policies.select(F.col("id").alias("policy_id"))
        .join(flags, "policy_id", "left")
        .join(_violations_per_policy(violations), "policy_id", "left")
        .na.fill(0, [*roles, "violations"])
    )


def role_mismatch(violations, policies, listed) -> DataFrame:
    """Pairs of role and policy found in only one of the two places that state them."""
    applies = policy_roles(policies).withColumn("applies", F.lit(True))
    stated = listed.withColumn("listed", F.lit(True))
    return (
        applies.join(stated, ["policy_id", "role"], "full")
        .filter(F.col("applies").isNull() | F.col("listed").isNull())
        .withColumn(
            "found_in", F.when(F.col("applies").isNull(), "role_list").otherwise("applies_to")
        )
        .join(_violations_per_policy(violations), "policy_id", "left")
        .select(
            "policy_id", "role", "found_in",
            F.coalesce("violations", F.lit(0)).alias("violations"),
        )
    )


def team_sprints(teams: DataFrame, sprints: DataFrame) -> DataFrame:
    """Every listed team with every listed sprint: the list of sprints, which is one
    short array, is unfolded for each team."""
    listed = sprints.agg(F.collect_set("id")).scalar()
    return teams.select(F.col("id").alias("team_id"), F.explode(listed).alias("sprint_id"))


def policy_evaluation(violations, quality, teams, policies=None, sprints=None) -> DataFrame:
    """pass, fail or no_data per policy, team and sprint; no_data without a threshold.

    A policy is judged on its number of violations, or on the mean of a quality
    measure. All teams and sprints count that reported a violation or a quality
    measure, and with ``sprints`` every listed team in every listed sprint: where
    nothing happened there are no violations, and no measures. Each fact is read once and reduced to one row per team and sprint
    with a column per policy; the policies are unfolded after that.
    """
    policies = fv.POLICIES if policies is None else policies
    counted = [
        p[0] for p in policies
        if p[0] not in fv.MEASURED_POLICIES and p[0] not in fv.UNMEASURED_POLICIES
    ]
    keys = ["team_id", "sprint_id"]
    counts = violations.groupBy(*keys).agg(
        *[F.count(F.when(F.col("policy_id") == p, 1)).cast("double").alias(p) for p in counted]
    )
    means = quality.groupBy(*keys).agg(
        *[F.avg(column).alias(p) for p, (column, _) in fv.MEASURED_POLICIES.items()]
    )
    wide = counts.join(means, keys, "full")
    if sprints is not None:
        wide = team_sprints(teams, sprints).join(wide, keys, "full")
    wide = wide.na.fill(0.0, counted)

    def judged(policy):
        name, threshold = policy[0], None if policy[6] is None else float(policy[6])
        if name in fv.UNMEASURED_POLICIES or threshold is None:
            measure, kept = F.lit(None).cast("double"), F.lit(None).cast("boolean")
        else:
            measure = F.col(f"`{name}`")
            at_least = fv.MEASURED_POLICIES.get(name, (None, "max"))[1] == "min"
            kept = measure >= threshold if at_least else measure <= threshold
        status = F.when(kept, "pass").when(~kept, "fail").otherwise("no_data")
        return F.struct(
            F.lit(name).alias("policy_id"),
            F.lit(threshold).cast("double").alias("threshold"),
            measure.alias("measure"),
            status.alias("status"),
        )

    long = wide.select(*keys, F.inline(F.array(*[judged(p) for p in policies])))
    return with_team(long, teams).select(
        "team", "sprint_id", "policy_id", "threshold", "measure", "status"
    )

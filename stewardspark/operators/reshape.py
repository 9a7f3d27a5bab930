"""The compliance heatmap as a wide table."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stewardspark import fixed_values as fv
from stewardspark.functions import scalars
from stewardspark.operators.aggregates import mean_scores


def heatmap_pivot(scores, teams, sprint_id=None, categories=None) -> DataFrame:
    """One row per team, one column per category with its mean, 0 where missing.

    The categories are given, so the columns never depend on the data and no
    extra pass is needed to find them. Each column comes with its cell text.
    """
    categories = categories or sorted(fv.CATEGORIES)
    labels = {c: fv.SHORT_CATEGORY_LABELS.get(c, c) for c in categories}
    means = mean_scores(scores, teams, sprint_id)
    keys = [c for c in means.columns if c not in ("category", "score")]
    wide = (
        means.groupBy(*keys)
        .pivot("category", categories)
        .agg(F.first("score"))
        .na.fill(0.0, categories)
        .withColumnsRenamed(labels)
    )
    texts = [
        F.concat(scalars.fixed_text(F.col(f"`{label}`"), 0), F.lit("%")).alias(f"{label} text")
        for label in labels.values()
    ]
    return wide.select("*", *texts).orderBy(*keys)

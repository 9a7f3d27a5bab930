"""Token cost of usage rows."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stewardspark.functions import measures
from stewardspark.sources.dimensions import micro_prices


def with_token_cost(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Usage rows with total tokens and cost; rows without input tokens go.

    A model without a price keeps its row, with a NULL cost.
    """
    tokens_in, tokens_out = F.col("input_tokens"), F.col("output_tokens")
    cost = measures.token_cost_usd(
        tokens_in, tokens_out, F.col("input_price"), F.col("output_price")
    )
    kept = [c for c in usage.columns if c not in ("total_tokens", "cost_usd", "output_tokens")]
    return (
        usage.filter(tokens_in > 0)
        .join(micro_prices(prices), "model", "left")
        .select(
            *kept,
            F.greatest(F.lit(0), tokens_out).alias("output_tokens"),
            F.greatest(F.lit(0), tokens_in + tokens_out).alias("total_tokens"),
            F.when(F.col("input_price").isNotNull(), cost).alias("cost_usd"),
        )
    )

"""Token counts and prices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Dollars for a token in and out.
PRICES = {
    "claude-3-opus-20240229": (0.000015, 0.000075),
    "claude-3-sonnet-20240229": (0.000003, 0.000015),
    "claude-3-haiku-20240307": (0.00000025, 0.00000125),
    "claude-opus-4-1-20250805": (0.000015, 0.000075),
    "claude-sonnet-4-5-20250929": (0.000003, 0.000015),
    "claude-haiku-4-5-20251001": (0.00000025, 0.00000125),
    "claude-sonnet-4-20250514": (0.000003, 0.000015),
    "claude-opus-4-20250514": (0.000015, 0.000075),
}


def prices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(m, *p) for m, p in PRICES.items()], "model string, price_in double, price_out double")


def with_cost(usage: DataFrame) -> DataFrame:
    """``usage``: model, input_tokens, output_tokens. A model without a price costs as much as the dearest one."""
    dear = max(PRICES.values())
    known = F.broadcast(prices(usage.sparkSession))  # a constant of a few rows
    p_in, p_out = F.coalesce("price_in", F.lit(dear[0])), F.coalesce("price_out", F.lit(dear[1]))
    return usage.join(known, "model", "left").withColumn("cost", F.col("input_tokens") * p_in + F.col("output_tokens") * p_out).drop("price_in", "price_out")


def estimate(messages: DataFrame, key: str, max_tokens: str = "NULL") -> DataFrame:
    """Input tokens as a quarter of the characters of a conversation, output as asked or 100."""
    return messages.groupBy(key).agg(F.expr("CAST(floor(sum(length(text)) / 4) AS BIGINT)").alias("input_tokens"), F.expr(f"CAST(coalesce(nullif({max_tokens}, 0), 100) AS BIGINT)").alias("output_tokens"), F.count("*").alias("n_messages"))


def totals(usage: DataFrame) -> DataFrame:
    return usage.agg(F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"), F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"), F.coalesce(F.sum("cost"), F.lit(0.0)).alias("cost"), F.count("*").alias("requests"))

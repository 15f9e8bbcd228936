"""Token and cost estimates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def embed_tokens(text: Column) -> Column:
    """A quarter of the characters, at least 1; 0 for an empty text."""
    n = F.length(F.coalesce(text, F.lit("")))
    return F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(n / 4))).cast("long")


def is_local(provider: Column) -> Column:
    return F.lower(provider).isin("ollama", "local", "sentence-transformers", "huggingface")


def priced(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """cost_usd of (provider, model, tokens_in, tokens_out), by a price table of (model, usd_in, usd_out) a
    million tokens; local models and unknown prices cost 0."""
    of = usage.join(prices.withColumnRenamed("model", "__m"), F.lower("model") == F.col("__m"), "left")
    raw = (F.col("tokens_in") * F.coalesce("usd_in", F.lit(0.0)) + F.col("tokens_out") * F.coalesce("usd_out", F.lit(0.0))) / 1e6
    return of.withColumn("cost_usd", F.round(F.when(is_local(F.col("provider")), 0.0).otherwise(raw), 6)).drop("__m", "usd_in", "usd_out")

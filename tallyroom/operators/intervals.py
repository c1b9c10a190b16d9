"""Interval unions and capped budgets, by chunked running values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyroom.operators.skew import previous_max, range_chunks, running_sum


def union_length(intervals: DataFrame, key: str, chunk_width: int) -> DataFrame:
    """Covered length and number of islands of half-open ``[start, end)``.

    An interval adds what lies beyond the largest end before it. Chunks are
    stretches of ``chunk_width`` along the start, so a key with very many
    intervals is sorted stretch by stretch.
    """
    # Equal intervals add nothing but their count.
    packed = intervals.groupBy(key, "start", "end").agg(F.count(F.lit(1)).alias("_n"))
    chunked = packed.withColumn("_chunk", F.floor(F.col("start") / chunk_width))
    seen = previous_max(chunked, [key], "_chunk", ["start", "end"], "end", "_reach")
    reach = F.coalesce("_reach", F.col("start"))
    gain = F.greatest(F.lit(0).cast("bigint"), F.col("end") - F.greatest("start", reach))
    return seen.groupBy(key).agg(
        F.sum("_n").alias("intervals"),
        F.count(F.when(F.col("_reach").isNull() | (F.col("start") > F.col("_reach")), F.lit(1))).alias("islands"),
        F.sum(gain).cast("bigint").alias("covered"),
    )


def ceil_cost(tokens: Column, rate_per_million: int) -> Column:
    """Integer price ceiling of a token count."""
    units = tokens * F.lit(rate_per_million).cast("bigint") + F.lit(999_999).cast("bigint")
    return ((units - F.pmod(units, F.lit(1_000_000).cast("bigint"))) / F.lit(1_000_000).cast("bigint")).cast("bigint")


def budget(
    items: DataFrame, keys: list[str], order: str, tokens: Column, output_tokens: int,
    input_rate: int, output_rate: int, item_cap: int, run_cap: int,
) -> DataFrame:
    """Byte-length token ceilings, cost ceilings and caps per item and per run.

    The running spend of a run is carried from range chunk to range chunk.
    """
    out_cost = (output_tokens * output_rate + 999_999) // 1_000_000
    priced = items.withColumn("tokens", tokens).withColumn("cost", ceil_cost(F.col("tokens"), input_rate) + F.lit(out_cost).cast("bigint"))
    counted = priced.withColumn("_c", F.when(F.col("tokens") <= item_cap, F.col("cost")).otherwise(F.lit(0).cast("bigint")))
    chunked = range_chunks(counted.select(*keys, order, "tokens", "cost", "_c"), keys, [F.col(order)])
    run = running_sum(chunked, keys, "_chunk", [order], "_c", "spent")
    return run.select(
        *keys, order, "tokens", "cost", "spent",
        F.when(F.col("tokens") > item_cap, "item-over-cap").when(F.col("spent") > run_cap, "run-over-cap").otherwise("queued").alias("status"),
    )

"""Exact statistics that combine before the shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyroom.operators.skew import hot_keys, magnitude_chunk, running_sum, spread_join


def exact_median(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """Exact median of whole numbers per key.

    Equal values are counted first; a running count over the distinct values
    (chunked by size) finds the one or two middle values. The built-in exact
    percentile would hold every value of a group in one task's memory.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    chunked = counts.withColumn("_chunk", -magnitude_chunk(F.col("_v")))
    run = running_sum(chunked, keys, "_chunk", ["_v"], "_n", "_upto")
    totals = counts.groupBy(*keys).agg(F.sum("_n").alias("_total"), F.count(F.lit(1)).alias("_values"))
    low = F.expr("(_total + 1) div 2")
    high = F.expr("(_total + 2) div 2")
    holds = lambda rank: (F.col("_upto") >= rank) & (F.col("_upto") - F.col("_n") < rank)
    return (
        spread_join(run, totals.drop("_values"), keys, "inner", spread_on=["_v"], hot=hot_keys(totals, keys, "_values"))
        .groupBy(*keys)
        .agg(F.max(F.when(holds(low), F.col("_v"))).alias("_a"), F.max(F.when(holds(high), F.col("_v"))).alias("_b"))
        .select(*keys, ((F.col("_a") + F.col("_b")).cast("double") / F.lit(2.0)).alias(out))
    )

"""Exact money: decimals for rates, whole cents for sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyroom.operators.skew import hot_keys, spread_join

MONEY = "decimal(20,2)"
RATE = "decimal(18,12)"


def round_to_quantum(value: Column, quantum: str = "0.01", method: str = "half-up") -> Column:
    """Round a decimal to a multiple of ``quantum``, half up or half even."""
    step = F.lit(quantum).cast("decimal(12,6)")
    rounder = {"half-up": F.round, "half-even": F.bround}[method]
    return (rounder((value.cast("decimal(32,12)") / step).cast("decimal(38,12)"), 0).cast("decimal(26,0)") * step).cast(MONEY)


def shares_of_total(parts: DataFrame, keys: list[str], amount: str) -> DataFrame:
    """Each part over the total of its key; null unless the total is positive.

    The totals come from one aggregation; a key with very many parts is spread.
    """
    totals = parts.groupBy(*keys).agg(F.sum(amount).cast("bigint").alias("total"), F.count(F.lit(1)).alias("_n"))
    share = F.when(F.col("total") > 0, F.col(amount).cast("double") / F.col("total").cast("double"))
    return spread_join(parts, totals.drop("_n"), keys, "inner", hot=hot_keys(totals, keys, "_n")).withColumn("share", share)


def display_tolerance(printed: Column, money: Column) -> Column:
    """Half the last displayed unit of a number as printed. Money is shown in
    cents, or in whole units when it has no decimal point."""
    places = F.when(printed.contains("."), F.length(F.substring_index(printed, ".", -1))).otherwise(0)
    shown = F.when(money & (places > 0), 2).otherwise(places)
    return F.lit(0.5) * F.pow(F.lit(10.0), -shown)

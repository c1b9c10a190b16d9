"""Years: newest filing, fallback text, ordered history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def years_of(filings: DataFrame, key: str, year: str, payload: list[str]) -> DataFrame:
    """One row per key and year. Repeated filings of a year reduce to the
    greatest payload, so a key has as many rows as it has years."""
    return filings.groupBy(key, year).agg(
        F.max(F.struct(*payload)).alias("_p"), F.count(F.lit(1)).alias("filings")
    ).select(key, year, "filings", *[F.col(f"_p.{p}").alias(p) for p in payload])


def fallback_reason(latest: Column, current: int, oldest: int) -> Column:
    """Why an older year stands in: the years after it that have no record."""
    missing = F.array_join(F.transform(F.reverse(F.sequence(latest + 1, F.lit(current))), lambda y: y.cast("string")), " or ")
    return (
        F.when(latest.isNull(), F.lit(f"No {oldest}-{current} record in the locked files."))
        .when(latest >= current, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("No "), missing, F.lit(" record in the locked files.")))
    )


def latest_filing(directory: DataFrame, filings: DataFrame, key: str, year: str, payload: list[str], current: int, oldest: int) -> DataFrame:
    """Newest year of each directory row with its payload and fallback text.

    ``max`` over a struct led by the year combines before the shuffle; no group
    is sorted.
    """
    newest = filings.groupBy(key).agg(F.max(F.struct(year, *payload)).alias("_n"))
    return directory.join(newest, key, "left").select(
        *directory.columns,
        F.col(f"_n.{year}").alias("latest_year"),
        *[F.col(f"_n.{p}").alias(p) for p in payload],
        fallback_reason(F.col(f"_n.{year}"), current, oldest).alias("fallback_reason"),
    )


def requested_or_latest(filings: DataFrame, key: str, year: str, requested: int, payload: list[str]) -> DataFrame:
    """The requested year when the key has it, else its newest."""
    row = F.struct(year, *payload)
    picked = filings.groupBy(key).agg(
        F.max(F.when(F.col(year) == requested, row)).alias("_r"), F.max(row).alias("_n")
    )
    chosen = picked.withColumn("_c", F.coalesce("_r", "_n"))
    return chosen.select(
        key, F.col(f"_c.{year}").alias(year), *[F.col(f"_c.{p}").alias(p) for p in payload], F.col("_r").isNotNull().alias("as_requested")
    )


def year_history(years: DataFrame, key: str, year: str, name: str) -> DataFrame:
    """Newest-first years of a key and its names in first-seen order.

    ``years`` has one row per key and year, so the lists are as short as the
    period covered.
    """
    rows = years.groupBy(key).agg(F.reverse(F.array_sort(F.collect_list(F.struct(year, name)))).alias("_h"))
    return rows.select(
        key,
        F.transform("_h", lambda s: s[year]).alias("years"),
        F.array_distinct(F.transform("_h", lambda s: s[name])).alias("names"),
    )

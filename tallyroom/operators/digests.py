"""Canonical digests of records and of whole record sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEPARATOR = "\x1f"


def record_digest(*columns: str | Column) -> Column:
    """SHA-256 over the columns as text, a unit separator between them; null
    stays different from empty text."""
    parts = [
        F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("\x00")) for c in columns
    ]
    return F.sha2(F.concat_ws(SEPARATOR, *parts), 256)


def set_digest(df: DataFrame, groups: list[str], digest: str) -> DataFrame:
    """Order-free digest of the set of record digests in each group.

    A digest tree: equal records are counted first, then sub-digests are made by
    the leading 6, 4 and 2 hex digits of the record digest and last for the
    whole group. Every list that is joined into one text holds about
    rows / 16^6 entries or at most 256 sub-digests, whatever the group size.
    """
    level = df.groupBy(*groups, F.col(digest).alias("_d")).agg(F.count(F.lit(1)).alias("_n"))
    records = F.sum("_n")
    prefix, entry, order = F.substring("_d", 1, 6), F.concat_ws(":", "_d", F.col("_n").cast("string")), "_d"
    level = level.groupBy(*groups, prefix.alias("_p")).agg(
        F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, entry.alias("e")))), lambda s: s["e"]), ","), 256).alias("_h"),
        records.alias("_n"),
    )
    for width in (4, 2, 0):
        level = level.groupBy(*groups, F.substring("_p", 1, width).alias("_q")).agg(
            F.sha2(
                F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_p", "_h"))), lambda s: s["_h"]), ","),
                256,
            ).alias("_h"),
            F.sum("_n").alias("_n"),
        ).withColumnRenamed("_q", "_p")
    return level.select(*groups, F.col("_n").alias("records"), F.col("_h").alias("set_digest"))

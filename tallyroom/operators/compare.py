"""Keyed comparison of two tables: the one join behind exact cover, snapshot
diff, inventory diff, lock overlay and the two-way reconciliations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def compare_sets(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    fields: list[str] = (),
    labels: tuple[str, str, str, str] = ("missing", "extra", "changed", "same"),
) -> DataFrame:
    """Full outer join on unique keys.

    ``labels`` name: only on the left, only on the right, a field differs, equal.
    ``differs`` lists the unequal fields in field order.
    """
    only_left, only_right, changed, same = labels
    l = left.select(*keys, F.struct(F.lit(1).alias("_in"), *fields).alias("_l"))
    r = right.select(*keys, F.struct(F.lit(1).alias("_in"), *fields).alias("_r"))
    differs = F.array(*[
        F.when(~F.col(f"_l.{f}").eqNullSafe(F.col(f"_r.{f}")), F.lit(f)) for f in fields
    ]) if fields else F.array().cast("array<string>")
    both = F.col("_l").isNotNull() & F.col("_r").isNotNull()
    return (
        l.join(r, keys, "full")
        .withColumn("differs", F.when(both, F.array_join(F.array_compact(differs), ",")).otherwise(F.lit("")))
        .withColumn(
            "status",
            F.when(F.col("_r").isNull(), only_left)
            .when(F.col("_l").isNull(), only_right)
            .when(F.col("differs") != "", changed)
            .otherwise(same),
        )
        .select(*keys, "status", "differs")
    )


def two_sided_difference(left: DataFrame, right: DataFrame, keys: list[str], sides=("left", "right")) -> DataFrame:
    """Keys on exactly one side, each labelled with its side. Keys are reduced
    to distinct values first, so repeated keys combine before the shuffle."""
    l = left.select(*keys).distinct().withColumn("_l", F.lit(1))
    r = right.select(*keys).distinct().withColumn("_r", F.lit(1))
    return (
        l.join(r, keys, "full")
        .filter(F.col("_l").isNull() | F.col("_r").isNull())
        .select(*keys, F.when(F.col("_r").isNull(), sides[0]).otherwise(sides[1]).alias("side"))
    )


def overlay(ledger: DataFrame, lock: DataFrame, key: str, field: str) -> DataFrame:
    """Lock values override ledger values; a disagreement is an error and a lock
    row nobody uses is a warning."""
    a = ledger.select(key, F.lit(1).alias("_a"), F.col(field).alias("_av"))
    b = lock.select(key, F.lit(1).alias("_b"), F.col(field).alias("_bv"))
    return a.join(b, key, "full").select(
        key,
        F.coalesce("_bv", "_av").alias(field),
        F.when(F.col("_a").isNull(), "unused-lock")
        .when(F.col("_b").isNull(), "unlocked")
        .when(F.col("_av").isNotNull() & ~F.col("_av").eqNullSafe(F.col("_bv")), "mismatch")
        .when(F.col("_av").isNull(), "filled")
        .otherwise("agree")
        .alias("status"),
    )


def write_once(store: DataFrame, incoming: DataFrame, key: str, digest: str) -> DataFrame:
    """Same key and bytes: no-op. New key: insert. Same key, other bytes, in the
    store or within the drop itself: conflict. One row per incoming key; a key
    that is dropped very often combines before the join."""
    s = store.select(key, F.col(digest).alias("_stored"))
    drop = incoming.groupBy(key).agg(F.min(digest).alias(digest), F.max(digest).alias("_last"))
    return drop.join(s, key, "left").select(
        key,
        digest,
        F.when(F.col(digest) != F.col("_last"), "conflict")
        .when(F.col("_stored").isNull(), "insert")
        .when(F.col("_stored") == F.col(digest), "no-op")
        .otherwise("conflict")
        .alias("action"),
    )


def lock_differences(lock: DataFrame, observed: DataFrame, key: str) -> DataFrame:
    """Compare reviewed locks with observed payloads.

    Columns on both sides: bytes, sha256, member_sha256, row_count,
    record_count. A pinned payload that still matches outranks its container;
    the counts are always compared. Any difference quarantines the source.
    """
    l = lock.select(key, F.struct("bytes", "sha256", "member_sha256", "row_count", "record_count").alias("l"))
    o = observed.select(key, F.struct("bytes", "sha256", "member_sha256", "row_count", "record_count").alias("o"))
    pinned = F.col("l.member_sha256").isNotNull()
    matches = pinned & F.coalesce(F.col("l.member_sha256") == F.col("o.member_sha256"), F.lit(False))

    def unequal(name: str) -> Column:
        return ~F.col(f"l.{name}").eqNullSafe(F.col(f"o.{name}"))

    found = F.array_compact(F.array(
        F.when(~matches & unequal("bytes"), F.lit("bytes")),
        F.when(~matches & unequal("sha256"), F.lit("sha256")),
        F.when(unequal("row_count"), F.lit("row_count")),
        F.when(unequal("record_count"), F.lit("record_count")),
        F.when(pinned & ~matches, F.lit("member_sha256")),
    ))
    return (
        l.join(o, key, "left")
        .withColumn("differences", F.when(F.col("o").isNull(), "").otherwise(F.array_join(found, ",")))
        .select(
            key,
            "differences",
            F.when(F.col("o").isNull(), "not-observed")
            .when(F.col("differences") == "", "verified")
            .otherwise("quarantined")
            .alias("status"),
        )
    )


def lock_status(has_source: Column, source_present: Column, has_extract: Column, extract_present: Column) -> Column:
    """What a source lock can vouch for, from what is declared and what is there."""
    return (
        F.when((has_source & ~source_present) | (has_extract & ~extract_present), "missing")
        .when(has_source & has_extract, "source-and-extract")
        .when(has_source, "source-only")
        .when(has_extract, "extract-only")
        .otherwise("remote-unlocked")
    )

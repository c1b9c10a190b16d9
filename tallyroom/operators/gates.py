"""Publish a record or refuse it with a named reason.

A rule is ``(name, broken)`` where ``broken`` is a boolean column. A rule that
cannot be decided (null) counts as broken, so a gate never passes on missing
evidence. Every gate splits its input: accepted + refused = input.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Rule = tuple[str, Column]


class Gate(NamedTuple):
    accepted: DataFrame
    refused: DataFrame


def _broken(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(True))


def first_reason(rules: list[Rule]) -> Column:
    """The first broken rule names the reason; null when none is broken."""
    return F.coalesce(*[F.when(_broken(bad), F.lit(name)) for name, bad in rules])


def broken_rules(rules: list[Rule]) -> Column:
    """Every broken rule, in rule order, as an array."""
    return F.filter(
        F.array(*[F.when(_broken(bad), F.lit(name)) for name, bad in rules]),
        lambda name: name.isNotNull(),
    )


def gate(df: DataFrame, rules: list[Rule]) -> Gate:
    judged = df.withColumn("reason", first_reason(rules))
    return Gate(
        judged.filter(F.col("reason").isNull()).drop("reason"),
        judged.filter(F.col("reason").isNotNull()),
    )


def verdicts(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """Both sides of the gate as one table with ``status`` and ``reason``."""
    return df.withColumn("reason", first_reason(rules)).withColumn(
        "status", F.when(F.col("reason").isNull(), "accepted").otherwise("refused")
    )


def refusal_summary(judged: DataFrame, by: list[str] | None = None) -> DataFrame:
    return judged.groupBy(*(by or []), "status", F.coalesce("reason", F.lit("")).alias("reason")).agg(
        F.count(F.lit(1)).alias("records")
    )


def severity(finding: Column, strict: bool) -> Column:
    """The same finding warns on a draft and is an error once sealed."""
    return F.when(finding, F.lit("error" if strict else "warning"))


def single_valued(df: DataFrame, keys: list[str], values: list[str]) -> Gate:
    """Keep keys that occur once; quarantine repeated ones.

    One aggregation with map-side combine, so a key that owns a large part of
    the rows collapses before the shuffle.
    """
    packed = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("copies"), *[F.min(v).alias(v) for v in values]
    )
    return Gate(
        packed.filter("copies = 1").drop("copies"),
        packed.filter("copies > 1").select(*keys, "copies"),
    )


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")


def identity_conflicts(df: DataFrame, code: str, attributes: list[str]) -> DataFrame:
    """Codes that carry more than one attribute set."""
    variants = df.groupBy(code, *attributes).agg(F.count(F.lit(1)).alias("rows"))
    return (
        variants.groupBy(code)
        .agg(F.count(F.lit(1)).alias("identities"), F.sum("rows").alias("rows"))
        .filter("identities > 1")
    )


def identity_scan(df: DataFrame, code: str, attributes: list[str], updated: str, rows: str | None = None) -> DataFrame:
    """One identity per code with its row count and newest date; conflicts refused.
    ``rows`` names a count that each row already stands for."""
    variants = df.groupBy(code, *attributes).agg(
        (F.sum(rows) if rows else F.count(F.lit(1))).alias("rows"), F.max(updated).alias("last_updated")
    )
    return (
        variants.groupBy(code)
        .agg(
            *[F.min(a).alias(a) for a in attributes],
            F.count(F.lit(1)).alias("identities"),
            F.sum("rows").alias("rows"),
            F.max("last_updated").alias("last_updated"),
        )
        .withColumn("status", F.when(F.col("identities") == 1, "accepted").otherwise("refused"))
    )


def expected_counts(observed: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """Observed group counts against the declared ones (both carry ``rows``)."""
    o = observed.withColumnRenamed("rows", "observed")
    e = expected.withColumnRenamed("rows", "expected")
    return o.join(e, keys, "full").select(
        *keys,
        F.coalesce("expected", F.lit(0)).cast("bigint").alias("expected"),
        F.coalesce("observed", F.lit(0)).cast("bigint").alias("observed"),
        F.when(F.col("expected").eqNullSafe(F.col("observed")), "ok").otherwise("changed").alias("status"),
    )

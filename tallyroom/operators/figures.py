"""Figures looked up by name, the identities they must keep, and lines that are
no real figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyroom.operators.gates import first_reason

# Classes of lines that are not a place money goes to.
NOT_SHOWN = ["reconciling_item", "disclosure_subline", "special_levy"]
#: How far an identity may be off.
CLOSURE_TOLERANCE = 0.5


def named_figures(wanted: DataFrame, facts: DataFrame, derived: DataFrame, figure: str = "figure_id", amount: str = "amount") -> DataFrame:
    """The amount of every wanted figure, from the facts or else the derived rows,
    or the reason why there is none.

    An id that stands several times in one table takes its row of least
    ``position``. Only wanted ids are grouped, so the tables are read once.
    """
    entries = facts.select(figure, F.lit(0).alias("_kind"), "position", amount).unionByName(
        derived.select(figure, F.lit(1).alias("_kind"), "position", amount)
    )
    ids = wanted.select(figure).distinct()
    first = entries.join(ids, figure, "left_semi").groupBy(figure).agg(F.min(F.struct("_kind", "position", amount)).alias("_e"))
    found = wanted.join(first, figure, "left")
    return found.select(
        *wanted.columns, F.col(f"_e.{amount}").alias(amount),
        F.when(F.col("_e._kind") == 0, "fact").when(F.col("_e._kind") == 1, "derived").alias("origin"),
        first_reason([("no entry has this id", F.col("_e").isNull()), ("the entry carries no amount", F.col(f"_e.{amount}").isNull())]).alias("reason"),
    )


def closures(parts: DataFrame, named: DataFrame, identity: str, figure: str = "figure_id", amount: str = "amount", tolerance=CLOSURE_TOLERANCE) -> DataFrame:
    """Whether the signed parts ``(identity, figure, sign)`` of each identity add
    to zero. An identity with a refused figure has no total.

    A figure may stand in many identities; the named figures hold one row each.
    """
    one = named.select(figure, amount, "reason").distinct()
    met = parts.join(one, figure, "left").withColumn("_bad", F.col("reason").isNotNull() | F.col(amount).isNull())
    per = met.groupBy(identity).agg(
        F.sum(F.col("sign") * F.col(amount)).alias("_sum"), F.count(F.when(F.col("_bad"), F.lit(1))).alias("refused_figures"), F.count(F.lit(1)).alias("figures")
    )
    whole = F.col("refused_figures") == 0
    difference = F.when(whole, F.col("_sum"))
    return per.select(
        identity, "figures", "refused_figures", difference.alias("difference"),
        F.when(~whole, "a figure is refused").when(F.abs(difference) > F.lit(tolerance), "the identity does not hold").alias("reason"),
    )


def is_shown(classification: Column, amount: Column) -> Column:
    """Whether a line is a place money goes to: a positive finite amount of a
    shown class. A line without a class is shown."""
    finite = ~F.isnan(amount.cast("double")) & (F.abs(amount.cast("double")) != F.lit(float("inf")))
    return F.coalesce(~classification.isin(NOT_SHOWN), F.lit(True)) & F.coalesce(finite & (amount > 0), F.lit(False))


def is_unallocated(classification: Column, gap: Column, label: Column) -> Column:
    """Whether a line is one combined amount that no department schedule splits:
    by its class, by the gap it names, or by its label."""
    low = F.lower(label)
    combined = low.contains("combined") & (low.contains("rate") | low.contains("assessment"))
    checks = [F.lower(classification).contains("unallocated"), F.upper(gap).contains("DEPT-SCHEDULE"), combined]
    held = [F.coalesce(c, F.lit(False)) for c in checks]
    return held[0] | held[1] | held[2]

"""Place search, quotas, top lines and rankings."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyroom.functions.text import search_text
from tallyroom.operators.skew import hot_keys, range_chunks, running_sum, spread_join

# The most places one search shows, and the line budget of a view.
MAX_RESULTS = 20
TOP_LINES = 5
REMAINDER_SHARE = 0.02


def clamp_limit(limit) -> int:
    if limit is None or not math.isfinite(limit):
        return MAX_RESULTS
    return max(0, min(int(math.floor(limit)), MAX_RESULTS))


def query_terms(query: str) -> list[str]:
    """The words of a typed query in the same form as the searched text."""
    import unicodedata

    form = unicodedata.normalize("NFKD", query.casefold())
    kept = "".join(ch if ch.isalnum() else " " for ch in form if not unicodedata.combining(ch))
    return kept.split()


def matches(records: DataFrame, fields: list[Column], query: str) -> DataFrame:
    """Records in which every query word occurs in some field."""
    text = search_text(F.concat_ws(" ", *fields))
    found = records.withColumn("_text", text)
    for term in query_terms(query):
        found = found.filter(F.col("_text").contains(term))
    return found.drop("_text")


def place_search(records: DataFrame, fields: list[Column], query: str, order: list, limit=None) -> DataFrame:
    """First rows in directory order with the exact total and a capped flag.

    The shown rows are a take-ordered limit; the total is a scalar subquery.
    """
    shown = clamp_limit(limit)
    found = matches(records, fields, query)
    total = found.agg(F.count(F.lit(1)).alias("total_matches"))
    top = found.orderBy(*order).limit(shown)
    return top.withColumn("total_matches", total.scalar()).withColumn("capped", F.col("total_matches") > shown)


def quota(records: DataFrame, kind: str, first: str, order: list, queried: bool, limit: int = MAX_RESULTS) -> DataFrame:
    """Rows of the first kind fill the quota, the other kind gets what is left,
    and only when something was searched for. Every row carries both totals and
    whether rows were left out.

    Both lists are cut to the limit before they meet, so the final ranking sees
    at most twice the limit.
    """
    if not queried:
        records = records.filter(F.col(kind) == first)
    totals = records.agg(
        F.count(F.when(F.col(kind) == first, F.lit(1))).alias("first_total"), F.count(F.when(F.col(kind) != first, F.lit(1))).alias("other_total")
    )
    a = records.filter(F.col(kind) == first).orderBy(*order).limit(limit).withColumn("_rank", F.lit(0))
    b = records.filter(F.col(kind) != first).orderBy(*order).limit(limit).withColumn("_rank", F.lit(1))
    shown = a.unionByName(b).orderBy("_rank", *order).limit(limit).drop("_rank")
    return (
        shown.withColumn("first_total", totals.select("first_total").scalar()).withColumn("other_total", totals.select("other_total").scalar())
        .withColumn("capped", F.col("first_total") + F.col("other_total") > limit)
    )


def top_lines(lines: DataFrame, key: str, line: str, amount: str, top: int = TOP_LINES, share: float = REMAINDER_SHARE) -> DataFrame:
    """Largest positive lines of each key and an everything-else row.

    The rest is shown only when lines remain and it is more than ``share`` of
    the total. The row-number cut is pushed below the shuffle by the planner
    (window group limit), so a long key sends at most ``top`` rows per task.
    """
    kept = lines.filter(F.col(amount) > 0)
    totals = kept.groupBy(key).agg(F.sum(amount).cast("bigint").alias("_total"), F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(key).orderBy(F.desc(amount), F.asc(line))
    best = kept.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top).select(
        key, F.col("rank").cast("bigint").alias("rank"), F.col(line).cast("string").alias("line"), F.col(amount).alias("amount")
    )
    shown = best.groupBy(key).agg(F.sum("amount").cast("bigint").alias("_shown"))
    rest = (
        totals.filter(F.col("_n") > top).join(shown, key)
        .withColumn("amount", F.col("_total") - F.col("_shown"))
        .filter(F.col("amount").cast("double") / F.col("_total").cast("double") > F.lit(share))
        .select(key, F.lit(top + 1).cast("bigint").alias("rank"), F.lit("everything-else").alias("line"), "amount")
    )
    return best.unionByName(rest)


def cumulative_share(parts: DataFrame, key: str, order: str, amount: str) -> DataFrame:
    """Start and end of each positive part on the total of its key, in ``order``
    (distinct within a key)."""
    kept = parts.filter(F.col(amount) > 0)
    totals = kept.groupBy(key).agg(F.sum(amount).cast("bigint").alias("_total"), F.count(F.lit(1)).alias("_n"))
    run = running_sum(range_chunks(kept.select(key, order, amount), [key], [F.col(order)]), [key], "_chunk", [order], amount, "_end")
    joined = spread_join(run, totals.drop("_n"), [key], "inner", spread_on=[order], hot=hot_keys(totals, [key], "_n"))
    share = lambda c: c.cast("double") / F.col("_total").cast("double")
    return joined.select(
        key, order, amount,
        share(F.col("_end") - F.col(amount)).alias("start_share"), share(F.col("_end")).alias("end_share"),
    )


def rank_by_magnitude(lines: DataFrame, key: str, line: str, amount: str) -> DataFrame:
    """Rank by absolute amount, largest first, unknown amounts last.

    The rank is a running count over range chunks, so one long key is sorted a
    chunk at a time, whatever its amounts are.
    """
    size = F.abs(amount)
    falling = [F.desc_nulls_last(size), F.asc(line)]
    chunked = range_chunks(lines.withColumn("_one", F.lit(1).cast("bigint")), [key], falling)
    # the order of the chunks, for rows that are equal in all it names
    whole = [*falling, F.xxhash64(*[F.col(f"`{c}`") for c in chunked.columns if c != "_chunk"])]
    return running_sum(chunked, [key], "_chunk", whole, "_one", "rank").drop("_one", "_chunk")


def best_candidate(candidates: DataFrame, key: str, score: Column, position: str, payload: list[str]) -> DataFrame:
    """Highest score, first position on ties, as one combining aggregate."""
    pick = F.struct((-score).alias("s"), F.col(position).alias("p"), F.struct(*payload).alias("v"))
    return candidates.groupBy(key).agg(F.min(pick).alias("_b")).select(key, *[F.col(f"_b.v.{p}").alias(p) for p in payload])

"""Joins and running values that hold when one key owns a large part of the rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyroom.session import cut_lineage

HOT_ROWS = 2_000_000
FAN = 64
#: Rows that one task holds in the sort buffers and hash tables of a stage.
TASK_ROWS = 250_000


def hot_row_limit(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.tallyroom.hotRows", str(HOT_ROWS)))


def hot_keys(df: DataFrame, keys: list[str], count: str | None = None) -> DataFrame:
    """Keys above ``spark.tallyroom.hotRows`` rows: at most rows / limit of them. The
    list grows with the data, so it is never forced into a broadcast: the planner
    decides by its measured size. ``count`` names a column of ``df`` that already
    holds the rows per key."""
    limit = hot_row_limit(df)
    counted = df if count else df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return counted.filter(F.col(count or "_n") > limit).select(*keys, F.lit(True).alias("_hot"))


def in_tasks(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` dealt out by ``keys`` so that a task gets about ``TASK_ROWS`` of its
    ``rows`` rows, whatever the number of shuffle partitions is and however much
    they compress; a table of few rows is left to the planner. ``rows`` may be an
    estimate, such as the rows of the table behind it, which Parquet footers tell."""
    tasks = -(-rows // int(df.sparkSession.conf.get("spark.tallyroom.taskRows", str(TASK_ROWS))))
    return df.repartition(tasks, *keys) if tasks > 1 else df


def spread_join(
    big: DataFrame,
    small: DataFrame,
    keys: list[str],
    how: str = "inner",
    spread_on: list[str] | None = None,
    fan: int = FAN,
    hot: DataFrame | None = None,
) -> DataFrame:
    """Join many rows to a table with few rows per key, splitting hot keys.

    Rows of hot keys spread over ``fan`` salts by a hash of ``spread_on`` (a
    deterministic salt, safe under task retries) and only the hot keys of
    ``small`` are repeated. Rows with a null key match nothing and are spread as
    well. ``hot`` is the list of hot keys where a cheaper table than ``big`` can
    tell them (see ``hot_keys``); it may hold a part of the key columns. Without
    it the join is left to adaptive skew splitting: counting the keys of ``big``
    would compute it twice.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError("the row side is kept on the left")
    if hot is None:
        return big.join(small, keys, how)
    on = [c for c in hot.columns if c != "_hot"]
    salt = F.pmod(F.xxhash64(*(spread_on or big.columns)), F.lit(fan)).cast("int")
    null_key = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    rows = (
        big.join(hot, on, "left")
        .withColumn("_salt", F.when(F.col("_hot") | null_key, salt).otherwise(F.lit(0)))
        .drop("_hot")
    )
    return rows.join(salted_copies(small, hot, fan), [*keys, "_salt"], how).drop("_salt")


def salted_copies(small: DataFrame, hot: DataFrame, fan: int = FAN) -> DataFrame:
    """``small`` with a ``_salt``: hot keys once per salt, the others once."""
    on = [c for c in hot.columns if c != "_hot"]
    salts = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(fan - 1))).otherwise(F.array(F.lit(0)))
    return small.join(hot, on, "left").withColumn("_salt", F.explode(salts)).drop("_hot")


def range_chunks(df: DataFrame, keys: list[str], order: list, out: str = "_chunk") -> DataFrame:
    """``df`` with a chunk number that ascends along (keys, order): the partition
    of a range partitioning. A key owns no more chunks than there are partitions,
    and equal rows of one key are told apart by their hash, so no key, and no run
    of equal or unknown values, meets in one task. The partitioning is written
    once, because all its readers must see the same chunks.
    """
    every = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    ranged = df.repartitionByRange(*[F.col(k) for k in keys], *order, every)
    return cut_lineage(ranged.withColumn(out, F.spark_partition_id().cast("bigint")))


def _before(df: DataFrame, keys: list[str], chunk: str, carry: Column, fold) -> DataFrame:
    """Per (key, chunk): the folded carry of all earlier chunks of the key.

    The inner table holds one row per chunk, so this window is small even when
    the key is not.
    """
    chunks = df.groupBy(*keys, chunk).agg(carry.alias("_carry"))
    earlier = Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    return chunks.select(*keys, chunk, fold("_carry").over(earlier).alias("_before"))


def running_sum(df: DataFrame, keys: list[str], chunk: str, order: list, value: str, out: str) -> DataFrame:
    """Inclusive running sum. ``chunk`` must be non-decreasing in ``order``; the
    sort then works on one chunk of a key at a time."""
    inside = Window.partitionBy(*keys, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    offsets = _before(df, keys, chunk, F.sum(value), F.sum)
    return (
        df.withColumn("_run", F.sum(value).over(inside))
        .join(offsets, [*keys, chunk])
        .withColumn(out, F.col("_run") + F.coalesce("_before", F.lit(0)))
        .drop("_run", "_before")
    )


def previous_max(df: DataFrame, keys: list[str], chunk: str, order: list, value: str, out: str) -> DataFrame:
    """Largest ``value`` on all earlier rows of the key (null on the first)."""
    inside = Window.partitionBy(*keys, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    offsets = _before(df, keys, chunk, F.max(value), F.max)
    return (
        df.withColumn("_run", F.max(value).over(inside))
        .join(offsets, [*keys, chunk])
        .withColumn(out, F.greatest("_run", "_before"))
        .drop("_run", "_before")
    )


def previous_value(df: DataFrame, keys: list[str], chunk: str, order: list[str], value: str, out: str) -> DataFrame:
    """``value`` on the row just before, across chunk borders."""
    inside = Window.partitionBy(*keys, chunk).orderBy(*order)
    last = df.groupBy(*keys, chunk).agg(F.max_by(value, F.struct(*order)).alias("_carry"))
    border = last.select(
        *keys, chunk, F.lag("_carry").over(Window.partitionBy(*keys).orderBy(chunk)).alias("_before")
    )
    return (
        df.withColumn("_lag", F.lag(value).over(inside))
        .withColumn("_first", F.row_number().over(inside) == 1)
        .join(border, [*keys, chunk])
        .withColumn(out, F.when(F.col("_first"), F.col("_before")).otherwise(F.col("_lag")))
        .drop("_lag", "_first", "_before")
    )


def magnitude_chunk(amount: Column) -> Column:
    """A chunk number that falls as the amount grows: 16 steps per power of two.

    Use it with a descending order so that chunks ascend along that order.
    """
    size = F.abs(amount).cast("double")
    steps = F.floor(F.log2(size + F.lit(1.0)) * F.lit(16.0)).cast("bigint")
    return F.when(amount >= 0, -steps).otherwise(steps)

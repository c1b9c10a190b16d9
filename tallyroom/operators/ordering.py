"""Total orders over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyroom.session import cut_lineage


def positions(df: DataFrame, order: list[Column], out: str = "position") -> DataFrame:
    """Global position of every row without sorting in one task.

    A range-partitioned sort is written once; each partition then numbers its
    own rows and adds the rows of the partitions before it.
    """
    ranged = cut_lineage(df.repartitionByRange(*order).sortWithinPartitions(*order).select(
        "*", F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().alias("_m")
    ))
    sizes = ranged.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"), F.min("_m").alias("_first"))
    # one row per partition
    before = sizes.select(
        "_p", "_first",
        F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
    )
    return (
        ranged.join(F.broadcast(before), "_p")
        .withColumn(out, F.col("_m") - F.col("_first") + F.col("_before") + 1)
        .drop("_p", "_m", "_first", "_before")
    )

"""Connected components of a large graph by alternating star operations.

Every round points the larger ends of a node's edges at the smallest end it
knows (large star), then the smaller ends (small star), until nothing moves.
Each round is two aggregations to a minimum, combined before the shuffle, and
two joins that adaptive execution may split; rounds are cut by checkpoints in
the shared folder. No neighbour list is ever gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyroom.session import cut_lineage


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``root`` (the smallest node of its component) of every node with an edge."""
    pair = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    pair = cut_lineage(pair)
    seen = None
    while True:
        # Large star: neighbours above a node go to its smallest neighbour.
        both = pair.unionAll(pair.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: the node and its smaller neighbours go to the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        pair = cut_lineage(small.unionAll(least.select("u", F.col("m").alias("v"))).distinct())
        state = pair.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == seen:
            break
        seen = tuple(state)
    return pair.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(
        pair.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )

"""Files on disk against a manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyroom.operators.compare import compare_sets


def read_inventory(spark: SparkSession, path: str) -> DataFrame:
    """``(path, bytes, sha256)`` of every file below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def inventory_diff(files: DataFrame, manifest: DataFrame, fields: list[str]) -> DataFrame:
    """Manifest rows without a file, files without a row, and fields that differ."""
    return compare_sets(manifest, files, ["path"], fields, ("missing", "unlisted", "changed", "verified"))

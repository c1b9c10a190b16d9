"""Numbered lines of text files that are split and packed as Spark likes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyroom.sources.encodings import windows_text


def numbered_lines(spark: SparkSession, path: str, windows: bool = False) -> DataFrame:
    """``(path, line_no, line)`` of text files; blank lines count, lines count from 1
    in each file.

    Rows are numbered inside the stretch of a file that one task reads, and the
    rows of the earlier stretches of the file are added: a prefix sum over (file,
    start of the stretch). So a large file may be split and small files share a
    task. ``windows``: the bytes are Windows-1252, else UTF-8.
    """
    raw = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_id"), "value",
    )
    # one row per stretch
    stretches = raw.groupBy("path", "_start").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("path").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stretches.select("path", "_start", "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    # Bytes before text: a pattern would spoil what is not UTF-8.
    line = windows_text(F.decode(F.col("value").cast("binary"), "ISO-8859-1")) if windows else F.col("value")
    line = F.regexp_replace(line, "\r$", "")
    return raw.join(offsets, ["path", "_start"]).select("path", (F.col("_id") - F.col("_first") + F.col("_before") + 1).alias("line_no"), line.alias("line"))


def cells_of(line: str, width: int):
    """Up to ``width`` cells of a line of comma-separated values, as an array; those
    a short line lacks are null."""
    schema = ", ".join(f"c{i} STRING" for i in range(width))
    # An array of one struct, so that a line is parsed once for all its cells.
    parsed = F.array(F.from_csv(line, schema, {"mode": "PERMISSIVE"}))
    return F.get(F.transform(parsed, lambda row: F.array(*[row[f"c{i}"] for i in range(width)])), F.lit(0))

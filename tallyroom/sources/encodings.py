"""Encoding policies of text sources.

Spark reads Unicode and ISO-8859-1 files only. A Windows-1252 file is read as
ISO-8859-1, which keeps every byte, and its 27 differing characters are then
translated; the bytes also tell whether a text is valid UTF-8.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _differing() -> tuple[str, str]:
    source, target = "", ""
    for byte in range(0x80, 0xA0):
        try:
            target += bytes([byte]).decode("cp1252")
        except UnicodeDecodeError:
            continue
        source += chr(byte)
    return source, target


LATIN, WINDOWS = _differing()
POLICIES = ("utf-8", "cp1252", "utf-8-or-cp1252")


def windows_text(latin: Column) -> Column:
    """Text read as ISO-8859-1, as Windows-1252."""
    return F.translate(latin, LATIN, WINDOWS)


def utf8_bytes(latin: Column) -> Column:
    return F.encode(latin, "ISO-8859-1").cast("string")


def is_utf8(latin: Column) -> Column:
    return F.is_valid_utf8(utf8_bytes(latin))


def read_lines(spark: SparkSession, path: str, policy: str) -> DataFrame:
    """``(path, text, reason)`` lines under a policy. Strict UTF-8 refuses a line
    that is not; the fallback is decided per file, not per line. A byte-order
    mark is dropped."""
    if policy not in POLICIES:
        raise ValueError(f"unknown encoding policy {policy}")
    raw = spark.read.option("encoding", "ISO-8859-1").option("lineSep", "\n").csv(path, schema="line STRING", sep="\x00", quote="", escape="", mode="FAILFAST")
    lines = raw.select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("line", "\r$", "").alias("line"))
    unicode = F.regexp_replace(utf8_bytes(F.col("line")), "^﻿", "")
    if policy == "cp1252":
        return lines.select("path", windows_text(F.col("line")).alias("text"), F.lit(None).cast("string").alias("reason"))
    if policy == "utf-8":
        ok = is_utf8(F.col("line"))
        return lines.select("path", F.when(ok, unicode).alias("text"), F.when(~ok, "not valid UTF-8").alias("reason"))
    # one row per file; the planner broadcasts it by its measured size
    files = lines.groupBy("path").agg(F.bool_and(is_utf8(F.col("line"))).alias("_ok"))
    return lines.join(files, "path").select(
        "path", F.when(F.col("_ok"), unicode).otherwise(windows_text(F.col("line"))).alias("text"), F.lit(None).cast("string").alias("reason")
    )

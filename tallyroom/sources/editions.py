"""Change lists of differing layouts to one event table."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyroom.functions.text import slash_date
from tallyroom.sources.lines import cells_of, numbered_lines

# Types that never levied, the dissolution code, the region prefix.
NON_LEVYING_TYPES = ["IRI", "NO", "S-E", "S-É", "SE"]
DISSOLUTION_CODE = "4"
REGION_PREFIX = "35"
REMARK = r"\(dissolution\)[^-]*-\s*([^-]+?)\s*,\s*([A-ZÉ-]{1,4})\s*$"


def read_edition(spark: SparkSession, path: str, width: int, with_path: bool = False) -> DataFrame:
    """``(line_no, c0 … c<width-1>)`` of headerless Windows-1252 change lists; line
    numbers count from the top of each file, blank lines included."""
    cells = cells_of("line", width)
    rows = numbered_lines(spark, path, windows=True).filter(F.trim("line") != "").select("path", "line_no", cells.alias("_c"))
    return rows.select(*(["path"] if with_path else []), "line_no", *[F.get("_c", F.lit(i)).alias(f"c{i}") for i in range(width)])


def _cell(i: int) -> Column:
    return F.trim(F.coalesce(F.col(f"c{i}"), F.lit("")))


def _events(rows: DataFrame, source_id: str, dissolved, dissolved_type, successor, successor_type, effective, sgc) -> DataFrame:
    day = slash_date(effective)
    return rows.select(
        dissolved.alias("dissolved"), dissolved_type.alias("dissolved_type"),
        F.nullif(successor, F.lit("")).alias("successor"), F.nullif(successor_type, F.lit("")).alias("successor_type"),
        day.alias("effective_date"), (~dissolved_type.isin(NON_LEVYING_TYPES)).alias("levied"),
        F.lit(source_id).alias("source_id"), F.col("line_no").cast("bigint").alias("source_line"),
        F.regexp_replace(sgc, " ", "").alias("sgc_code"),
        F.when(successor == "", "no parseable successor").when(day.isNull(), "invalid effective date").alias("reason"),
    )


def legacy_events(rows: DataFrame, source_id: str) -> DataFrame:
    """``rows(line_no, c0 … c7)`` of the bilingual layout: subject rows with code
    4; the remark names the successor. A row cut short before its remark is
    refused like one whose remark cannot be read."""
    subject = rows.filter((_cell(0) != "") & (_cell(3) == DISSOLUTION_CODE))
    remark = _cell(7)
    return _events(
        subject, source_id, _cell(0), _cell(2), F.regexp_extract(remark, REMARK, 1), F.regexp_extract(remark, REMARK, 2), _cell(4), _cell(5)
    )


def gaining_losing_events(rows: DataFrame, source_id: str, code_column: int, date_column: int, code_is_text: bool = False) -> DataFrame:
    """The gaining/losing layout: losing side in the region, the date in the
    second-last column, the code a number or a description."""
    code = _cell(code_column)
    dissolved = F.lower(code).contains("dissolution") if code_is_text else code == DISSOLUTION_CODE
    wanted = rows.filter(_cell(5).startswith(REGION_PREFIX) & dissolved)
    return _events(wanted, source_id, _cell(6), _cell(7), _cell(1), _cell(2), _cell(date_column), _cell(5))


def union_editions(editions: dict[str, tuple[DataFrame, Callable[[DataFrame, str], DataFrame]]]) -> DataFrame:
    """Run each edition's parser and stack the events."""
    return reduce(DataFrame.unionByName, [parse(rows, source_id) for source_id, (rows, parse) in editions.items()])


def source_counts(events: DataFrame, sources: DataFrame) -> DataFrame:
    """Events found per registered source of ``sources(source_id, …)``; a source
    that gave none has 0, and events of no registered source have a reason."""
    found = events.groupBy("source_id").agg(F.count(F.lit(1)).alias("found"), F.min("effective_date").alias("earliest"), F.max("effective_date").alias("latest"))
    listed = sources.withColumn("_listed", F.lit(True))
    return listed.join(found, "source_id", "full").select(
        *sources.columns, F.coalesce("found", F.lit(0)).alias("found"), "earliest", "latest",
        F.when(F.col("_listed").isNull(), "source is not registered").when(F.col("found").isNull(), "source gave no event").alias("reason"),
    )


def dedupe_events(events: DataFrame, edition_order: list[str]) -> DataFrame:
    """One event per (code, date), the earliest edition's row; another place or
    successor under the same key is a conflict."""
    rank = F.coalesce(*[F.when(F.col("source_id") == s, F.lit(i)) for i, s in enumerate(edition_order)])
    row = F.struct(rank.alias("rank"), "source_line", "dissolved", "successor", "levied", "source_id")
    identity = F.struct("dissolved", "successor")
    return events.groupBy("sgc_code", "effective_date").agg(
        F.min(row).alias("_r"), F.count(F.lit(1)).alias("copies"), (F.min(identity) == F.max(identity)).alias("_same")
    ).select(
        "sgc_code", "effective_date", F.col("_r.dissolved").alias("dissolved"), F.col("_r.successor").alias("successor"),
        F.col("_r.levied").alias("levied"), F.col("_r.source_id").alias("source_id"), "copies",
        F.when(F.col("_same"), "accepted").otherwise("conflict").alias("status"),
    )

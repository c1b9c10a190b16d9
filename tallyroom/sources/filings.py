"""Filing CSV scans with a declared schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The published header of the long filing file.
FILING_HEADERS = [
    "MARSYEAR", "ASSESSMENT_CODE", "MUNICIPALITY_DESC", "MUNID", "MSO_NUMBER", "SGC_CODE",
    "UT_NUMBER", "MTYPE_CODE", "TIER_CODE", "LAST_UPDATE_DATE", "SCHEDULE_DESC",
    "SUB_SCHEDULE_DESC", "SCHEDULE_LINE_DESC", "SCHEDULE_COLUMN_DESC", "SLC",
    "DATATYPE_DESC", "AMOUNT", "VALUE_TEXT",
]
#: Digits an amount keeps: 28 before the point and 10 after it.
AMOUNT = T.DecimalType(38, 10)
FILING_SCHEMA = T.StructType([T.StructField(name, T.StringType()) for name in FILING_HEADERS])


def read_filing_csv(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """The filing file as text columns. A changed header fails the read, and no
    type is inferred, so codes keep their leading zeros."""
    return (
        spark.read.schema(FILING_SCHEMA)
        .option("header", True)
        .option("enforceSchema", False)
        .option("mode", "FAILFAST")
        .option("encoding", encoding)
        .option("quote", '"').option("escape", '"')
        .csv(path)
    )


def scan_facts(rows: DataFrame, address_pattern: str, codes: list[str] | DataFrame | None = None) -> DataFrame:
    """Facts ``(code, slc, amount)`` of the wanted addresses and filers.

    Blank and non-numeric amounts are skipped, and so is ``nan``. Amounts keep all
    their digits up to ``AMOUNT``; ``refused_amounts`` lists numbers beyond it.
    ``codes`` is a short list or a table with a ``code`` column.
    """
    return _wanted(rows, address_pattern, codes).filter(F.col("amount").isNotNull())


def refused_amounts(rows: DataFrame, address_pattern: str, codes: list[str] | DataFrame | None = None) -> DataFrame:
    """Wanted facts whose amount is a number that ``AMOUNT`` cannot hold exactly,
    as printed, with a reason."""
    printed = F.trim("AMOUNT")
    decimals = F.length(F.regexp_extract(printed, r"\.([0-9]*)", 1)) > AMOUNT.scale
    number = printed.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$")
    lost = rows.filter(number & (decimals | printed.try_cast(AMOUNT).isNull()))
    return _wanted(lost.withColumn("reason", F.when(decimals, "more decimals than can be kept").otherwise("amount out of range")), address_pattern, codes).select(
        "code", "slc", "printed", "reason"
    )


def _wanted(rows: DataFrame, address_pattern: str, codes: list[str] | DataFrame | None) -> DataFrame:
    facts = rows.select(
        F.trim("ASSESSMENT_CODE").alias("code"),
        F.trim("SLC").alias("slc"),
        F.trim("AMOUNT").alias("printed"),
        F.trim("AMOUNT").try_cast(AMOUNT).alias("amount"),
        *[F.trim(c).alias(c.lower()) for c in rows.columns if c not in ("ASSESSMENT_CODE", "SLC", "AMOUNT")],
    ).filter((F.col("code") != "") & F.col("slc").rlike(address_pattern))
    if codes is None:
        return facts
    if isinstance(codes, DataFrame):
        return facts.join(codes.select("code").distinct(), "code", "left_semi")
    return facts.filter(F.col("code").isin(codes))

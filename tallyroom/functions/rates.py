"""Tax rates: stated units, printed suffixes and rate rows on a page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyroom.operators.gates import first_reason

# Unit names and their factors.
UNIT_FACTORS = {"decimal": "1", "percent": "0.01", "mill": "0.001"}
UNIT_NAMES = {
    "decimal": "decimal",
    "rate": "decimal",
    "percent": "percent",
    "percentage": "percent",
    "%": "percent",
    "per cent": "percent",
    "mill": "mill",
    "mills": "mill",
    "per-thousand": "mill",
    "per_1000": "mill",
}

# A residential row is a label and four numbers with optional units.
NUMBER = r"([0-9]+(?:[.,][0-9]+)?)"
SUFFIX = r"(%|percent|per\s+cent|mills?)?"
RATE_ROW = (
    r"(?i)((?:Residential|R\s*T|RT|RTEP)[^\n]{0,80}?)"
    + r"\s+".join([NUMBER + r"\s*" + SUFFIX] * 4)
)


def unit_of(name: Column) -> Column:
    """Canonical unit of a unit name or printed suffix; null when unknown."""
    clean = F.regexp_replace(F.lower(F.trim(name)), r"\s+", " ")
    names = F.create_map(*[F.lit(x) for pair in UNIT_NAMES.items() for x in pair])
    return F.try_element_at(names, clean)


#: Decimal places a printed rate may have.
PLACES = 18


def plain_rate(raw: Column) -> Column:
    """A printed rate with a decimal point; a lone comma is the decimal mark."""
    return F.when(raw.contains(",") & ~raw.contains("."), F.regexp_replace(raw, ",", ".")).otherwise(raw)


def rate_value(raw: Column, unit: Column) -> Column:
    """A printed rate as an exact decimal rate; null beyond PLACES places or twelve
    digits before the point."""
    text = plain_rate(raw)
    factor = F.coalesce(*[F.when(unit == u, F.lit(f).cast("decimal(4,3)")) for u, f in UNIT_FACTORS.items()])
    exact = F.when(F.length(F.regexp_extract(text, r"\.([0-9]*)$", 1)) <= PLACES, text.try_cast("decimal(30,18)"))
    return (exact * factor).cast("decimal(38,21)")


def resolve_unit(declared: Column, printed: Column) -> tuple[Column, Column]:
    """(unit, refusal): printed or declared, never guessed from the magnitude."""
    d, p = unit_of(declared), unit_of(printed)
    reason = first_reason([
        ("unsupported unit", (declared.isNotNull() & d.isNull()) | (printed.isNotNull() & p.isNull())),
        ("declared and printed units conflict", F.coalesce(d != p, F.lit(False))),
        ("ambiguous unmarked rate", d.isNull() & p.isNull()),
    ])
    return F.when(reason.isNull(), F.coalesce(p, d)), reason


def rate_rows(pages: DataFrame, text: str, declared: str | None = None) -> DataFrame:
    """Candidate residential rows of each page with unit, rates and refusal."""
    unit_word = F.lit(declared).cast("string")
    rows = pages.withColumn("_rows", F.regexp_extract_all(text, F.lit(RATE_ROW), F.lit(0)))
    rows = rows.select(*pages.columns, F.posexplode("_rows").alias("row_no", "row"))
    # One match per row: its groups are written next to each other and split.
    marked_up = F.regexp_replace("row", RATE_ROW, "\x1f".join(f"${i}" for i in range(1, 10)))
    rows = rows.withColumn("_g", F.split(marked_up, "\x1f"))
    group = lambda i: F.get("_g", F.lit(i - 1))
    rows = rows.select(
        *pages.columns, "row_no", F.trim(F.regexp_replace("row", r"\s+", " ")).alias("excerpt"),
        F.trim(F.regexp_replace(group(1), r"\s+", " ")).alias("label"),
        *[group(2 + 2 * i).alias(f"raw_{n}") for i, n in enumerate(("city", "region", "education", "total"))],
        F.array(*[F.nullif(group(3 + 2 * i), F.lit("")) for i in range(4)]).alias("suffixes"),
    )
    low = F.lower("label")
    rows = rows.filter(~(low.contains("farm") & ~low.contains("residential")) & ~low.contains("forest"))
    units = F.array_distinct(F.transform(F.filter("suffixes", lambda s: s.isNotNull()), unit_of))
    marked = F.size(F.filter("suffixes", lambda s: s.isNotNull()))
    unit, unit_reason = resolve_unit(unit_word, F.when(F.size("units") == 1, F.element_at("units", 1)))
    rows = rows.withColumn("units", units).withColumn("marked", marked).withColumn(
        "reason",
        F.coalesce(
            F.when((F.col("marked") > 0) & (F.col("marked") < 4), "mixed marked and unmarked values"),
            F.when(F.size("units") > 1, "mixed units in one row"),
            unit_reason,
        ),
    ).withColumn("unit", F.when(F.col("reason").isNull(), unit))
    for n in ("city", "region", "education", "total"):
        rows = rows.withColumn(f"rate_{n}", rate_value(F.col(f"raw_{n}"), F.col("unit")))
    off = F.abs(F.col("rate_city") + F.col("rate_region") + F.col("rate_education") - F.col("rate_total"))
    score = F.when(F.col("label").rlike(r"(?i)\bRT\b|RTEP|Residential"), 2).otherwise(0) - F.when(low.contains("new multi"), 1).otherwise(0)
    return rows.withColumn(
        "reason", F.coalesce(
            "reason", F.when(off.isNull(), "rate has too many digits"),
            F.when(off > F.lit("0.0000000001").cast("decimal(12,10)"), "rates do not add to the total"),
        )
    ).withColumn("score", score).drop("units", "marked", "suffixes")

"""Wide table rows printed on text pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_pattern(areas: int) -> str:
    """A label, a net figure, a levy, then one percentage and amount per area.
    Dollar and percent signs may be missing; amounts in parentheses are negative."""
    return r"^\S.* \(?[0-9,]+\)? \$?\(?[0-9,]+\)?" + r" [0-9.]+%? \$?\(?[0-9,]+\)?" * areas + "$"


def whole_money(text: Column) -> Column:
    """``1,234`` and ``(1,234)`` as whole units, parentheses negative."""
    digits = F.translate(text, "$(),", "").try_cast("bigint")
    return F.when(text.contains("("), -digits).otherwise(digits)


def service_rows(rows: DataFrame, row: str, areas: list[str]) -> DataFrame:
    """One row per printed line and area; a line that does not parse keeps a
    reason instead of being dropped."""
    width = 2 + 2 * len(areas)
    clean = rows.withColumn("_row", F.trim(F.regexp_replace(row, r"\s+", " ")))
    # One match decides whether the row parses; its cells are then plain words.
    parsed = clean.withColumn("_ok", F.col("_row").rlike(row_pattern(len(areas)))).withColumn("_w", F.split("_row", " "))
    at = lambda i: F.try_element_at("_w", F.lit(i - width - 1))
    label = F.array_join(F.slice("_w", F.lit(1), F.greatest(F.lit(0), F.size("_w") - width)), " ")
    cells = F.array(*[
        F.struct(F.lit(a).alias("area"), F.translate(at(3 + 2 * k), "%", "").alias("pct"), whole_money(at(4 + 2 * k)).alias("household"))
        for k, a in enumerate(areas)
    ])
    kept = [c for c in rows.columns if c != row]
    read = parsed.select(
        *kept,
        F.when(F.col("_ok"), F.trim(F.regexp_replace(label, r"\([0-9]+\)\s*$", ""))).alias("label"),
        F.when(F.col("_ok"), whole_money(at(1))).alias("net"), F.when(F.col("_ok"), whole_money(at(2))).alias("levy"),
        F.when(~F.col("_ok"), "could not parse the table row").alias("reason"),
        F.when(F.col("_ok"), cells).alias("_cells"),
    )
    # The line's own cells are read above, once, before the areas fan out.
    fanned = read.select(*kept, "label", "net", "levy", "reason", F.explode_outer("_cells").alias("_c"))
    return fanned.select(*kept, "label", "net", "levy", "reason", "_c.area", "_c.pct", "_c.household")


def footer_controls(rows: DataFrame, row: str, areas: list[str]) -> DataFrame:
    """One row per area and printed control total: a footer repeats ``100% $amount``
    once per area. Other rows give nothing."""
    pattern = r"100%\s+\$[0-9,]+" + r"\s+100%\s+\$[0-9,]+" * (len(areas) - 1)
    footer = F.regexp_extract(row, pattern, 0)
    totals = F.regexp_extract_all(footer, F.lit(r"\$([0-9,]+)"), F.lit(1))
    cells = F.array(*[F.struct(F.lit(a).alias("area"), whole_money(F.try_element_at(totals, F.lit(k + 1))).alias("control")) for k, a in enumerate(areas)])
    kept = [c for c in rows.columns if c != row]
    return rows.filter(footer != "").select(*kept, F.explode(cells).alias("_c")).select(*kept, "_c.area", "_c.control")


def control_verdicts(cells: DataFrame, controls: DataFrame, keys: list[str]) -> DataFrame:
    """Sums of the table's cells ``(keys, area, household)`` against the printed
    controls ``(keys, area, control)``, one row per table and area."""
    by = [*keys, "area"]
    summed = cells.filter(F.col("area").isNotNull()).groupBy(*by).agg(
        F.sum("household").cast("bigint").alias("total"), F.count(F.when(F.col("household").isNull(), F.lit(1))).alias("unread")
    )
    printed = controls.groupBy(*by).agg(F.min("control").alias("control"), F.max("control").alias("_other"))
    return summed.join(printed, by, "full").select(
        *by, "total", "control",
        F.when(F.col("total").isNull(), "no line was read").when(F.col("unread") > 0, "a cell could not be read")
        .when(F.col("control").isNull(), "no control is printed").when(F.col("control") != F.col("_other"), "two controls are printed")
        .when(F.col("total") != F.col("control"), "lines do not add to the control").alias("reason"),
    )

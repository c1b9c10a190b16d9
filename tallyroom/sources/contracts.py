"""Declared schemas: drift is an error, never inferred."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def contract_report(df: DataFrame, name: str, contract: dict[str, str]) -> DataFrame:
    """One row per declared or found column: declared and actual type, status
    and the number of empty cells, from one pass over the table."""
    actual = {f.name: f.dataType.simpleString() for f in df.schema}
    present = [c for c in contract if c in actual]
    counts = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count(c).alias(c) for c in present])
    rows = []
    for column in [*contract, *[c for c in actual if c not in contract]]:
        declared, found = contract.get(column), actual.get(column)
        status = "missing" if found is None else "extra" if declared is None else "ok" if declared == found else "changed"
        empty = (F.col("_rows") - F.col(column)) if column in present else F.lit(None).cast("bigint")
        rows.append(F.struct(
            F.lit(name).alias("table_name"), F.lit(column).alias("column_name"),
            F.lit(declared).cast("string").alias("declared_type"), F.lit(found).cast("string").alias("actual_type"),
            F.lit(status).alias("status"), empty.cast("bigint").alias("null_rows"),
        ))
    return counts.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def contract_reports(tables: dict[str, tuple[DataFrame, dict[str, str]]]) -> DataFrame:
    return reduce(DataFrame.unionByName, [contract_report(df, name, c) for name, (df, c) in tables.items()])


def field_count(line: Column) -> Column:
    """Cells of a CSV line; separators inside quotes do not count."""
    bare = F.regexp_replace(line, '"(?:[^"]|"")*"', "q")
    return F.size(F.split(bare, ","))


def csv_verdicts(lines: DataFrame, line: str, fields: list[str], record_id: str, year: str, fiscal_year: int, max_extra: int = 0) -> DataFrame:
    """Each CSV line with its cells and the rule it breaks: missing columns, too
    many extra columns, an empty record id, another fiscal year."""
    schema = ", ".join(f"{f} STRING" for f in [*fields, *[f"_extra{i}" for i in range(max_extra)]])
    n = field_count(F.col(line))
    parsed = lines.withColumn("_n", n).withColumn("_r", F.from_csv(line, schema, {"mode": "PERMISSIVE", "quote": '"', "escape": '"'}))
    rid = F.trim(F.coalesce(F.col(f"_r.{record_id}"), F.lit("")))
    reason = (
        F.when(F.col("_n") < len(fields), "missing columns")
        .when(F.col("_n") > len(fields) + max_extra, "unreviewed extra columns")
        .when(rid == "", "invalid record id")
        .when(~F.trim(F.col(f"_r.{year}")).eqNullSafe(F.lit(str(fiscal_year))), "another fiscal year")
    )
    return parsed.select(*[F.col(f"_r.{f}").alias(f) for f in fields], rid.alias("record_id"), reason.alias("reason"))


def csv_profile(verdicts: DataFrame) -> DataFrame:
    """Rows and distinct record ids per outcome. Ids collapse before counting."""
    outcome = F.coalesce("reason", F.lit("accepted")).alias("outcome")
    ids = verdicts.groupBy(outcome, "record_id").agg(F.count(F.lit(1)).alias("_n"))
    return ids.groupBy("outcome").agg(F.sum("_n").alias("rows"), F.count(F.lit(1)).alias("record_ids"))


def drop_preamble(numbered: DataFrame, line_no: str, rows: int) -> DataFrame:
    """Leave out the declared title lines before the header, and the header."""
    return numbered.filter(F.col(line_no) > rows + 1)

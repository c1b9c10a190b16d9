"""Paged text, HTML link cells and JSON record collections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyroom.sources.lines import cells_of

PAGE_MARK = r"=====\s*PAGE\s+([0-9]+)\s*====="


def split_pages(documents: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, page, text)`` rows from page markers; a text without markers is
    page 1. A page number that repeats is flagged, not merged."""
    body = F.col(text)
    printed = F.regexp_extract_all(body, F.lit(PAGE_MARK), F.lit(1))
    bodies = F.slice(F.split(body, PAGE_MARK), F.lit(2), F.size(printed))
    pages = F.when(
        F.size(printed) > 0,
        F.transform(F.arrays_zip(printed.alias("n"), bodies.alias("t")), lambda p: F.struct(p["n"].cast("int").alias("page"), p["t"].alias("text"))),
    ).otherwise(F.array(F.struct(F.lit(1).alias("page"), body.alias("text"))))
    repeated = F.size(printed) > F.size(F.array_distinct(F.transform(printed, lambda n: n.cast("int"))))
    return documents.select(key, repeated.alias("repeated_page"), F.explode(pages).alias("_p")).select(
        key, F.col("_p.page").alias("page"), F.col("_p.text").alias("text"), "repeated_page"
    )


ANCHOR = r'<a href="([^"]*)"[^>]*>([^<]*)</a>'
LINK_CELL = r'^\s*<a\b([^>]*)>([^<]*)</a>\s*$'


def repair_mojibake(text: Column) -> Column:
    """The two known broken sequences, nothing else is touched."""
    return F.replace(F.replace(text, F.lit("Ã´"), F.lit("ô")), F.lit("Ã©"), F.lit("é"))


def link_cell(cell: Column) -> tuple[Column, Column, Column]:
    """(text, href, reason) of a directory cell: exactly one anchor whose text is
    its title."""
    anchors = F.size(F.regexp_extract_all(cell, F.lit(r"<a\b"), F.lit(0)))
    attributes = F.regexp_extract(cell, r"<a\b([^>]*)>", 1)
    href = F.nullif(F.regexp_extract(attributes, r'href="([^"]*)"', 1), F.lit(""))
    title = repair_mojibake(F.regexp_extract(attributes, r'title="([^"]*)"', 1))
    text = repair_mojibake(F.trim(F.regexp_extract(cell, r"<a\b[^>]*>([^<]*)</a>", 1)))
    reason = (
        F.when(anchors != 1, "not exactly one anchor").when(text == "", "anchor has no text")
        .when(title != text, "anchor text differs from its title")
    )
    return text, href, reason


def page_anchors(pages: DataFrame, key: str, html: str) -> DataFrame:
    """Every anchor of a page with its position, link and text."""
    found = F.regexp_extract_all(html, F.lit(ANCHOR), F.lit(0))
    return pages.select(key, F.posexplode(found).alias("pos", "_a")).select(
        key, "pos", F.regexp_extract("_a", ANCHOR, 1).alias("href"), F.regexp_extract("_a", ANCHOR, 2).alias("anchor_text")
    )


def json_entries(rows: DataFrame, document: str) -> DataFrame:
    """One row per key of a flat JSON object, values as text. A document that is
    no object, or has no key, gives one row with a ``reason`` instead."""
    entries = F.from_json(document, "map<string,string>")
    kept = [c for c in rows.columns if c != document]
    held = rows.select(
        *kept, entries.alias("_e"), F.when(entries.isNull(), "not a JSON object").when(F.size(entries) == 0, "no keys").alias("reason")
    )
    return held.select(*kept, F.explode_outer("_e").alias("json_key", "json_value"), "reason")


def json_records(rows: DataFrame, document: str, path: str, key: str, fields: list[str]) -> DataFrame:
    """The records of the array of objects at ``path`` (``a.b``, or ``$`` for the
    document itself), one row each: ``position``, the key, the fields as trimmed
    text, and a ``reason``.

    A document without that array, or with an empty one, gives one refused row.
    A record is refused when it is no object, holds a list, an object or a null in
    any field, lacks a non-empty key, or repeats a key of its document. Types are
    those of the JSON, so a text that begins with a bracket is a text.
    """
    kept = [c for c in rows.columns if c != document]
    kind = lambda v: F.coalesce(F.schema_of_variant(v), F.lit(""))
    steps = "$" if path == "$" else "$" + "".join(f"['{step}']" for step in path.split("."))
    parsed = rows.select(*kept, F.monotonically_increasing_id().alias("_doc"), F.try_parse_json(document).alias("_v"))
    found = parsed.select(*kept, "_doc", F.col("_v").isNotNull().alias("_ok"), F.try_variant_get("_v", steps, "variant").alias("_f"))
    items = F.try_variant_get("_f", "$", "array<variant>")
    problem = (
        F.when(~F.col("_ok"), "not a JSON object")
        .when(F.col("_f").isNull(), "no collection at the path")
        .when(~kind(F.col("_f")).startswith("ARRAY"), "not an array")
        .when(F.size(items) == 0, "empty collection")
    )
    each = found.select(*kept, "_doc", problem.alias("_p"), F.posexplode_outer(F.when(problem.isNull(), items)).alias("position", "_r"))
    entries = F.when(kind(F.col("_r")).startswith("OBJECT"), F.try_variant_get("_r", "$", "map<string,variant>"))
    read = each.withColumn("_e", entries)
    kinds = F.transform(F.map_values("_e"), kind)
    shown = lambda f: F.trim(F.when(kind(F.col("_e")[f]) == "BOOLEAN", F.initcap(as_text(F.col("_e")[f]))).otherwise(as_text(F.col("_e")[f])))
    read = read.select(*kept, "_doc", "_p", "position", "_e", kinds.alias("_kinds"), shown(key).alias("_k"), *[shown(f).alias(f"_x{i}") for i, f in enumerate(fields)])
    reason = F.coalesce(
        F.col("_p"),
        F.when(F.col("_e").isNull(), "record is not an object")
        .when(F.exists("_kinds", lambda k: k.startswith("ARRAY") | k.startswith("OBJECT")), "record holds a list or an object")
        .when(F.exists("_kinds", lambda k: k == "VOID"), "record holds a null")
        .when(F.coalesce("_k", F.lit("")) == "", "record has no key")
        .when(_copies() > 1, "key is repeated"),
    )
    return read.withColumn("reason", reason).select(
        *kept, "position", F.col("_k").alias(key), *[F.col(f"_x{i}").alias(f) for i, f in enumerate(fields) if f != key], "reason"
    )


def as_text(value: Column) -> Column:
    return F.try_variant_get(value, "$", "string")


def _copies() -> Column:
    return F.count("_k").over(Window.partitionBy("_doc", "_k"))


def csv_records(rows: DataFrame, document: str, key: str, fields: list[str], width: int = 64) -> DataFrame:
    """The records of a text of comma-separated values with a header, as in
    ``json_records``: cells are trimmed, missing ones empty, blank lines skipped. A
    header without the key, or with more than ``width`` columns, refuses the text.
    A line is a record: no cell holds a line end."""
    kept = [c for c in rows.columns if c != document]
    lines = F.split(F.regexp_replace(document, "^\ufeff", ""), "\r\n|\n|\r")
    parsed = rows.select(*kept, F.monotonically_increasing_id().alias("_doc"), F.get(lines, F.lit(0)).alias("_head"), F.filter(
        F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))), lambda line: F.trim(line) != ""
    ).alias("_lines"))
    headed = parsed.select(*kept, "_doc", "_lines", cells_of("_head", width + 1).alias("_names"))
    problem = (
        F.when(F.get("_names", F.lit(width)).isNotNull(), "too many columns")
        .when(~F.coalesce(F.array_contains("_names", key), F.lit(False)), "key is absent from the header")
        .when(F.size("_lines") == 0, "empty collection")
    )
    each = headed.select(*kept, "_doc", "_names", problem.alias("_p"), F.posexplode_outer(F.when(problem.isNull(), F.col("_lines"))).alias("position", "_line"))
    read = each.select(*kept, "_doc", "_names", "_p", "position", F.when(F.col("_line").isNotNull(), cells_of("_line", width)).alias("_cells"))
    place = lambda f: (F.array_position("_names", f) - 1).cast("int")
    shown = lambda f: F.when(place(f) >= 0, F.when(F.col("_cells").isNotNull(), F.trim(F.coalesce(F.get("_cells", place(f)), F.lit("")))))
    read = read.select(*kept, "_doc", "_p", "position", shown(key).alias("_k"), *[shown(f).alias(f"_x{i}") for i, f in enumerate(fields)])
    reason = F.coalesce(F.col("_p"), F.when(F.coalesce("_k", F.lit("")) == "", "record has no key").when(_copies() > 1, "key is repeated"))
    return read.withColumn("reason", reason).select(
        *kept, "position", F.col("_k").alias(key), *[F.col(f"_x{i}").alias(f) for i, f in enumerate(fields) if f != key], "reason"
    )


def document_unreadable(document: Column) -> Column:
    return F.from_json(document, "map<string,string>").isNull()


def closed_fields(document: Column, allowed: list[str], required: list[str]) -> tuple[Column, Column]:
    """(unknown, missing) field lists of a record that must use a closed set."""
    keys = F.map_keys(F.from_json(document, "map<string,string>"))
    unknown = F.array_sort(F.array_except(keys, F.array(*[F.lit(a) for a in allowed])))
    missing = F.array_except(F.array(*[F.lit(r) for r in required]), keys)
    return F.array_join(unknown, ","), F.array_join(missing, ",")


LEDGER_SCHEMA = """
  id STRING,
  sources ARRAY<STRUCT<id: STRING, title: STRING, url: STRING, asOf: STRING, authority: STRING>>,
  facts ARRAY<STRUCT<id: STRING, sourceId: STRING, page: INT, label: STRING, amountCad: DECIMAL(20,2), excerpt: STRING>>,
  derived ARRAY<STRUCT<id: STRING, label: STRING, amountCad: DECIMAL(20,2), inputs: ARRAY<STRING>>>,
  gaps ARRAY<STRUCT<id: STRING, title: STRING>>,
  findings ARRAY<STRUCT<id: STRING, cited: ARRAY<STRING>>>
"""


def ledger_nodes(ledgers: DataFrame, document: str) -> DataFrame:
    """The five arrays of an evidence document as one node table. A document that
    cannot be read, has no id or no node gives one row with a ``reason``."""
    parsed = ledgers.select(F.col(document).alias("t"), F.from_json(document, LEDGER_SCHEMA).alias("d"))

    def listed(kind: str) -> Column:
        nodes = F.transform(
            F.col(f"d.{kind}"), lambda n, i: F.struct(F.lit(kind).alias("kind"), i.alias("position"), n["id"].alias("node_id"))
        )
        return F.coalesce(nodes, F.array().cast("array<struct<kind:string,position:int,node_id:string>>"))

    nodes = F.concat(*[listed(kind) for kind in ("sources", "facts", "derived", "gaps", "findings")])
    reason = (
        F.when(document_unreadable(F.col("t")), "not a JSON object").when(F.coalesce(F.col("d.id"), F.lit("")) == "", "no id")
        .when(F.size(nodes) == 0, "no nodes")
    )
    listed_or_refused = parsed.select(F.col("d.id").alias("ledger"), reason.alias("reason"), nodes.alias("_n"))
    return listed_or_refused.select("ledger", "reason", F.explode_outer(F.when(F.col("reason").isNull(), F.col("_n"))).alias("n")).select(
        "ledger", "n.kind", "n.position", "n.node_id", "reason"
    )

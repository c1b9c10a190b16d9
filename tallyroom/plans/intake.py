"""Source, document and release queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyroom.plans.registry import cents, query, sql_cents, table
from tallyroom.session import checkpoint_folder
from tallyroom.sources import adapters, archives, contracts, documents, editions, inventory
from tallyroom.streaming import intake

# The declared columns of the given tables.
CONTRACTS = {
    "region": {"r_regionkey": "int", "r_name": "string"},
    "nation": {"n_nationkey": "int", "n_name": "string", "n_regionkey": "int"},
    "customer": {"c_custkey": "bigint", "c_name": "string", "c_nationkey": "int", "c_acctbal": "double", "c_mktsegment": "string"},
    "supplier": {"s_suppkey": "bigint", "s_name": "string", "s_nationkey": "int", "s_acctbal": "double"},
    "part": {"p_partkey": "bigint", "p_name": "string", "p_brand": "string", "p_type": "string", "p_size": "int", "p_retailprice": "double"},
    "orders": {"o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string", "o_totalprice": "double", "o_orderpriority": "string"},
    "lineitem": {"l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "int", "l_quantity": "double",
                 "l_extendedprice": "double", "l_discount": "double", "l_tax": "double", "l_returnflag": "string", "l_linestatus": "string"},
    "events": {"event_id": "bigint", "user_id": "bigint", "event_type": "string", "value": "double", "props": "string"},
    "documents": {"doc_id": "bigint", "text": "string", "lang": "string", "source": "string", "n_chars": "bigint"},
    "pages": {"page_id": "bigint", "url": "string", "html": "string"},
    "benchmark": {"item_id": "bigint", "text": "string"},
    "labels": {"doc_id": "bigint", "quality": "int", "toxic": "int"},
    "conversations": {"conv_id": "bigint", "turn": "bigint", "role": "string", "text": "string"},
}


@query("schema_contract", " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, '{c}' AS column_name, '{kind}' AS declared_type, '{kind}' AS actual_type, 'ok' AS status, count(*) - count({c}) AS null_rows FROM {t}"
    for t, columns in CONTRACTS.items() for c, kind in columns.items()
))
def schema_contract(spark: SparkSession, sf: str) -> DataFrame:
    # Whole tables: a declared column that is gone is a row, not an error. Columns that
    # CONTRACTS leaves out are the subject of schema_drift.
    checked = {n: (table(spark, sf, n), c) for n, c in CONTRACTS.items()}
    return contracts.contract_reports(checked).filter("declared_type IS NOT NULL")


# Every table with every column, then some drift on purpose: a changed type, columns
# that no table has, and columns that nothing declares.
DECLARED = {t: dict(columns) for t, columns in CONTRACTS.items()}
DECLARED["orders"]["o_orderdate"] = DECLARED["lineitem"]["l_shipdate"] = DECLARED["events"]["ts"] = "timestamp_ntz"
DECLARED["embeddings"] = {"vec_id": "bigint", "embedding": "array<float>", "label": "int"}
GONE = {"nation": "n_comment", "conversations": "language"}
DECLARED["nation"] |= {"n_regionkey": "bigint", GONE["nation"]: "string"}
DECLARED["conversations"][GONE["conversations"]] = "string"
del DECLARED["labels"]["toxic"], DECLARED["supplier"]["s_acctbal"]


@query("schema_drift", f"""
WITH found AS ({" UNION ALL ".join(f"SELECT '{t}' AS table_name, column_name, column_type FROM (DESCRIBE {t})" for t in DECLARED)}),
typed AS (
  SELECT table_name, column_name, CASE column_type WHEN 'INTEGER' THEN 'int' WHEN 'VARCHAR' THEN 'string' WHEN 'TIMESTAMP' THEN 'timestamp_ntz'
    WHEN 'TIMESTAMP WITH TIME ZONE' THEN 'timestamp' WHEN 'FLOAT[]' THEN 'array<float>' ELSE lower(column_type) END AS actual_type FROM found
),
declared(table_name, column_name, declared_type) AS (VALUES {", ".join(f"('{t}', '{c}', '{kind}')" for t, columns in DECLARED.items() for c, kind in columns.items())}),
empty AS ({" UNION ALL ".join(
    f"SELECT '{t}' AS table_name, '{c}' AS column_name, count(*) - count({c}) AS null_rows FROM {t}"
    for t, columns in DECLARED.items() for c in columns if GONE.get(t) != c
)})
SELECT table_name, column_name, declared_type, actual_type,
  CASE WHEN actual_type IS NULL THEN 'missing' WHEN declared_type IS NULL THEN 'extra' WHEN actual_type = declared_type THEN 'ok' ELSE 'changed' END AS status, null_rows
FROM declared FULL JOIN typed USING (table_name, column_name) LEFT JOIN empty USING (table_name, column_name)
""")
def schema_drift(spark: SparkSession, sf: str) -> DataFrame:
    return contracts.contract_reports({n: (table(spark, sf, n), c) for n, c in DECLARED.items()})


@query("csv_quality_profile", """
WITH r AS (
  SELECT CASE WHEN o_totalprice < 2000 THEN '' ELSE CAST(o_orderkey // 2 AS VARCHAR) END AS id,
    CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '5-LOW' THEN 'missing columns'
         WHEN o_orderstatus = 'P' AND o_orderpriority = '1-URGENT' THEN 'unreviewed extra columns'
         WHEN o_totalprice < 2000 THEN 'invalid record id' WHEN year(o_orderdate) <> 1998 THEN 'another fiscal year' ELSE 'accepted' END AS outcome FROM orders
)
SELECT outcome, count(*) AS rows, count(DISTINCT id) AS record_ids FROM r GROUP BY 1
""")
def csv_quality_profile(spark: SparkSession, sf: str) -> DataFrame:
    st, pr = F.col("o_orderstatus"), F.col("o_orderpriority")
    ident = F.when(F.col("o_totalprice") < 2000, " ").otherwise(F.expr("o_orderkey div 2").cast("string"))
    line = F.concat_ws(
        ",", ident, F.col("o_custkey").cast("string"), F.year("o_orderdate").cast("string"),
        F.when(~((st == "P") & (pr == "5-LOW")), F.concat(F.lit('"name, '), pr, F.lit(' ""x"""'))),
        F.when(pr == "2-HIGH", "one more"), F.when((st == "P") & (pr == "1-URGENT"), F.lit("a,b")),
    )
    rows = table(spark, sf, "orders").select(line.alias("line"))
    fields = ["id", "customer", "fiscal_year", "name"]
    return contracts.csv_profile(contracts.csv_verdicts(rows, "line", fields, "id", "fiscal_year", 1998, max_extra=1))


@query("archive_member_ingest", """
SELECT doc_id, 'doc-' || CAST(doc_id AS VARCHAR) || '.txt' AS member, octet_length(encode(text)) AS member_bytes, sha256(text) AS member_sha256 FROM documents
""")
def archive_member_ingest(spark: SparkSession, sf: str) -> DataFrame:
    member = F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".txt"))
    packed = table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("path"), member.alias("member"), archives.pack_member(member, F.col("text")).alias("content")
    )
    return archives.inspect_archives(packed).select(F.col("path").cast("bigint").alias("doc_id"), "member", "member_bytes", "member_sha256")


@query("json_collection_scan", """
WITH j AS (SELECT event_type, event_id % 40 = 0 AS broken, CAST(json_extract_string(props, '$.k') AS BIGINT) AS v FROM events)
SELECT event_type, 'k' AS json_key, CAST(NULL AS VARCHAR) AS reason, count(*) AS documents, CAST(sum(v) AS BIGINT) AS total, min(v) AS low, max(v) AS high
FROM j WHERE NOT broken GROUP BY 1
UNION ALL SELECT event_type, NULL, 'not a JSON object', count(*), NULL, NULL, NULL FROM j WHERE broken GROUP BY 1
""")
def json_collection_scan(spark: SparkSession, sf: str) -> DataFrame:
    # some documents are cut short
    props = F.when(F.col("event_id") % 40 == 0, F.expr("left(props, 3)")).otherwise(F.col("props")).alias("props")
    entries = documents.json_entries(table(spark, sf, "events").select("event_type", props), "props")
    v = F.col("json_value").try_cast("bigint")
    return entries.groupBy("event_type", "json_key", "reason").agg(
        F.count(F.lit(1)).alias("documents"), F.sum(v).alias("total"), F.min(v).alias("low"), F.max(v).alias("high")
    )


@query("json_record_scan", """
WITH o AS (SELECT o_orderkey AS k, o_orderkey % 11 AS m, 'c' || CAST(o_custkey AS VARCHAR) AS id, o_orderpriority AS p FROM orders)
SELECT k, CAST(NULL AS INTEGER) AS position, CAST(NULL AS VARCHAR) AS id, CAST(NULL AS VARCHAR) AS name,
       CASE m WHEN 0 THEN 'not a JSON object' WHEN 1 THEN 'no collection at the path' WHEN 2 THEN 'empty collection' ELSE 'not an array' END AS reason FROM o WHERE m <= 3
UNION ALL SELECT k, 0, id, p, CASE WHEN m = 4 THEN 'key is repeated' END FROM o WHERE m >= 4
UNION ALL SELECT k, 1, CASE m WHEN 4 THEN id WHEN 5 THEN '' ELSE 'second' END, CASE m WHEN 6 THEN '[1,2]' WHEN 7 THEN '[sic] Town' WHEN 8 THEN NULL WHEN 9 THEN 'True' WHEN 10 THEN 'padded' ELSE p END,
                 CASE m WHEN 4 THEN 'key is repeated' WHEN 5 THEN 'record has no key' WHEN 6 THEN 'record holds a list or an object' WHEN 8 THEN 'record holds a null' END FROM o WHERE m >= 4
""")
def json_record_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Record collections of order documents: most with one defect each, the others
    with a text that looks like a list, a flag, or a padded text."""
    m, record = F.col("o_orderkey") % 11, lambda key, name: F.concat(F.lit('{"id":"'), key, F.lit('","name":'), name, F.lit("}"))
    first, name = F.concat(F.lit("c"), F.col("o_custkey").cast("string")), F.concat(F.lit('"'), F.col("o_orderpriority"), F.lit('"'))
    second = F.when(m == 4, first).when(m == 5, F.lit(" ")).otherwise(F.lit("second"))
    odd = F.when(m == 6, "[1,2]").when(m == 7, '"[sic] Town"').when(m == 8, "null").when(m == 9, "true").when(m == 10, '" padded "').otherwise(name)
    both = F.concat(record(first, name), F.lit(","), record(second, odd))
    body = F.when(m == 2, F.lit("[]")).when(m == 3, F.lit('"text"')).otherwise(F.concat(F.lit("["), both, F.lit("]")))
    document = F.when(m == 0, F.lit('{"a":')).when(m == 1, F.lit('{"a":{}}')).otherwise(F.concat(F.lit('{"a":{"b":'), body, F.lit("}}")))
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), document.alias("document"))
    return documents.json_records(rows, "document", "a.b", "id", ["id", "name"])


@query("csv_record_scan", """
WITH o AS (SELECT o_orderkey AS k, o_orderkey % 6 AS m, 'c' || CAST(o_custkey AS VARCHAR) AS id, o_orderpriority AS p FROM orders)
SELECT k, CAST(NULL AS INTEGER) AS position, CAST(NULL AS VARCHAR) AS id, CAST(NULL AS VARCHAR) AS name, CASE m WHEN 0 THEN 'key is absent from the header' ELSE 'empty collection' END AS reason FROM o WHERE m <= 1
UNION ALL SELECT k, 0, id, p || ', "old"', CASE WHEN m = 2 THEN 'key is repeated' END FROM o WHERE m >= 2
UNION ALL SELECT k, 1, CASE m WHEN 2 THEN id WHEN 3 THEN '' ELSE 'second' END, CASE WHEN m = 4 THEN '' ELSE p END, CASE m WHEN 2 THEN 'key is repeated' WHEN 3 THEN 'record has no key' END FROM o WHERE m >= 2
""")
def csv_record_scan(spark: SparkSession, sf: str) -> DataFrame:
    """The same records as comma-separated texts: quoted cells, a byte-order mark,
    blank lines and short rows among them."""
    m, p = F.col("o_orderkey") % 6, F.col("o_orderpriority")
    first = F.concat(F.lit("c"), F.col("o_custkey").cast("string"))
    head = F.when(m == 0, "code,name").when(m == 5, "\ufeffname,id").otherwise("id,name")
    quoted = F.concat(F.lit('"'), p, F.lit(', \\"old\\""'))
    one = F.when(m == 5, F.concat(quoted, F.lit(","), first)).otherwise(F.concat(first, F.lit(","), quoted))
    second = F.when(m == 2, first).when(m == 3, F.lit("  ")).otherwise(F.lit("second"))
    two = F.when(m == 4, second).when(m == 5, F.concat(p, F.lit(", "), second, F.lit(" "))).otherwise(F.concat(second, F.lit(","), p))
    text = F.when(m == 1, F.concat(head, F.lit("\n \n"))).otherwise(F.concat_ws("\n", head, one, F.lit(""), F.concat(two, F.lit("\r"))))
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), text.alias("document"))
    return documents.csv_records(rows, "document", "id", ["id", "name"], width=8)


@query("edition_lines", """
WITH w AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS line_no FROM customer)
SELECT CAST(c_nationkey AS INTEGER) AS file_no, line_no, CAST(c_custkey AS VARCHAR) AS dissolved, CASE WHEN c_custkey % 5 = 0 THEN 'Québec, “old”' ELSE c_name END AS successor FROM w WHERE c_custkey % 7 <> 3
""")
def edition_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Windows-1252 lists written to files of their own, one for each nation, with
    blank lines between the rows, and read back with the numbers of their lines."""
    name = F.when(F.col("c_custkey") % 5 == 0, "Québec, “old”").otherwise(F.col("c_name"))
    row = F.when(F.col("c_custkey") % 7 == 3, "").otherwise(F.concat(F.col("c_custkey").cast("string"), F.lit(',"'), name, F.lit('"')))
    # Windows-1252 bytes: Latin ones, and those of the two quotes.
    latin = F.encode(F.translate(row, "“”", "\x93\x94"), "ISO-8859-1")
    folder = f"{checkpoint_folder(spark)}/lines-{uuid.uuid4().hex}"
    lists = table(spark, sf, "customer").select(F.col("c_nationkey").alias("file_no"), "c_custkey", latin.cast("string").alias("value"))
    lists.repartition("file_no").sortWithinPartitions("file_no", "c_custkey").drop("c_custkey").write.partitionBy("file_no").text(folder)
    rows = editions.read_edition(spark, folder, 2, with_path=True)
    return rows.select(
        F.regexp_extract("path", "file_no=([0-9]+)", 1).cast("int").alias("file_no"), "line_no", F.col("c0").alias("dissolved"), F.col("c1").alias("successor")
    )


@query("ledger_explode", """
WITH refused AS (SELECT o_orderkey % 50 = 0 AS broken, * FROM orders), orders AS (SELECT * FROM refused WHERE NOT broken)
SELECT CAST(NULL AS VARCHAR) AS ledger, CAST(NULL AS VARCHAR) AS kind, CAST(NULL AS INTEGER) AS position, CAST(NULL AS VARCHAR) AS node_id, 'not a JSON object' AS reason FROM refused WHERE broken
UNION ALL SELECT *, NULL FROM (
SELECT CAST(o_orderkey AS VARCHAR) AS ledger, 'sources' AS kind, 0 AS position, 's' || CAST(o_custkey AS VARCHAR) AS node_id FROM orders
UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'facts', 0, 'total' FROM orders UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'facts', 1, 'date' FROM orders
UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'derived', 0, 'd' || CAST(o_orderkey AS VARCHAR) FROM orders
UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'gaps', 0, 'gap' FROM orders WHERE o_orderpriority = '4-NOT SPECIFIED'
UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'findings', 0, 'f' FROM orders WHERE o_orderstatus = 'F')
""")
def ledger_explode(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("o_orderkey").cast("string")
    source = F.concat(F.lit("s"), F.col("o_custkey").cast("string"))
    doc = F.to_json(F.struct(
        key.alias("id"),
        F.array(F.struct(source.alias("id"), F.lit("order").alias("title"))).alias("sources"),
        F.array(
            F.struct(F.lit("total").alias("id"), source.alias("sourceId"), F.col("o_totalprice").cast("decimal(20,2)").alias("amountCad")),
            F.struct(F.lit("date").alias("id"), source.alias("sourceId"), F.lit(None).cast("decimal(20,2)").alias("amountCad")),
        ).alias("facts"),
        F.array(F.struct(F.concat(F.lit("d"), key).alias("id"), F.array(F.lit("total")).alias("inputs"))).alias("derived"),
        F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED", F.array(F.struct(F.lit("gap").alias("id")))).alias("gaps"),
        F.when(F.col("o_orderstatus") == "F", F.array(F.struct(F.lit("f").alias("id"), F.array(F.lit("total")).alias("cited")))).alias("findings"),
    ))
    doc = F.when(F.col("o_orderkey") % 50 == 0, F.expr("'{\"id\"'")).otherwise(doc)  # cut short
    return documents.ledger_nodes(table(spark, sf, "orders").select(doc.alias("document")), "document")


@query("anchor_extract", """
WITH a AS (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)"[^>]*>([^<]*)</a>', 1) AS h, regexp_extract_all(html, '<a href="([^"]*)"[^>]*>([^<]*)</a>', 2) AS t FROM pages)
SELECT page_id, CAST(generate_subscripts(h, 1) - 1 AS INTEGER) AS pos, unnest(h) AS href, unnest(t) AS anchor_text FROM a
""")
def anchor_extract(spark: SparkSession, sf: str) -> DataFrame:
    return documents.page_anchors(table(spark, sf, "pages"), "page_id", "html")


@query("closed_record_check", """
SELECT CASE WHEN event_type IN ('purchase', 'error') THEN '' ELSE event_type END AS unknown, CASE WHEN event_type = 'error' THEN '' ELSE 'error' END AS missing, count(*) AS records
FROM events GROUP BY 1, 2
""")
def closed_record_check(spark: SparkSession, sf: str) -> DataFrame:
    doc = F.concat(F.regexp_replace("props", r"\}\s*$", ""), F.lit(', "'), F.col("event_type"), F.lit('": '), F.col("value").cast("string"), F.lit("}"))
    unknown, missing = documents.closed_fields(F.col("doc"), ["k", "purchase", "error"], ["k", "error"])
    return table(spark, sf, "events").select(doc.alias("doc")).groupBy(unknown.alias("unknown"), missing.alias("missing")).agg(F.count(F.lit(1)).alias("records"))


SQL_EVENTS = """
o AS (
  SELECT *, CAST(o_orderdate AS DATE) AS d, 'Place ' || CAST(o_custkey AS VARCHAR) AS place, 'Town ' || CAST(o_custkey % 100 AS VARCHAR) AS town,
         '35' || lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS sgc, CASE WHEN o_orderpriority = '1-URGENT' THEN 'IRI' ELSE 'TP' END AS kind FROM orders
),
events_ AS (
  SELECT place AS dissolved, kind AS dissolved_type, town AS successor, 'TP' AS successor_type, d AS effective_date, kind <> 'IRI' AS levied, 'legacy' AS source_id, o_orderkey AS source_line, sgc AS sgc_code FROM o WHERE o_orderstatus = 'F' AND o_orderpriority <> '2-HIGH'
  UNION ALL
  SELECT place, kind, CASE WHEN o_orderpriority = '5-LOW' THEN 'Elsewhere' ELSE town END, 'TP', d, kind <> 'IRI', 'numbered', o_orderkey, sgc FROM o WHERE o_orderstatus <> 'O'
  UNION ALL
  SELECT place, kind, town, 'TP', d, kind <> 'IRI', 'described', o_orderkey, sgc FROM o WHERE o_orderpriority = '3-MEDIUM'
)"""
EDITION_ORDER = ["legacy", "numbered", "described"]


def edition_events(spark: SparkSession, sf: str) -> DataFrame:
    """Three layouts of the same kind of event, printed from orders."""
    place = F.concat(F.lit("Place "), F.col("o_custkey").cast("string"))
    town = F.concat(F.lit("Town "), (F.col("o_custkey") % 100).cast("string"))
    digits = F.lpad(F.col("o_orderkey").cast("string"), 9, "0")
    spaced = F.concat(F.lit("35 "), F.substring(digits, 1, 4), F.lit(" "), F.substring(digits, 5, 5))
    kind = F.when(F.col("o_orderpriority") == "1-URGENT", "IRI").otherwise("TP")
    day = F.date_format("o_orderdate", "dd/MM/yyyy")
    e = F.lit("")
    orders = table(spark, sf, "orders").withColumn("line_no", F.col("o_orderkey"))
    remark = F.concat(F.lit("Now part of (dissolution) - Maintenant partie de (dissolution) - "), town, F.lit(" , TP"))
    code = F.when(F.col("o_orderpriority") == "2-HIGH", "1").otherwise("4")
    row = lambda *cells: [c.alias(f"c{i}") for i, c in enumerate(cells)]
    legacy = orders.filter("o_orderstatus = 'F'").select("line_no", *row(place, e, kind, code, day, spaced, e, remark))
    other = F.when(F.col("o_orderpriority") == "5-LOW", "Elsewhere").otherwise(town)
    tail = [F.concat(F.lit("35"), digits), place, kind]
    numbered = orders.filter("o_orderstatus <> 'O'").select("line_no", *row(e, other, F.lit("TP"), e, e, *tail, F.lit("4"), day, e))
    words = F.when(F.col("o_orderpriority") == "3-MEDIUM", "Dissolution / dissolution").otherwise("Annexation")
    described = orders.select("line_no", *row(e, town, F.lit("TP"), e, e, *tail, e, words, day, e))
    return editions.union_editions({
        "legacy": (legacy, editions.legacy_events),
        "numbered": (numbered, lambda rows, s: editions.gaining_losing_events(rows, s, 8, 9)),
        "described": (described, lambda rows, s: editions.gaining_losing_events(rows, s, 9, 10, code_is_text=True)),
    })


@query("edition_union", f"WITH {SQL_EVENTS} SELECT * REPLACE (CAST(effective_date AS VARCHAR) AS effective_date), CAST(NULL AS VARCHAR) AS reason FROM events_")
def edition_union(spark: SparkSession, sf: str) -> DataFrame:
    return edition_events(spark, sf).withColumn("effective_date", F.col("effective_date").cast("string"))


@query("event_dedupe", f"""
WITH {SQL_EVENTS},
r AS (SELECT *, CASE source_id WHEN 'legacy' THEN 0 WHEN 'numbered' THEN 1 ELSE 2 END AS rank FROM events_)
SELECT sgc_code, CAST(effective_date AS VARCHAR) AS effective_date, arg_min(dissolved, rank) AS dissolved, arg_min(successor, rank) AS successor, arg_min(levied, rank) AS levied,
  arg_min(source_id, rank) AS source_id, count(*) AS copies, CASE WHEN count(DISTINCT dissolved || '|' || successor) = 1 THEN 'accepted' ELSE 'conflict' END AS status
FROM r GROUP BY 1, 2
""")
def event_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    events = editions.dedupe_events(edition_events(spark, sf), EDITION_ORDER)
    return events.withColumn("effective_date", F.col("effective_date").cast("string"))


@query("inventory_diff", """
WITH f AS (SELECT source || '/' || CAST(doc_id AS VARCHAR) || '.txt' AS path, octet_length(encode(text)) AS bytes, sha256(text) AS sha, lang AS kind, doc_id FROM documents WHERE lang <> 'es'),
m AS (SELECT source || '/' || CAST(d.doc_id AS VARCHAR) || '.txt' AS path, octet_length(encode(text)) + toxic AS bytes, sha256(CASE WHEN quality = 0 THEN '' ELSE text END) AS sha, lang AS kind FROM labels q JOIN documents d ON d.doc_id = q.doc_id)
SELECT coalesce(m.path, f.path) AS path, CASE WHEN f.path IS NULL THEN 'missing' WHEN m.path IS NULL THEN 'unlisted' WHEN f.bytes <> m.bytes OR f.sha <> m.sha THEN 'changed' ELSE 'verified' END AS status,
  CASE WHEN f.path IS NULL OR m.path IS NULL THEN '' ELSE concat_ws(',', CASE WHEN f.bytes <> m.bytes THEN 'bytes' END, CASE WHEN f.sha <> m.sha THEN 'sha256' END) END AS differs
FROM m FULL JOIN f ON f.path = m.path
""")
def inventory_diff(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select(
        F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"),
        F.octet_length("text").cast("bigint").alias("bytes"), F.sha2("text", 256).alias("sha256"), F.col("lang").alias("content_type"), "doc_id",
    )
    labels = table(spark, sf, "labels")
    manifest = docs.join(labels, "doc_id").select(
        "path", (F.col("bytes") + F.col("toxic")).alias("bytes"),
        F.when(F.col("quality") == 0, F.sha2(F.lit(""), 256)).otherwise(F.col("sha256")).alias("sha256"), "content_type",
    )
    return inventory.inventory_diff(docs.filter("content_type <> 'es'"), manifest, ["bytes", "sha256", "content_type"])


@query("provider_adapter", """
SELECT 'json-' || CAST(c_custkey AS VARCHAR) AS source_id, CAST(c_custkey AS VARCHAR) AS record_id, c_name AS name, CAST(NULL AS VARCHAR) AS reason FROM customer WHERE c_mktsegment <> 'MACHINERY'
UNION ALL SELECT 'json-' || CAST(c_custkey AS VARCHAR), CAST(c_custkey AS VARCHAR), c_name, 'unknown field owner' FROM customer WHERE c_mktsegment = 'MACHINERY'
UNION ALL SELECT 'csv-' || CAST(s_suppkey AS VARCHAR), CAST(s_suppkey AS VARCHAR), s_name || ', "north"', NULL FROM supplier
UNION ALL SELECT 'none-' || CAST(n_nationkey AS VARCHAR), NULL, NULL, 'no adapter' FROM nation
""")
def provider_adapter(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("c_custkey").cast("string")
    record = F.concat(
        F.lit('{"records": [{"id": "'), key, F.lit('", "name": "'), F.col("c_name"), F.lit('"'),
        F.when(F.col("c_mktsegment") == "MACHINERY", ', "owner": 1').otherwise(""), F.lit("}]}"),
    )
    a = table(spark, sf, "customer").select(F.concat(F.lit("json-"), key).alias("source_id"), F.lit("json-directory").alias("adapter"), record.cast("binary").alias("payload"))
    skey = F.col("s_suppkey").cast("string")
    lines = F.concat(F.lit("id,name\n"), skey, F.lit(',"'), F.col("s_name"), F.lit(', ""north"""\n'))
    b = table(spark, sf, "supplier").select(F.concat(F.lit("csv-"), skey).alias("source_id"), F.lit("csv-directory").alias("adapter"), lines.cast("binary").alias("payload"))
    c = table(spark, sf, "nation").select(F.concat(F.lit("none-"), F.col("n_nationkey").cast("string")).alias("source_id"), F.lit("pdf-directory").alias("adapter"), F.col("n_name").cast("binary").alias("payload"))
    return adapters.parse_payloads(a.unionByName(b).unionByName(c))


@query("release_intake_stream", f"""
SELECT event_type, CASE WHEN event_type = 'signup' THEN 'late' WHEN value > 150 THEN 'quarantined' ELSE 'accepted' END AS status,
       count(*) AS records, CAST(sum({sql_cents('value')}) AS BIGINT) AS cents FROM events GROUP BY 1, 2
""")
def release_intake_stream(spark: SparkSession, sf: str) -> DataFrame:
    from tallyroom.operators.digests import record_digest

    events = table(spark, sf, "events")
    lock = events.filter("event_type <> 'signup'").select(
        "event_id", record_digest("event_type", F.when(F.col("value") > 150, F.lit("0")).otherwise(F.col("value").cast("string"))).alias("digest")
    )
    # The glob names the table itself, whether it is one file or a folder of parts.
    stream = spark.readStream.schema(events.schema).parquet(f"{sf}/events.parq[u]et")
    folder = f"{checkpoint_folder(spark)}/intake-{uuid.uuid4().hex}"
    target = intake.run_intake(stream, lock, "event_id", ["event_type", "value"], folder)
    return intake.taken(spark, target).groupBy("event_type", "status").agg(F.count(F.lit(1)).alias("records"), F.sum(cents("value")).alias("cents"))


@query("declared_counts", """
SELECT conv_id, max(turn) + 1 AS declared, count(*) AS counted, CASE WHEN max(turn) + 1 = count(*) THEN 'ok' ELSE 'differs' END AS status FROM conversations GROUP BY 1
""")
def declared_counts(spark: SparkSession, sf: str) -> DataFrame:
    per = table(spark, sf, "conversations").groupBy("conv_id").agg((F.max("turn") + 1).alias("declared"), F.count(F.lit(1)).alias("counted"))
    return per.withColumn("status", F.when(F.col("declared") == F.col("counted"), "ok").otherwise("differs"))


@query("ledger_summary", """
WITH j AS (SELECT lang, quality, toxic, n_chars FROM documents d LEFT JOIN labels q ON q.doc_id = d.doc_id)
SELECT lang, count(*) AS facts, count(quality) AS reviewed, count(*) - count(quality) AS gaps, CAST(coalesce(sum(quality), 0) AS BIGINT) AS strong,
  CAST(coalesce(sum(toxic), 0) AS BIGINT) AS held, CAST(sum(n_chars) AS BIGINT) AS chars, row_number() OVER (ORDER BY count(*) DESC, lang) AS position FROM j GROUP BY 1
""")
def ledger_summary(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    j = table(spark, sf, "documents").select("doc_id", "lang", "n_chars").join(table(spark, sf, "labels"), "doc_id", "left")
    per = j.groupBy("lang").agg(
        F.count(F.lit(1)).alias("facts"), F.count("quality").alias("reviewed"), F.count(F.when(F.col("quality").isNull(), F.lit(1))).alias("gaps"),
        F.coalesce(F.sum("quality"), F.lit(0)).cast("bigint").alias("strong"), F.coalesce(F.sum("toxic"), F.lit(0)).cast("bigint").alias("held"),
        F.sum("n_chars").alias("chars"),
    )
    # one row per language
    return per.withColumn("position", F.row_number().over(Window.orderBy(F.desc("facts"), "lang")).cast("bigint"))

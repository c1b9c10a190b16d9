"""Key, crosswalk and cover queries."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyroom.functions import text
from tallyroom.operators import compare, crosswalk, gates
from tallyroom.operators.digests import record_digest
from tallyroom.plans.registry import cents, query, sql_cents, table

TOTAL = sql_cents("o_totalprice")


@query("filer_identity", """
WITH v AS (
  SELECT o_custkey AS code, c_name, c_mktsegment, count(*) AS n, max(CAST(o_orderdate AS DATE)) AS d
  FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2, 3
)
SELECT code, min(c_name) AS c_name, min(c_mktsegment) AS c_mktsegment, count(*) AS identities,
       CAST(sum(n) AS BIGINT) AS rows, CAST(max(d) AS VARCHAR) AS last_updated,
       CASE WHEN count(*) = 1 THEN 'accepted' ELSE 'refused' END AS status
FROM v GROUP BY code
""")
def filer_identity(spark: SparkSession, sf: str) -> DataFrame:
    # Filing rows repeat the identity of their filer; reduce them before the lookup.
    rows = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count(F.lit(1)).alias("rows"), F.max(F.col("o_orderdate").cast("date")).alias("updated")
    )
    named = rows.join(table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment"), "c_custkey")
    identities = gates.identity_scan(named.withColumnRenamed("c_custkey", "code"), "code", ["c_name", "c_mktsegment"], "updated", rows="rows")
    return identities.withColumn("last_updated", F.col("last_updated").cast("string"))


@query("identity_conflict", """
WITH v AS (SELECT l_suppkey AS code, l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY 1, 2, 3)
SELECT code, count(*) AS identities, CAST(sum(n) AS BIGINT) AS rows FROM v GROUP BY 1 HAVING count(*) > 1
""")
def identity_conflict(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("code"), "l_returnflag", "l_linestatus")
    return gates.identity_conflicts(rows, "code", ["l_returnflag", "l_linestatus"])


@query("duplicate_keys", """
SELECT l_orderkey AS code, l_linenumber AS line, count(*) AS copies FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1
""")
def duplicate_keys(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("code"), F.col("l_linenumber").alias("line"))
    return gates.duplicate_keys(rows, ["code", "line"])


@query("expected_counts", """
WITH o AS (SELECT o_orderpriority AS grp, count(*) AS n FROM orders GROUP BY 1),
e AS (SELECT o_orderpriority AS grp, count(DISTINCT o_orderkey) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)
SELECT coalesce(o.grp, e.grp) AS grp, coalesce(e.n, 0) AS expected, coalesce(o.n, 0) AS observed,
       CASE WHEN o.n IS NOT DISTINCT FROM e.n THEN 'ok' ELSE 'changed' END AS status
FROM o FULL JOIN e ON e.grp = o.grp
""")
def expected_counts(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderpriority").alias("grp"))
    filed = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    observed = orders.groupBy("grp").agg(F.count(F.lit(1)).alias("rows"))
    expected = orders.join(filed, "o_orderkey", "left_semi").groupBy("grp").agg(F.count(F.lit(1)).alias("rows"))
    return gates.expected_counts(observed, expected, ["grp"])


@query("name_crosswalk", """
WITH d AS (
  SELECT c_custkey AS entry, regexp_replace(lower(c_name), '[^0-9]', '', 'g') AS name_key, n_regionkey AS tier,
         CASE WHEN c_mktsegment = 'MACHINERY' THEN c_custkey // 2 END AS oc
  FROM customer JOIN nation ON n_nationkey = c_nationkey
),
f AS (
  SELECT s_suppkey AS code, regexp_replace(lower(s_name), '[^0-9]', '', 'g') AS name_key, n_regionkey AS tier
  FROM supplier JOIN nation ON n_nationkey = s_nationkey
),
c AS (SELECT name_key, tier, min(code) AS mc, count(*) AS matches FROM f GROUP BY 1, 2),
r AS (
  SELECT entry, oc, coalesce(oc, mc) AS code, coalesce(matches, 0) AS matches, k.code IS NOT NULL AS known
  FROM d LEFT JOIN c ON c.name_key = d.name_key AND c.tier = d.tier LEFT JOIN f k ON k.code = oc
),
u AS (SELECT code, count(*) AS uses FROM r WHERE code IS NOT NULL GROUP BY 1)
SELECT entry, r.code, CASE WHEN oc IS NOT NULL THEN 'override' WHEN matches > 0 THEN 'name' ELSE 'none' END AS basis,
       CASE WHEN oc IS NOT NULL AND NOT known THEN 'override points outside the filers'
            WHEN oc IS NULL AND matches > 1 THEN 'ambiguous name match'
            WHEN uses > 1 THEN 'code maps to several entries' END AS reason
FROM r LEFT JOIN u ON u.code = r.code
""")
def name_crosswalk(spark: SparkSession, sf: str) -> DataFrame:
    nation = table(spark, sf, "nation").select("n_nationkey", F.col("n_regionkey").alias("tier"))
    customers = table(spark, sf, "customer")
    digits = lambda c: F.regexp_replace(text.normalized_name(F.col(c)), "[^0-9]", "")
    directory = customers.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("entry"), digits("c_name").alias("name_key"), "tier"
    )
    filers = table(spark, sf, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_suppkey").alias("code"), digits("s_name").alias("name_key"), "tier"
    )
    overrides = customers.filter("c_mktsegment = 'MACHINERY'").selectExpr("c_custkey AS entry", "c_custkey div 2 AS code")
    return crosswalk.name_crosswalk(directory, filers, overrides)


@query("crosswalk_orphans", """
SELECT c_custkey AS code, 'no-history' AS status FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events)
UNION ALL
SELECT DISTINCT user_id, 'orphan' FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer)
""")
def crosswalk_orphans(spark: SparkSession, sf: str) -> DataFrame:
    left = table(spark, sf, "customer").select(F.col("c_custkey").alias("code"))
    right = table(spark, sf, "events").select(F.col("user_id").alias("code"))
    return crosswalk.unmatched(left, right, "code", "no-history", "orphan")


@query("dangling_refs", """
WITH refs AS (
  SELECT 'document' AS kind, conv_id AS ref_id, 'turn ' || CAST(turn AS VARCHAR) AS location FROM conversations
  UNION ALL SELECT 'part', l_partkey * 2, 'line ' || CAST(l_linenumber AS VARCHAR) FROM lineitem
  UNION ALL SELECT 'supplier', l_suppkey, 'line ' || CAST(l_linenumber AS VARCHAR) FROM lineitem
),
t AS (
  SELECT 'document' AS kind, doc_id AS ref_id FROM labels UNION ALL SELECT 'part', p_partkey FROM part
  UNION ALL SELECT 'supplier', s_suppkey FROM supplier
)
SELECT kind, ref_id, count(*) AS citations, min(location) AS first_location FROM refs r
WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.kind = r.kind AND t.ref_id = r.ref_id) GROUP BY 1, 2
""")
def dangling_refs(spark: SparkSession, sf: str) -> DataFrame:
    lines, turns = table(spark, sf, "lineitem"), table(spark, sf, "conversations")

    def refs(df, kind, ref, where, word):
        return df.select(F.lit(kind).alias("kind"), ref.alias("ref_id"), F.concat(F.lit(word + " "), F.col(where).cast("string")).alias("location"))

    references = (
        refs(turns, "document", F.col("conv_id"), "turn", "turn")
        .unionByName(refs(lines, "part", F.col("l_partkey") * 2, "l_linenumber", "line"))
        .unionByName(refs(lines, "supplier", F.col("l_suppkey"), "l_linenumber", "line"))
    )
    targets = (
        table(spark, sf, "labels").select(F.lit("document").alias("kind"), F.col("doc_id").alias("ref_id"))
        .unionByName(table(spark, sf, "part").select(F.lit("part").alias("kind"), F.col("p_partkey").alias("ref_id")))
        .unionByName(table(spark, sf, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("ref_id")))
    )
    return crosswalk.dangling(references, targets)


@query("exact_cover", f"""
WITH r AS (SELECT o_custkey AS code, CASE WHEN count(*) > 10 THEN 'BUILDING' ELSE 'MACHINERY' END AS segment FROM orders GROUP BY 1)
SELECT coalesce(c_custkey, code) AS code,
       CASE WHEN code IS NULL THEN 'missing' WHEN c_custkey IS NULL THEN 'extra'
            WHEN segment <> c_mktsegment THEN 'changed' ELSE 'same' END AS status,
       CASE WHEN segment <> c_mktsegment THEN 'segment' ELSE '' END AS differs
FROM customer FULL JOIN r ON code = c_custkey
""")
def exact_cover(spark: SparkSession, sf: str) -> DataFrame:
    roster = table(spark, sf, "customer").select(F.col("c_custkey").alias("code"), F.col("c_mktsegment").alias("segment"))
    review = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("code")).agg(F.count(F.lit(1)).alias("n")).select(
        "code", F.when(F.col("n") > 10, "BUILDING").otherwise("MACHINERY").alias("segment")
    )
    return compare.compare_sets(roster, review, ["code"], ["segment"])


@query("set_difference", """
SELECT doc_id, 'unlabelled' AS side FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
UNION ALL SELECT DISTINCT doc_id, 'label without document' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)
UNION ALL SELECT DISTINCT user_id, 'user without document' FROM events WHERE user_id NOT IN (SELECT doc_id FROM documents)
UNION ALL SELECT DISTINCT doc_id, 'document without user' FROM documents WHERE doc_id NOT IN (SELECT user_id FROM events)
""")
def set_difference(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id")
    labelled = table(spark, sf, "labels").select("doc_id")
    users = table(spark, sf, "events").select(F.col("user_id").alias("doc_id"))
    a = compare.two_sided_difference(docs, labelled, ["doc_id"], ("unlabelled", "label without document"))
    b = compare.two_sided_difference(users, docs, ["doc_id"], ("user without document", "document without user"))
    return a.unionByName(b)


@query("set_overlap", """
WITH k AS (SELECT l_orderkey AS code, l_returnflag || l_linestatus AS kind, l_discount < 0.05 AS low FROM lineitem),
s AS (SELECT code, coalesce(list(DISTINCT kind) FILTER (low), []) AS a, coalesce(list(DISTINCT kind) FILTER (NOT low), []) AS b FROM k GROUP BY 1)
SELECT code, array_to_string(list_sort(list_intersect(a, b)), ',') AS shared, len(list_intersect(a, b)) = 0 AS disjoint FROM s
""")
def set_overlap(spark: SparkSession, sf: str) -> DataFrame:
    # Both flags are one-letter codes, so a set holds a handful of kinds.
    lines = table(spark, sf, "lineitem").withColumn("kind", F.concat("l_returnflag", "l_linestatus"))
    low = F.col("l_discount") < F.lit(0.05)
    sets = lines.groupBy(F.col("l_orderkey").alias("code")).agg(
        F.collect_set(F.when(low, F.col("kind"))).alias("a"), F.collect_set(F.when(~low, F.col("kind"))).alias("b")
    )
    return sets.select(
        "code",
        F.array_join(F.array_sort(F.array_intersect("a", "b")), ",").alias("shared"),
        (~F.arrays_overlap("a", "b")).alias("disjoint"),
    )


@query("exactly_one", """
SELECT c_custkey AS code, count(o_orderkey) AS matches,
       CASE count(o_orderkey) WHEN 0 THEN 'absent' WHEN 1 THEN 'selected' ELSE 'ambiguous' END AS status
FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderpriority = '1-URGENT' AND o_orderstatus = 'F' GROUP BY 1
""")
def exactly_one(spark: SparkSession, sf: str) -> DataFrame:
    wanted = table(spark, sf, "customer").select(F.col("c_custkey").alias("code"))
    rows = table(spark, sf, "orders").filter("o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'").select(F.col("o_custkey").alias("code"))
    return crosswalk.match_counts(wanted, rows, "code")


@query("edge_symmetry", """
WITH e AS (SELECT DISTINCT l_partkey AS a, l_suppkey AS b FROM lineitem)
SELECT least(a, b) AS low, greatest(a, b) AS high,
       CASE WHEN least(a, b) = greatest(a, b) THEN 'self-edge' WHEN count(*) = 2 THEN 'mutual' ELSE 'one-way' END AS status
FROM e GROUP BY 1, 2
""")
def edge_symmetry(spark: SparkSession, sf: str) -> DataFrame:
    return crosswalk.undirected_edges(table(spark, sf, "lineitem").select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b")))


@query("bidirectional_reconcile", """
WITH l AS (SELECT DISTINCT o_custkey AS code FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1998-01-01'),
r AS (SELECT DISTINCT o_custkey AS code FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' AND o_orderdate < TIMESTAMP '1999-01-01')
SELECT code, 'table-only' AS side FROM l WHERE code NOT IN (SELECT code FROM r)
UNION ALL SELECT code, 'crosswalk-only' FROM r WHERE code NOT IN (SELECT code FROM l)
""")
def bidirectional_reconcile(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders")

    def window(start, end):
        inside = (F.col("o_orderdate") >= F.lit(start).cast("timestamp")) & (F.col("o_orderdate") < F.lit(end).cast("timestamp"))
        return orders.filter(inside).select(F.col("o_custkey").alias("code"))

    return compare.two_sided_difference(window("1997-01-01", "1998-01-01"), window("1998-01-01", "1999-01-01"), ["code"], ("table-only", "crosswalk-only"))


@query("positional_bind", """
WITH a AS (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS hrefs, regexp_extract_all(html, '<p>([^<]*)</p>', 1) AS ps FROM pages),
l AS (SELECT page_id, generate_subscripts(hrefs, 1) - 1 AS pos, unnest(hrefs) AS left_item FROM a),
r AS (SELECT page_id, generate_subscripts(ps, 1) - 1 AS pos, unnest(ps) AS right_item FROM a)
SELECT coalesce(l.page_id, r.page_id) AS page_id, CAST(coalesce(l.pos, r.pos) AS INTEGER) AS pos, left_item, right_item,
       CASE WHEN left_item IS NULL THEN 'right-only' WHEN right_item IS NULL THEN 'left-only' ELSE 'bound' END AS status
FROM l FULL JOIN r ON r.page_id = l.page_id AND r.pos = l.pos
""")
def positional_bind(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages").select(
        "page_id",
        F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), 1).alias("hrefs"),
        F.regexp_extract_all("html", F.lit("<p>([^<]*)</p>"), 1).alias("ps"),
    )
    return crosswalk.bind_positions(pages, pages, "page_id", "hrefs", "ps")


@query("two_witness", f"""
WITH a AS (SELECT l_orderkey AS code, CAST(sum({sql_cents('l_extendedprice')}) AS BIGINT) AS v FROM lineitem GROUP BY 1),
b AS (SELECT o_orderkey AS code, {TOTAL} AS v FROM orders)
SELECT coalesce(a.code, b.code) AS code, a.v AS first, b.v AS second,
       CASE WHEN a.v IS NULL OR b.v IS NULL THEN 'single-witness' WHEN abs(a.v - b.v) <= 2000000 THEN 'corroborated' ELSE 'conflict' END AS status
FROM a FULL JOIN b ON b.code = a.code
""")
def two_witness(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("code")).agg(F.sum(cents("l_extendedprice")).alias("v"))
    b = table(spark, sf, "orders").select(F.col("o_orderkey").alias("code"), cents("o_totalprice").alias("v"))
    return crosswalk.two_witness(a, b, "code", "v", 2_000_000)


@query("context_agreement", """
WITH s AS (
  SELECT c_custkey AS code, c_nationkey AS field FROM customer
  UNION ALL SELECT s_suppkey, s_nationkey FROM supplier
  UNION ALL SELECT user_id, max(CASE WHEN event_type = 'error' THEN 3 END) FROM events GROUP BY 1
)
SELECT code, count(*) AS artifacts,
       CASE WHEN min(field) IS NULL THEN 'silent' WHEN min(field) = max(field) THEN 'agree' ELSE 'disagree' END AS status
FROM s GROUP BY 1
""")
def context_agreement(spark: SparkSession, sf: str) -> DataFrame:
    pack = table(spark, sf, "customer").select(F.col("c_custkey").alias("code"), F.col("c_nationkey").alias("field"))
    ledger = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("code"), F.col("s_nationkey").alias("field"))
    receipt = table(spark, sf, "events").groupBy(F.col("user_id").alias("code")).agg(
        F.max(F.when(F.col("event_type") == "error", 3)).alias("field")
    )
    return crosswalk.context_agreement([pack, ledger, receipt], "code", "field")


# What must agree of a place in its pack (customer), ledger (supplier) and receipt (events).
CONTEXT = {
    "slug": crosswalk.Rule("slug", required=("pack", "ledger", "receipt")),
    "name": crosswalk.Rule("name", "text", ("pack", "ledger"), ("ledger",)),
    "display name": crosswalk.Rule("name", "prefix", ("pack", "receipt")),
    "level": crosswalk.Rule("level"),
    "code": crosswalk.Rule("nation", artifacts=("pack", "ledger"), together=True),
    "year": crosswalk.Rule("year", required=("ledger", "receipt"), anchored=True),
    "currency": crosswalk.Rule("currency", "upper", required=("ledger", "receipt"), anchored=True),
}


@query("context_fields", """
WITH c AS (SELECT c_custkey AS code, right(c_name, 4) AS slug, lower(c_name) AS name, c_nationkey % 2 AS level, c_nationkey AS nation,
    c_nationkey % 3 AS year, CASE WHEN c_mktsegment <> 'BUILDING' THEN CASE WHEN c_acctbal < 0 THEN 'usd' ELSE 'cad' END END AS currency FROM customer),
s AS (SELECT s_suppkey AS code, right(s_name, 4) AS slug, CASE WHEN s_suppkey % 3 = 0 THEN lower(s_name) WHEN s_suppkey % 3 = 1 THEN lower(replace(s_name, 'Supplier', 'Customer')) END AS name,
    s_nationkey % 2 AS level, CASE WHEN s_suppkey % 4 > 0 THEN CASE WHEN s_suppkey % 4 = 1 THEN s_nationkey ELSE s_suppkey % 25 END END AS nation, s_nationkey % 3 AS year,
    CASE WHEN s_acctbal < 0 THEN 'USD' ELSE 'CAD' END AS currency FROM supplier),
e AS (SELECT user_id AS code, lpad(CAST(user_id % 997 AS VARCHAR), 4, '0') AS slug,
    CASE user_id % 4 WHEN 0 THEN 'user' ELSE 'customer#' || lpad(CAST(user_id AS VARCHAR), 9, '0') || ' (in town)' END AS name,
    CASE WHEN max(value) > 150 THEN 1 END AS level, CASE WHEN min(value) < 5 THEN user_id % 3 END AS year, 'CAD' AS currency FROM events GROUP BY 1),
j AS (
  SELECT coalesce(c.code, s.code, e.code) AS code, c.slug AS cs, s.slug AS ss, e.slug AS es, c.name AS cn, s.name AS sn, e.name AS en,
    c.level AS cl, s.level AS sl, e.level AS el, c.nation AS ca, s.nation AS sa, c.year AS cy, s.year AS sy, e.year AS ey, upper(c.currency) AS cu, s.currency AS su, e.currency AS eu
  FROM c FULL JOIN s ON s.code = c.code FULL JOIN e ON e.code = coalesce(c.code, s.code)
),
r AS (
  SELECT code, 'slug' AS rule, CASE WHEN coalesce(cs, ss, es) IS NULL THEN 'silent' WHEN cs <> ss OR cs <> es OR ss <> es THEN 'disagree' ELSE 'agree' END AS status,
    concat_ws(', ', CASE WHEN cs IS NULL THEN 'pack' END, CASE WHEN ss IS NULL THEN 'ledger' END, CASE WHEN es IS NULL THEN 'receipt' END) AS missing FROM j
  UNION ALL SELECT code, 'name', CASE WHEN coalesce(cn, sn) IS NULL THEN 'silent' WHEN cn <> sn THEN 'disagree' ELSE 'agree' END, CASE WHEN sn IS NULL THEN 'ledger' ELSE '' END FROM j
  UNION ALL SELECT code, 'display name', CASE WHEN coalesce(cn, en) IS NULL THEN 'silent' WHEN NOT starts_with(en, cn) THEN 'disagree' ELSE 'agree' END, '' FROM j
  UNION ALL SELECT code, 'level', CASE WHEN coalesce(cl, sl, el) IS NULL THEN 'silent' WHEN cl <> sl OR cl <> el OR sl <> el THEN 'disagree' ELSE 'agree' END, '' FROM j
  UNION ALL SELECT code, 'code', CASE WHEN coalesce(ca, sa) IS NULL THEN 'silent' WHEN ca <> sa THEN 'disagree' ELSE 'agree' END,
    CASE WHEN ca IS NULL AND sa IS NOT NULL THEN 'pack' WHEN sa IS NULL AND ca IS NOT NULL THEN 'ledger' ELSE '' END FROM j
  UNION ALL SELECT code, 'year', CASE WHEN coalesce(cy, sy, ey) IS NULL THEN 'silent' WHEN cy IS NULL OR cy <> sy OR cy <> ey THEN 'disagree' ELSE 'agree' END,
    concat_ws(', ', CASE WHEN sy IS NULL THEN 'ledger' END, CASE WHEN ey IS NULL THEN 'receipt' END) FROM j
  UNION ALL SELECT code, 'currency', CASE WHEN coalesce(cu, su, eu) IS NULL THEN 'silent' WHEN cu IS NULL OR cu <> su OR cu <> eu THEN 'disagree' ELSE 'agree' END,
    concat_ws(', ', CASE WHEN su IS NULL THEN 'ledger' END, CASE WHEN eu IS NULL THEN 'receipt' END) FROM j
)
SELECT code, rule, status, missing, mode, CASE WHEN status = 'disagree' OR (missing <> '' AND mode = 'strict') THEN 'error' WHEN missing <> '' THEN 'warning' ELSE 'none' END AS severity
FROM r CROSS JOIN (VALUES ('strict'), ('lenient')) m(mode)
""")
def context_fields(spark: SparkSession, sf: str) -> DataFrame:
    key, user = F.col("s_suppkey"), F.col("user_id")
    pack = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("code"), F.right("c_name", F.lit(4)).alias("slug"), F.col("c_name").alias("name"),
        (F.col("c_nationkey") % 2).alias("level"), F.col("c_nationkey").alias("nation"), (F.col("c_nationkey") % 3).alias("year"),
        F.when(F.col("c_mktsegment") != "BUILDING", F.when(F.col("c_acctbal") < 0, "usd").otherwise("cad")).alias("currency"),
    )
    shouted = F.concat(F.lit(" "), F.upper(F.replace("s_name", F.lit("Supplier"), F.lit("Customer"))), F.lit("  "))
    ledger = table(spark, sf, "supplier").select(
        key.alias("code"), F.right("s_name", F.lit(4)).alias("slug"),
        F.when(key % 3 == 0, F.col("s_name")).when(key % 3 == 1, shouted).otherwise(" ").alias("name"),
        (F.col("s_nationkey") % 2).alias("level"),
        F.when(key % 4 > 0, F.when(key % 4 == 1, F.col("s_nationkey")).otherwise(key % 25)).alias("nation"),
        (F.col("s_nationkey") % 3).alias("year"), F.when(F.col("s_acctbal") < 0, "USD").otherwise("CAD").alias("currency"),
    )
    shown = F.concat(F.lit("Customer#"), F.lpad(user.cast("string"), 9, "0"), F.lit("  (In Town)"))
    receipt = table(spark, sf, "events").groupBy(user.alias("code")).agg(F.max("value").alias("most"), F.min("value").alias("least")).select(
        "code", F.lpad((F.col("code") % 997).cast("string"), 4, "0").alias("slug"), "most", "least", F.col("code").alias("user_id")
    ).select(
        "code", "slug", F.when(user % 4 == 0, "User").otherwise(shown).alias("name"), F.when(F.col("most") > 150, 1).alias("level"),
        F.when(F.col("least") < 5, user % 3).alias("year"), F.lit("CAD").alias("currency"),
    )
    artifacts = {"pack": pack, "ledger": ledger, "receipt": receipt}
    modes = [crosswalk.context_fields(artifacts, "code", CONTEXT, mode == "strict").withColumn("mode", F.lit(mode)) for mode in ("strict", "lenient")]
    return modes[0].unionByName(modes[1])


@query("request_cover", """
WITH a AS (
  SELECT l_orderkey AS code, CASE l_returnflag WHEN 'A' THEN 'closing' WHEN 'N' THEN 'non-closing' ELSE 'gap' END AS kind,
         CASE WHEN l_returnflag = 'A' THEN '' ELSE l_linestatus END AS reason
  FROM lineitem
),
p AS (
  SELECT code, reason, max(CASE WHEN kind = 'closing' THEN 1 ELSE 0 END) AS c, max(CASE WHEN kind = 'non-closing' THEN 1 ELSE 0 END) AS n,
         max(CASE WHEN kind = 'gap' THEN 1 ELSE 0 END) AS g FROM a GROUP BY 1, 2
),
f AS (SELECT code, max(c) AS c, max(n) AS n, max(g) AS g, max(n * g) AS s FROM p GROUP BY 1),
j AS (
  SELECT coalesce(o_orderkey, code) AS code, o_orderpriority <> '5-LOW' AS required, coalesce(c, 0) AS c, coalesce(n, 0) AS n, coalesce(g, 0) AS g, coalesce(s, 0) AS s
  FROM (SELECT * FROM orders WHERE o_orderstatus <> 'P') FULL JOIN f ON code = o_orderkey
),
v AS (
  SELECT code, CASE WHEN required IS NULL THEN 'not requested'
    WHEN (c = 1 OR n = 1) AND g = 1 AND s = 0 THEN 'source and gap overlap without a stated reason'
    WHEN n = 1 AND c = 0 AND s = 0 THEN 'non-closing source without its gap'
    WHEN required AND c = 0 AND g = 0 THEN 'required item has neither source nor gap' END AS reason FROM j
)
SELECT code, reason, CASE WHEN reason IS NULL THEN 'covered' ELSE 'refused' END AS status FROM v
""")
def request_cover(spark: SparkSession, sf: str) -> DataFrame:
    """Orders are the requested documents (not the ones in status P); their
    lines are closing sources, non-closing sources and gaps."""
    requests = table(spark, sf, "orders").filter("o_orderstatus <> 'P'").select(
        F.col("o_orderkey").alias("code"), (F.col("o_orderpriority") != "5-LOW").alias("required")
    )
    flag = F.col("l_returnflag")
    answers = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("code"),
        F.when(flag == "A", "closing").when(flag == "N", "non-closing").otherwise("gap").alias("kind"),
        F.when(flag == "A", "").otherwise(F.col("l_linestatus")).alias("reason"),
    )
    return crosswalk.request_cover(requests, answers, "code")


@query("area_fanout", """
SELECT c_custkey AS code, r_name AS area, n.n_nationkey AS line
FROM customer JOIN nation m ON m.n_nationkey = c_nationkey JOIN region ON r_regionkey = m.n_regionkey
JOIN nation n ON n.n_regionkey = m.n_regionkey
""")
def area_fanout(spark: SparkSession, sf: str) -> DataFrame:
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    areas = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_nationkey").alias("c_nationkey"), F.col("r_regionkey").alias("area_key"), F.col("r_name").alias("area")
    )
    schedule = nation.select(F.col("n_regionkey").alias("area_key"), F.col("n_nationkey").alias("line"))
    filers = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    return filers.join(areas, "c_nationkey").join(schedule, "area_key").select(F.col("c_custkey").alias("code"), "area", "line")


@query("alias_enrich", """
WITH f AS (SELECT DISTINCT l_suppkey, p_brand FROM lineitem JOIN part ON p_partkey = l_partkey),
g AS (SELECT l_suppkey, count(*) AS n, string_agg(p_brand, ', ' ORDER BY p_brand) AS names FROM f GROUP BY 1)
SELECT s_suppkey AS code, s_name AS name, coalesce(names, '') AS former,
       CASE WHEN n = 1 THEN 'Includes the former ' || names WHEN n > 1 THEN 'Includes the former places ' || names END AS note
FROM supplier LEFT JOIN g ON l_suppkey = s_suppkey
""")
def alias_enrich(spark: SparkSession, sf: str) -> DataFrame:
    suppliers = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("code"), F.col("s_name").alias("name"))
    pairs = table(spark, sf, "lineitem").select("l_partkey", "l_suppkey").distinct().join(
        table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")
    ).select(F.col("l_suppkey").alias("code"), F.col("p_brand").alias("former_name")).distinct()
    former = pairs.join(suppliers, "code").select(F.upper("name").alias("successor"), "former_name")
    return crosswalk.alias_enrich(suppliers, former, "name").select(
        "code", "name", F.coalesce(F.array_join("former_names", ", "), F.lit("")).alias("former"), "note"
    )


STORE_DIGEST = "sha256(concat_ws(chr(31), CAST(o_custkey AS VARCHAR), o_orderpriority))"


@query("write_once_merge", f"""
WITH s AS (SELECT o_orderkey, {STORE_DIGEST} AS d FROM orders WHERE o_orderstatus <> 'O'),
i AS (SELECT o_orderkey, sha256(concat_ws(chr(31), CAST(o_custkey AS VARCHAR), CASE WHEN o_totalprice < 100000 THEN 'revised' ELSE o_orderpriority END)) AS digest FROM orders)
SELECT i.o_orderkey AS code, digest, CASE WHEN d IS NULL THEN 'insert' WHEN d = digest THEN 'no-op' ELSE 'conflict' END AS action
FROM i LEFT JOIN s ON s.o_orderkey = i.o_orderkey
""")
def write_once_merge(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").withColumnRenamed("o_orderkey", "code")
    store = orders.filter("o_orderstatus <> 'O'").select("code", record_digest("o_custkey", "o_orderpriority").alias("digest"))
    incoming = orders.select(
        "code", record_digest("o_custkey", F.when(F.col("o_totalprice") < 100000, "revised").otherwise(F.col("o_orderpriority"))).alias("digest")
    )
    return compare.write_once(store, incoming, "code", "digest")


@query("snapshot_diff", f"""
WITH p AS (SELECT o_orderkey AS code, {STORE_DIGEST} AS d FROM orders WHERE o_orderpriority <> '5-LOW'),
b AS (SELECT o_orderkey AS code, sha256(concat_ws(chr(31), CAST(o_custkey AS VARCHAR), CASE WHEN o_orderstatus = 'P' THEN 'x' ELSE o_orderpriority END)) AS d
      FROM orders WHERE o_orderpriority <> '2-HIGH')
SELECT coalesce(b.code, p.code) AS code,
       CASE WHEN p.code IS NULL THEN 'missing' WHEN b.code IS NULL THEN 'stale' WHEN p.d <> b.d THEN 'changed' ELSE 'fresh' END AS status
FROM b FULL JOIN p ON p.code = b.code
""")
def snapshot_diff(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").withColumnRenamed("o_orderkey", "code")
    published = orders.filter("o_orderpriority <> '5-LOW'").select("code", record_digest("o_custkey", "o_orderpriority").alias("digest"))
    rebuilt = orders.filter("o_orderpriority <> '2-HIGH'").select(
        "code", record_digest("o_custkey", F.when(F.col("o_orderstatus") == "P", "x").otherwise(F.col("o_orderpriority"))).alias("digest")
    )
    return compare.compare_sets(rebuilt, published, ["code"], ["digest"], ("missing", "stale", "changed", "fresh")).drop("differs")


@query("publish_freshness", """
WITH o AS (SELECT o_orderkey AS code, o_orderpriority AS pr, o_orderstatus AS st FROM orders),
f AS (SELECT code, 1 AS version, 'fresh' AS status FROM o WHERE pr <> '5-LOW'
  UNION ALL SELECT code, 2, CASE WHEN pr = '5-LOW' THEN 'missing' WHEN pr = '2-HIGH' THEN 'stale' WHEN st = 'P' THEN 'changed' ELSE 'fresh' END FROM o
  UNION ALL SELECT code, 3, 'fresh' FROM o WHERE pr <> '2-HIGH')
SELECT code, CAST(version AS BIGINT) AS version, status FROM f
""")
def publish_freshness(spark: SparkSession, sf: str) -> DataFrame:
    """Receipts of orders published, judged against themselves (1) and against a
    rebuild (2), published again from the rebuild and judged against that (3)."""
    from tallyroom.session import checkpoint_folder
    from tallyroom.sources import sinks

    root = f"{checkpoint_folder(spark).rstrip('/')}/published-{uuid.uuid4().hex}"
    orders = table(spark, sf, "orders").withColumnRenamed("o_orderkey", "code")
    shown = sinks.receipt_documents(orders.filter("o_orderpriority <> '5-LOW'"), "code", ["o_custkey", "o_orderpriority"])
    revised = orders.filter("o_orderpriority <> '2-HIGH'").withColumn(
        "o_orderpriority", F.when(F.col("o_orderstatus") == "P", "x").otherwise(F.col("o_orderpriority"))
    )
    rebuilt = sinks.receipt_documents(revised, "code", ["o_custkey", "o_orderpriority"])
    first = sinks.publish(shown, root, "code")
    judged = [
        sinks.freshness(shown, root, "code").withColumn("version", F.lit(first).cast("bigint")),
        sinks.freshness(rebuilt, root, "code").withColumn("version", F.lit(first + 1).cast("bigint")),
    ]
    second = sinks.publish(rebuilt, root, "code")
    judged.append(sinks.freshness(rebuilt, root, "code").withColumn("version", F.lit(second + 1).cast("bigint")))
    return reduce(DataFrame.unionByName, judged).select("code", "version", "status")


@query("lock_diff", f"""
WITH o AS (SELECT l_orderkey, count(*) AS rows, count(DISTINCT l_linenumber) AS records FROM lineitem GROUP BY 1),
l AS (
  SELECT o_orderkey AS code, CASE WHEN o_orderstatus = 'F' THEN sha256(CAST(o_custkey AS VARCHAR)) END AS lm,
         CASE WHEN o_orderpriority = '1-URGENT' THEN sha256('changed') ELSE sha256(CAST(o_custkey AS VARCHAR)) END AS om,
         rows AS lr, rows + CASE WHEN o_orderpriority = '5-LOW' THEN 1 ELSE 0 END AS orr, records, o_orderpriority AS p
  FROM orders JOIN o ON l_orderkey = o_orderkey
),
d AS (
  SELECT code, p, coalesce(lm = om, false) AS matches, lm IS NOT NULL AS pinned, lr, orr FROM l
),
x AS (
  SELECT code, p, concat_ws(',',
    CASE WHEN NOT matches AND p = '2-HIGH' THEN 'bytes' END,
    CASE WHEN NOT matches AND p IN ('2-HIGH', '3-MEDIUM') THEN 'sha256' END,
    CASE WHEN lr <> orr THEN 'row_count' END,
    CASE WHEN pinned AND NOT matches THEN 'member_sha256' END) AS differences FROM d
)
SELECT code, CASE WHEN p = '4-NOT SPECIFIED' THEN '' ELSE differences END AS differences,
       CASE WHEN p = '4-NOT SPECIFIED' THEN 'not-observed' WHEN differences = '' THEN 'verified' ELSE 'quarantined' END AS status FROM x
""")
def lock_diff(spark: SparkSession, sf: str) -> DataFrame:
    counts = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("code"), "l_linenumber").agg(F.count(F.lit(1)).alias("n")).groupBy("code").agg(
        F.sum("n").alias("rows"), F.count(F.lit(1)).alias("records")
    )
    p = F.col("o_orderpriority")
    base = table(spark, sf, "orders").withColumnRenamed("o_orderkey", "code").join(counts, "code")
    member = F.sha2(F.col("o_custkey").cast("string"), 256)
    lock = base.select(
        "code", F.lit(100).alias("bytes"), F.sha2(F.lit("container"), 256).alias("sha256"),
        F.when(F.col("o_orderstatus") == "F", member).alias("member_sha256"),
        F.col("rows").alias("row_count"), F.col("records").alias("record_count"),
    )
    observed = base.filter(p != "4-NOT SPECIFIED").select(
        "code", F.when(p == "2-HIGH", 120).otherwise(100).alias("bytes"),
        F.sha2(F.when(p.isin("2-HIGH", "3-MEDIUM"), "rezipped").otherwise("container"), 256).alias("sha256"),
        F.when(p == "1-URGENT", F.sha2(F.lit("changed"), 256)).otherwise(member).alias("member_sha256"),
        (F.col("rows") + F.when(p == "5-LOW", 1).otherwise(0)).alias("row_count"), F.col("records").alias("record_count"),
    )
    return compare.lock_differences(lock, observed, "code")


@query("lock_overlay", """
WITH a AS (SELECT doc_id, CASE WHEN lang = 'fr' THEN NULL ELSE n_chars END AS v FROM documents),
b AS (SELECT doc_id, 1 AS one, n_chars + CASE WHEN quality = 0 THEN 1 ELSE 0 END AS v FROM labels JOIN documents USING (doc_id)
      UNION ALL SELECT 10000000 + item_id, 1, length(text) FROM benchmark)
SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(b.v, a.v) AS n_chars,
       CASE WHEN a.doc_id IS NULL THEN 'unused-lock' WHEN b.doc_id IS NULL THEN 'unlocked'
            WHEN a.v IS NOT NULL AND a.v <> b.v THEN 'mismatch' WHEN a.v IS NULL THEN 'filled' ELSE 'agree' END AS status
FROM a FULL JOIN b ON b.doc_id = a.doc_id
""")
def lock_overlay(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    ledger = docs.select("doc_id", F.when(F.col("lang") != "fr", F.col("n_chars")).alias("n_chars"))
    lock = table(spark, sf, "labels").select("doc_id", "quality").join(docs, "doc_id").select(
        "doc_id", (F.col("n_chars") + F.when(F.col("quality") == 0, 1).otherwise(0)).alias("n_chars")
    ).unionByName(
        table(spark, sf, "benchmark").select((F.col("item_id") + 10000000).alias("doc_id"), F.length("text").cast("bigint").alias("n_chars"))
    )
    return compare.overlay(ledger, lock, "doc_id", "n_chars")


@query("lock_status", """
SELECT d.doc_id, CASE WHEN (d.lang = 'en' AND q.doc_id IS NULL AND d.n_chars > 3000) THEN 'missing'
       WHEN d.lang = 'en' AND q.doc_id IS NOT NULL THEN 'source-and-extract' WHEN d.lang = 'en' THEN 'source-only'
       WHEN q.doc_id IS NOT NULL THEN 'extract-only' ELSE 'remote-unlocked' END AS status
FROM documents d LEFT JOIN labels q ON q.doc_id = d.doc_id
""")
def lock_status(spark: SparkSession, sf: str) -> DataFrame:
    present = table(spark, sf, "labels").select("doc_id", F.lit(True).alias("present"))
    docs = table(spark, sf, "documents").select("doc_id", "lang", "n_chars").join(present, "doc_id", "left")
    there = F.coalesce("present", F.lit(False))
    declared_source = F.col("lang") == "en"
    declared_extract = there | (declared_source & (F.col("n_chars") > 3000))
    return docs.select("doc_id", compare.lock_status(declared_source, F.lit(True), declared_extract, there).alias("status"))


@query("canonical_digest", """
WITH h AS (SELECT o_orderpriority AS grp, sha256(concat_ws(chr(31), CAST(o_custkey AS VARCHAR), o_orderstatus)) AS d FROM orders),
c AS (SELECT grp, d, count(*) AS n FROM h GROUP BY 1, 2),
l6 AS (SELECT grp, left(d, 6) AS p, sha256(string_agg(d || ':' || CAST(n AS VARCHAR), ',' ORDER BY d)) AS h, sum(n) AS n FROM c GROUP BY 1, 2),
l4 AS (SELECT grp, left(p, 4) AS p, sha256(string_agg(h, ',' ORDER BY l6.p)) AS h, sum(n) AS n FROM l6 GROUP BY 1, left(p, 4)),
l2 AS (SELECT grp, left(p, 2) AS p, sha256(string_agg(h, ',' ORDER BY l4.p)) AS h, sum(n) AS n FROM l4 GROUP BY 1, left(p, 2))
SELECT grp, CAST(sum(n) AS BIGINT) AS records, sha256(string_agg(h, ',' ORDER BY p)) AS set_digest FROM l2 GROUP BY 1
""")
def canonical_digest(spark: SparkSession, sf: str) -> DataFrame:
    from tallyroom.operators.digests import set_digest

    rows = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("grp"), record_digest("o_custkey", "o_orderstatus").alias("digest"))
    return set_digest(rows, ["grp"], "digest")


@query("compat_matrix", """
SELECT o_orderstatus AS body_type, o_orderpriority AS tier, count(*) AS records FROM orders
WHERE NOT ((o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH')) OR (o_orderstatus = 'O' AND o_orderpriority = '5-LOW')) GROUP BY 1, 2
""")
def compat_matrix(spark: SparkSession, sf: str) -> DataFrame:
    from tallyroom.operators.hierarchy import incompatible

    allowed = {"F": ["1-URGENT", "2-HIGH"], "O": ["5-LOW"]}
    bodies = table(spark, sf, "orders").select(F.col("o_orderstatus").alias("body_type"), F.col("o_orderpriority").alias("tier"))
    return incompatible(bodies, allowed, "body_type", "tier").groupBy("body_type", "tier").agg(F.count(F.lit(1)).alias("records"))


@query("iff_rules", """
WITH r AS (
  SELECT o_orderkey AS code, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderdate END AS d, o_orderpriority = '4-NOT SPECIFIED' AS f,
         CASE WHEN o_orderstatus = 'O' THEN NULL ELSE o_custkey END AS a, CASE WHEN o_totalprice < 50000 THEN NULL ELSE o_totalprice END AS b FROM orders
)
SELECT code, concat_ws(',', CASE WHEN (d IS NULL) <> f THEN 'date-unclear-iff-no-date' END,
       CASE WHEN (a IS NULL) <> (b IS NULL) THEN 'provenance-all-or-none' END) AS violations
FROM r WHERE (d IS NULL) <> f OR (a IS NULL) <> (b IS NULL)
""")
def iff_rules(spark: SparkSession, sf: str) -> DataFrame:
    from tallyroom.functions import rules

    rows = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("code"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate")).alias("published"),
        F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED", F.array(F.lit("date-unclear"))).otherwise(F.array().cast("array<string>")).alias("flags"),
        F.when(F.col("o_orderstatus") != "O", F.col("o_custkey")).alias("a"),
        F.when(F.col("o_totalprice") >= 50000, F.col("o_totalprice")).alias("b"),
    )
    broken = gates.broken_rules([
        ("date-unclear-iff-no-date", rules.not_iff(F.col("published").isNull(), F.array_contains("flags", "date-unclear"))),
        ("provenance-all-or-none", rules.partly_null("a", "b")),
    ])
    return rows.select("code", F.array_join(broken, ",").alias("violations")).filter("violations <> ''")


@query("record_rules", """
WITH r AS (
  SELECT doc_id, concat_ws(',', CASE WHEN n_chars <> length(text) THEN 'length' END, CASE WHEN trim(text) = '' THEN 'empty' END,
    CASE WHEN lang NOT IN ('en', 'fr') THEN 'language' END, CASE WHEN NOT regexp_matches(source, '^src[0-9]$') THEN 'source-id' END,
    CASE WHEN length(text) < 200 THEN 'too-short' END) AS violations FROM documents
)
SELECT * FROM r WHERE violations <> ''
""")
def record_rules(spark: SparkSession, sf: str) -> DataFrame:
    broken = gates.broken_rules([
        ("length", F.col("n_chars") != F.length("text")),
        ("empty", F.trim("text") == ""),
        ("language", ~F.col("lang").isin("en", "fr")),
        ("source-id", ~F.col("source").rlike("^src[0-9]$")),
        ("too-short", F.length("text") < 200),
    ])
    return table(spark, sf, "documents").select("doc_id", F.array_join(broken, ",").alias("violations")).filter("violations <> ''")


@query("approved_only", """
SELECT DISTINCT l_orderkey AS receipt, l_linenumber AS finding FROM lineitem
WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority NOT IN ('4-NOT SPECIFIED', '5-LOW')) AND l_linenumber <= 3
""")
def approved_only(spark: SparkSession, sf: str) -> DataFrame:
    from tallyroom.operators.projection import approved_findings

    priority = F.col("o_orderpriority")
    receipts = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("receipt"),
        F.when(F.col("o_orderstatus") == "F", "approved").otherwise("pending").alias("review"),
        # one priority is unsigned, another signed with blanks
        F.when(priority == "5-LOW", "  ").when(priority != "4-NOT SPECIFIED", priority).alias("reviewer"),
        F.col("o_orderdate").alias("reviewed_at"), F.sequence(F.lit(1), F.lit(3)).alias("approved"),
    )
    findings = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("receipt"), F.col("l_linenumber").alias("finding"))
    return approved_findings(receipts, findings, "receipt", "finding", "approved")


@query("public_projection", f"""
SELECT o_orderkey AS id, o_orderstatus AS kind, {TOTAL} AS amount_cents, o_orderpriority AS label,
       CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN o_orderpriority ELSE 'missing_evidence' END AS disposition
FROM orders
""")
def public_projection(spark: SparkSession, sf: str) -> DataFrame:
    from tallyroom.operators.projection import allow_listed

    nested = table(spark, sf, "orders").select(
        F.struct(
            F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("kind"), F.col("o_custkey").alias("internal_owner"),
            F.struct(cents("o_totalprice").alias("amount_cents"), F.col("o_orderpriority").alias("label"), F.col("o_orderdate").alias("reviewed_at")).alias("body"),
        ).alias("node")
    )
    kept = allow_listed(nested, "node", {"id": None, "kind": None, "body": {"amount_cents": None, "label": None}})
    return kept.select("node.id", "node.kind", "node.body.amount_cents", "node.body.label").withColumn(
        "disposition", F.when(F.col("label").isin("1-URGENT", "2-HIGH"), F.col("label")).otherwise("missing_evidence")
    )


@query("stage_sequence", """
WITH s AS (
  SELECT l_orderkey AS code, l_linenumber AS stage, min(CASE WHEN l_linestatus = 'F' THEN 'complete' WHEN l_returnflag = 'R' THEN 'in-progress' ELSE 'not-started' END) AS st
  FROM lineitem GROUP BY 1, 2
),
f AS (SELECT code, min(CASE WHEN st <> 'complete' THEN stage END) AS open FROM s GROUP BY 1)
SELECT s.code, any_value(f.open) AS first_open, count(CASE WHEN st = 'in-progress' THEN 1 END) AS active,
  CASE WHEN count(CASE WHEN st = 'complete' AND stage > open THEN 1 END) > 0 THEN 'completed stage follows unfinished work'
       WHEN count(CASE WHEN st = 'in-progress' AND stage > open THEN 1 END) > 0 THEN 'only the first unfinished stage may be active' END AS reason
FROM s JOIN f ON f.code = s.code GROUP BY 1
""")
def stage_sequence(spark: SparkSession, sf: str) -> DataFrame:
    from tallyroom.operators.hierarchy import stage_verdicts

    status = (
        F.when(F.col("l_linestatus") == "F", "complete").when(F.col("l_returnflag") == "R", "in-progress").otherwise("not-started")
    )
    stages = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("code"), F.col("l_linenumber").alias("stage")).agg(F.min(status).alias("status"))
    return stage_verdicts(stages, "code", "stage").select("code", "first_open", "active", "reason")

"""Lookups, printed controls, refused values and accepted forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyroom.functions import text
from tallyroom.operators import coverage, figures, filings
from tallyroom.operators.skew import in_tasks
from tallyroom.plans.intake import EDITION_ORDER, SQL_EVENTS, edition_events
from tallyroom.plans.registry import cents, query, sql_cents, table
from tallyroom.sources import editions, tables_on_pages
from tallyroom.sources.filings import refused_amounts as refused
from tallyroom.sources.filings import scan_facts

TOTAL, CENTS = sql_cents("o_totalprice"), sql_cents("l_extendedprice")
LAYERS = ["1-URGENT", "2-HIGH", "3-MEDIUM"]

# A customer's final orders are taxation, the others corporate revenue; the base
# is off by 51 or 50 cents for some, and some entries are gone or empty.
SQL_LEDGER = f"""
c AS (SELECT o_custkey AS k, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN {TOTAL} ELSE 0 END) AS BIGINT) AS tax,
             CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 0 ELSE {TOTAL} END) AS BIGINT) AS corp FROM orders GROUP BY 1),
w AS (
  SELECT k, 'TAX-' || CAST(k AS VARCHAR) AS figure_id, -1 AS sign, tax AS amount, 'fact' AS origin FROM c
  UNION ALL SELECT k, 'CORP-' || CAST(k AS VARCHAR), -1, CASE WHEN k % 11 = 0 THEN NULL ELSE corp END, 'fact' FROM c
  UNION ALL SELECT k, 'BASE-' || CAST(k AS VARCHAR), 1, CASE WHEN k % 7 = 0 THEN NULL ELSE tax + corp + CASE k % 3 WHEN 0 THEN 51 WHEN 1 THEN -50 ELSE 0 END END, CASE WHEN k % 7 = 0 THEN NULL ELSE 'derived' END FROM c
),
n AS (SELECT *, CASE WHEN origin IS NULL THEN 'no entry has this id' WHEN amount IS NULL THEN 'the entry carries no amount' END AS reason FROM w)"""


def _ledger(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The wanted parts of every identity and their named figures."""
    final = F.col("o_orderstatus") == "F"
    k = F.col("k")
    sums = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("k")).agg(
        F.sum(F.when(final, cents("o_totalprice")).otherwise(0)).alias("tax"), F.sum(F.when(final, 0).otherwise(cents("o_totalprice"))).alias("corp")
    )
    name = lambda kind: F.concat(F.lit(f"{kind}-"), k.cast("string"))
    row = lambda kind, amount, position=0: F.struct(name(kind).alias("figure_id"), F.lit(position).alias("position"), amount.alias("amount"))
    listed = lambda *rows: sums.select(F.inline(F.array(*rows)))
    none = F.lit(None).cast("bigint")
    # a second row of an id, and a derived row beside a fact, are not the first
    facts = listed(row("TAX", F.col("tax")), row("TAX", F.lit(1).cast("bigint"), 1), row("CORP", F.when(k % 11 == 0, none).otherwise(F.col("corp"))))
    base = F.col("tax") + F.col("corp") + F.when(k % 3 == 0, 51).when(k % 3 == 1, -50).otherwise(0)
    derived = listed(row("TAX", F.lit(2).cast("bigint"))).unionByName(sums.filter("k % 7 <> 0").select(F.inline(F.array(row("BASE", base)))))
    parts = sums.select("k", F.inline(F.array(*[F.struct(name(kind).alias("figure_id"), F.lit(sign).alias("sign")) for kind, sign in (("TAX", -1), ("CORP", -1), ("BASE", 1))])))
    return parts, figures.named_figures(parts.select("figure_id"), facts, derived)


@query("named_figures", f"WITH {SQL_LEDGER} SELECT figure_id, amount, origin, reason FROM n")
def named_figures(spark: SparkSession, sf: str) -> DataFrame:
    return _ledger(spark, sf)[1]


@query("figure_closure", f"""
WITH {SQL_LEDGER},
p AS (SELECT k, count(*) AS figures, count(reason) AS refused_figures, CASE WHEN count(reason) = 0 THEN CAST(sum(sign * amount) AS BIGINT) END AS difference FROM n GROUP BY 1)
SELECT k AS code, figures, refused_figures, difference, CASE WHEN refused_figures > 0 THEN 'a figure is refused' WHEN abs(difference) > 50 THEN 'the identity does not hold' END AS reason FROM p
""")
def figure_closure(spark: SparkSession, sf: str) -> DataFrame:
    parts, named = _ledger(spark, sf)
    return figures.closures(parts, named, "k", tolerance=50).withColumnRenamed("k", "code")


@query("layer_evidence", """
WITH l AS (SELECT o_custkey AS jurisdiction, o_orderpriority AS layer, count(*) AS n, count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS bodies FROM orders GROUP BY 1, 2),
s AS (SELECT *, CASE WHEN n >= 3 THEN 'complete' WHEN n = 2 THEN 'partial' ELSE 'planned' END AS status FROM l)
SELECT jurisdiction, layer, status, CASE
  WHEN status <> 'planned' AND jurisdiction % 5 = 0 THEN 'claimed coverage requires a locked source'
  WHEN status = 'partial' AND bodies < 1 THEN 'partial coverage requires a verified body'
  WHEN status = 'complete' AND jurisdiction % 4 = 0 THEN 'complete coverage requires an expected count'
  WHEN status = 'complete' AND bodies <> n THEN 'complete coverage has another count' END AS reason FROM s
""")
def layer_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """Orders of a customer and priority are a layer; final ones are verified bodies."""
    orders = table(spark, sf, "orders").select(F.col("o_custkey").alias("jurisdiction"), F.col("o_orderpriority").alias("layer"), "o_orderstatus")
    n, odd = F.col("n"), F.col("jurisdiction")
    layers = orders.groupBy("jurisdiction", "layer").agg(F.count(F.lit(1)).alias("n")).select(
        "jurisdiction", "layer", F.when(n >= 3, "complete").when(n == 2, "partial").otherwise("planned").alias("status"),
        F.when(odd % 5 != 0, F.array(F.lit("locked"))).alias("sources"), F.when(odd % 4 != 0, n).alias("expected"),
    )
    observed = orders.filter("o_orderstatus = 'F'").groupBy("jurisdiction", "layer").agg(F.count(F.lit(1)).alias("bodies"))
    return coverage.layer_verdicts(layers, observed)


@query("layer_cover", """
WITH l AS (SELECT DISTINCT o_custkey AS k, o_orderpriority AS layer FROM orders UNION ALL SELECT DISTINCT o_custkey, '1-URGENT' FROM orders WHERE o_custkey % 6 = 0),
r AS (SELECT * FROM (VALUES ('1-URGENT'), ('2-HIGH'), ('3-MEDIUM')) AS t(layer)),
m AS (SELECT u.k, string_agg(r.layer, ', ' ORDER BY r.layer) AS missing FROM (SELECT DISTINCT k FROM l) u CROSS JOIN r WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.k = u.k AND l.layer = r.layer) GROUP BY 1),
c AS (SELECT k, count(CASE WHEN layer > '4' THEN 1 END) AS unexpected, count(CASE WHEN layer < '4' THEN 1 END) - count(DISTINCT CASE WHEN layer < '4' THEN layer END) AS repeated FROM l GROUP BY 1)
SELECT c.k AS jurisdiction, coalesce(missing, '') AS missing, unexpected, repeated,
  CASE WHEN missing IS NOT NULL THEN 'a required layer is missing' WHEN unexpected > 0 THEN 'a layer is unexpected' WHEN repeated > 0 THEN 'a layer is repeated' END AS reason
FROM c LEFT JOIN m ON m.k = c.k
""")
def layer_cover(spark: SparkSession, sf: str) -> DataFrame:
    held = table(spark, sf, "orders").select(F.col("o_custkey").alias("jurisdiction"), F.col("o_orderpriority").alias("layer")).distinct()
    again = held.filter("jurisdiction % 6 = 0").select("jurisdiction", F.lit("1-URGENT").alias("layer")).distinct()
    return coverage.layer_cover(held.unionByName(again), LAYERS)


def _filing_rows(spark: SparkSession, sf: str, amount) -> DataFrame:
    slc = F.concat(F.lit("slc.40X.L"), F.lpad(F.col("l_linenumber").cast("string"), 4, "0"), F.lit(".C01."), F.when(F.col("l_linestatus") == "F", "07").otherwise("08"))
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").cast("string").alias("ASSESSMENT_CODE"), slc.alias("SLC"), amount.alias("AMOUNT"))


@query("filer_subset", f"""
SELECT CAST(l_orderkey AS VARCHAR) AS code, count(*) AS facts, CAST(sum({CENTS}) AS BIGINT) AS cents
FROM lineitem WHERE l_linestatus = 'F' AND l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P') GROUP BY 1
""")
def filer_subset(spark: SparkSession, sf: str) -> DataFrame:
    """The filers wanted come as a table, as large as it may be."""
    rows = _filing_rows(spark, sf, F.col("l_extendedprice").cast("decimal(20,2)").cast("string"))
    wanted = table(spark, sf, "orders").filter("o_orderstatus = 'P'").select(F.col("o_orderkey").cast("string").alias("code"))
    return scan_facts(rows, filings.SPEND_ADDRESS, wanted).groupBy("code").agg(
        F.count(F.lit(1)).alias("facts"), F.sum((F.col("amount") * 100).cast("bigint")).alias("cents")
    )


@query("refused_amounts", f"""
WITH r AS (SELECT CAST(l_orderkey AS VARCHAR) AS code, 'slc.40X.L' || lpad(CAST(l_linenumber AS VARCHAR), 4, '0') || '.C01.07' AS slc, {CENTS} AS c, l_partkey % 6 AS kind FROM lineitem WHERE l_linestatus = 'F')
SELECT code, slc, CASE kind WHEN 1 THEN '0.00000000001' || CAST(c AS VARCHAR) WHEN 2 THEN repeat('9', 29) || CAST(c AS VARCHAR) ELSE CAST(c AS VARCHAR) || 'e40' END AS printed,
  CASE kind WHEN 1 THEN 'more decimals than can be kept' ELSE 'amount out of range' END AS reason FROM r WHERE kind IN (1, 2, 3)
""")
def refused_amounts(spark: SparkSession, sf: str) -> DataFrame:
    """Amounts with eleven decimals or more, beyond 28 digits, or with a large exponent; others fit, are blank or junk."""
    kind, c = F.col("l_partkey") % 6, cents("l_extendedprice").cast("string")
    amount = F.when(kind == 1, F.concat(F.lit("0.00000000001"), c)).when(kind == 2, F.concat(F.lit("9" * 29), c)).when(kind == 3, F.concat(F.lit(" "), c, F.lit("e40")))
    rows = _filing_rows(spark, sf, amount.when(kind == 4, "n/a").when(kind == 5, " ").otherwise(c))
    return refused(rows, filings.SPEND_ADDRESS)


AREAS = ["blended", "urban", "rural"]


@query("footer_controls", """
WITH l AS (SELECT l_orderkey AS code, l_linenumber AS line, CAST(sum(round(l_quantity)) AS BIGINT) AS q FROM lineitem GROUP BY 1, 2),
t AS (SELECT code, a.area, CAST(sum(q * a.k) AS BIGINT) AS total, a.k FROM l, (VALUES ('blended', 1), ('urban', 2), ('rural', 3)) AS a(area, k) GROUP BY 1, 2, a.k),
c AS (SELECT *, CASE WHEN code % 5 <> 0 THEN total + CASE WHEN code % 3 = 0 AND k = 2 THEN 1 ELSE 0 END END AS control FROM t)
SELECT code, area, total, control, CASE WHEN control IS NULL THEN 'no control is printed' WHEN total <> control THEN 'lines do not add to the control' END AS reason FROM c
""")
def footer_controls(spark: SparkSession, sf: str) -> DataFrame:
    """Each order prints a table of its lines and, most of them, a footer of controls."""
    items = table(spark, sf, "lineitem")
    lines = items.groupBy(F.col("l_orderkey").alias("code"), F.col("l_linenumber").alias("line")).agg(F.sum(F.round("l_quantity").cast("bigint")).alias("q"))
    # A line becomes a cell for each area; all of a table's meet in the task that gets its lines here.
    lines = in_tasks(lines, items.count(), "code")
    shown = lambda share, amount: F.concat(F.lit(f"{share} $"), F.format_number(amount, 0))
    row = F.concat_ws(" ", F.concat(F.lit("Service "), F.col("line").cast("string")), F.lit("1,000"), F.lit("$500"), *[shown("12.5%", F.col("q") * k) for k in (1, 2, 3)])
    off = F.when(F.col("code") % 3 == 0, 1).otherwise(0)
    foot = F.concat_ws("  ", *[shown("100%", F.col("q") * k + (off if k == 2 else 0)) for k in (1, 2, 3)])
    feet = lines.groupBy("code").agg(F.sum("q").alias("q")).filter("code % 5 <> 0").select("code", F.concat(F.lit("Total "), foot).alias("row"))
    cells = tables_on_pages.service_rows(lines.select("code", row.alias("row")), "row", AREAS)
    return tables_on_pages.control_verdicts(cells, tables_on_pages.footer_controls(feet, "row", AREAS), ["code"])


@query("unallocated_lines", f"""
WITH l AS (SELECT o_orderkey AS code, o_custkey % 5 AS a, o_orderkey % 4 AS b, o_orderkey % 7 AS c, {TOTAL} AS cents FROM orders)
SELECT code, a NOT IN (1, 2) AND c <> 0 AS shown, a = 3 OR b = 1 OR c IN (1, 2) AS unallocated FROM l
""")
def unallocated_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as receipt lines of several classes, gaps and labels; some amounts are zero, negative or not finite."""
    a, b, c = F.col("o_custkey") % 5, F.col("o_orderkey") % 4, F.col("o_orderkey") % 7
    kind = F.when(a == 1, "reconciling_item").when(a == 2, "special_levy").when(a == 3, "City_Levy_Unallocated").when(a == 4, "department")
    gap = F.when(b == 1, "gap-dept-schedule-2026").when(b == 2, "GAP-OTHER")
    label = F.when(c == 1, "Combined Rate").when(c == 2, "combined ASSESSMENT share").when(c == 3, "Combined services").otherwise("Road rate")
    amount = F.when(c != 0, cents("o_totalprice").cast("double")).when(b == 0, 0.0).when(b == 1, -1.0).when(b == 2, float("nan")).otherwise(float("inf"))
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("code"), figures.is_shown(kind, amount).alias("shown"), figures.is_unallocated(kind, gap, label).alias("unallocated")
    )


@query("identifier_forms", """
SELECT doc_id, doc_id % 4 < 2 AS is_digest, doc_id % 5 < 2 AS is_id FROM documents
""")
def identifier_forms(spark: SparkSession, sf: str) -> DataFrame:
    """Digests and ids of documents as producers spell them: right, upper-case, cut short, with doubled marks, empty."""
    digest, k, m = F.sha2("text", 256), F.col("doc_id") % 4, F.col("doc_id") % 5
    spelled = F.when(k < 2, F.coalesce(digest, F.lit("0" * 64))).when(k == 2, F.concat(F.lit("A"), F.substring(digest, 2, 63))).otherwise(F.substring(digest, 1, 63))
    number = F.col("doc_id").cast("string")
    name = F.when(m < 2, F.concat_ws("-", F.lit("on"), F.col("lang"), number)).when(m == 2, F.concat(F.lit("on--"), number)).when(m == 3, F.concat(F.lit("On-"), number))
    return table(spark, sf, "documents").select("doc_id", text.is_digest(spelled).alias("is_digest"), text.is_identifier(name).alias("is_id"))


@query("official_names", """
WITH n AS (SELECT p_partkey AS code, p_name AS stem, p_size % 7 AS k FROM part)
SELECT code, CASE k WHEN 0 THEN stem WHEN 1 THEN stem WHEN 2 THEN 'Haldimand County' WHEN 3 THEN 'Norfolk County' WHEN 4 THEN 'The Nation' END AS display,
  CASE k WHEN 0 THEN 'City' WHEN 1 THEN 'District Municipality' WHEN 2 THEN 'County' WHEN 3 THEN 'County' WHEN 4 THEN 'Municipality' END AS kind,
  CASE WHEN k > 4 THEN 'unsupported name form' END AS reason FROM n
""")
def official_names(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_size") % 7
    name = F.when(k == 0, F.concat("p_name", F.lit(", City of"))).when(k == 1, F.concat("p_name", F.lit(", District Municipality of"))).when(k == 2, "Haldimand County")
    name = name.when(k == 3, "Norfolk County").when(k == 4, "The Nation Municipality").when(k == 5, F.concat("p_name", F.lit(" County"))).otherwise(F.concat("p_name", F.lit(", Borough of")))
    display, kind = text.official_name_parts(name)
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("code"), display.alias("display"), kind.alias("kind"), F.when(kind.isNull(), "unsupported name form").alias("reason")
    )


@query("edition_counts", f"""
WITH {SQL_EVENTS},
s AS (SELECT * FROM (VALUES ('legacy'), ('numbered'), ('retired')) AS t(source_id)),
e AS (SELECT source_id, count(*) AS found, CAST(min(effective_date) AS VARCHAR) AS earliest, CAST(max(effective_date) AS VARCHAR) AS latest FROM events_ GROUP BY 1)
SELECT coalesce(s.source_id, e.source_id) AS source_id, coalesce(found, 0) AS found, earliest, latest,
  CASE WHEN s.source_id IS NULL THEN 'source is not registered' WHEN e.source_id IS NULL THEN 'source gave no event' END AS reason
FROM s FULL JOIN e ON e.source_id = s.source_id
""")
def edition_counts(spark: SparkSession, sf: str) -> DataFrame:
    """One parser's source is not registered, and one registered source has no parser."""
    registered = spark.createDataFrame([(s,) for s in [*EDITION_ORDER[:2], "retired"]], "source_id string")
    found = editions.source_counts(edition_events(spark, sf), registered)
    return found.withColumn("earliest", F.col("earliest").cast("string")).withColumn("latest", F.col("latest").cast("string"))

"""Geography, governing-body and coverage queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyroom.operators import coverage, hierarchy
from tallyroom.plans.registry import query, sql_cents, table

# Region, nation and customer as three levels whose codes nest by prefix.
GEO_LEVELS = {1: "region", 3: "division", 12: "place"}
GEO_PARENTS = {3: 1, 12: 3}
SQL_GEO = """
n AS (SELECT n_nationkey, n_regionkey, CAST(n_regionkey + 1 AS VARCHAR) || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS ncode FROM nation),
g AS (
  SELECT CAST(r_regionkey + 1 AS VARCHAR) AS code, 'region' AS level, CAST(NULL AS VARCHAR) AS parent_code, CAST(NULL AS BIGINT) AS place FROM region
  UNION ALL SELECT ncode, 'division', left(ncode, 1), NULL FROM n
  UNION ALL SELECT ncode || lpad(CAST(c_custkey AS VARCHAR), 9, '0'), 'place', ncode, c_custkey FROM customer JOIN n ON n_nationkey = c_nationkey
)"""


def nation_codes(spark: SparkSession, sf: str) -> DataFrame:
    code = F.concat((F.col("n_regionkey") + 1).cast("string"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0"))
    return table(spark, sf, "nation").select("n_nationkey", "n_regionkey", code.alias("ncode"))


def geography(spark: SparkSession, sf: str) -> DataFrame:
    nations = nation_codes(spark, sf)
    none = F.lit(None).cast("bigint").alias("place")
    places = table(spark, sf, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.concat("ncode", F.lpad(F.col("c_custkey").cast("string"), 9, "0")).alias("code"), F.col("c_custkey").alias("place")
    )
    codes = (
        table(spark, sf, "region").select((F.col("r_regionkey") + 1).cast("string").alias("code"), none)
        .unionByName(nations.select(F.col("ncode").alias("code"), none))
        .unionByName(places)
    )
    return hierarchy.build_levels(codes, "code", GEO_LEVELS, GEO_PARENTS)


@query("hierarchy_build", f"WITH {SQL_GEO} SELECT code, level, parent_code FROM g")
def hierarchy_build(spark: SparkSession, sf: str) -> DataFrame:
    return geography(spark, sf).select("code", "level", "parent_code")


@query("hierarchy_check", f"""
WITH {SQL_GEO},
h AS (
  SELECT g.code, g.level, CASE WHEN g.level <> 'place' THEN g.parent_code WHEN c_acctbal < -500 THEN NULL WHEN c_acctbal < 0 THEN left(g.code, 1)
    WHEN c_acctbal > 9900 THEN '999' WHEN c_acctbal > 9000 THEN coalesce(b.parent_code, g.parent_code) ELSE g.parent_code END AS parent_code
  FROM g LEFT JOIN customer ON c_custkey = g.place LEFT JOIN g b ON b.place = g.place - 1
)
SELECT h.code, h.level, h.parent_code, CASE WHEN h.level = 'region' THEN NULL WHEN h.parent_code IS NULL THEN 'parent is required' WHEN p.code IS NULL THEN 'parent is absent'
  WHEN p.level <> CASE h.level WHEN 'place' THEN 'division' ELSE 'region' END THEN 'parent has the wrong level'
  WHEN h.parent_code <> left(h.code, CASE h.level WHEN 'place' THEN 3 ELSE 1 END) THEN 'parent code is not the prefix' END AS reason
FROM h LEFT JOIN g p ON p.code = h.parent_code
""")
def hierarchy_check(spark: SparkSession, sf: str) -> DataFrame:
    balances = table(spark, sf, "customer").select(F.col("c_custkey").alias("place"), "c_acctbal")
    bal = F.col("c_acctbal")
    built = geography(spark, sf)
    # Some places name the parent of the place before them.
    before = built.filter("place IS NOT NULL").select((F.col("place") + 1).alias("place"), F.col("parent_code").alias("other"))
    nodes = built.join(balances, "place", "left").join(before, "place", "left").select(
        "code", "level",
        F.when(F.col("level") != "place", F.col("parent_code")).when(bal < -500, None).when(bal < 0, F.substring("code", 1, 1))
        .when(bal > 9900, "999").when(bal > 9000, F.coalesce("other", "parent_code")).otherwise(F.col("parent_code")).alias("parent_code"),
    )
    return hierarchy.hierarchy_verdicts(nodes, {"division": "region", "place": "division"}, {"division": 1, "place": 3})


@query("crosswalk_exact", """
WITH b AS (SELECT c_custkey AS body, m.n_regionkey AS province, unnest([c_nationkey, c_nationkey + 3]) AS geography FROM customer JOIN nation m ON m.n_nationkey = c_nationkey)
SELECT body, geography, CASE WHEN n_nationkey IS NULL THEN 'unknown' WHEN n_regionkey <> province THEN 'other-province' ELSE 'ok' END AS status
FROM b LEFT JOIN nation ON n_nationkey = geography
""")
def crosswalk_exact(spark: SparkSession, sf: str) -> DataFrame:
    nation = table(spark, sf, "nation")
    home = nation.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").alias("province"))
    bodies = table(spark, sf, "customer").join(home, "c_nationkey").select(
        F.col("c_custkey").alias("body"), "province", F.array("c_nationkey", F.col("c_nationkey") + 3).alias("geography_ids")
    )
    return hierarchy.body_geographies(bodies, nation.select(F.col("n_nationkey").alias("geography"), F.col("n_regionkey").alias("geo_province")))


@query("parent_rules", """
WITH b AS (
  SELECT c_custkey AS body, n_regionkey AS province, CASE c_mktsegment WHEN 'BUILDING' THEN 'upper-tier' WHEN 'MACHINERY' THEN 'single-tier' ELSE 'lower-tier' END AS tier,
    CASE WHEN c_mktsegment = 'BUILDING' AND c_acctbal > 0 THEN 'regional-government' ELSE 'municipal-government' END AS body_type,
    CASE WHEN c_mktsegment NOT IN ('BUILDING', 'MACHINERY') AND c_acctbal > 9500 THEN c_custkey + 10000000
         WHEN c_mktsegment NOT IN ('BUILDING', 'MACHINERY') AND c_acctbal >= -500 THEN c_custkey // 2
         WHEN c_mktsegment = 'MACHINERY' AND c_acctbal > 9000 THEN 0 END AS parent
  FROM customer JOIN nation ON n_nationkey = c_nationkey
)
SELECT b.body, b.parent, CASE WHEN b.tier = 'lower-tier' AND b.parent IS NULL THEN 'lower tier requires a parent'
  WHEN b.tier <> 'lower-tier' AND b.parent IS NOT NULL THEN 'only a lower tier has parents'
  WHEN b.parent IS NOT NULL AND p.body IS NULL THEN 'unknown parent' WHEN p.province <> b.province THEN 'parent is in another province'
  WHEN b.parent IS NOT NULL AND NOT (p.body_type = 'regional-government' AND p.tier = 'upper-tier') THEN 'parent is not an upper-tier regional body' END AS reason
FROM b LEFT JOIN b p ON p.body = b.parent
""")
def parent_rules(spark: SparkSession, sf: str) -> DataFrame:
    nation = table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").alias("province"))
    seg, bal = F.col("c_mktsegment"), F.col("c_acctbal")
    lower = ~seg.isin("BUILDING", "MACHINERY")
    parent = (
        F.when(lower & (bal > 9500), F.col("c_custkey") + 10000000).when(lower & (bal >= -500), F.expr("c_custkey div 2"))
        .when((seg == "MACHINERY") & (bal > 9000), F.lit(0).cast("bigint"))
    )
    bodies = table(spark, sf, "customer").join(nation, "c_nationkey").select(
        F.col("c_custkey").alias("body"), "province",
        F.when((seg == "BUILDING") & (bal > 0), "regional-government").otherwise("municipal-government").alias("body_type"),
        F.when(seg == "BUILDING", "upper-tier").when(seg == "MACHINERY", "single-tier").otherwise("lower-tier").alias("tier"),
        F.array_compact(F.array(parent)).alias("parent_ids"),
    )
    return hierarchy.parent_verdicts(bodies)


@query("ancestor_contains", f"""
WITH {SQL_GEO},
h AS (SELECT s_suppkey AS parent, CASE WHEN s_acctbal < 3000 THEN left(ncode, 1) ELSE ncode END AS geography FROM supplier JOIN n ON n_nationkey = s_nationkey),
c AS (SELECT place AS body, place % 100 AS parent, code AS geography FROM g WHERE level = 'place')
SELECT body, c.parent, c.geography, bool_or(h.parent IS NOT NULL) AS contained
FROM c LEFT JOIN h ON h.parent = c.parent AND h.geography IN (c.geography, left(c.geography, 3), left(c.geography, 1)) GROUP BY 1, 2, 3
""")
def ancestor_contains(spark: SparkSession, sf: str) -> DataFrame:
    nodes = geography(spark, sf)
    nations = nation_codes(spark, sf)
    governed = table(spark, sf, "supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_suppkey").alias("parent"), F.when(F.col("s_acctbal") < 3000, F.substring("ncode", 1, 1)).otherwise(F.col("ncode")).alias("geography")
    )
    claims = nodes.filter("level = 'place'").select(F.col("place").alias("body"), (F.col("place") % 100).alias("parent"), F.col("code").alias("geography"))
    return hierarchy.contained(claims, governed, hierarchy.ancestor_chains(nodes.select("code", "parent_code")))


@query("provenance_join", """
WITH s AS (SELECT c_custkey AS source_id, c_nationkey % 2 AS adapter, n_regionkey AS jurisdiction, c_mktsegment AS licence FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_acctbal > -900),
k AS (SELECT c_custkey AS source_id, CASE WHEN c_acctbal > 9800 THEN 9 ELSE c_nationkey % 2 END AS adapter FROM customer WHERE c_mktsegment <> 'MACHINERY')
SELECT o_orderkey AS record, CASE WHEN s.source_id IS NULL THEN 'no snapshot' WHEN k.source_id IS NULL THEN 'source is not in the catalog'
  WHEN s.adapter <> k.adapter THEN 'snapshot and catalog adapters differ' WHEN s.adapter <> o_orderkey % 2 THEN 'record and snapshot adapters differ'
  WHEN s.licence = 'FURNITURE' THEN 'licence is not approved' WHEN s.jurisdiction <> 0 AND s.jurisdiction <> o_orderkey % 5 THEN 'source belongs to another jurisdiction' END AS reason
FROM orders LEFT JOIN s ON s.source_id = o_custkey LEFT JOIN k ON k.source_id = o_custkey
""")
def provenance_join(spark: SparkSession, sf: str) -> DataFrame:
    nation = table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").alias("jurisdiction"))
    customers = table(spark, sf, "customer").join(nation, "c_nationkey").withColumnRenamed("c_custkey", "source_id")
    adapter = F.col("c_nationkey") % 2
    snapshots = customers.filter("c_acctbal > -900").select("source_id", adapter.alias("adapter"), "jurisdiction", (F.col("c_mktsegment") != "FURNITURE").alias("approved"))
    catalog = customers.filter("c_mktsegment <> 'MACHINERY'").select("source_id", F.when(F.col("c_acctbal") > 9800, 9).otherwise(adapter).alias("adapter"))
    records = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("record"), F.col("o_custkey").alias("source_id"),
        (F.col("o_orderkey") % 2).alias("adapter"), (F.col("o_orderkey") % 5).alias("jurisdiction"),
    )
    return coverage.provenance_verdicts(records, snapshots, catalog, national=0)


@query("coverage_counts", """
SELECT o_orderpriority AS tier, o_orderstatus AS status, CAST(year(o_orderdate) AS INTEGER) AS yr, count(*) AS records, CAST(max(CAST(o_orderdate AS DATE)) AS VARCHAR) AS newest
FROM orders GROUP BY GROUPING SETS ((o_orderpriority), (o_orderstatus), (CAST(year(o_orderdate) AS INTEGER)), (o_orderpriority, o_orderstatus), ())
""")
def coverage_counts(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("tier"), F.col("o_orderstatus").alias("status"), F.year("o_orderdate").alias("yr"), F.col("o_orderdate").cast("date").alias("d")
    )
    return coverage.counts_by(rows, [["tier"], ["status"], ["yr"], ["tier", "status"], []], "d").withColumn("newest", F.col("newest").cast("string"))


@query("coverage_status", """
WITH l AS (SELECT o_custkey AS code, o_orderpriority AS layer, CASE WHEN bool_and(o_orderstatus = 'F') THEN 'complete' WHEN bool_or(o_orderstatus = 'F') THEN 'partial' ELSE 'planned' END AS st FROM orders GROUP BY 1, 2)
SELECT code, count(*) AS layers, CASE WHEN bool_and(st = 'complete') THEN 'complete' WHEN bool_or(layer IN ('1-URGENT', '2-HIGH') AND st <> 'planned') THEN 'partial' ELSE 'planned' END AS status FROM l GROUP BY 1
""")
def coverage_status(spark: SparkSession, sf: str) -> DataFrame:
    final = F.col("o_orderstatus") == "F"
    layers = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("code"), F.col("o_orderpriority").alias("layer")).agg(
        F.when(F.bool_and(final), "complete").when(F.bool_or(final), "partial").otherwise("planned").alias("layer_status")
    )
    return hierarchy.coverage_status(layers, "code", "layer", "layer_status", ["1-URGENT", "2-HIGH"])


@query("three_way_totals", """
WITH f AS (SELECT c_nationkey AS code, count(*) AS official FROM customer GROUP BY 1),
e AS (SELECT c_nationkey AS code, count(DISTINCT o_custkey) AS emitted FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1),
a AS (SELECT c_nationkey AS code, count(*) AS active FROM customer WHERE c_acctbal > 0 GROUP BY 1)
SELECT code, official, coalesce(emitted, 0) AS emitted, coalesce(active, 0) AS active, official - coalesce(emitted, 0) AS unmatched,
  CASE WHEN official <> coalesce(emitted, 0) THEN 'official and emitted differ' WHEN coalesce(emitted, 0) <> coalesce(active, 0) THEN 'emitted and active differ' END AS reason
FROM f LEFT JOIN e USING (code) LEFT JOIN a USING (code)
""")
def three_way_totals(spark: SparkSession, sf: str) -> DataFrame:
    customers = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("code"), "c_acctbal")
    emitted = customers.join(table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct(), "c_custkey", "left_semi")
    return coverage.three_totals(customers, emitted, customers.filter("c_acctbal > 0"), "code")


@query("progress_report", f"""
WITH s AS (
  SELECT l_orderkey AS code, l_linenumber AS stage, min(CASE WHEN l_linestatus = 'F' THEN 'complete' WHEN l_returnflag = 'R' THEN 'in-progress' ELSE 'not-started' END) AS st FROM lineitem GROUP BY 1, 2
),
r AS (SELECT code, count(*) AS stages, count(CASE WHEN st = 'complete' THEN 1 END) AS completed, coalesce(string_agg(CASE WHEN st <> 'complete' THEN CAST(stage AS VARCHAR) END, ',' ORDER BY stage), '') AS blockers FROM s GROUP BY 1)
SELECT code, stages, completed, blockers, blockers = '' AS ready FROM r
UNION ALL SELECT NULL, CAST(sum(stages) AS BIGINT), CAST(sum(completed) AS BIGINT), CAST(count(CASE WHEN blockers = '' THEN 1 END) AS VARCHAR) || ' of ' || CAST(count(*) AS VARCHAR) || ' ready', bool_and(blockers = '') FROM r
""")
def progress_report(spark: SparkSession, sf: str) -> DataFrame:
    status = F.when(F.col("l_linestatus") == "F", "complete").when(F.col("l_returnflag") == "R", "in-progress").otherwise("not-started")
    stages = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("code"), F.col("l_linenumber").alias("stage")).agg(F.min(status).alias("status"))
    return coverage.progress_report(stages, "code", "stage")

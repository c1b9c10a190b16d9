"""Filing queries. Order lines stand for filing facts and orders for filers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyroom.functions import addresses, money
from tallyroom.operators import filings, gates
from tallyroom.operators.skew import in_tasks
from tallyroom.plans.registry import cents, query, sql_cents, table
from tallyroom.sources.filings import scan_facts

CENTS = sql_cents("l_extendedprice")

# One amount per (order, flag, line number): the address-level fact.
SQL_COMP = f"""
comp AS (
  SELECT l_orderkey AS code,
         CASE l_returnflag WHEN 'A' THEN '02' WHEN 'N' THEN '04' ELSE '19' END AS g,
         l_linenumber,
         CAST(sum(CASE WHEN l_returnflag = 'R' THEN -{CENTS} ELSE {CENTS} END) AS BIGINT) AS cents
  FROM lineitem GROUP BY 1, 2, 3
)"""
SQL_SPEND = f"""{SQL_COMP},
facts AS (
  SELECT code, g || lpad(CAST(l_linenumber AS VARCHAR), 2, '0') AS line, cents FROM comp
  UNION ALL
  SELECT c.code, g || '99', CAST(sum(cents) + max(CASE WHEN o_orderstatus = 'P' THEN 52 ELSE 0 END) AS BIGINT)
  FROM comp c JOIN orders ON o_orderkey = c.code
  WHERE g = '02' OR (g = '04' AND o_orderpriority <> '1-URGENT') OR (g = '19' AND o_orderpriority = '3-MEDIUM' AND c.code % 5 = 0) GROUP BY c.code, g
  UNION ALL
  SELECT c.code, '9910', CAST(sum(cents) + max(CASE o_orderpriority WHEN '5-LOW' THEN 52 WHEN '2-HIGH' THEN 51 ELSE 0 END) AS BIGINT)
  FROM comp c JOIN orders ON o_orderkey = c.code
  WHERE o_orderpriority <> '4-NOT SPECIFIED' GROUP BY c.code
)"""
SQL_GROUPS = f"""{SQL_SPEND},
groups AS (
  SELECT code, left(line, 2) || '99' AS grp,
         max(CASE WHEN line LIKE '%99' THEN cents END) AS printed,
         CAST(coalesce(sum(CASE WHEN line NOT LIKE '%99' THEN cents END), 0) AS BIGINT) AS parts,
         count(CASE WHEN line NOT LIKE '%99' THEN 1 END) AS n_parts
  FROM facts WHERE line <> '9910' GROUP BY 1, 2
)"""
SQL_TOTALS = f"""{SQL_GROUPS},
per_filer AS (
  SELECT code,
         coalesce(string_agg(CASE WHEN grp <> '1999' AND printed IS NULL THEN grp END, ',' ORDER BY grp), '') AS orphans,
         min(CASE WHEN abs(CASE WHEN grp = '1999' THEN 0 ELSE parts END - printed) > 51 THEN grp END) AS bad_group,
         CAST(coalesce(sum(printed), 0) AS BIGINT) AS functions_cents,
         CAST(coalesce(sum(CASE WHEN grp = '1999' THEN parts END), 0) AS BIGINT) AS other_cents,
         max(printed) AS largest_function,
         min(printed) AS smallest_function
  FROM groups GROUP BY code
),
totals AS (
  SELECT p.*, g.cents AS grand,
         CASE WHEN g.cents IS NULL THEN 'missing grand total'
              WHEN orphans <> '' THEN 'component lines without a published rollup'
              WHEN bad_group IS NOT NULL THEN 'components do not sum to their group'
              WHEN abs(functions_cents + other_cents - g.cents) > 51 THEN 'functions plus other do not sum to the grand total'
         END AS reason
  FROM per_filer p LEFT JOIN (SELECT code, cents FROM facts WHERE line = '9910') g ON g.code = p.code
)"""


def spend_facts(spark: SparkSession, sf: str) -> DataFrame:
    """Long spend facts from order lines: components, printed rollups and a
    printed grand total, with the defects a filing can have."""
    flag = F.col("l_returnflag")
    items = table(spark, sf, "lineitem")
    amounts = items.select(
        F.col("l_orderkey").alias("code"),
        F.when(flag == "A", "02").when(flag == "N", "04").otherwise("19").alias("g"),
        F.lpad(F.col("l_linenumber").cast("string"), 2, "0").alias("n"),
        F.when(flag == "R", -cents("l_extendedprice")).otherwise(cents("l_extendedprice")).alias("cents"),
    )
    # Components first; rollups and the grand total come from those few rows per filer.
    # All further steps are by filer and stay in the tasks that get its components here.
    added_up = in_tasks(amounts.groupBy("code", "g", "n").agg(F.sum("cents").alias("cents")), items.count(), "code")
    parts = added_up.groupBy("code").agg(
        F.collect_list(F.struct("g", "n", "cents")).alias("parts")
    )
    added = lambda p: F.aggregate(p, F.lit(0).cast("bigint"), lambda acc, x: acc + x["cents"])
    of = lambda g: F.filter("parts", lambda x: x["g"] == g)
    rows = lambda g, n, c, no_g, no_n: F.struct(
        g.alias("g"), n.alias("n"), c.alias("cents"), F.lit(no_g).alias("no_g"), F.lit(no_n).alias("no_n")
    )
    none = F.lit(None).cast("string")
    every = F.concat(
        F.transform("parts", lambda x: rows(x["g"], x["n"], x["cents"], 0, 0)),
        F.transform(F.array_distinct(F.transform("parts", lambda x: x["g"])), lambda g: rows(g, none, added(of(g)), 0, 1)),
        F.array(rows(none, none, added(F.col("parts")), 1, 1)),
    )
    sums = parts.select("code", F.explode(every).alias("_r")).select("code", "_r.*")
    filer = table(spark, sf, "orders").select(F.col("o_orderkey").alias("code"), "o_orderstatus", "o_orderpriority")
    priority = F.col("o_orderpriority")
    component, grand = F.col("no_n") == 0, F.col("no_g") == 1
    printed = (
        F.when(grand, priority != "4-NOT SPECIFIED")
        .when(component, True)
        .otherwise(
            (F.col("g") == "02") | ((F.col("g") == "04") & (priority != "1-URGENT"))
            | ((F.col("g") == "19") & (priority == "3-MEDIUM") & (F.col("code") % 5 == 0))
        )
    )
    drift = (
        F.when(component, 0)
        .when(grand, F.when(priority == "5-LOW", 52).when(priority == "2-HIGH", 51).otherwise(0))
        .otherwise(F.when(F.col("o_orderstatus") == "P", 52).otherwise(0))
    )
    line = F.when(grand, filings.GRAND_LINE).when(component, F.concat("g", "n")).otherwise(F.concat("g", F.lit("99")))
    return sums.join(filer, "code").filter(printed).select("code", line.alias("line"), (F.col("cents") + drift).cast("bigint").alias("cents"))


SQL_LEVY = f"""
base AS (
  SELECT l_orderkey AS code,
         CASE l_returnflag WHEN 'A' THEN '0010' WHEN 'N' THEN '0050' ELSE '0110' END AS class,
         CAST(sum({CENTS}) AS BIGINT) AS m04,
         CAST(sum({CENTS} * CAST(round(l_tax * 100) AS BIGINT)) // 100 AS BIGINT) AS m05
  FROM lineitem GROUP BY 1, 2
),
wide0 AS (
  SELECT code, class, m04, m05, m04 * 700 AS m16,
         (m04 * 700 * 153) // 100000 + CASE WHEN o_orderpriority = '1-URGENT' THEN (m04 * 7) // 100 ELSE 0 END AS m06,
         CASE WHEN o_orderstatus = 'P' AND class = '0050' THEN 100 ELSE 50 END AS drift,
         CASE WHEN o_orderpriority = '5-LOW' THEN 'UT' ELSE 'ST' END AS tier
  FROM base JOIN orders ON o_orderkey = code
),
wide AS (
  SELECT code, tier, class, CAST(m04 AS BIGINT) AS lower_or_single_tier, CAST(m05 AS BIGINT) AS upper_tier,
         CAST(m06 AS BIGINT) AS education, CAST(m16 AS BIGINT) AS assessment,
         CAST(m04 + m05 + m06 + drift AS BIGINT) AS total_taxes
  FROM wide0
),
levy AS (
  SELECT code, tier,
         max(CASE WHEN class = '0010' THEN assessment END) AS assessment,
         max(CASE WHEN class = '0010' THEN education END) AS education,
         max(CASE WHEN class = '0010' THEN total_taxes END) AS total_taxes,
         max(CASE WHEN class = '0010' THEN lower_or_single_tier END) AS lower_or_single_tier,
         max(CASE WHEN class = '0010' THEN upper_tier END) AS upper_tier,
         min(CASE WHEN abs(lower_or_single_tier + upper_tier + education - total_taxes) > 51 THEN class END) AS bad_class
  FROM wide GROUP BY 1, 2
),
judged AS (
  SELECT *, CAST(education AS DOUBLE) / CAST(assessment AS DOUBLE) AS education_rate,
         CASE WHEN tier = 'UT' THEN 'upper tier levies through its members'
              WHEN assessment IS NULL OR assessment <= 0 THEN 'no residential assessment'
              WHEN education IS NULL THEN 'no residential education levy'
              WHEN abs(CAST(education AS DOUBLE) / CAST(assessment AS DOUBLE) - CAST(0.00153 AS DOUBLE)) > CAST(0.00005 AS DOUBLE)
                THEN 'education rate outside the provincial constant'
              WHEN bad_class IS NOT NULL THEN 'class parts do not sum to the printed total'
         END AS reason
  FROM levy
)"""


def levy_facts(spark: SparkSession, sf: str) -> DataFrame:
    """Long levy facts (code, tier, class, measure, cents) from order lines."""
    flag = F.col("l_returnflag")
    items = table(spark, sf, "lineitem")
    base = (
        items
        .groupBy(
            F.col("l_orderkey").alias("code"),
            F.when(flag == "A", "0010").when(flag == "N", "0050").otherwise("0110").alias("class"),
        )
        .agg(
            F.sum(cents("l_extendedprice")).alias("m04"),
            F.sum(cents("l_extendedprice") * F.round(F.col("l_tax") * 100).cast("bigint")).alias("m05x"),
        )
    )
    filer = table(spark, sf, "orders").select(F.col("o_orderkey").alias("code"), "o_orderstatus", "o_orderpriority")
    # All further steps are by filer and stay in the tasks that get its classes here.
    wide = in_tasks(base, items.count(), "code").join(filer, "code").selectExpr(
        "code", "class", "m04", "m05x div 100 AS m05", "m04 * 700 AS m16",
        "(m04 * 700 * 153) div 100000 + IF(o_orderpriority = '1-URGENT', (m04 * 7) div 100, 0) AS m06",
        "IF(o_orderstatus = 'P' AND class = '0050', 100, 50) AS drift",
        "IF(o_orderpriority = '5-LOW', 'UT', 'ST') AS tier",
    )
    return wide.selectExpr(
        "code", "tier", "class",
        "stack(5, '04', m04, '05', m05, '06', m06, '16', m16, '03', m04 + m05 + m06 + drift) AS (measure, cents)",
    )


@query("group_identity", f"""
WITH lines AS (
  SELECT l_orderkey, CAST(sum({CENTS}) AS BIGINT) AS parts, count(*) AS n_parts FROM lineitem GROUP BY 1
), g AS (
  SELECT o_orderkey AS code, CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN {sql_cents('o_totalprice')} END AS printed,
         coalesce(parts, 0) AS parts, coalesce(n_parts, 0) AS n_parts
  FROM orders LEFT JOIN lines ON l_orderkey = o_orderkey
)
SELECT code, '0299' AS grp, printed, parts, n_parts, parts - printed AS difference,
       CASE WHEN printed IS NULL THEN 'no-rollup' WHEN abs(parts - printed) > 51 THEN 'parts-differ' END AS reason,
       CASE WHEN printed IS NOT NULL AND abs(parts - printed) <= 51 THEN 'accepted' ELSE 'refused' END AS status
FROM g
""")
def group_identity(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines as the components of a group, order totals as its rollup; some are not printed."""
    parts = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("code")).agg(
        F.sum(cents("l_extendedprice")).alias("parts"), F.count(F.lit(1)).alias("n_parts")
    )
    printed = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("code"), F.lit("0299").alias("grp"),
        F.when(F.col("o_orderpriority") != "4-NOT SPECIFIED", cents("o_totalprice")).alias("printed"),
    )
    none = F.lit(0).cast("bigint")
    groups = printed.join(parts, "code", "left").select(
        "code", "grp", "printed", F.coalesce("parts", none).alias("parts"), F.coalesce("n_parts", none).alias("n_parts")
    )
    return filings.group_identity(groups)


@query("grand_identity", f"""
WITH {SQL_TOTALS}
SELECT code, grand, functions_cents, other_cents, reason,
       CASE WHEN reason IS NULL THEN 'accepted' ELSE 'refused' END AS status FROM totals
""")
def grand_identity(spark: SparkSession, sf: str) -> DataFrame:
    return filings.spend_totals(spend_facts(spark, sf)).select(
        "code", "grand", "functions_cents", "other_cents", "reason", "status"
    )


@query("orphan_groups", f"""
WITH {SQL_GROUPS}
SELECT code, grp, parts, n_parts FROM groups WHERE grp <> '1999' AND printed IS NULL
""")
def orphan_groups(spark: SparkSession, sf: str) -> DataFrame:
    return filings.group_identity(filings.spend_groups(spend_facts(spark, sf))).filter("reason = 'no-rollup'").select(
        "code", "grp", "parts", "n_parts"
    )


@query("refusal_ladder", f"""
WITH {SQL_TOTALS}
SELECT code, orphans, bad_group, reason FROM totals WHERE reason IS NOT NULL
""")
def refusal_ladder(spark: SparkSession, sf: str) -> DataFrame:
    return filings.spend_totals(spend_facts(spark, sf)).filter("status = 'refused'").select(
        "code", "orphans", "bad_group", "reason"
    )


@query("refusal_summary", f"""
WITH {SQL_TOTALS}
SELECT CASE WHEN reason IS NULL THEN 'accepted' ELSE 'refused' END AS status, coalesce(reason, '') AS reason,
       count(*) AS records FROM totals GROUP BY 1, 2
""")
def refusal_summary(spark: SparkSession, sf: str) -> DataFrame:
    return gates.refusal_summary(filings.spend_totals(spend_facts(spark, sf)))


@query("share_policy", f"""
WITH {SQL_TOTALS},
ok AS (
  SELECT code, grand, functions_cents, other_cents,
         greatest(coalesce(largest_function, 0), other_cents) AS hi, least(coalesce(smallest_function, 0), other_cents) AS lo
  FROM totals WHERE reason IS NULL
),
p AS (
  SELECT code, grand, functions_cents, other_cents,
         CASE WHEN grand <= 0 THEN 'withheld-no-positive-total'
              WHEN hi * 2000000 >= grand * 2000001 THEN 'withheld-part-exceeds-whole'
              WHEN lo * 2000000 <= -grand THEN 'reported-with-negative-note'
              ELSE 'reported' END AS policy
  FROM ok
)
SELECT *, policy LIKE 'reported%' AS shares_reported FROM p
""")
def share_policy(spark: SparkSession, sf: str) -> DataFrame:
    return filings.share_policy(filings.spend_totals(spend_facts(spark, sf)))


@query("nest_tree", f"""
WITH {SQL_SPEND},
g AS (
  SELECT code, left(line, 2) || '99' AS grp,
         coalesce(max(CASE WHEN line LIKE '%99' AND line <> '1999' THEN cents END),
                  CAST(sum(CASE WHEN line NOT LIKE '%99' THEN cents END) AS BIGINT)) AS amount,
         coalesce(string_agg(CASE WHEN line NOT LIKE '%99' THEN line || '=' || CAST(cents AS VARCHAR) END, ';' ORDER BY line), '') AS comps
  FROM facts WHERE line <> '9910' GROUP BY 1, 2
)
SELECT code, count(*) AS n_groups,
       string_agg(grp || ':' || CAST(amount AS VARCHAR) || '[' || comps || ']', ' ' ORDER BY grp) AS tree
FROM g GROUP BY code
""")
def nest_tree(spark: SparkSession, sf: str) -> DataFrame:
    nested = filings.nest_spend(spend_facts(spark, sf))
    return nested.select(
        "code",
        F.size("functions").cast("bigint").alias("n_groups"),
        F.array_join(
            F.transform("functions", lambda f: F.concat(
                f["grp"], F.lit(":"), f["amount"].cast("string"), F.lit("["),
                F.array_join(F.transform(f["components"], lambda c: F.concat(c["line"], F.lit("="), c["cents"].cast("string"))), ";"),
                F.lit("]"),
            )), " ",
        ).alias("tree"),
    )


@query("measure_pivot", f"""
WITH {SQL_LEVY}
SELECT code, class, total_taxes, lower_or_single_tier, upper_tier, education, assessment FROM wide
""")
def measure_pivot(spark: SparkSession, sf: str) -> DataFrame:
    wide = filings.measure_pivot(levy_facts(spark, sf), ["code", "class"], filings.MEASURES)
    return wide.select("code", "class", "total_taxes", "lower_or_single_tier", "upper_tier", "education", "assessment")


@query("parts_identity", f"""
WITH {SQL_LEVY}
SELECT code, bad_class, CASE WHEN bad_class IS NULL THEN 'accepted' ELSE 'refused' END AS status FROM levy
""")
def parts_identity(spark: SparkSession, sf: str) -> DataFrame:
    return filings.levy_verdicts(levy_facts(spark, sf)).select(
        "code", "bad_class", F.when(F.col("bad_class").isNull(), "accepted").otherwise("refused").alias("status")
    )


@query("constant_gate", f"""
WITH {SQL_LEVY}
SELECT code, tier, assessment, education, education_rate, reason,
       CASE WHEN reason IS NULL THEN 'accepted' ELSE 'refused' END AS status FROM judged
""")
def constant_gate(spark: SparkSession, sf: str) -> DataFrame:
    return filings.levy_verdicts(levy_facts(spark, sf)).select(
        "code", "tier", "assessment", "education", "education_rate", "reason", "status"
    )


@query("shares", f"""
WITH {SQL_COMP},
t AS (SELECT code, CAST(sum(cents) AS BIGINT) AS total FROM comp GROUP BY 1),
g AS (SELECT code, g, CAST(sum(cents) AS BIGINT) AS cents FROM comp GROUP BY 1, 2)
SELECT g.code, g.g AS grp, g.cents, total,
       CASE WHEN total > 0 THEN CAST(g.cents AS DOUBLE) / CAST(total AS DOUBLE) END AS share
FROM g JOIN t ON t.code = g.code
""")
def shares(spark: SparkSession, sf: str) -> DataFrame:
    parts = spend_facts(spark, sf).filter(~F.col("line").endswith("99") & (F.col("line") != filings.GRAND_LINE))
    return money.shares_of_total(
        parts.groupBy("code", F.substring("line", 1, 2).alias("grp")).agg(F.sum("cents").alias("cents")), ["code"], "cents"
    )


@query("per_capita", f"""
WITH t AS (SELECT o_custkey AS code, CAST(sum({sql_cents('o_totalprice')}) AS BIGINT) AS cents, count(*) FILTER (o_orderstatus <> 'P') AS population FROM orders GROUP BY 1)
SELECT code, cents, population,
       CAST(CASE WHEN population > 0 THEN CAST((2 * cents + population) // (2 * population) AS DECIMAL(20,2)) / 100 END AS DECIMAL(20,2)) AS per_capita,
       CASE WHEN population < 10 THEN 'below-floor' ELSE 'ok' END AS floor_flag
FROM t
""")
def per_capita(spark: SparkSession, sf: str) -> DataFrame:
    totals = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("code")).agg(
        F.sum(cents("o_totalprice")).alias("cents"), F.count(F.when(F.col("o_orderstatus") != "P", F.lit(1))).alias("population")
    )
    return totals.select(
        "code", "cents", "population", filings.per_capita(F.col("cents"), F.col("population")).alias("per_capita"),
        F.when(F.col("population") < 10, "below-floor").otherwise("ok").alias("floor_flag"),
    )


@query("comparability_flags", """
SELECT c_custkey AS code, count(o_orderkey) AS population,
       'tier-scope-differs:' || c_mktsegment ||
         CASE WHEN count(o_orderkey) < 10 THEN ',population-below-declared-floor' ELSE '' END AS blockers
FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_mktsegment
""")
def comparability_flags(spark: SparkSession, sf: str) -> DataFrame:
    heads = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("population"))
    filers = table(spark, sf, "customer").select("c_custkey", "c_mktsegment").join(heads, "c_custkey", "left")
    population = F.coalesce("population", F.lit(0))
    return filers.select(
        F.col("c_custkey").alias("code"), population.alias("population"),
        F.array_join(filings.comparability(population, F.col("c_mktsegment"), floor=10), ",").alias("blockers"),
    )


@query("materiality_filter", f"""
WITH l AS (SELECT l_orderkey AS code, l_linenumber AS line, CAST(sum({CENTS}) AS BIGINT) AS cents FROM lineitem GROUP BY 1, 2),
t AS (SELECT code, CAST(sum(cents) AS BIGINT) AS levy FROM l GROUP BY 1)
SELECT l.code, line, cents, levy FROM l JOIN t ON t.code = l.code
WHERE CAST(cents AS DOUBLE) / CAST(levy AS DOUBLE) < CAST(0.0025 AS DOUBLE)
""")
def materiality_filter(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("code"), F.col("l_linenumber").alias("line")).agg(
        F.sum(cents("l_extendedprice")).alias("cents")
    )
    return filings.materiality(lines, "code").filter(~F.col("material")).select("code", "line", "cents", "levy")


@query("filing_fact_scan", f"""
SELECT lpad(CAST(l_orderkey AS VARCHAR), 10, '0') AS code,
       lpad(CAST(l_linenumber AS VARCHAR), 4, '0') AS line, {CENTS} AS cents
FROM lineitem WHERE l_returnflag = 'A' AND l_linestatus = 'F' AND round(l_discount * 100) <> 0 AND round(l_tax * 100) <> 0
""")
def filing_fact_scan(spark: SparkSession, sf: str) -> DataFrame:
    # The address carries flag and status; amounts arrive as text, some blank or junk.
    rows = table(spark, sf, "lineitem").select(
        F.lpad(F.col("l_orderkey").cast("string"), 10, "0").alias("ASSESSMENT_CODE"),
        F.concat(
            F.lit("slc.40"), F.when(F.col("l_returnflag") == "A", "X").otherwise(F.col("l_returnflag")), F.lit(".L"),
            F.lpad(F.col("l_linenumber").cast("string"), 4, "0"), F.lit(".C01."),
            F.when(F.col("l_linestatus") == "F", "07").otherwise("08"),
        ).alias("SLC"),
        F.when(F.round(F.col("l_discount") * 100) == 0, "  ")
        .when(F.round(F.col("l_tax") * 100) == 0, "x")
        .otherwise(F.concat(F.lit(" "), F.col("l_extendedprice").cast("decimal(20,2)").cast("string"))).alias("AMOUNT"),
    )
    return scan_facts(rows, filings.SPEND_ADDRESS).select(
        "code", addresses.line_of("slc").alias("line"), (F.col("amount") * 100).cast("bigint").alias("cents")
    )


@query("address_filter", f"""
SELECT l_returnflag AS schedule, l_linenumber AS line, count(*) AS facts, CAST(sum({CENTS}) AS BIGINT) AS cents
FROM lineitem WHERE l_returnflag IN ('A', 'N') AND l_linestatus = 'F' GROUP BY 1, 2
""")
def address_filter(spark: SparkSession, sf: str) -> DataFrame:
    # Address parts are columns, so the predicate reaches the scan.
    rows = table(spark, sf, "lineitem").filter(F.col("l_returnflag").isin("A", "N") & (F.col("l_linestatus") == "F"))
    return rows.groupBy(F.col("l_returnflag").alias("schedule"), F.col("l_linenumber").alias("line")).agg(
        F.count(F.lit(1)).alias("facts"), F.sum(cents("l_extendedprice")).alias("cents")
    )


@query("address_parse", """
SELECT '40' || l_returnflag AS schedule, lpad(CAST(l_linenumber AS VARCHAR), 4, '0') AS line,
       '01' AS col, CASE WHEN l_linestatus = 'F' THEN '07' ELSE '08' END AS measure,
       left(lpad(CAST(l_linenumber AS VARCHAR), 4, '0'), 2) || '99' AS rollup, count(*) AS facts
FROM lineitem GROUP BY 1, 2, 3, 4, 5
""")
def address_parse(spark: SparkSession, sf: str) -> DataFrame:
    slc = F.concat(
        F.lit("slc.40"), F.col("l_returnflag"), F.lit(".L"), F.lpad(F.col("l_linenumber").cast("string"), 4, "0"),
        F.lit(".C01."), F.when(F.col("l_linestatus") == "F", "07").otherwise("08"),
    )
    parsed = addresses.parse(table(spark, sf, "lineitem").select(slc.alias("slc")), "slc")
    return parsed.groupBy("schedule", "line", "col", "measure", "rollup").agg(F.count(F.lit(1)).alias("facts"))


@query("code_decode", """
SELECT o_orderstatus AS code, CASE o_orderstatus WHEN 'F' THEN 'final' WHEN 'O' THEN 'open' ELSE o_orderstatus END AS label,
       CASE WHEN o_orderstatus IN ('F', 'O') THEN 'accepted' ELSE 'refused' END AS status, count(*) AS records
FROM orders GROUP BY 1, 2, 3
""")
def code_decode(spark: SparkSession, sf: str) -> DataFrame:
    labels = {"F": "final", "O": "open"}
    code = F.col("o_orderstatus")
    return table(spark, sf, "orders").groupBy(
        code.alias("code"),
        addresses.decode(code, labels).alias("label"),
        F.when(addresses.decode(code, labels, keep_unknown=False).isNull(), "refused").otherwise("accepted").alias("status"),
    ).agg(F.count(F.lit(1)).alias("records"))


@query("receipt_index", f"""
WITH {SQL_TOTALS}
SELECT code, grand, functions_cents, other_cents,
       sha256(concat_ws(chr(31), CAST(code AS VARCHAR), CAST(grand AS VARCHAR), CAST(functions_cents AS VARCHAR), CAST(other_cents AS VARCHAR))) AS digest
FROM totals WHERE reason IS NULL
""")
def receipt_index(spark: SparkSession, sf: str) -> DataFrame:
    from tallyroom.sources.sinks import receipt_documents

    accepted = filings.spend_totals(spend_facts(spark, sf)).filter("status = 'accepted'")
    docs = receipt_documents(accepted, "code", ["grand", "functions_cents", "other_cents"])
    return docs.select("code", "grand", "functions_cents", "other_cents", "digest")

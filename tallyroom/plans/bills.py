"""Bills, allocation, history, windows and search queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyroom.functions import rates
from tallyroom.operators import bills, filings, hierarchy, history, search, skew
from tallyroom.plans.registry import cents, query, sql_cents, table

CENTS = sql_cents("l_extendedprice")
TOTAL = sql_cents("o_totalprice")

SQL_LINES = f"l AS (SELECT l_orderkey AS code, l_linenumber AS line, CAST(sum({CENTS}) AS BIGINT) AS cents FROM lineitem GROUP BY 1, 2)"


def order_lines(spark: SparkSession, sf: str) -> DataFrame:
    """One amount per order and line number."""
    return table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("code"), F.col("l_linenumber").alias("line")).agg(
        F.sum(cents("l_extendedprice")).alias("cents")
    )


SQL_RATES = """
r AS (
  SELECT o_orderkey AS code, CAST(round(o_totalprice * 100) AS BIGINT) AS a, 43743 + o_custkey % 7 AS c, 84183 AS g, 15300 AS e,
         43743 + o_custkey % 7 + 84183 + 15300 + CASE WHEN o_orderpriority = '5-LOW' THEN 1 ELSE 0 END AS t
  FROM orders
)"""


@query("bill_stack", f"""
WITH {SQL_RATES},
p AS (
  SELECT code, a, c, g, e, t, (a * c + 5000000) // 10000000 AS city, (a * g + 5000000) // 10000000 AS region,
         (a * e + 5000000) // 10000000 AS education, (a * t + 5000000) // 10000000 AS total FROM r
)
SELECT code, CAST(city AS BIGINT) AS city_cents, CAST(region AS BIGINT) AS region_cents, CAST(education AS BIGINT) AS education_cents,
       CAST(total AS BIGINT) AS combined_cents, CAST(total - city - region - education AS BIGINT) AS adjustment_cents,
       CASE WHEN c + g + e <> t THEN 'rates do not add to the total rate' END AS reason FROM p
""")
def bill_stack(spark: SparkSession, sf: str) -> DataFrame:
    city = 43743 + F.pmod(F.col("o_custkey"), F.lit(7))
    rate = lambda n: (n.cast("decimal(9,0)") / F.lit(10000000).cast("decimal(8,0)")).cast("decimal(18,12)")
    rows = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("code"),
        (cents("o_totalprice").cast("decimal(18,0)") / F.lit(100).cast("decimal(3,0)")).cast("decimal(20,2)").alias("assessment"),
        rate(city).alias("rate_city"), rate(F.lit(84183)).alias("rate_region"), rate(F.lit(15300)).alias("rate_education"),
        rate(city + 84183 + 15300 + F.when(F.col("o_orderpriority") == "5-LOW", 1).otherwise(0)).alias("rate_total"),
    )
    out = bills.bill_stack(rows, strategy="total")
    to_cents = lambda c: (F.col(c) * 100).cast("bigint").alias(f"{c}_cents")
    return out.select(
        "code", to_cents("city"), to_cents("region"), to_cents("education"), to_cents("combined"),
        (F.col("rounding_adjustment") * 100).cast("bigint").alias("adjustment_cents"), "reason",
    )


@query("prorata_allocation", f"""
WITH {SQL_LINES},
b AS (SELECT code, CAST(sum(cents) AS BIGINT) AS base FROM l GROUP BY 1),
o AS (SELECT o_orderkey AS code, {TOTAL} AS bill FROM orders),
a AS (
  SELECT l.code, CAST(l.line AS VARCHAR) AS line,
         CAST((2 * CAST(bill AS HUGEINT) * l.cents + base) // (2 * CAST(base AS HUGEINT)) AS BIGINT) AS cents
  FROM l JOIN b ON b.code = l.code JOIN o ON o.code = l.code
)
SELECT * FROM a
UNION ALL
SELECT a.code, 'rounding', CAST(any_value(bill) - sum(cents) AS BIGINT) FROM a JOIN o ON o.code = a.code GROUP BY a.code HAVING any_value(bill) <> sum(cents)
""")
def prorata_allocation(spark: SparkSession, sf: str) -> DataFrame:
    lines = order_lines(spark, sf).withColumnRenamed("cents", "weight")
    bill = table(spark, sf, "orders").select(F.col("o_orderkey").alias("code"), cents("o_totalprice").alias("bill_cents"))
    return bills.prorata(lines, bill, "code", "line")


@query("control_total", f"""
WITH s AS (SELECT l_orderkey AS code, CAST(sum({CENTS}) AS BIGINT) AS sum_cents FROM lineitem GROUP BY 1),
c AS (SELECT o_orderkey AS code, {TOTAL} AS control FROM orders WHERE o_orderpriority <> '5-LOW')
SELECT coalesce(s.code, c.code) AS code, sum_cents, control,
       CASE WHEN control IS NULL THEN 'no-control' WHEN sum_cents IS NULL THEN 'no-parts'
            WHEN abs(sum_cents - control) <= 1000000 THEN 'closed' ELSE 'open' END AS status
FROM s FULL JOIN c ON c.code = s.code
""")
def control_total(spark: SparkSession, sf: str) -> DataFrame:
    parts = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("code"), cents("l_extendedprice").alias("cents"))
    controls = table(spark, sf, "orders").filter("o_orderpriority <> '5-LOW'").select(F.col("o_orderkey").alias("code"), cents("o_totalprice").alias("control"))
    return bills.control_totals(parts, controls, "code", 1_000_000)


@query("schedule_reconcile", """
WITH l AS (
  SELECT l_orderkey AS schedule, l_linestatus AS area, l_linenumber AS line_no, min(l_returnflag) AS label,
         CAST(sum(round(l_quantity)) AS BIGINT) AS amount, min(l_suppkey % 3) AS net, 1 AS levy FROM lineitem GROUP BY 1, 2, 3
),
p AS (SELECT schedule, area, CAST(sum(amount) AS BIGINT) AS line_sum FROM l GROUP BY 1, 2),
q AS (SELECT schedule, line_no, min(label) <> max(label) OR min(net) <> max(net) AS drift, count(*) AS seen FROM l GROUP BY 1, 2),
s AS (SELECT schedule, bool_or(drift) AS drift, max(seen) AS hi, min(seen) AS lo FROM q GROUP BY 1),
a AS (
  SELECT p.schedule, p.area, p.line_sum, line_sum + CASE WHEN o_orderpriority = '1-URGENT' THEN 6 ELSE 5 END AS published_subtotal,
         CASE WHEN o_orderpriority = '5-LOW' THEN 1 ELSE 0 END AS bad
  FROM p JOIN orders ON o_orderkey = p.schedule
)
SELECT a.schedule, area, line_sum, published_subtotal, published_subtotal - line_sum AS rounding,
       CASE WHEN drift OR hi <> lo THEN 'labels or bases differ between areas'
            WHEN published_subtotal - line_sum > 5 THEN 'rounding exceeds the tolerance'
            WHEN bad = 1 THEN 'subtotal and offset do not give the printed total' END AS reason
FROM a JOIN s ON s.schedule = a.schedule
""")
def schedule_reconcile(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").groupBy(
        F.col("l_orderkey").alias("schedule"), F.col("l_linestatus").alias("area"), F.col("l_linenumber").alias("line_no")
    ).agg(
        F.min("l_returnflag").alias("label"), F.sum(F.round("l_quantity").cast("bigint")).alias("amount"),
        F.min(F.col("l_suppkey") % 3).alias("net"), F.lit(1).alias("levy"),
    )
    sums = lines.groupBy("schedule", "area").agg(F.sum("amount").alias("s"))
    p = F.col("o_orderpriority")
    areas = sums.join(table(spark, sf, "orders").select(F.col("o_orderkey").alias("schedule"), "o_orderpriority"), "schedule").select(
        "schedule", "area",
        (F.col("s") + F.when(p == "1-URGENT", 6).otherwise(5)).cast("bigint").alias("published_subtotal"),
        F.lit(-10).cast("bigint").alias("offset"),
        (F.col("s") + F.when(p == "1-URGENT", 6).otherwise(5) - 10 + F.when(p == "5-LOW", 1).otherwise(0)).cast("bigint").alias("after_offset"),
    )
    return bills.schedule_reconcile(lines, areas)


@query("peer_ratio", f"""
WITH v AS (SELECT c_custkey AS code, c_nationkey AS grp, {sql_cents('c_acctbal')} AS cents FROM customer),
s AS (SELECT grp, sum(cents) AS s, count(*) AS n FROM v GROUP BY 1)
SELECT code, v.grp, cents, CASE WHEN n > 1 THEN CAST(s - cents AS DOUBLE) / CAST(n - 1 AS DOUBLE) END AS peer_mean,
       CASE WHEN n > 1 AND s - cents <> 0 THEN CAST(cents AS DOUBLE) / (CAST(s - cents AS DOUBLE) / CAST(n - 1 AS DOUBLE)) END AS ratio
FROM v JOIN s ON s.grp = v.grp
""")
def peer_ratio(spark: SparkSession, sf: str) -> DataFrame:
    values = table(spark, sf, "customer").select(F.col("c_custkey").alias("code"), F.col("c_nationkey").alias("grp"), cents("c_acctbal").alias("cents"))
    return bills.peer_ratio(values, "grp", "code", "cents")


@query("role_cardinality", f"""
WITH b AS (
  SELECT l_orderkey AS code, CASE l_linenumber WHEN 1 THEN 'local' WHEN 2 THEN 'upper' WHEN 3 THEN 'education' ELSE 'special' END AS role,
         l_returnflag <> 'R' AS applies, {CENTS} AS cents FROM lineitem
),
r AS (
  SELECT code, role, count(CASE WHEN applies THEN 1 END) AS ch, count(CASE WHEN NOT applies THEN 1 END) AS wv, sum(CASE WHEN applies THEN cents END) AS cents FROM b GROUP BY 1, 2
),
p AS (
  SELECT code, min(CASE WHEN role <> 'special' AND ch > 1 THEN role END) AS repeated, coalesce(max(CASE WHEN role = 'local' THEN ch END), 0) AS loc,
         bool_or(ch > 0 AND wv > 0) AS clash, CAST(coalesce(sum(cents), 0) AS BIGINT) AS sum_cents FROM r GROUP BY 1
)
SELECT o_orderkey AS code, sum_cents, repeated,
  CASE WHEN repeated IS NOT NULL THEN 'a role is named more than once' WHEN coalesce(loc, 0) = 0 THEN 'no local body'
       WHEN clash THEN 'a role is both charged and not applicable'
       WHEN o_orderstatus = 'P' AND abs(sum_cents - {TOTAL}) > 5 THEN 'bodies do not sum to the printed total' END AS reason
FROM orders LEFT JOIN p ON code = o_orderkey
""")
def role_cardinality(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("l_linenumber")
    bodies = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("code"),
        F.when(n == 1, "local").when(n == 2, "upper").when(n == 3, "education").otherwise("special").alias("role"),
        (F.col("l_returnflag") != "R").alias("applies"), cents("l_extendedprice").alias("cents"),
    )
    printed = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("code"), F.when(F.col("o_orderstatus") == "P", cents("o_totalprice")).alias("total_cents")
    )
    return bills.role_verdicts(bodies, printed, "code")


@query("rate_units", """
WITH u AS (
  SELECT l_orderkey AS code, l_linenumber AS line, CAST(round(l_tax * 100) AS BIGINT) AS n,
         CASE l_returnflag WHEN 'A' THEN 'percent' WHEN 'N' THEN NULL ELSE 'mill' END AS declared,
         CASE WHEN l_linestatus = 'F' AND l_quantity < 10 THEN 'percent' WHEN l_linestatus = 'F' THEN NULL WHEN l_quantity > 49 THEN 'furlong' ELSE 'mill' END AS printed
  FROM lineitem
),
j AS (
  SELECT *, CASE WHEN printed = 'furlong' THEN 'unsupported unit' WHEN declared <> printed THEN 'declared and printed units conflict'
                 WHEN declared IS NULL AND printed IS NULL THEN 'ambiguous unmarked rate' END AS reason FROM u
)
SELECT reason, CASE WHEN reason IS NULL THEN coalesce(printed, declared) END AS unit, n, count(*) AS rows,
       CASE WHEN reason IS NULL THEN n * (CASE coalesce(printed, declared) WHEN 'percent' THEN 10 ELSE 1 END) END AS rate_per_hundred_thousand
FROM j GROUP BY ALL
""")
def rate_units(spark: SparkSession, sf: str) -> DataFrame:
    n = F.round(F.col("l_tax") * 100).cast("bigint")
    flag, final = F.col("l_returnflag"), F.col("l_linestatus") == "F"
    rows = table(spark, sf, "lineitem").select(
        n.alias("n"),
        F.concat(F.lit("0,0"), n.cast("string")).alias("raw"),  # a printed rate with a decimal comma
        F.when(flag == "A", "Percentage").when(flag == "R", " mills ").alias("declared"),
        F.when(final & (F.col("l_quantity") < 10), "per  cent").when(final, None)
        .when(F.col("l_quantity") > 49, "furlong").otherwise("mill").alias("printed"),
    )
    unit, reason = rates.resolve_unit(F.col("declared"), F.col("printed"))
    value = rates.rate_value(F.col("raw"), F.col("unit"))
    # 0,0n percent is n per hundred thousand times ten; 0,0n mill is n.
    return rows.withColumn("reason", reason).withColumn("unit", unit).groupBy("reason", "unit", "n").agg(
        F.count(F.lit(1)).alias("rows"), F.max((value * 100000).cast("bigint")).alias("rate_per_hundred_thousand")
    )


@query("rate_distribution", """
SELECT CAST(year(o_orderdate) AS BIGINT) AS year, median(CAST(round(o_totalprice * 100) AS BIGINT)) AS median_cents,
       count(*) AS filers, count(CASE WHEN abs(o_totalprice - 250000) <= 50000 THEN 1 END) AS within_wide,
       count(CASE WHEN abs(o_totalprice - 250000) <= 10000 THEN 1 END) AS within_narrow
FROM orders GROUP BY 1
""")
def rate_distribution(spark: SparkSession, sf: str) -> DataFrame:
    from tallyroom.operators.statistics import exact_median

    rows = table(spark, sf, "orders").select(
        F.year("o_orderdate").cast("bigint").alias("year"), cents("o_totalprice").alias("v"), "o_totalprice"
    )
    near = lambda w: F.count(F.when(F.abs(F.col("o_totalprice") - 250000) <= w, F.lit(1)))
    counts = rows.groupBy("year").agg(F.count(F.lit(1)).alias("filers"), near(50000).alias("within_wide"), near(10000).alias("within_narrow"))
    return exact_median(rows, ["year"], "v", "median_cents").join(counts, "year")


SQL_YEARS = "y AS (SELECT o_custkey AS code, CAST(year(o_orderdate) AS INTEGER) AS yr, max(o_orderpriority) AS name FROM orders GROUP BY 1, 2)"


def order_years(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").select(F.col("o_custkey").alias("code"), F.year("o_orderdate").alias("yr"), F.col("o_orderpriority").alias("name"))
    return history.years_of(rows, "code", "yr", ["name"])


@query("latest_with_fallback", f"""
WITH {SQL_YEARS},
n AS (SELECT code, max(yr) AS latest_year, max_by(name, yr) AS name FROM y GROUP BY 1)
SELECT c_custkey AS code, latest_year, name,
  CASE WHEN latest_year IS NULL THEN 'No 1995-2001 record in the locked files.' WHEN latest_year >= 2001 THEN NULL
       ELSE 'No ' || (SELECT string_agg(CAST(g AS VARCHAR), ' or ' ORDER BY g DESC) FROM range(1995, 2002) t(g) WHERE g > latest_year) || ' record in the locked files.' END AS fallback_reason
FROM customer LEFT JOIN n ON n.code = c_custkey
""")
def latest_with_fallback(spark: SparkSession, sf: str) -> DataFrame:
    directory = table(spark, sf, "customer").select(F.col("c_custkey").alias("code"))
    return history.latest_filing(directory, order_years(spark, sf), "code", "yr", ["name"], 2001, 1995)


@query("year_history", f"""
WITH {SQL_YEARS},
f AS (SELECT code, name, max(yr) AS seen FROM y GROUP BY 1, 2)
SELECT y.code, string_agg(CAST(yr AS VARCHAR), ',' ORDER BY yr DESC) AS years,
       any_value((SELECT string_agg(name, ',' ORDER BY seen DESC) FROM f WHERE f.code = y.code)) AS names
FROM y GROUP BY 1
""")
def year_history(spark: SparkSession, sf: str) -> DataFrame:
    return history.year_history(order_years(spark, sf), "code", "yr", "name").select(
        "code", F.array_join(F.transform("years", lambda y: y.cast("string")), ",").alias("years"), F.array_join("names", ",").alias("names")
    )


@query("requested_or_latest", f"""
WITH {SQL_YEARS},
p AS (SELECT code, coalesce(max(CASE WHEN yr = 1998 THEN yr END), max(yr)) AS yr, max(CASE WHEN yr = 1998 THEN 1 ELSE 0 END) = 1 AS as_requested FROM y GROUP BY 1)
SELECT p.code, p.yr, name, as_requested FROM p JOIN y ON y.code = p.code AND y.yr = p.yr
""")
def requested_or_latest(spark: SparkSession, sf: str) -> DataFrame:
    return history.requested_or_latest(order_years(spark, sf), "code", "yr", 1998, ["name"])


@query("topk_remainder", f"""
WITH {SQL_LINES},
r AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY cents DESC, line) AS rank, count(*) OVER (PARTITION BY code) AS n,
             sum(cents) OVER (PARTITION BY code) AS total FROM l WHERE cents > 0)
SELECT code, rank, CAST(line AS VARCHAR) AS line, cents AS amount FROM r WHERE rank <= 5
UNION ALL
SELECT code, 6, 'everything-else', CAST(any_value(total) - sum(CASE WHEN rank <= 5 THEN cents END) AS BIGINT) FROM r GROUP BY code
HAVING any_value(n) > 5 AND CAST(any_value(total) - sum(CASE WHEN rank <= 5 THEN cents END) AS DOUBLE) / CAST(any_value(total) AS DOUBLE) > 0.02
""")
def topk_remainder(spark: SparkSession, sf: str) -> DataFrame:
    return search.top_lines(order_lines(spark, sf), "code", "line", "cents")


@query("abs_rank", f"""
WITH a AS (SELECT l_orderkey AS code, l_linenumber AS line, CASE WHEN min(l_discount) > 0.09 THEN NULL ELSE
  CAST(sum(CASE WHEN l_returnflag = 'R' THEN -{CENTS} ELSE {CENTS} END) AS BIGINT) END AS cents FROM lineitem GROUP BY 1, 2)
SELECT code, line, cents, row_number() OVER (PARTITION BY code ORDER BY abs(cents) DESC NULLS LAST, line) AS rank FROM a
""")
def abs_rank(spark: SparkSession, sf: str) -> DataFrame:
    signed = F.when(F.col("l_returnflag") == "R", -cents("l_extendedprice")).otherwise(cents("l_extendedprice"))
    lines = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("code"), F.col("l_linenumber").alias("line")).agg(
        F.sum(signed).alias("s"), F.min("l_discount").alias("d")
    ).select("code", "line", F.when(F.col("d") <= F.lit(0.09), F.col("s")).alias("cents"))
    return search.rank_by_magnitude(lines, "code", "line", "cents")


@query("best_candidate", f"""
WITH c AS (SELECT l_orderkey AS code, l_linenumber AS pos, max(CASE l_returnflag WHEN 'A' THEN 2 WHEN 'N' THEN 1 ELSE 0 END) AS score,
  CAST(sum({CENTS}) AS BIGINT) AS cents FROM lineitem GROUP BY 1, 2)
SELECT code, pos, score, cents FROM c QUALIFY row_number() OVER (PARTITION BY code ORDER BY score DESC, pos) = 1
""")
def best_candidate(spark: SparkSession, sf: str) -> DataFrame:
    flag = F.col("l_returnflag")
    rows = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("code"), F.col("l_linenumber").alias("pos")).agg(
        F.max(F.when(flag == "A", 2).when(flag == "N", 1).otherwise(0)).alias("score"), F.sum(cents("l_extendedprice")).alias("cents")
    )
    return search.best_candidate(rows, "code", F.col("score"), "pos", ["pos", "score", "cents"])


@query("cumulative_share", f"""
WITH {SQL_LINES},
w AS (SELECT *, sum(cents) OVER (PARTITION BY code ORDER BY line) AS e, sum(cents) OVER (PARTITION BY code) AS t FROM l WHERE cents > 0)
SELECT code, line, cents, CAST(e - cents AS DOUBLE) / CAST(t AS DOUBLE) AS start_share, CAST(e AS DOUBLE) / CAST(t AS DOUBLE) AS end_share FROM w
""")
def cumulative_share(spark: SparkSession, sf: str) -> DataFrame:
    return search.cumulative_share(order_lines(spark, sf), "code", "line", "cents")


@query("sorted_check", """
WITH s AS (SELECT event_id, event_type, value, lag(value) OVER (PARTITION BY event_type ORDER BY event_id) AS prior FROM events)
SELECT event_type, count(*) AS rows, count(CASE WHEN value < prior THEN 1 END) AS descents FROM s GROUP BY 1
""")
def sorted_check(spark: SparkSession, sf: str) -> DataFrame:
    # Five event types: each owns a fifth of the rows, so the lag runs per range chunk.
    rows = skew.range_chunks(table(spark, sf, "events").select("event_type", "event_id", "value"), ["event_type"], [F.col("event_id")])
    with_prior = skew.previous_value(rows, ["event_type"], "_chunk", ["event_id"], "value", "prior")
    return with_prior.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("rows"), F.count(F.when(F.col("value") < F.col("prior"), F.lit(1))).alias("descents")
    )


@query("interval_union", """
WITH i AS (SELECT o_custkey AS code, o_orderkey AS id, datediff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) AS s,
                  datediff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) + 1 + CAST(floor(o_totalprice / 10000) AS BIGINT) AS e FROM orders),
m AS (SELECT *, max(e) OVER (PARTITION BY code ORDER BY s, e, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM i)
SELECT code, count(*) AS intervals, count(CASE WHEN pe IS NULL OR s > pe THEN 1 END) AS islands,
       CAST(sum(greatest(0, e - greatest(s, coalesce(pe, s)))) AS BIGINT) AS covered FROM m GROUP BY 1
""")
def interval_union(spark: SparkSession, sf: str) -> DataFrame:
    from tallyroom.operators.intervals import union_length

    start = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1990-01-01").cast("date")).cast("bigint")
    rows = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("code"), F.col("o_orderkey").alias("id"), start.alias("start"),
        (start + 1 + F.floor(F.col("o_totalprice") / 10000).cast("bigint")).alias("end"),
    )
    return union_length(rows, "code", chunk_width=90)


@query("budget_caps", """
WITH p AS (SELECT source, doc_id, octet_length(encode(text)) AS tokens FROM documents),
c AS (SELECT source, doc_id, tokens, (tokens * 3000000 + 999999) // 1000000 + (CAST(800 AS BIGINT) * 15000000 + 999999) // 1000000 AS cost FROM p),
r AS (SELECT *, CAST(sum(CASE WHEN tokens <= 8000 THEN cost ELSE 0 END) OVER (PARTITION BY source ORDER BY doc_id) AS BIGINT) AS spent FROM c)
SELECT source, doc_id, tokens, CAST(cost AS BIGINT) AS cost, spent,
       CASE WHEN tokens > 8000 THEN 'item-over-cap' WHEN spent > 1000000 THEN 'run-over-cap' ELSE 'queued' END AS status FROM r
""")
def budget_caps(spark: SparkSession, sf: str) -> DataFrame:
    from tallyroom.operators.intervals import budget

    rows = table(spark, sf, "documents").select("source", "doc_id", "text")
    return budget(
        rows, ["source"], "doc_id", F.octet_length("text").cast("bigint"), output_tokens=800,
        input_rate=3_000_000, output_rate=15_000_000, item_cap=8000, run_cap=1_000_000,
    )


@query("directory_order", """
SELECT row_number() OVER (ORDER BY lower(c_mktsegment), lower(c_name), c_custkey) AS position, c_custkey AS code, c_name AS name FROM customer
""")
def directory_order(spark: SparkSession, sf: str) -> DataFrame:
    from tallyroom.operators.ordering import positions

    rows = table(spark, sf, "customer").select(F.col("c_custkey").alias("code"), F.col("c_name").alias("name"), "c_mktsegment")
    return positions(rows, [F.lower("c_mktsegment"), F.lower("name"), F.col("code")]).select("position", "code", "name")


@query("mixed_sort", """
SELECT row_number() OVER (ORDER BY o_orderpriority, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE year(o_orderdate) END DESC NULLS LAST, o_orderkey) AS position,
       o_orderkey AS code FROM orders
""")
def mixed_sort(spark: SparkSession, sf: str) -> DataFrame:
    from tallyroom.operators.ordering import positions

    rows = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("code"), "o_orderpriority", F.when(F.col("o_orderstatus") != "P", F.year("o_orderdate")).alias("yr")
    )
    return positions(rows, [F.col("o_orderpriority"), F.desc_nulls_last("yr"), F.col("code")]).select("position", "code")


@query("place_search", """
WITH t AS (SELECT c_custkey AS code, c_name AS name, lower(c_name || ' ' || c_mktsegment || ' ' || n_name) AS body
           FROM customer JOIN nation ON n_nationkey = c_nationkey),
m AS (SELECT code, name FROM t WHERE contains(body, 'furn') AND contains(body, 'nation') AND contains(body, '17'))
SELECT code, name, (SELECT count(*) FROM m) AS total_matches, (SELECT count(*) FROM m) > 20 AS capped FROM m ORDER BY name, code LIMIT 20
""")
def place_search(spark: SparkSession, sf: str) -> DataFrame:
    nation = table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("area"))
    places = table(spark, sf, "customer").select(F.col("c_custkey").alias("code"), F.col("c_name").alias("name"), "c_mktsegment", "c_nationkey").join(nation, "c_nationkey")
    fields = [F.col("name"), F.col("c_mktsegment"), F.col("area")]
    return search.place_search(places, fields, "Furn  17, Nation", ["name", "code"]).select("code", "name", "total_matches", "capped")


@query("quota_topk", """
WITH m AS (SELECT r_name AS name, 'receipt' AS kind FROM region UNION ALL SELECT n_name, 'directory' FROM nation UNION ALL SELECT c_name, 'directory' FROM customer),
a AS (SELECT *, row_number() OVER (ORDER BY name) AS r FROM m WHERE kind = 'receipt'),
b AS (SELECT *, row_number() OVER (ORDER BY name) AS r FROM m WHERE kind <> 'receipt')
,t AS (SELECT (SELECT count(*) FROM a) AS x, (SELECT count(*) FROM b) AS y)
SELECT 'query' AS mode, name, kind, x AS first_total, y AS other_total, x + y > 20 AS capped FROM a, t WHERE r <= 20
UNION ALL SELECT 'query', name, kind, x, y, x + y > 20 FROM b, t WHERE r <= 20 - least(20, x)
UNION ALL SELECT 'browse', name, kind, x, 0, x > 20 FROM a, t WHERE r <= 20
""")
def quota_topk(spark: SparkSession, sf: str) -> DataFrame:
    kinds = [("region", "r_name", "receipt"), ("nation", "n_name", "directory"), ("customer", "c_name", "directory")]
    parts = [table(spark, sf, t).select(F.col(c).alias("name"), F.lit(k).alias("kind")) for t, c, k in kinds]
    records = parts[0].unionByName(parts[1]).unionByName(parts[2])
    shown = [search.quota(records, "kind", "receipt", ["name"], queried).withColumn("mode", F.lit(mode)) for mode, queried in (("query", True), ("browse", False))]
    return shown[0].unionByName(shown[1])

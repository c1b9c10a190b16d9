"""Bills, allocation, schedules and rate units: cents must be exact."""

from decimal import Decimal

import pytest
from helpers import rows
from pyspark.sql import functions as F

from tallyroom.functions import rates
from tallyroom.functions.money import round_to_quantum
from tallyroom.operators import bills

BILL = "assessment decimal(20,2), rate_city decimal(18,12), rate_region decimal(18,12), rate_education decimal(18,12), rate_total decimal(18,12)"


def bill(spark, assessment, *rate, **kw):
    return bills.bill_stack(spark.createDataFrame([(Decimal(assessment), *map(Decimal, rate))], BILL), **kw).collect()[0]


def test_published_example(spark):
    row = bill(spark, "405000", "0.00437426", "0.00841834", "0.00153", "0.0143226", strategy="total")
    assert row.reason is None and row.combined == Decimal("5800.65")
    by_part = bill(spark, "405000", "0.00437426", "0.00841834", "0.00153", "0.0143226", strategy="component")
    assert by_part.combined == by_part.city + by_part.region + by_part.education
    assert row.rounding_adjustment == row.combined - row.component_sum


def test_half_cent_up_and_even(spark):
    df = spark.createDataFrame([(Decimal("2.50"),), (Decimal("3.50"),), (Decimal("-2.50"),)], "x decimal(20,2)")
    up = df.select(round_to_quantum(F.col("x"), "1", "half-up").cast("int").alias("v"))
    even = df.select(round_to_quantum(F.col("x"), "1", "half-even").cast("int").alias("v"))
    assert rows(up, "v") == [(-3,), (3,), (4,)] and rows(even, "v") == [(-2,), (2,), (4,)]
    nickel = df.select(round_to_quantum(F.col("x") + F.lit("0.03").cast("decimal(3,2)"), "0.05").cast("double").alias("v"))
    assert rows(nickel, "v") == [(-2.45,), (2.55,), (3.55,)]


def test_rates_that_do_not_add_are_refused(spark):
    assert bill(spark, "100", "0.1", "0.1", "0.1", "0.3000000001").reason is None
    assert bill(spark, "100", "0.1", "0.1", "0.1", "0.3000000002").reason == "rates do not add to the total rate"
    assert bill(spark, "-1", "0.1", "0.1", "0.1", "0.3").reason == "assessment and rates must be non-negative"


def test_allocation_re_adds_with_a_residual_row(spark):
    lines = spark.createDataFrame([("a", "x", 1), ("a", "y", 1), ("a", "z", 1), ("b", "x", 1), ("b", "y", 1)], "code string, line string, weight long")
    amounts = spark.createDataFrame([("a", 100), ("b", 100)], "code string, bill_cents long")
    out = bills.prorata(lines, amounts, "code", "line")
    assert rows(out, "code", "line", "cents") == [
        ("a", "rounding", 1), ("a", "x", 33), ("a", "y", 33), ("a", "z", 33), ("b", "x", 50), ("b", "y", 50)]


def test_negative_weight_keeps_the_sum(spark):
    lines = spark.createDataFrame([("a", "x", 150), ("a", "y", -50)], "code string, line string, weight long")
    out = bills.prorata(lines, spark.createDataFrame([("a", 1001)], "code string, bill_cents long"), "code", "line")
    # 1501.5 and -500.5 round half up away from zero: 1502 - 501 = 1001
    assert rows(out, "line", "cents") == [("x", 1502), ("y", -501)]


def test_control_total(spark):
    parts = spark.createDataFrame([("a", 5), ("a", -2), ("b", 5), ("c", 1)], "code string, cents long")
    control = spark.createDataFrame([("a", 3), ("b", 4), ("d", 1)], "code string, control long")
    assert rows(bills.control_totals(parts, control, "code"), "code", "status") == [("a", "closed"), ("b", "open"), ("c", "no-control"), ("d", "no-parts")]


@pytest.mark.parametrize("subtotal,after,label,reason", [
    (35, 25, "Police", None),
    (36, 26, "Police", "rounding exceeds the tolerance"),
    (35, 24, "Police", "subtotal and offset do not give the printed total"),
    (35, 25, "Polise", "labels or bases differ between areas"),
])
def test_schedule(spark, subtotal, after, label, reason):
    lines = spark.createDataFrame(
        [("s", a, i, label if (a, i) == ("b", 1) else ("Police", "Roads")[i - 1], 15, 100, 50) for a in "ab" for i in (1, 2)],
        "schedule string, area string, line_no int, label string, amount long, net long, levy long")
    areas = spark.createDataFrame([("s", "a", subtotal, -10, after), ("s", "b", 30, -10, 20)], "schedule string, area string, published_subtotal long, offset long, after_offset long")
    got = dict(rows(bills.schedule_reconcile(lines, areas), "area", "reason"))
    assert got["a"] == reason


def test_line_missing_from_one_area(spark):
    lines = spark.createDataFrame([("s", "a", 1, "P", 5, 1, 1), ("s", "a", 2, "R", 5, 1, 1), ("s", "b", 1, "P", 5, 1, 1)],
                                  "schedule string, area string, line_no int, label string, amount long, net long, levy long")
    areas = spark.createDataFrame([("s", "a", 10, 0, 10), ("s", "b", 5, 0, 5)], "schedule string, area string, published_subtotal long, offset long, after_offset long")
    assert {r.reason for r in bills.schedule_reconcile(lines, areas).collect()} == {"labels or bases differ between areas"}


def test_roles(spark):
    bodies = spark.createDataFrame([
        ("ok", "local", True, 100), ("ok", "upper", True, 50), ("two", "local", True, 1), ("two", "local", True, 1),
        ("none", "upper", True, 1), ("both", "local", True, 1), ("both", "education", True, 1), ("both", "education", False, 0), ("off", "local", True, 100),
    ], "code string, role string, applies boolean, cents long")
    printed = spark.createDataFrame([("ok", 155), ("two", None), ("none", None), ("both", None), ("off", 106)], "code string, total_cents long")
    assert dict(rows(bills.role_verdicts(bodies, printed, "code"), "code", "reason")) == {
        "ok": None, "two": "a role is named more than once", "none": "no local body",
        "both": "a role is both charged and not applicable", "off": "bodies do not sum to the printed total"}


def test_peer_ratio_leaves_itself_out(spark, hot_keys):
    df = spark.createDataFrame([("g", 1, 10), ("g", 2, 20), ("g", 3, 30), ("h", 4, 7)], "grp string, id int, v long")
    out = bills.peer_ratio(df, "grp", "id", "v")
    assert rows(out, "id", "peer_mean", "ratio") == [(1, 25.0, 0.4), (2, 20.0, 1.0), (3, 15.0, 2.0), (4, None, None)]


@pytest.mark.parametrize("declared,printed,unit,reason", [
    ("percent", None, "percent", None), (None, "%", "percent", None), (None, "mills", "mill", None), ("Rate", None, "decimal", None),
    (None, None, None, "ambiguous unmarked rate"), ("mill", "%", None, "declared and printed units conflict"), ("furlong", None, None, "unsupported unit"),
])
def test_units(spark, declared, printed, unit, reason):
    df = spark.createDataFrame([(declared, printed)], "d string, p string")
    u, r = rates.resolve_unit(F.col("d"), F.col("p"))
    assert rows(df.select(u.alias("u"), r.alias("r")), "u", "r") == [(unit, reason)]


def test_rate_rows(spark):
    page = "\n".join([
        "Residential RT 0.437426% 0.841834% 0.153000% 1.432260%",
        "RT managed forest 0.1% 0.1% 0.1% 0.3%",
        "Residential farm 1 mill 2 mill 3 mill 7 mill",
        "RTEP 1,5% 1,0 1,0% 3,5%",
        "Commercial 1% 1% 1% 3%",
    ])
    got = rows(rates.rate_rows(spark.createDataFrame([(1, page)], "p int, t string"), "t"), "row_no", "label", "unit", "rate_total", "reason")
    assert got[0] == (0, "Residential RT", "percent", Decimal("0.014322600000"), None)
    assert got[1][1:3] == ("Residential farm", "mill") and got[1][4] == "rates do not add to the total"
    assert got[2][4] == "mixed marked and unmarked values"
    assert len(got) == 3

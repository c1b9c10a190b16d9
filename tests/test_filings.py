"""Spend and levy receipts: one clean case and one planted defect per rule."""

import pytest
from helpers import rows
from pyspark.sql import functions as F

from tallyroom.operators import filings, gates
from tallyroom.sources.filings import FILING_HEADERS, read_filing_csv, refused_amounts, scan_facts

SPEND = "code string, line string, cents long"


def cents(d):
    return {k: round(v * 100) for k, v in d.items()}


CLEAN = {"0299": 100, "0210": 60, "0220": 40, "9910": 100}


def verdict(spark, **filers):
    facts = [(code, line, c) for code, lines in filers.items() for line, c in cents(lines).items()]
    return filings.spend_totals(spark.createDataFrame(facts, SPEND))


def changed(base, **change):
    out = {**base, **{k[1:]: v for k, v in change.items()}}
    return {k: v for k, v in out.items() if v is not None}


@pytest.mark.parametrize("lines,reason", [
    (CLEAN, None),
    (changed(CLEAN, L0210=60.50), None),
    (changed(CLEAN, L0210=60.52), "components do not sum to their group"),
    (changed(CLEAN, L9910=None), "missing grand total"),
    (changed(CLEAN, L0410=5), "component lines without a published rollup"),
    (changed(CLEAN, L0499=0.50, L9910=100.50), None),
    (changed(CLEAN, L0499=0.60, L9910=100.60), "components do not sum to their group"),
    (changed(CLEAN, L9910=100.51), None),
    (changed(CLEAN, L9910=100.52), "functions plus other do not sum to the grand total"),
    (changed(CLEAN, L1910=-20, L9910=80), None),
])
def test_spend_ladder(spark, lines, reason):
    assert rows(verdict(spark, f1=lines), "code", "reason") == [("f1", reason)]


def test_accepted_and_refused_add_up(spark):
    judged = verdict(spark, a=CLEAN, b=changed(CLEAN, L9910=None), c=changed(CLEAN, L0410=5))
    assert rows(judged.groupBy("status").count(), "status", "count") == [("accepted", 1), ("refused", 2)]
    assert judged.filter("status = 'refused' AND reason IS NULL").count() == 0


def test_group_identity_names_the_group(spark):
    facts = spark.createDataFrame([("a", k, v) for k, v in cents(changed(CLEAN, L0410=5)).items()], SPEND)
    out = filings.group_identity(filings.spend_groups(facts))
    assert rows(out, "grp", "reason") == [("0299", None), ("0499", "no-rollup")]


@pytest.mark.parametrize("lines,policy", [
    (CLEAN, "reported"),
    ({"0299": 60, "0210": 60, "0499": 60, "0410": 60, "1910": -20, "9910": 100}, "reported-with-negative-note"),
    ({"0299": 150, "0210": 150, "1910": -100, "9910": 50}, "withheld-part-exceeds-whole"),
    ({"0299": 10, "0210": 10, "1910": -30, "9910": -20}, "withheld-no-positive-total"),
])
def test_share_policy(spark, lines, policy):
    assert rows(filings.share_policy(verdict(spark, f=lines)), "policy", "shares_reported") == [(policy, policy.startswith("reported"))]


def test_printed_rollup_of_the_other_group_is_refused(spark):
    lines = {**CLEAN, "1910": -20, "1999": -20, "9910": 80}
    assert rows(verdict(spark, f=lines), "status", "bad_group") == [("refused", "1999")]
    facts = spark.createDataFrame([("f", k, v) for k, v in cents(lines).items()], SPEND)
    assert ("1999", "parts-differ") in rows(filings.group_identity(filings.spend_groups(facts)), "grp", "reason")
    assert [(f.grp, f.amount) for f in filings.nest_spend(facts).first().functions] == [("0299", 10000), ("1999", -2000)]


def test_nested_tree_is_ordered(spark):
    facts = spark.createDataFrame([("a", k, v) for k, v in cents(CLEAN).items()], SPEND)
    row = filings.nest_spend(facts).collect()[0]
    assert [(f.grp, f.amount, [c.line for c in f.components]) for f in row.functions] == [("0299", 10000, ["0210", "0220"])]


def test_per_capita_and_floor(spark):
    df = spark.createDataFrame([(1, 10000, 4000), (2, 10000, 0), (3, 10000, None), (4, 10000, 5000)], "id int, cents long, pop long")
    out = df.select("id", filings.per_capita(F.col("cents"), F.col("pop")).cast("double").alias("pc"), filings.comparability(F.col("pop"), F.lit("lower-tier")).alias("b"))
    got = {r.id: (r.pc, r.b) for r in out.collect()}
    assert got[1] == (0.03, ["tier-scope-differs:lower-tier", "population-below-declared-floor"])
    assert got[2][0] is None and got[3] == (None, ["tier-scope-differs:lower-tier"])
    assert got[4] == (0.02, ["tier-scope-differs:lower-tier"])


BASE = {"16": 1_000_000_000, "02": 1_000_000_000, "04": 3_000_000, "05": 5_000_000, "06": 1_530_000, "03": 9_530_000}


def levy(spark, tier="ST", extra=(), **change):
    m = {**BASE, **{k[1:]: v for k, v in change.items()}}
    facts = [("f", tier, "0010", k, round(v * 100)) for k, v in m.items() if v is not None]
    facts += [("f", tier, c, k, round(v * 100)) for c, k, v in extra]
    return filings.levy_verdicts(spark.createDataFrame(facts, "code string, tier string, class string, measure string, cents long"))


@pytest.mark.parametrize("kwargs,reason", [
    ({}, None),
    ({"m06": 1_579_000, "m03": 9_579_000}, None),
    ({"m06": 1_581_000, "m03": 9_581_000}, "education rate outside the provincial constant"),
    ({"m03": 9_530_000.50}, None),
    ({"m03": 9_530_001.00}, "class parts do not sum to the printed total"),
    ({"tier": "UT"}, "upper tier levies through its members"),
    ({"m16": None}, "no residential assessment"),
    ({"m16": 0}, "no residential assessment"),
    ({"m06": None}, "no residential education levy"),
    ({"m03": None}, "no taxable property class"),
    ({"m03": None, "extra": [("0110", "03", 5), ("0110", "04", 5)]}, "residential class has no printed total"),
    ({"extra": [("0210", "03", 50), ("0210", "04", 48)]}, "class parts do not sum to the printed total"),
    ({"extra": [("7777", "03", 50), ("7777", "04", 1)]}, None),
])
def test_levy_ladder(spark, kwargs, reason):
    assert rows(levy(spark, **kwargs), "reason") == [(reason,)]


def test_levy_shares(spark):
    row = filings.levy_shares(levy(spark)).collect()[0]
    got = [float(row[c]) for c in ("lower_or_single_tier_share", "upper_tier_share", "education_share")]
    assert got == [0.314795, 0.524659, 0.160546]
    assert abs(row.education_rate - 0.00153) < 1e-12


def filing_line(**cells):
    base = {h: "" for h in FILING_HEADERS}
    base.update({"MARSYEAR": "2023", "ASSESSMENT_CODE": "0001", "SLC": "slc.40X.L0210.C01.07", "AMOUNT": "60"}, **cells)
    return ",".join(base[h] for h in FILING_HEADERS)


def test_csv_scan_skips_blank_and_junk_amounts(spark, tmp_path):
    path = tmp_path / "filing.csv"
    lines = [filing_line(), filing_line(AMOUNT=""), filing_line(AMOUNT="x"), filing_line(AMOUNT="nan"),
             filing_line(SLC="slc.40X.L0210.C02.07"), filing_line(ASSESSMENT_CODE="0002", AMOUNT=" 7.5 ")]
    path.write_text("\n".join([",".join(FILING_HEADERS), *lines]) + "\n")
    facts = scan_facts(read_filing_csv(spark, str(path)), filings.SPEND_ADDRESS)
    assert [(c, float(a)) for c, a in rows(facts, "code", "amount")] == [("0001", 60.0), ("0002", 7.5)]
    assert scan_facts(read_filing_csv(spark, str(path)), filings.SPEND_ADDRESS, ["0002"]).count() == 1
    only = spark.createDataFrame([("0001",)], "code string")
    assert scan_facts(read_filing_csv(spark, str(path)), filings.SPEND_ADDRESS, only).count() == 1


def test_amounts_keep_their_digits_or_are_refused(spark, tmp_path):
    path = tmp_path / "filing.csv"
    amounts = ["1234567890123456789", "1.005", "9" * 30, "0.12345678901", "x", ""]
    path.write_text("\n".join([",".join(FILING_HEADERS), *[filing_line(AMOUNT=a) for a in amounts]]) + "\n")
    read = read_filing_csv(spark, str(path))
    kept = [str(a).rstrip("0") for (a,) in rows(scan_facts(read, filings.SPEND_ADDRESS), "amount")]
    assert "1.005" in kept and "1234567890123456789." in kept
    assert rows(refused_amounts(read, filings.SPEND_ADDRESS), "printed", "reason") == [
        ("0.12345678901", "more decimals than can be kept"), ("9" * 30, "amount out of range")]


def test_changed_header_fails_the_read(spark, tmp_path):
    path = tmp_path / "filing.csv"
    path.write_text("\n".join([",".join(["YEAR", *FILING_HEADERS[1:]]), filing_line()]) + "\n")
    with pytest.raises(Exception, match="(?i)header|schema"):
        read_filing_csv(spark, str(path)).collect()


def test_repeated_address_is_quarantined(spark):
    df = spark.createDataFrame([("a", "0210", 1), ("a", "0210", 1), ("a", "0220", 2)], SPEND)
    kept, held = gates.single_valued(df, ["code", "line"], ["cents"])
    assert rows(kept, "line", "cents") == [("0220", 2)]
    assert rows(held, "line", "copies") == [("0210", 2)]


def test_identity_conflict(spark):
    df = spark.createDataFrame([("1", "A", "LT"), ("1", "A", "LT"), ("2", "B", "LT"), ("2", "B2", "LT")], "code string, name string, tier string")
    assert rows(gates.identity_conflicts(df, "code", ["name", "tier"]), "code", "identities", "rows") == [("2", 2, 2)]


def test_gate_treats_unknown_as_broken(spark):
    df = spark.createDataFrame([(1, 5), (2, None)], "id int, x int")
    accepted, refused = gates.gate(df, [("too big", F.col("x") > 7)])
    assert rows(accepted, "id") == [(1,)] and rows(refused, "id", "reason") == [(2, "too big")]


def test_materiality_floor(spark):
    df = spark.createDataFrame([("a", 1, 99_760), ("a", 2, 240)], "code string, line int, cents long")
    assert rows(filings.materiality(df, "code"), "line", "material") == [(1, True), (2, False)]


def test_severity_follows_the_strict_flag(spark):
    df = spark.createDataFrame([(True,), (False,)], "bad boolean")
    assert rows(df.select(gates.severity(F.col("bad"), True).alias("s")), "s") == [(None,), ("error",)]
    assert rows(df.select(gates.severity(F.col("bad"), False).alias("s")), "s") == [(None,), ("warning",)]


@pytest.mark.parametrize("name", [
    "grand_identity", "refusal_ladder", "share_policy", "refusal_summary", "receipt_index", "orphan_groups", "constant_gate", "footer_controls",
])
def test_filers_are_dealt_out_by_their_lines(spark, name):
    """A task gets so many lines of filers at most, whatever the number of shuffle partitions."""
    from tallyroom.plans import QUERIES

    spark.conf.set("spark.tallyroom.taskRows", "200")
    try:
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.tallyroom.taskRows")
    assert "REPARTITION_BY_NUM" in plan and "hashpartitioning(code#" in plan

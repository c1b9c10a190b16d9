"""Named figures, printed controls, layer cover, source counts and accepted forms."""

from pyspark.sql import functions as F

from helpers import rows
from tallyroom.functions import text
from tallyroom.operators import coverage, figures
from tallyroom.sources import editions, tables_on_pages
from tallyroom.sources.filings import scan_facts


def df(spark, schema, *data):
    return spark.createDataFrame(list(data), schema)


def test_named_figures_and_closure(spark):
    entry = "figure_id string, position int, amount decimal(10,2)"
    from decimal import Decimal as D

    facts = df(spark, entry, ("A", 1, D("9.00")), ("A", 0, D("10.00")), ("B", 0, None))
    derived = df(spark, entry, ("A", 0, D("1.00")), ("B", 0, D("2.00")), ("T", 0, D("10.50")), ("U", 0, D("10.51")))
    wanted = df(spark, "figure_id string", ("A",), ("B",), ("T",), ("U",), ("gone",), (None,))
    named = figures.named_figures(wanted, facts, derived)
    assert rows(named, "figure_id", "amount", "origin", "reason") == [
        (None, None, None, "no entry has this id"), ("A", D("10.00"), "fact", None), ("B", None, "fact", "the entry carries no amount"),
        ("T", D("10.50"), "derived", None), ("U", D("10.51"), "derived", None), ("gone", None, None, "no entry has this id")]
    parts = df(spark, "k string, figure_id string, sign int", ("edge", "T", 1), ("edge", "A", -1), ("off", "U", 1), ("off", "A", -1),
               ("empty", "T", 1), ("empty", "B", -1), ("missing", "gone", 1), ("unlisted", "Z", 1), ("unlisted", "A", -1))
    out = figures.closures(parts, named, "k")
    assert rows(out, "k", "difference", "refused_figures", "reason") == [
        ("edge", D("0.50"), 0, None), ("empty", None, 1, "a figure is refused"), ("missing", None, 1, "a figure is refused"),
        ("off", D("0.51"), 0, "the identity does not hold"), ("unlisted", None, 1, "a figure is refused")]
    none = df(spark, "figure_id string")
    assert figures.named_figures(none, facts, derived).count() == 0
    # a figure named twice is one figure
    twice = figures.named_figures(wanted.unionAll(wanted), facts, derived)
    assert twice.count() == 12 and rows(figures.closures(parts, twice, "k"), "k", "figures")[0] == ("edge", 2)


def test_shown_and_unallocated_lines(spark):
    nan, inf = float("nan"), float("inf")
    lines = df(spark, "id int, c string, gap string, label string, amount double",
               (1, "department", None, "Roads", 1.0), (2, "special_levy", None, "Roads", 1.0), (3, None, None, None, nan), (4, None, "x-Dept-Schedule", "Roads", inf),
               (5, "city_levy_UNALLOCATED", None, None, 0.0), (6, None, None, "Combined tax RATE", 2.0), (7, None, None, "Combined", None))
    c, gap, label = F.col("c"), F.col("gap"), F.col("label")
    out = lines.select("id", figures.is_shown(c, F.col("amount")).alias("s"), figures.is_unallocated(c, gap, label).alias("u"))
    assert rows(out, "id", "s", "u") == [(1, True, False), (2, False, False), (3, False, False), (4, False, True), (5, False, True), (6, True, True), (7, False, False)]


def test_layer_cover(spark):
    layers = df(spark, "jurisdiction string, layer string", ("a", "x"), ("a", "y"), ("b", "y"), ("c", "x"), ("c", "y"), ("c", "z"), ("d", "x"), ("d", "x"), ("d", "y"), ("e", None))
    out = coverage.layer_cover(layers, ["y", "x"])
    assert rows(out, "jurisdiction", "missing", "unexpected", "repeated", "reason") == [
        ("a", "", 0, 0, None), ("b", "x", 0, 0, "a required layer is missing"), ("c", "", 1, 0, "a layer is unexpected"),
        ("d", "", 0, 1, "a layer is repeated"), ("e", "x, y", 1, 0, "a required layer is missing")]


def test_control_verdicts(spark):
    areas = ["a", "b"]
    lines = df(spark, "id int, line string", (1, "Roads 1,000 $500 50% $10 50% $20"), (1, "Parks 1,000 $500 50% $1 50% $2"), (2, "Roads 1,000 $500 50% $10 50% $20"), (3, "no row"))
    feet = df(spark, "id int, line string", (1, "100% $11  100% $23"), (2, "100% $10  100% $20"), (2, "100% $10  100% $21"), (4, "100% $5  100% $6"))
    out = tables_on_pages.control_verdicts(tables_on_pages.service_rows(lines, "line", areas), tables_on_pages.footer_controls(feet, "line", areas), ["id"])
    assert rows(out, "id", "area", "total", "reason") == [
        (1, "a", 11, None), (1, "b", 22, "lines do not add to the control"), (2, "a", 10, None), (2, "b", 20, "two controls are printed"),
        (4, "a", None, "no line was read"), (4, "b", None, "no line was read")]


def test_source_counts(spark):
    events = df(spark, "source_id string, effective_date string", ("s", "2001-01-02"), ("s", "2000-01-01"), ("stray", "1999-01-01"))
    listed = df(spark, "source_id string, digest string", ("s", "d1"), ("none", "d2"))
    assert rows(editions.source_counts(events, listed), "source_id", "digest", "found", "earliest", "reason") == [
        ("none", "d2", 0, None, "source gave no event"), ("s", "d1", 2, "2000-01-01", None), ("stray", None, 1, "1999-01-01", "source is not registered")]


def test_forms_and_official_names(spark):
    values = df(spark, "v string", ("a" * 64,), ("A" * 64,), ("a" * 63,), ("on-12-a",), ("on--12",), ("-on",), ("",), (None,))
    found = {r.v: (r.d, r.i) for r in values.select("v", text.is_digest(F.col("v")).alias("d"), text.is_identifier(F.col("v")).alias("i")).collect()}
    assert found == {"a" * 64: (True, True), "A" * 64: (False, False), "a" * 63: (False, True), "on-12-a": (False, True), "on--12": (False, False),
                     "-on": (False, False), "": (False, False), None: (False, False)}
    d, k = text.official_name_parts(F.col("v"))
    names = df(spark, "v string", ("The Nation Municipality",), ("Norfolk County",), ("Other County",), ("Haldimand County",), ("Guelph, City of",), (None,))
    assert {r.v: (r.d, r.k) for r in names.select("v", d.alias("d"), k.alias("k")).collect()} == {
        "The Nation Municipality": ("The Nation", "Municipality"), "Norfolk County": ("Norfolk County", "County"), "Other County": (None, None),
        "Haldimand County": ("Haldimand County", "County"), "Guelph, City of": ("Guelph", "City"), None: (None, None)}


def test_filers_by_list_and_by_table(spark):
    read = df(spark, "ASSESSMENT_CODE string, SLC string, AMOUNT string", *[(c, "slc.40X.L0210.C01.07", "1") for c in ("1", "2", "3", " 2 ")])
    by_list = scan_facts(read, "^slc", ["2", "9"])
    by_table = scan_facts(read, "^slc", df(spark, "code string", ("2",), ("2",), ("9",)))
    assert rows(by_list, "code") == rows(by_table, "code") == [("2",), ("2",)]

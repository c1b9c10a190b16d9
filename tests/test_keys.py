"""Crosswalks, comparisons, hierarchy, history and search."""

import random

import pytest
from helpers import rows
from pyspark.sql import functions as F

from tallyroom.functions import text
from tallyroom.operators import compare, coverage, crosswalk, hierarchy, history, search, skew
from tallyroom.operators.intervals import union_length
from tallyroom.operators.ordering import positions
from tallyroom.operators.statistics import exact_median


def df(spark, schema, *data):
    return spark.createDataFrame(list(data), schema)


def test_context_of_every_field(spark):
    pack = spark.createDataFrame([(1, "a", "Old  Town", "7", "cad"), (2, "b", "North", "8", None), (3, "c", "", None, "cad")], "k int, slug string, name string, code string, currency string")
    ledger = spark.createDataFrame([(1, "a", "old town ", 7, "CAD"), (2, "x", "South", None, "CAD"), (3, "c", None, None, None)], "k int, slug string, name string, code int, currency string")
    receipt = spark.createDataFrame([(1, "a", "Old Town (Paris)"), (2, None, "Northern"), (4, "d", "x")], "k int, slug string, name string")
    rules = {
        "slug": crosswalk.Rule("slug", required=("pack", "ledger", "receipt")), "name": crosswalk.Rule("name", "text", ("pack", "ledger"), ("ledger",)),
        "shown": crosswalk.Rule("name", "prefix", ("pack", "receipt")), "code": crosswalk.Rule("code", artifacts=("pack", "ledger"), together=True),
        "currency": crosswalk.Rule("currency", "upper", ("pack", "ledger"), ("ledger",), anchored=True),
    }
    artifacts = {"pack": pack, "ledger": ledger, "receipt": receipt}
    for strict, gap in ((True, "error"), (False, "warning")):
        out = crosswalk.context_fields(artifacts, "k", rules, strict)
        got = {(r.k, r.rule): (r.status, r.missing, r.severity) for r in out.collect()}
        assert len(got) == out.count() == 20
        assert all(got[1, r] == ("agree", "", "none") for r in rules)
        assert got[2, "slug"] == ("disagree", "receipt", "error") and got[2, "name"] == ("disagree", "", "error")
        assert got[2, "shown"] == ("agree", "", "none") and got[2, "code"] == ("agree", "ledger", gap)
        assert got[2, "currency"] == ("disagree", "", "error") and got[3, "currency"] == ("agree", "ledger", gap)
        assert got[3, "slug"] == ("agree", "receipt", gap) and got[3, "name"] == ("silent", "ledger", gap) and got[3, "code"] == ("silent", "", "none")
        assert got[4, "slug"] == ("agree", "pack, ledger", gap)


def test_crosswalk(spark):
    directory = df(spark, "entry string, name_key string, tier string", ("A", "a", "L"), ("B", "b", "L"), ("C", "c", "L"), ("D", "d", "L"), ("E", "e", "L"), ("F", "a", "U"), ("G", "g", "L"))
    filers = df(spark, "code string, name_key string, tier string", ("1", "a", "L"), ("2", "b", "L"), ("3", "b", "L"), ("4", "x", "L"), ("5", "e", "L"))
    overrides = df(spark, "entry string, code string", ("C", "4"), ("D", "9"), ("G", "5"))
    assert rows(crosswalk.name_crosswalk(directory, filers, overrides), "entry", "code", "basis", "reason") == [
        ("A", "1", "name", None), ("B", "2", "name", "ambiguous name match"), ("C", "4", "override", None),
        ("D", "9", "override", "override points outside the filers"), ("E", "5", "name", "code maps to several entries"),
        ("F", None, "none", None), ("G", "5", "override", "code maps to several entries")]


@pytest.mark.parametrize("raw,key", [("Mattice-Val Côté", "matticevalcote"), ("Leeds & Grenville", "leedsandgrenville"), ("Straße", "strasse"), ("St. Joseph's", "stjosephs")])
def test_name_key(spark, raw, key):
    assert rows(df(spark, "n string", (raw,)).select(text.normalized_name(F.col("n")).alias("k")), "k") == [(key,)]


@pytest.mark.parametrize("name,slug", [("Wellesley Tp", "wellesley-on"), ("Waterloo R", "waterloo-on"), ("Tp", "muni-0001-on"), ("St. Joseph's / Hilton TP", "josephs-hilton-on")])
def test_slug(spark, name, slug):
    out = df(spark, "n string", (name,)).select(text.slug(F.col("n"), F.lit("0001"), "-on").alias("s"))
    assert rows(out, "s") == [(slug,)]


def test_name_parts(spark):
    d, k = text.filing_name_parts(F.col("n"))
    out = df(spark, "n string", ("Huron-Kinloss Tp",), ("Norfolk County",), ("Odd Zz",), ("One",)).select("n", d.alias("d"), k.alias("k"))
    assert rows(out, "n", "d", "k") == [("Huron-Kinloss Tp", "Huron-Kinloss", "Township"), ("Norfolk County", "Norfolk County", "County"), ("Odd Zz", None, None), ("One", None, None)]
    d, k = text.official_name_parts(F.col("n"))
    out = df(spark, "n string", ("Hamilton, City of",), ("Muskoka, District Municipality of",), ("Elsewhere",)).select("n", d.alias("d"), k.alias("k"))
    assert {r.n: (r.d, r.k) for r in out.collect()} == {"Hamilton, City of": ("Hamilton", "City"), "Muskoka, District Municipality of": ("Muskoka", "District Municipality"), "Elsewhere": (None, None)}


def test_exact_cover(spark):
    a = df(spark, "k int, x string, y string", (1, "a", None), (2, "b", "c"), (3, "d", "e"))
    b = df(spark, "k int, x string, y string", (1, "a", None), (2, "b", None), (4, "z", "z"))
    assert rows(compare.compare_sets(a, b, ["k"], ["x", "y"]), "k", "status", "differs") == [(1, "same", ""), (2, "changed", "y"), (3, "missing", ""), (4, "extra", "")]


def lock(*r):
    return ("s", *r)


@pytest.mark.parametrize("locked,seen,status,differences", [
    (("s", 10, "c", "m", 5, 4), ("s", 12, "d", "m", 5, 4), "verified", ""),
    (("s", 10, "c", "m", 5, 4), ("s", 10, "c", "n", 5, 4), "quarantined", "member_sha256"),
    (("s", 10, "c", "m", 5, 4), ("s", 10, "c", "m", 6, 4), "quarantined", "row_count"),
    (("s", 10, "c", None, 5, 4), ("s", 12, "d", None, 5, 4), "quarantined", "bytes,sha256"),
    (("s", 10, "c", None, 5, 4), ("s", 10, "c", "m", 5, 4), "verified", ""),
])
def test_lock_differences(spark, locked, seen, status, differences):
    schema = "id string, bytes long, sha256 string, member_sha256 string, row_count long, record_count long"
    assert rows(compare.lock_differences(df(spark, schema, locked), df(spark, schema, seen), "id"), "status", "differences") == [(status, differences)]


def test_undirected_edges(spark):
    e = df(spark, "a int, b int", (1, 2), (2, 1), (3, 1), (4, 4), (1, 2))
    assert rows(crosswalk.undirected_edges(e), "low", "high", "status") == [(1, 2, "mutual"), (1, 3, "one-way"), (4, 4, "self-edge")]


def test_request_cover(spark):
    requests = df(spark, "k string, required boolean", ("closed", True), ("gap", True), ("none", True), ("opt", False), ("overlap", True), ("reasoned", True), ("nogap", True))
    answers = df(spark, "k string, kind string, reason string", ("closed", "closing", ""), ("gap", "gap", "r"), ("overlap", "closing", ""), ("overlap", "gap", "r"),
                 ("reasoned", "non-closing", "r"), ("reasoned", "gap", "r"), ("nogap", "non-closing", "r"), ("stray", "gap", "r"))
    assert dict(rows(crosswalk.request_cover(requests, answers, "k"), "k", "reason")) == {
        "closed": None, "gap": None, "opt": None, "reasoned": None, "none": "required item has neither source nor gap",
        "overlap": "source and gap overlap without a stated reason", "nogap": "non-closing source without its gap", "stray": "not requested"}


GEO = [("3", "region", None), ("35", "province-territory", "3"), ("3518", "census-division", "35"), ("3518013", "census-subdivision", "3518")]


@pytest.mark.parametrize("row,reason", [
    (("3518014", "census-subdivision", None), "parent is required"),
    (("3518014", "census-subdivision", "9999"), "parent is absent"),
    (("3518014", "census-subdivision", "35"), "parent has the wrong level"),
    (("3519014", "census-subdivision", "3518"), "parent code is not the prefix"),
    (("4", "region", "3"), "root cannot have a parent"),
])
def test_hierarchy(spark, row, reason):
    built = hierarchy.build_levels(df(spark, "code string", *[(c,) for c, _, _ in GEO]), "code")
    assert rows(built, "code", "level", "parent_code") == sorted(GEO)
    nodes = df(spark, "code string, level string, parent_code string", *GEO, row)
    got = dict(rows(hierarchy.hierarchy_verdicts(nodes, hierarchy.PARENT_LEVEL, {l: hierarchy.PARENT_LENGTH[n] for n, l in hierarchy.LEVELS.items() if n > 1}), "code", "reason"))
    assert got.pop(row[0]) == reason and set(got.values()) == {None}


def test_stage_sequence(spark):
    s = df(spark, "k string, n int, status string",
           ("ok", 1, "complete"), ("ok", 2, "in-progress"), ("ok", 3, "not-started"), ("late", 1, "not-started"), ("late", 2, "complete"),
           ("two", 1, "blocked"), ("two", 2, "in-progress"), ("done", 1, "complete"))
    assert dict(rows(hierarchy.stage_verdicts(s, "k", "n"), "k", "reason")) == {
        "ok": None, "done": None, "late": "completed stage follows unfinished work", "two": "only the first unfinished stage may be active"}
    report = rows(coverage.progress_report(s, "k", "n"), "k", "completed", "blockers", "ready")
    assert (None, 3, "1 of 4 ready", False) in report and ("ok", 1, "2,3", False) in report


def test_coverage_status(spark):
    l = df(spark, "k string, layer string, status string", ("a", "x", "complete"), ("a", "y", "not-applicable"), ("b", "x", "partial"), ("b", "y", "planned"), ("c", "x", "planned"), ("c", "y", "complete"))
    assert rows(hierarchy.coverage_status(l, "k", "layer", "status", ["x"]), "k", "status") == [("a", "complete"), ("b", "partial"), ("c", "planned")]


def test_layer_evidence(spark):
    layers = df(spark, "jurisdiction string, layer string, status string, sources array<string>, expected int",
                ("a", "m", "complete", ["s"], 3), ("b", "m", "complete", ["s"], 2), ("c", "m", "partial", ["s"], None), ("d", "m", "partial", [], None),
                ("e", "m", "planned", None, None), ("f", "m", "complete", ["s"], None))
    observed = df(spark, "jurisdiction string, layer string, bodies long", ("a", "m", 3), ("b", "m", 3), ("d", "m", 1))
    assert dict(rows(coverage.layer_verdicts(layers, observed), "jurisdiction", "reason")) == {
        "a": None, "b": "complete coverage has another count", "c": "partial coverage requires a verified body",
        "d": "claimed coverage requires a locked source", "e": None, "f": "complete coverage requires an expected count"}


def test_write_once(spark):
    store = df(spark, "k string, d string", ("a", "1"), ("b", "1"))
    drop = df(spark, "k string, d string", ("a", "1"), ("a", "1"), ("b", "2"), ("c", "3"), ("e", "4"), ("e", "5"))
    assert rows(compare.write_once(store, drop, "k", "d"), "k", "action") == [("a", "no-op"), ("b", "conflict"), ("c", "insert"), ("e", "conflict")]


def test_history(spark):
    f = df(spark, "k string, y int, name string", ("a", 2025, "A"), ("a", 2024, "A old"), ("b", 2024, "B"), ("c", 2023, "C"), ("a", 2023, "A"))
    d = df(spark, "k string", ("a",), ("b",), ("c",), ("d",))
    assert rows(history.latest_filing(d, f, "k", "y", ["name"], 2025, 2023), "k", "latest_year", "fallback_reason") == [
        ("a", 2025, None), ("b", 2024, "No 2025 record in the locked files."), ("c", 2023, "No 2025 or 2024 record in the locked files."),
        ("d", None, "No 2025-2023 record in the locked files.".replace("2025-2023", "2023-2025"))]
    h = {r.k: (r.years, r.names) for r in history.year_history(f, "k", "y", "name").collect()}
    assert h["a"] == ([2025, 2024, 2023], ["A", "A old"])
    assert rows(history.requested_or_latest(f, "k", "y", 2024, ["name"]), "k", "y", "as_requested") == [("a", 2024, True), ("b", 2024, True), ("c", 2023, False)]


def places(spark):
    return df(spark, "id int, name string, area string", *[(i, f"Place {i:02d}", "Québec Nord" if i % 2 else "Waterloo") for i in range(50)], (99, "São Tomé Township", "Waterloo"))


@pytest.mark.parametrize("query,limit,shown,total,capped", [
    ("quebec NORD", None, 20, 25, True), ("township waterloo", None, 1, 1, False), ("tome", 5, 1, 1, False), ("", 50, 20, 51, True),
    ("waterloo", float("nan"), 20, 26, True), ("waterloo", -1, 0, 26, True), ("place 07", None, 1, 1, False),
])
def test_place_search(spark, query, limit, shown, total, capped):
    found = search.matches(places(spark), [F.col("name"), F.col("area")], query)
    assert found.count() == total
    out = search.place_search(places(spark), [F.col("name"), F.col("area")], query, ["id"], limit).collect()
    assert len(out) == shown and all(r.total_matches == total and r.capped is capped for r in out)


def test_quota(spark):
    r = df(spark, "id int, kind string", *[(i, "receipt") for i in range(15)], *[(100 + i, "directory") for i in range(15)])
    got = search.quota(r, "kind", "receipt", ["id"], True)
    assert dict(rows(got.groupBy("kind").count(), "kind", "count")) == {"receipt": 15, "directory": 5}
    assert search.quota(df(spark, "id int, kind string", *[(i, "receipt") for i in range(21)], (200, "directory")), "kind", "receipt", ["id"], True).count() == 20
    browse = search.quota(r, "kind", "receipt", ["id"], False)
    assert {k for (k,) in rows(browse, "kind")} == {"receipt"} and {(o, c) for o, c in rows(browse, "other_total", "capped")} == {(0, False)}


def test_top_lines(spark):
    lines = df(spark, "k string, line string, v long", *[("a", f"l{i}", 100) for i in range(7)], *[("b", f"l{i}", 1000) for i in range(5)], ("b", "l9", 1), ("c", "l1", -5), ("c", "l2", 5))
    out = rows(search.top_lines(lines, "k", "line", "v"), "k", "rank", "line", "amount")
    assert ("a", 6, "everything-else", 200) in out and sum(1 for r in out if r[0] == "a") == 6
    assert [r for r in out if r[0] == "b" and r[1] == 6] == [] and [r for r in out if r[0] == "c"] == [("c", 1, "l2", 5)]


def test_best_candidate_prefers_first_on_ties(spark):
    c = df(spark, "k string, pos int, score int, v string", ("a", 2, 2, "y"), ("a", 1, 2, "x"), ("a", 0, 1, "z"))
    assert rows(search.best_candidate(c, "k", F.col("score"), "pos", ["v", "pos"]), "v", "pos") == [("x", 1)]


def test_running_values_match_plain_python(spark):
    rng = random.Random(11)
    data = [(rng.choice("ab"), i, rng.randint(-50, 50)) for i in range(300)]
    base = df(spark, "k string, i int, v long", *data).withColumn("c", F.floor(F.col("i") / 17))
    sums = {(r.k, r.i): r.s for r in skew.running_sum(base, ["k"], "c", ["i"], "v", "s").collect()}
    tops = {(r.k, r.i): r.m for r in skew.previous_max(base, ["k"], "c", ["i"], "v", "m").collect()}
    lags = {(r.k, r.i): r.p for r in skew.previous_value(base, ["k"], "c", ["i"], "v", "p").collect()}
    for key in "ab":
        total, seen = 0, []
        for k, i, v in data:
            if k != key:
                continue
            total += v
            assert sums[k, i] == total
            assert tops[k, i] == (max(seen) if seen else None)
            assert lags[k, i] == (seen[-1] if seen else None)
            seen.append(v)


def test_interval_union(spark):
    i = df(spark, "k string, start long, end long", ("a", 0, 5), ("a", 3, 7), ("a", 7, 8), ("a", 10, 13), ("a", 10, 13), ("b", 4, 6))
    assert rows(union_length(i, "k", 4), "k", "intervals", "islands", "covered") == [("a", 5, 2, 11), ("b", 1, 1, 2)]


def test_one_key_with_equal_and_unknown_amounts_spreads(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # the table is tiny
    try:
        check_one_key_spreads(spark)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def check_one_key_spreads(spark):
    lines = [("k", i, [5, 5, 5, None, -5, 0, None][i % 7]) for i in range(700)] + [("k", 1, 5), ("k", 1, 5), ("j", 0, None)]
    rows_ = spark.createDataFrame(lines, "key string, line int, amount long")
    chunked = skew.range_chunks(rows_, ["key"], [F.desc_nulls_last(F.abs("amount")), F.asc("line")])
    sizes = [r["count"] for r in chunked.groupBy("_chunk").count().collect()]
    assert len(sizes) == 4 and max(sizes) < 300
    ranked = search.rank_by_magnitude(rows_, "key", "line", F.col("amount")).collect()
    order = sorted((r for r in ranked if r.key == "k"), key=lambda r: r["rank"])
    assert [r["rank"] for r in order] == list(range(1, 703))
    sizes_in_order = [None if r.amount is None else abs(r.amount) for r in order]
    known = [x for x in sizes_in_order if x is not None]
    assert known == sorted(known, reverse=True) and sizes_in_order[len(known):] == [None] * (len(order) - len(known))


def test_magnitude_chunks_fall_with_the_amount(spark):
    v = df(spark, "v long", *[(x,) for x in [-10**9, -7, -1, 0, 1, 2, 3, 50, 51, 10**6, 10**12]])
    chunks = [r.c for r in v.withColumn("c", skew.magnitude_chunk(F.col("v"))).orderBy(F.desc("v")).collect()]
    assert chunks == sorted(chunks)


def test_exact_median(spark):
    d = df(spark, "k string, v long", ("a", 1), ("a", 9), ("a", 9), ("a", 2), ("b", -4), ("b", 0), ("b", 100), ("c", None), ("d", 7))
    assert rows(exact_median(d, ["k"], "v", "m"), "k", "m") == [("a", 5.5), ("b", 0.0), ("d", 7.0)]


def test_positions_are_dense(spark):
    d = spark.range(1000).select((F.col("id") * 37 % 1000).alias("v"), "id")
    out = positions(d, [F.desc("v"), F.col("id")]).orderBy("position").collect()
    assert [r.position for r in out] == list(range(1, 1001)) and [r.v for r in out] == sorted((r.v for r in out), reverse=True)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_spread_join_equals_a_plain_join(spark, hot_keys, how):
    big = spark.range(200).select("id", F.when(F.col("id") < 120, 1).when(F.col("id") < 190, F.col("id") % 7).cast("int").alias("k"))
    small = df(spark, "k int, name string", *[(i, f"n{i}") for i in range(5)])
    plain = big.join(small, "k", how)
    spread = skew.spread_join(big, small, ["k"], how, spread_on=["id"], fan=8)
    assert rows(spread, *sorted(plain.columns)) == rows(plain, *sorted(plain.columns))


def test_bodies_and_parents(spark):
    schema = "body string, province string, body_type string, tier string, parent_ids array<string>"
    b = df(spark, schema, ("r", "ON", "regional-government", "upper-tier", []), ("m", "ON", "municipal-government", "lower-tier", ["r"]),
           ("x", "ON", "municipal-government", "lower-tier", []), ("y", "ON", "municipal-government", "lower-tier", ["zz"]),
           ("q", "QC", "municipal-government", "lower-tier", ["r"]), ("s", "ON", "municipal-government", "single-tier", ["r"]), ("w", "ON", "municipal-government", "lower-tier", ["m"]))
    assert dict(rows(hierarchy.parent_verdicts(b), "body", "reason")) == {
        "r": None, "m": None, "x": "lower tier requires a parent", "y": "unknown parent", "q": "parent is in another province",
        "s": "only a lower tier has parents", "w": "parent is not an upper-tier regional body"}
    assert rows(hierarchy.incompatible(b, {"regional-government": ["upper-tier"], "municipal-government": ["single-tier"]}, "body_type", "tier"), "body") == [("m",), ("q",), ("w",), ("x",), ("y",)]
    claims = df(spark, "body string, province string, geography_ids array<string>", ("m", "ON", ["g1", "g2", "g9"]))
    geo = df(spark, "geography string, geo_province string", ("g1", "ON"), ("g2", "QC"))
    assert rows(hierarchy.body_geographies(claims, geo), "geography", "status") == [("g1", "ok"), ("g2", "other-province"), ("g9", "unknown")]


def test_containment_under_a_parent(spark):
    nodes = df(spark, "code string, parent_code string", *[(c, p) for c, _, p in GEO])
    closure = hierarchy.ancestor_chains(nodes)
    assert {r.code: r.ancestors for r in closure.collect()} == {"35": ["3"], "3518": ["35", "3"], "3518013": ["3518", "35", "3"]}
    claims = df(spark, "body string, parent string, geography string", ("m", "r", "3518013"), ("n", "t", "3518013"), ("o", "r", "3518"))
    deep = df(spark, "code string, parent_code string", *[(f"n{i}", f"n{i - 1}" if i else None) for i in range(6)], ("x", "gone"))
    assert {r.code: r.ancestors for r in hierarchy.ancestor_chains(deep).collect()}["n5"] == ["n4", "n3", "n2", "n1", "n0"]
    held = {r.code: r.ancestors for r in hierarchy.ancestor_chains(deep, 4).collect()}
    assert held["n5"] is None and held["n4"] == ["n3", "n2", "n1", "n0"]
    ring = deep.unionByName(df(spark, "code string, parent_code string", ("a", "b"), ("b", "a"), ("under", "a")))
    held = {r.code: r.ancestors for r in hierarchy.ancestor_chains(ring).collect()}
    assert held["under"] is None and held["a"] is None and held["n2"] == ["n1", "n0"]
    governed = df(spark, "parent string, geography string", ("r", "3518"), ("t", "9999"))
    assert rows(hierarchy.contained(claims, governed, closure), "body", "contained") == [("m", True), ("n", False), ("o", True)]


def test_folding_equals_the_unicode_tables(spark):
    import unicodedata

    points = [p for p in range(1, 0x33500) if not 0xD800 <= p <= 0xDFFF] + list(range(0xE0000, 0xE0200)) + [0x10FFFD]
    words = ["x" + "".join(map(chr, points[i:i + 16])) + "Y" for i in range(0, len(points), 16)]
    plain = lambda t: "".join(c for c in unicodedata.normalize("NFKD", t.casefold()) if not unicodedata.combining(c))
    # One character at a time: the marks between two others must not be reordered by the plain way.
    want = {w: "".join(plain(c) for c in w) for w in words}
    got = df(spark, "t string", *[(w,) for w in words], (None,), ("",)).select("t", text.folded(F.col("t")).alias("f"))
    assert {r.t: r.f for r in got.collect()} == {**want, None: None, "": ""}
    assert "Python" not in got._jdf.queryExecution().toString()


def test_folding_tries_the_long_class_beyond_ascii_only(spark):
    """Text in ASCII takes neither the character map nor the class; a text with one
    character that becomes several is not cut into all its characters."""
    import unicodedata

    words = ["Plain ASCII\n& More", "Stra\u00dfe & Caf\u00c9 " * 3, "\u00dfx" * 40, "a\u0301\ufb01 \ud55c\uae00 Z", "\U0001d400 b\u0130", "\x7f\x80"]
    want = ["".join(c for c in unicodedata.normalize("NFKD", "".join(x.casefold() for x in w)) if not unicodedata.combining(c)) for w in words]
    got = df(spark, "i int, t string", *enumerate(words)).select("i", text.folded(F.col("t")).alias("f")).collect()
    assert [r.f for r in sorted(got)] == want
    pieces = df(spark, "t string", ("x",)).select(text.folded(F.col("t")))._jdf.queryExecution().analyzed().toString()
    assert text.BEYOND_ASCII in pieces and 'split' not in pieces


def test_handover_guards_lose_nothing(spark):
    """What the plain patterns find is found behind the cheap searches too."""
    from tallyroom.functions import privacy

    run = "Ab1" * 9
    texts = [
        "see c:\\x", "file://h", "\\\\srv\\d\\", "~/x", "/tmp/x", "a/b", f"sk-{run}", f"sk-ant-{run}", f"xai-{run}", f"AIza{run}", "AKIA" + "A1" * 8, f"ghp_{run}", f"github_pat_{run}",
        f"xoxb-{run}", f"bEARER  {run}", "basic Ab1Ab1Ab1Ab1Ab1A==", "eyJabcdefgh.abcdefgh.abcdefgh", "PassWord : hunter22", "?sig=0123456789abcdef", "&Token=0123456789abcdef", "-----BEGIN PRIVATE KEY-----",
        "a.b@c.de", "@", "416-555-1234", "(416)5551234", "1 416.555.1234 ext 5", "4165551234", "046 454 286", "046-454-286", "046454287", "", None, "plain words only",
    ]
    found = df(spark, "t string", *[(t,) for t in texts]).select(
        privacy.handover_labels(F.col("t")).alias("labels"), F.array(*[F.col("t").rlike(p) for p in privacy.HANDOVER_PATTERNS.values()]).alias("plain")
    ).collect()
    for t, row in zip(texts, found):
        assert [x for x in row.labels if x != "checksum id"] == [n for n, hit in zip(privacy.HANDOVER_PATTERNS, row.plain) if hit], t
    assert sum(len(r.labels) for r in found) >= 27
    assert set(privacy.HANDOVER_REQUIRED) == set(privacy.HANDOVER_PATTERNS)

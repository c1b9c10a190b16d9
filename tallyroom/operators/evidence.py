"""Citations against document pages, printed values against cited nodes, and
derived metrics against their inputs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tallyroom.functions import exact, numbers
from tallyroom.operators import excerpts, printed
from tallyroom.operators.printed import LINE_END
from tallyroom.operators.skew import hot_keys, in_tasks, spread_join
from tallyroom.session import written

# Tiers that count as strong evidence, tiers that fail outright.
STRONG_TIERS = ["verbatim", "normalized", "alnum", "row-bound"]
HARD_TIERS = ["not-found", "wrong-page", "bad-page-number"]
COVERAGE_THRESHOLD = 0.90
BOUND_CENTS = 1.1  # a cent and a tenth, for printed amounts rounded from exact ones
LETTER_WORD = r"[\p{L}]{4,}"


@F.pandas_udf(StringType())
def _folded_tier(excerpts_: pd.Series, pages: pd.Series) -> pd.Series:
    """On Arrow batches: Spark has no case folding, and its patterns take several
    times as long."""

    def tier(excerpt, page):
        if page is None or excerpt is None:
            return None
        if " ".join(excerpt.split()).casefold() in " ".join(page.split()).casefold():
            return "normalized"
        shown = excerpts.letters(excerpt)
        return "alnum" if shown and shown in excerpts.letters(page) else None

    return pd.Series([tier(e, p) for e, p in zip(excerpts_, pages)], dtype=object)


def text_tier(excerpt: Column, page: Column) -> Column:
    """Match tier by wording alone, case-folded; null when the page does not hold
    the words. Only texts that differ as they stand travel to Python."""
    differs = (excerpt != "") & ~page.contains(excerpt)
    folded = _folded_tier(F.when(differs, excerpt), F.when(differs, page))
    return F.when(excerpt == "", "no-excerpt").when(page.contains(excerpt), "verbatim").otherwise(folded)


def labels_on(excerpt: Column, page: Column, lines: Column) -> Column:
    """Whether one of the numbered lines holds enough label words of the excerpt:
    at least two and six tenths of them, rounded half to even."""
    words = F.transform(F.regexp_extract_all(excerpt, F.lit(LETTER_WORD), F.lit(0)), lambda w: F.lower(w))
    need = F.greatest(F.lit(2), F.bround(F.size(words) * F.lit("0.6").cast("decimal(2,1)"), 0).cast("int"))
    shown = F.split(page, LINE_END)
    held = lambda at: F.size(F.filter(words, lambda w: F.lower(F.get(shown, at)).contains(w)))
    return F.when(F.size(lines) > 0, (F.size(words) > 0) & F.exists(lines, lambda at: held(at) >= need)).otherwise(False)


def needles_of(facts: DataFrame) -> DataFrame:
    """The columns of ``facts`` but the excerpt, and every distinct ``number`` of it."""
    tokens = F.array_distinct(F.transform(numbers.number_tokens(F.col("excerpt")), numbers.canonical_number))
    kept = [c for c in facts.columns if c != "excerpt"]
    return facts.filter(F.col("excerpt").rlike("[0-9]")).select(*kept, F.explode(tokens).alias("number"))


def numbers_on(needles: DataFrame, texts: DataFrame, place: list[str], wanted: tuple) -> DataFrame:
    """``fact_id`` and ``lines`` of facts whose text of the same ``place`` prints
    every needle of theirs; the lines are those that print them all."""
    index = printed.number_index(texts, place, wanted).select(*place, "number", "lines")
    met = spread_join(needles.select("fact_id", *place, "number"), index, [*place, "number"], "left", spread_on=["fact_id"])
    shared = F.aggregate(
        F.slice("_lines", 2, F.greatest(F.size("_lines") - 1, F.lit(0))), F.get("_lines", F.lit(0)), lambda a, b: F.array_intersect(a, b)
    )
    return (
        met.groupBy("fact_id").agg(F.bool_and(F.col("lines").isNotNull()).alias("_all"), F.collect_list("lines").alias("_lines"))
        .filter("_all").select("fact_id", shared.alias("lines"))
    )


def row_bound(facts: DataFrame, texts: DataFrame, place: list[str]) -> DataFrame:
    """``fact_id`` of the facts whose excerpt has all its numbers and enough of its
    label words on one line of the text of the same ``place``."""
    needles = needles_of(facts)
    bound = numbers_on(needles, texts, place, printed.wanted_shapes(needles))
    shown = spread_join(facts, texts.select(*place, F.col("text").alias("_text")), place, "inner", spread_on=["fact_id"])
    return shown.join(bound, "fact_id").filter(labels_on(F.col("excerpt"), F.col("_text"), F.col("lines"))).select("fact_id")


def letters_in(facts: DataFrame, documents: DataFrame) -> DataFrame:
    """``fact_id`` of the facts whose letters and digits stand in their document,
    which meets them in blocks."""
    asked = facts.select("source_id", "fact_id", excerpts.shown_letters(F.col("excerpt")).alias("_shown")).filter("_shown <> ''")
    blocks = excerpts.in_blocks(asked, ["source_id"], F.struct("fact_id", "_shown"), "fact_id")
    met = blocks.join(documents.select("source_id", "text"), "source_id").select("_items", excerpts.shown_letters(F.col("text")).alias("_letters"))
    held = F.filter("_items", lambda item: F.col("_letters").contains(item["_shown"]))
    return met.select(F.explode(held).alias("_item")).select("_item.fact_id")


def citation_tiers(facts: DataFrame, pages: DataFrame, documents: DataFrame) -> DataFrame:
    """``facts(fact_id, source_id, page, excerpt)`` against
    ``pages(source_id, page, text)`` and ``documents(source_id, text)``.

    The numbers of an excerpt meet the numbers printed on its page, and in its
    document, by equality (see ``printed``). Wording is compared on the cited
    page; only facts that the page leaves open ask for the whole document, in
    blocks, and its text is folded once. A fact without a page is compared with
    the whole document. A source cited by very many facts is a hot key and is
    spread; its weight is counted on the facts alone.
    """
    facts = facts.select("fact_id", "source_id", "page", F.trim(F.coalesce("excerpt", F.lit(""))).alias("excerpt"))
    needles = written(needles_of(facts))
    wanted = printed.wanted_shapes(needles)
    place = ["source_id", "page"]
    on_page = numbers_on(needles.filter("page IS NOT NULL"), pages, place, wanted)
    in_document = written(numbers_on(needles, documents, ["source_id"], wanted))
    # Written, so the planner knows how short the list is and deals no excerpt out for it.
    hot = written(hot_keys(facts.select("source_id"), ["source_id"]))

    def compared(part: DataFrame, texts: DataFrame, key: list[str], bound: DataFrame) -> DataFrame:
        shown = spread_join(part, texts.select(*key, F.col("text").alias("_text")), key, "left", spread_on=["fact_id"], hot=hot)
        shown = shown.withColumn("_found", F.col("_text").isNotNull())
        shown = shown.withColumn("_wording", F.when(F.col("_found"), text_tier(F.col("excerpt"), F.col("_text"))))
        # Only what the wording leaves open takes its texts along to the numbers.
        is_open = F.col("_wording").isNull()
        shown = shown.select(
            "fact_id", "source_id", "page", "_found", "_wording",
            F.when(is_open, F.col("excerpt")).alias("excerpt"), F.when(is_open, F.col("_text")).alias("_text"),
        )
        shown = shown.join(bound.withColumn("_present", F.lit(True)), "fact_id", "left")
        number = F.when(
            F.col("_found") & F.col("_present"),
            F.when(labels_on(F.col("excerpt"), F.col("_text"), F.col("lines")), "row-bound").otherwise("numbers-only"),
        )
        shown = shown.withColumn("_tier", F.coalesce(F.col("_wording"), number))
        return shown.select("fact_id", "source_id", "page", F.when(F.col("_tier").isNull(), F.col("excerpt")).alias("excerpt"), "_found", "_tier")

    judged = compared(facts.filter("page IS NOT NULL"), pages, place, on_page)
    unpaged = facts.filter("page IS NULL")
    if not unpaged.isEmpty():
        judged = judged.unionByName(compared(unpaged, documents, ["source_id"], in_document))
    known = documents.select("source_id", F.lit(True).alias("_known")).distinct()
    judged = written(spread_join(judged, known, ["source_id"], "left", spread_on=["fact_id"], hot=hot))

    left = judged.filter(F.col("_tier").isNull() & F.col("_known") & (F.col("_found") | F.col("page").isNull()))
    by_number = in_document.select("fact_id").join(left.select("fact_id"), "fact_id", "left_semi")
    elsewhere = by_number.unionByName(letters_in(left, documents)).distinct().withColumn("_elsewhere", F.lit(True))
    return judged.join(elsewhere, "fact_id", "left").select(
        "fact_id",
        F.when(F.col("_tier").isNotNull(), F.col("_tier"))
        .when(F.col("_known").isNull(), "unverifiable")
        .when(F.col("page").isNotNull() & ~F.col("_found"), "bad-page-number")
        .when(F.col("_elsewhere"), "wrong-page").otherwise("not-found")
        .alias("tier"),
    )


def amount_issues(facts: DataFrame, texts: DataFrame, place: list[str]) -> DataFrame:
    """``fact_id`` and ``issue``: whether the text of the same ``place`` prints the
    amount with its sign; null when it does or when there is no amount to find.

    ``facts(fact_id, place, amount, scale)`` with decimal amounts; the text prints
    amount / scale. Exact renderings in digits count first, exact ones in words
    (``5 million``) where there are none.
    """
    amount, scale = F.col("amount"), F.col("scale")
    asked = facts.select("fact_id", *place, "amount", F.explode(F.array_union(
        F.transform(numbers.renderings(amount, scale), lambda n: F.struct(F.lit(False).alias("worded"), n.alias("number"))),
        F.transform(numbers.magnitude_names(amount, scale), lambda n: F.struct(F.lit(True).alias("worded"), n.alias("number"))),
    )).alias("_n")).select("fact_id", *place, "amount", "_n.*")
    asked = written(asked)
    index = printed.number_index(texts, place, printed.wanted_shapes(asked)).drop("lines")
    met = spread_join(asked, index, [*place, "number"], "inner", spread_on=["fact_id"])
    fits = F.when(F.col("amount") < 0, F.col("negatives") > 0).otherwise(F.col("positives") > 0)
    seen = met.groupBy("fact_id").agg(
        F.bool_or(F.when(~F.col("worded"), fits)).alias("_plain"), F.bool_or(F.when(F.col("worded"), fits)).alias("_worded")
    )
    fitting = F.coalesce("_plain", "_worded")
    return facts.join(seen, "fact_id", "left").select(
        "fact_id",
        F.when(amount.isNull() | (amount == 0), F.lit(None).cast("string"))
        .when(scale <= 0, "scale-factor-invalid")
        .when(fitting.isNull(), "amount-not-on-cited-page")
        .when(~fitting, "amount-sign-mismatch").alias("issue"),
    )


def evidence_coverage(tiers: DataFrame, load_bearing: DataFrame, by: list[str]) -> DataFrame:
    """Strong share of the load-bearing facts against the publication threshold."""
    counted = tiers.join(load_bearing.select("fact_id").distinct(), "fact_id", "left_semi")
    strong = F.count(F.when(F.col("tier").isin(STRONG_TIERS), F.lit(1)))
    out = counted.groupBy(*by).agg(F.count(F.lit(1)).alias("counted"), strong.alias("strong"))
    share = F.col("strong").cast("double") / F.col("counted").cast("double")
    return out.withColumn("coverage", share).withColumn(
        "status", F.when(share >= F.lit(COVERAGE_THRESHOLD), "published").otherwise("refused")
    )


def citation_findings(tiers: DataFrame, strict: bool) -> DataFrame:
    """Findings per fact: a hard tier is an error on a draft too, an issue of
    the binding (``issue``, null when bound) an error once sealed, a weak tier a
    warning that only the coverage threshold turns into a refusal."""
    tier = F.col("tier")
    return tiers.select(
        "fact_id", "tier", "issue",
        F.when(tier.isin(HARD_TIERS), "error")
        .when(F.col("issue").isNotNull(), "error" if strict else "warning")
        .when(~tier.isin(STRONG_TIERS), "warning").alias("severity"),
    )


def value_binding(printed: DataFrame, nodes: DataFrame) -> DataFrame:
    """``printed(path, cited_id, amount, sibling, rate, assessment)`` against
    ``nodes(node_id, value)``; doubles as in the documents.

    Bound when the amount equals the node, a sibling field equals it, or the
    printed rate is the node and rate x assessment rounds to the amount. An
    unresolved id is left to the reference check.
    """
    joined = spread_join(
        printed.withColumnRenamed("cited_id", "node_id"),
        nodes.select("node_id", F.lit(True).alias("_known"), F.col("value").alias("_v")),
        ["node_id"], "inner", spread_on=["path"],
    )
    v = F.col("_v")
    cent = F.lit(0.011)
    near = F.abs(F.col("amount") - v) <= cent
    sibling_tolerance = F.least(cent, F.greatest(F.abs(v) * F.lit(1e-3), F.lit(1e-9)))
    sibling = F.coalesce(F.abs(F.col("sibling") - v) <= sibling_tolerance, F.lit(False))
    is_rate = F.coalesce(F.abs(F.col("rate") - v) <= F.lit(1e-9), F.lit(False))
    expected = F.round((F.col("rate").cast("decimal(18,12)") * F.col("assessment").cast("decimal(20,2)")).cast("decimal(38,12)"), 2).cast("double")
    return joined.select(
        "path", "node_id",
        F.when(v.isNull(), "cited node has no number")
        .when(near, "bound")
        .when(sibling, "bound-by-sibling")
        .when(is_rate & F.col("assessment").isNull(), "rate without an assessment in scope")
        .when(is_rate & (F.abs(F.col("amount") - expected) <= cent), "bound-by-rate")
        .when(is_rate, "rate times assessment is not the printed amount")
        .otherwise("printed amount does not equal its node").alias("status"),
    )


def recompute(derived: DataFrame, terms: DataFrame, nodes: DataFrame, inputs: DataFrame | None = None, rows: int = 0) -> DataFrame:
    """Derived metrics from stored inputs, formulas as rows.

    ``derived(derived_id, stored, tolerance, control)``, with the tolerance of the
    control as ``control_tolerance`` where it has one of its own: an identity is
    held to the larger of the two;
    ``terms(derived_id, factor_no, numerator, sign, input_id, constant)``;
    ``nodes(node_id, value)``. The value is the product of signed sums, the
    numerator factors over the denominator ones, without rounding: values of up to
    18 + 16 digits are compared at the very tolerance, wider ones refused. ``control`` (a value or null)
    is the other side of a sum identity. Terms with an input are joined to the nodes;
    constants are not, since without a key they would all meet in one task. Then the
    two aggregation levels of the formula; ``rows`` is the number of terms, where it is known
    beforehand, and keeps the tasks small (see ``in_tasks``). With ``inputs(derived_id, input_id)`` a term that uses an undeclared
    input refuses its metric.
    """
    if inputs is None:
        stated = terms.withColumn("_stated", F.lit(True))
    else:
        listed = inputs.select("derived_id", "input_id", F.lit(True).alias("_listed")).distinct()
        stated = terms.join(listed, ["derived_id", "input_id"], "left").withColumn(
            "_stated", F.col("input_id").isNull() | F.coalesce("_listed", F.lit(False))
        ).drop("_listed")
    plain = ["derived_id", "factor_no", "numerator", "sign", "_stated"]
    cited = stated.filter("input_id IS NOT NULL").select(*plain, F.col("input_id").alias("node_id"))
    valued = spread_join(
        in_tasks(cited, rows, "node_id"), nodes.select("node_id", F.col("value").alias("_x")), ["node_id"], "left", spread_on=["derived_id", "factor_no"]
    ).drop("node_id").unionByName(stated.filter("input_id IS NULL").select(*plain, F.col("constant").alias("_x")))
    valued = in_tasks(valued.withColumn("_e", F.col("_x").try_cast(exact.EXACT)), rows, "derived_id")
    factors = valued.groupBy("derived_id", "factor_no", "numerator").agg(
        F.sum(F.when(F.col("sign") < 0, -F.col("_e")).otherwise(F.col("_e"))).try_cast(exact.EXACT).alias("_f"),
        F.count(F.when(F.col("_x").isNull(), F.lit(1))).alias("_lost"),
        F.count(F.when(F.col("_x").isNotNull() & F.col("_e").isNull(), F.lit(1))).alias("_beyond"),
        F.bool_and("_stated").alias("_stated"),
    )
    # A formula has few factors, so its lists are short.
    listed = lambda numerator: F.collect_list(F.when(numerator, F.col("_f")))
    values = factors.groupBy("derived_id").agg(
        listed(F.col("numerator")).alias("_over"), listed(~F.col("numerator")).alias("_under"),
        F.count(F.when(F.col("_f") < 0, F.lit(1))).alias("_negative"),
        F.count(F.when(~F.col("numerator") & (F.col("_f") == 0), F.lit(1))).alias("_zero"),
        F.sum("_lost").alias("_lost"),
        F.count(F.when(F.col("_f").isNull() | (F.col("_beyond") > 0), F.lit(1))).alias("_beyond"),
        F.bool_and("_stated").alias("_stated"),
    ).select(
        "derived_id", "_lost", "_beyond", "_stated", "_zero", F.when(F.col("_negative") % 2 == 1, -1).otherwise(1).alias("_sign"),
        "_over", "_under",
    )
    out = derived.join(values, "derived_id", "left")
    wide = F.greatest("tolerance", "control_tolerance") if "control_tolerance" in derived.columns else F.col("tolerance")
    # Doubles tell all but those near the tolerance's edge; only these are multiplied out.
    for name, tolerance in (("control", wide), ("stored", F.col("tolerance"))):
        v, t = F.col(name).try_cast(exact.EXACT), tolerance.try_cast(exact.EXACT)
        out = out.withColumn(f"_sure_{name}", exact.surely_outside(F.col("_over"), F.col("_under"), v, t))
        near = F.col(f"_sure_{name}").isNull() & (F.col("_zero") == 0)
        multiplied = exact.off_by(F.when(near, F.col("_over")), F.when(near, F.col("_under")), v, t)
        out = out.withColumn(f"_off_{name}", F.coalesce(f"_sure_{name}", multiplied))
    beyond = lambda c: F.col(c).isNotNull() & F.col(c).try_cast(exact.EXACT).isNull()
    return out.select(
        "derived_id",
        F.when(F.col("_lost").isNull(), "no formula")
        .when(~F.col("_stated"), "formula input is not declared")
        .when(F.col("_lost") > 0, "formula input is missing")
        .when((F.col("_beyond") > 0) | beyond("stored") | beyond("control"), "value is out of range")
        .when(F.col("_zero") > 0, "division by zero")
        .when(F.col("control").isNotNull() & F.col("_off_control"), "identity fails")
        .when(F.col("_off_stored"), "does not recompute")
        .otherwise("recomputed").alias("status"),
    )


def scope_asof(rows: DataFrame, holders: DataFrame, doc: str, path: str, value: str, separator: str = "/") -> DataFrame:
    """The value of the nearest holder at or above each path.

    A path is exploded to its ancestors (as many as it is deep) and met by
    equality, so there is no prefix-comparison join; the deepest hit wins. An
    ancestor above very many rows is spread.
    """
    parts = F.split(path, separator)
    lifted = rows.select(
        doc, path, F.explode(F.sequence(F.lit(1), F.size(parts))).alias("_depth")
    ).withColumn("_holder", F.array_join(F.slice(F.split(path, separator), F.lit(1), F.col("_depth")), separator))
    held = holders.select(doc, F.col(path).alias("_holder"), F.col(value).alias("_v"))
    hits = spread_join(lifted, held, [doc, "_holder"], "inner", spread_on=[path])
    best = hits.groupBy(doc, path).agg(F.max(F.struct("_depth", "_v")).alias("_b"))
    return rows.join(best, [doc, path], "left").select(*rows.columns, F.col("_b._v").alias(value), F.col("_b._depth").alias("scope_depth"))


def deep_link(url: Column, page: Column, verified: Column) -> Column:
    """A link to the page only when the page is verified."""
    return F.when(verified & page.isNotNull(), F.concat(url, F.lit("#page="), page.cast("string"))).otherwise(url)

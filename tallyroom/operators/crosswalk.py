"""Matching directories, references and areas by explicit keys."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyroom.operators.gates import first_reason
from tallyroom.operators.skew import spread_join


def name_crosswalk(directory: DataFrame, filers: DataFrame, overrides: DataFrame) -> DataFrame:
    """Directory rows to filer codes.

    ``directory(entry, name_key, tier)``, ``filers(code, name_key, tier)`` with
    one row per code, ``overrides(entry, code)``. An override wins over a name
    match; an ambiguous match, an override to an unknown code and a code used by
    two entries are refused; no match means no history.
    """
    candidates = filers.groupBy("name_key", "tier").agg(
        F.min("code").alias("match_code"), F.count(F.lit(1)).alias("matches")
    )
    known = filers.select(F.col("code").alias("override_code"), F.lit(True).alias("override_known"))
    claimed = spread_join(
        overrides.withColumnRenamed("code", "override_code"), known, ["override_code"], "left", spread_on=["entry"]
    )
    resolved = (
        spread_join(directory, candidates, ["name_key", "tier"], "left", spread_on=["entry"])
        .join(claimed, "entry", "left")
        .select(
            "entry",
            "override_code",
            F.coalesce("override_known", F.lit(False)).alias("override_known"),
            F.coalesce("override_code", "match_code").alias("code"),
            F.coalesce("matches", F.lit(0)).alias("matches"),
        )
    )
    uses = resolved.filter("code IS NOT NULL").groupBy("code").agg(F.count(F.lit(1)).alias("uses"))
    by_name = F.col("override_code").isNull()
    return resolved.join(uses, "code", "left").select(
        "entry",
        "code",
        F.when(~by_name, "override").when(F.col("matches") > 0, "name").otherwise("none").alias("basis"),
        first_reason([
            ("override points outside the filers", ~by_name & ~F.col("override_known")),
            ("ambiguous name match", by_name & (F.col("matches") > 1)),
            ("code maps to several entries", F.coalesce(F.col("uses") > 1, F.lit(False))),
        ]).alias("reason"),
    )


def unmatched(left: DataFrame, right: DataFrame, key: str, left_label: str, right_label: str) -> DataFrame:
    """Left keys without a right row, and right keys without a left row."""
    l, r = left.select(key).distinct(), right.select(key).distinct()
    lost = l.join(r, key, "left_anti").select(key, F.lit(left_label).alias("status"))
    orphan = r.join(l, key, "left_anti").select(key, F.lit(right_label).alias("status"))
    return lost.unionByName(orphan)


def dangling(references: DataFrame, targets: DataFrame) -> DataFrame:
    """References ``(kind, ref_id, location)`` whose ``(kind, ref_id)`` is not a
    target: how often it is cited and its first location.

    References collapse to one row per id before the anti join, so a much-cited
    id costs one row there.
    """
    cited = references.groupBy("kind", "ref_id").agg(
        F.count(F.lit(1)).alias("citations"), F.min("location").alias("first_location")
    )
    return cited.join(targets.select("kind", "ref_id").distinct(), ["kind", "ref_id"], "left_anti")


def match_counts(wanted: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Exactly-one selection: each wanted key with its number of rows."""
    n = rows.groupBy(key).agg(F.count(F.lit(1)).alias("matches"))
    return wanted.select(key).join(n, key, "left").select(
        key,
        F.coalesce("matches", F.lit(0)).alias("matches"),
        F.when(F.col("matches") == 1, "selected").when(F.col("matches") > 1, "ambiguous").otherwise("absent").alias("status"),
    )


def undirected_edges(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Canonical undirected edges with their direction status.

    One aggregation on the ordered pair replaces the self join: an edge is
    mutual when both directions occur.
    """
    low, high = F.least(a, b), F.greatest(a, b)
    return edges.groupBy(low.alias("low"), high.alias("high")).agg(
        F.max(F.col(a) < F.col(b)).alias("up"), F.max(F.col(a) > F.col(b)).alias("down")
    ).select(
        "low", "high",
        F.when(F.col("low") == F.col("high"), "self-edge")
        .when(F.col("up") & F.col("down"), "mutual")
        .otherwise("one-way").alias("status"),
    )


def context_agreement(artifacts: list[DataFrame], key: str, field: str) -> DataFrame:
    """Each artifact has one row per key; a key whose non-null values differ
    across artifacts is refused."""
    rows = reduce(DataFrame.unionByName, [a.select(key, field) for a in artifacts])
    return rows.groupBy(key).agg(
        F.count(F.lit(1)).alias("artifacts"), F.min(field).alias("low"), F.max(field).alias("high")
    ).select(
        key, "artifacts",
        F.when(F.col("low").isNull(), "silent").when(F.col("low") == F.col("high"), "agree").otherwise("disagree").alias("status"),
    )


@dataclass(frozen=True)
class Rule:
    """How artifacts must agree on one field.

    ``compare``: ``exact``; ``upper`` (without case); ``text`` (without case and
    repeated spaces, an empty text is no value); ``prefix`` (as text, every value
    starts with that of the first artifact). ``artifacts`` are compared (all, if
    empty), ``required`` must carry a value. ``together``: all of them carry one or
    none does. ``anchored``: a value differs from no value in the first artifact.
    """

    field: str
    compare: str = "exact"
    artifacts: tuple[str, ...] = ()
    required: tuple[str, ...] = ()
    together: bool = False
    anchored: bool = False


def compared(value: Column, how: str) -> Column:
    value = value.cast("string")
    if how in ("text", "prefix"):
        return F.nullif(F.lower(F.trim(F.regexp_replace(value, r"(?U)\s+", " "))), F.lit(""))
    if how not in ("exact", "upper"):
        raise ValueError(f"unknown comparison {how}")
    return F.upper(value) if how == "upper" else value


def context_fields(artifacts: dict[str, DataFrame], key: str, rules: dict[str, Rule], strict: bool) -> DataFrame:
    """One row per key and rule: status (agree, disagree or silent), the artifacts whose
    value is missing, and severity. A disagreement is an error; a missing value is one
    in strict mode and a warning otherwise. An artifact without a row for a key carries
    no value. A field that an artifact has no column for is not carried by it.

    All rules come from one aggregation per key.
    """
    order = list(artifacts)
    names = {r: rule.artifacts or tuple(order) for r, rule in rules.items()}
    unknown = {a for r, rule in rules.items() for a in (*names[r], *rule.required)} - set(order)
    if unknown:
        raise ValueError(f"unknown artifacts {sorted(unknown)}")

    def cells(name: str, df: DataFrame) -> DataFrame:
        values = [
            compared(F.col(f"`{rule.field}`"), rule.compare) if rule.field in df.columns and name in {*names[r], *rule.required} else F.lit(None).cast("string")
            for r, rule in rules.items()
        ]
        return df.select(key, F.lit(order.index(name)).alias("_a"), *[v.alias(f"_v{i}") for i, v in enumerate(values)])

    every, shown = [], []
    for i, (r, rule) in enumerate(rules.items()):
        value, at = F.col(f"_v{i}"), F.col("_a")
        inside = at.isin([order.index(a) for a in names[r]])
        first = at == order.index(names[r][0])
        every += [
            F.min(F.when(inside, value)).alias(f"_low{i}"), F.max(F.when(inside, value)).alias(f"_high{i}"),
            F.min(F.when(first, value)).alias(f"_lead{i}"),
            *[F.count(F.when(at == k, value)).alias(f"_n{i}_{k}") for k in range(len(order))],
        ]
        low, high, lead = (F.col(f"_{x}{i}") for x in ("low", "high", "lead"))
        has = {a: F.col(f"_n{i}_{order.index(a)}") > 0 for a in order}
        # what sorts between two texts with the same beginning has that beginning too
        same = F.coalesce(F.startswith(low, lead) & F.startswith(high, lead), F.lit(True)) if rule.compare == "prefix" else low == high
        if rule.anchored:
            same = same & lead.isNotNull()
        some = reduce(lambda x, y: x | y, [has[a] for a in names[r]])
        lacks = [
            F.when(~has[a] & (F.lit(a in rule.required) | (F.lit(rule.together and a in names[r]) & some)), a) for a in order
        ]
        shown.append(F.struct(
            F.lit(r).alias("rule"),
            F.when(low.isNull(), "silent").when(same, "agree").otherwise("disagree").alias("status"),
            F.concat_ws(", ", *lacks).alias("missing"),
        ))
    rows = reduce(DataFrame.unionByName, [cells(name, df) for name, df in artifacts.items()])
    wrong = (F.col("status") == "disagree") | ((F.col("missing") != "") & F.lit(strict))
    return rows.groupBy(key).agg(*every).select(key, F.explode(F.array(*shown)).alias("_r")).select(key, "_r.*").withColumn(
        "severity", F.when(wrong, "error").when(F.col("missing") != "", "warning").otherwise("none")
    )


def request_cover(requests: DataFrame, answers: DataFrame, key: str) -> DataFrame:
    """Every required request needs a closing source or a gap.

    ``requests(key, required)``; ``answers(key, kind, reason)`` with kind
    ``closing``, ``non-closing`` or ``gap``. Overlap of a gap with a source is
    allowed only for a reason some non-closing source states. Answers reduce to
    one row per key and bounded reason set first.
    """
    per_reason = answers.groupBy(key, "reason").agg(
        F.max((F.col("kind") == "closing").cast("int")).alias("c"),
        F.max((F.col("kind") == "non-closing").cast("int")).alias("n"),
        F.max((F.col("kind") == "gap").cast("int")).alias("g"),
    )
    found = per_reason.groupBy(key).agg(
        F.max("c").alias("closing"), F.max("n").alias("non_closing"), F.max("g").alias("gap"),
        F.max(F.col("n") * F.col("g")).alias("shared_reason"),
    )
    value = lambda c: F.coalesce(c, F.lit(0))
    closing, non_closing, gap, shared = (value(c) for c in ("closing", "non_closing", "gap", "shared_reason"))
    source = (closing == 1) | (non_closing == 1)
    return requests.join(found, key, "full").select(
        key,
        first_reason([
            ("not requested", F.col("required").isNull()),
            ("source and gap overlap without a stated reason", source & (gap == 1) & (shared == 0)),
            ("non-closing source without its gap", (non_closing == 1) & (closing == 0) & (shared == 0)),
            ("required item has neither source nor gap", F.col("required") & (closing == 0) & (gap == 0)),
        ]).alias("reason"),
    ).withColumn("status", F.when(F.col("reason").isNull(), "covered").otherwise("refused"))


def bind_positions(left: DataFrame, right: DataFrame, key: str, left_items: str, right_items: str) -> DataFrame:
    """Item i of one list against item i of the other, per key."""
    l = left.select(key, F.posexplode(left_items).alias("pos", "left_item"))
    r = right.select(key, F.posexplode(right_items).alias("pos", "right_item"))
    return l.join(r, [key, "pos"], "full").withColumn(
        "status",
        F.when(F.col("left_item").isNull(), "right-only").when(F.col("right_item").isNull(), "left-only").otherwise("bound"),
    )


def two_witness(a: DataFrame, b: DataFrame, key: str, value: str, tolerance: int | Column) -> DataFrame:
    """One figure from two sources: corroborated within a tolerance or not."""
    return a.select(key, F.col(value).alias("first")).join(b.select(key, F.col(value).alias("second")), key, "full").select(
        key, "first", "second",
        F.when(F.col("first").isNull() | F.col("second").isNull(), "single-witness")
        .when(F.abs(F.col("first") - F.col("second")) <= tolerance, "corroborated")
        .otherwise("conflict").alias("status"),
    )


def alias_enrich(records: DataFrame, former: DataFrame, name: str) -> DataFrame:
    """Former names folded into the successor's record by lower-cased name.

    ``former(successor, former_name)``; names are made distinct before they are
    listed, so a list is as long as a place has former names.
    """
    listed = former.select(F.lower("successor").alias("_k"), "former_name").distinct().groupBy("_k").agg(
        F.array_sort(F.collect_list("former_name")).alias("former_names")
    )
    return records.withColumn("_k", F.lower(name)).join(listed, "_k", "left").drop("_k").withColumn(
        "note",
        F.when(F.size("former_names") == 1, F.concat(F.lit("Includes the former "), F.element_at("former_names", 1)))
        .when(F.size("former_names") > 1, F.concat(F.lit("Includes the former places "), F.array_join("former_names", ", "))),
    )

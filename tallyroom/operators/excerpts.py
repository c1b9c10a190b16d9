"""Where quoted texts occur: whole lines that repeat, and excerpts inside texts.

Excerpts are found by an inverted index of anchors. Of every ``size`` adjacent
stretches of ``size`` characters, the one with the least hash is an anchor; a text
that holds an excerpt has all anchors of the excerpt, whatever stands around it.
The anchor that the fewest texts have picks the candidates by an equality join,
and each candidate text is searched once for a block of excerpts by an automaton.
Where the texts of a scope are no longer than ``SCOPE_CHARS`` together with its
excerpts, no index is made: they meet in one row, and one automaton searches them.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from tallyroom.operators.skew import hot_keys, spread_join
from tallyroom.session import written

#: Stretch sizes; an excerpt uses the largest with ``2 * size - 1`` characters or fewer.
SIZES = (16, 8, 4, 2, 1)
#: Excerpts that one automaton holds.
BLOCK = 2_000
#: Characters of texts and excerpts of a scope that meet in one row; larger scopes are indexed.
SCOPE_CHARS = 1 << 18
_LETTERS = re.compile(r"[^\W_]+")


def repeated_on_other_pages(pages: DataFrame, doc: str, page: str, text: str) -> DataFrame:
    """Pages whose whole text also stands on other pages of the document: how
    many, and the first of them.

    Equal texts are counted per document and digest (a combining aggregate), so
    a line that repeats very often never produces pairs.
    """
    rows = pages.filter(F.trim(text) != "").select(doc, page, F.xxhash64(text).alias("_h"), F.md5(text).alias("_m"))
    key = [doc, "_h", "_m"]
    stats = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"), F.min(page).alias("_first")).filter("_n > 1")
    later = spread_join(rows, stats, key, "inner", spread_on=[page], hot=hot_keys(stats, key, "_n")).filter(F.col(page) > F.col("_first"))
    # The first page of a repeated text points to the second one: one row per text.
    runner_up = later.groupBy(*key).agg(F.min(page).alias("_next"))
    first = stats.join(runner_up, key).select(doc, F.col("_first").alias(page), (F.col("_n") - 1).alias("other_pages"), F.col("_next").alias("first_other"))
    return later.select(doc, page, (F.col("_n") - 1).alias("other_pages"), F.col("_first").alias("first_other")).unionByName(first)


def letters(text: str) -> str:
    """Case-folded letters and digits."""
    return "".join(_LETTERS.findall(text.casefold()))


def letter_places(text: str) -> tuple[str, np.ndarray]:
    """``letters`` and the place in the text that each of them comes from."""
    low = text.casefold()
    if len(low) == len(text):
        spans = [m.span() for m in _LETTERS.finditer(low)]
        places = np.concatenate([np.arange(a, b) for a, b in spans] or [np.zeros(0, np.int64)])
        return "".join(low[a:b] for a, b in spans), places
    kept = [(c, at) for at, ch in enumerate(text) for c in ch.casefold() if c.isalnum()]
    return "".join(c for c, _ in kept), np.array([at for _, at in kept], np.int64)


@F.pandas_udf(StringType())
def shown_letters(texts: pd.Series) -> pd.Series:
    """``letters`` as a column."""
    return texts.map(letters, na_action="ignore")


def size_of(length: int) -> int:
    return next((size for size in SIZES if length >= 2 * size - 1), 0)


def anchors(texts: list[str], sizes: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Text numbers and distinct anchors of many texts, in order of the texts: for
    all the sizes given, else for the size that fits each text."""
    length = np.array([len(t) for t in texts], np.int64)
    code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(texts)), length)
    left = np.repeat(np.cumsum(length), length) - np.arange(len(code))  # characters to the end of the text
    fitting = np.array([size_of(n) for n in length.tolist()], np.int64)
    owners, found = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for size in sizes or sorted(set(fitting.tolist()) - {0}):
        count = len(code) - 2 * size + 2
        if count <= 0:
            continue
        rolled = np.full(len(code) - size + 1, size, np.uint64)
        for k in range(size):
            rolled = (rolled * np.uint64(0x9E3779B97F4A7C15)) ^ (code[k : k + len(rolled)] * np.uint64(0xD6E8FEB86659FD93) + np.uint64(k))
            rolled ^= rolled >> np.uint64(29)
        reach = 1  # the least of the next ``reach`` stretches, doubled up to ``size``
        while reach < size:
            rolled = np.minimum(rolled[:-reach], rolled[reach:])
            reach *= 2
        inside = left[:count] >= 2 * size - 1
        if sizes is None:
            inside &= fitting[owner[:count]] == size
        mine, least = owner[:count][inside], rolled[inside]
        fresh = np.append(True, (least[1:] != least[:-1]) | (mine[1:] != mine[:-1]))[: len(least)]
        owners.append(mine[fresh])
        found.append(least[fresh])
    owner, least = np.concatenate(owners), np.concatenate(found)
    order = np.lexsort((least, owner))
    owner, least = owner[order], least[order]
    fresh = np.append(True, (least[1:] != least[:-1]) | (owner[1:] != owner[:-1]))[: len(least)]
    return owner[fresh], least[fresh].view(np.int64)


#: Characters that a task works on at once.
_PART = 1 << 20


def _with_anchors(source: DataFrame, keep: list[str], text: str, form: str, sizes: list[int] | None) -> DataFrame:
    """``keep`` and ``_a``, one row per distinct anchor of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column("_t").to_pylist()]
            texts = [letters(t) for t in texts] if form == "letters" else texts
            begin = size = 0
            for at, value in enumerate([*texts, None]):
                if value is not None and (not size or size + len(value) <= _PART):
                    size += len(value)
                    continue
                owner, found = anchors(texts[begin:at], sizes)
                taken = pa.array(owner + begin, pa.int64())
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(taken) for k in keep), pa.array(found, pa.int64())], names=[*keep, "_a"])
                begin, size = at, len(value or "")

    rows = source.select(*keep, F.col(text).alias("_t"))
    return rows.mapInArrow(run, StructType([*(rows.schema[k] for k in keep), *StructType.fromDDL("_a bigint").fields]))


def in_blocks(rows: DataFrame, key: list[str], item: Column, spread: str, size: int = BLOCK) -> DataFrame:
    """``key`` and ``_items``: the items of a key in lists of about ``size``."""
    counted = rows.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / size).alias("_blocks"))
    dealt = rows.join(counted, key).withColumn("_block", F.pmod(F.xxhash64(spread), F.col("_blocks")))
    return dealt.groupBy(*key, "_block").agg(F.collect_list(item).alias("_items"))


def matches(text: str, named: dict[str, list[str]], every: bool) -> Iterator[tuple[int, int, list[str]]]:
    """First and last character of the quotes in a text, and their names."""
    if not every:
        for quote, names in named.items():
            first = text.find(quote)
            if first >= 0:
                yield first, first + len(quote) - 1, names
        return
    automaton = ahocorasick.Automaton()
    for quote, names in named.items():
        automaton.add_word(quote, (len(quote), names))
    automaton.make_automaton()
    for last, (size, names) in automaton.iter(text):
        yield last - size + 1, last, names


def _met(texts: DataFrame, excerpts: DataFrame, scope: list[str], place: list[str], form: str, every: bool) -> DataFrame:
    """``located`` for scopes whose texts and excerpts fit in one row."""
    known = " AND ".join(f"{c} IS NOT NULL" for c in [*scope, *place, "text"])
    held = texts.filter(known).groupBy(*scope).agg(F.collect_list(F.struct(*place, F.col("text").alias("_t"))).alias("_texts"))
    asked = excerpts.filter("excerpt <> ''").groupBy(*scope).agg(F.collect_list(F.struct("excerpt_id", F.col("excerpt").alias("_quote"))).alias("_items"))
    added = StructType.fromDDL("start int, end int")
    types = [excerpts.schema["excerpt_id"], *(texts.schema[c] for c in [*scope, *place]), *added.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (text_at, held), (item_at, items) = [(batch.column(c).offsets.to_pylist(), batch.column(c).values) for c in ("_texts", "_items")]
            shown, quotes = held.field("_t").to_pylist(), items.field("_quote").to_pylist()
            spots = list(zip(*[held.field(c).to_pylist() for c in place])) or [()] * len(shown)
            out: list[tuple[int, int, int, int, int]] = []

            def taken() -> pa.RecordBatch:
                row, item, text, start, end = [pa.array(c, pa.int64()) for c in (zip(*out) if out else [()] * 5)]
                columns = [items.field("excerpt_id").take(item), *(batch.column(c).take(row) for c in scope), *(held.field(c).take(text) for c in place)]
                return pa.RecordBatch.from_arrays([*columns, start.cast(pa.int32()), end.cast(pa.int32())], names=[t.name for t in types])

            for k in range(batch.num_rows):
                named: dict[str, list[int]] = {}
                for item in range(item_at[k], item_at[k + 1]):
                    quote = letters(quotes[item]) if form == "letters" else quotes[item]
                    if quote:
                        named.setdefault(quote, []).append(item)
                if not named:
                    continue
                automaton = ahocorasick.Automaton()
                for quote in named:
                    automaton.add_word(quote, quote)
                automaton.make_automaton()
                mine = range(text_at[k], text_at[k + 1])
                found = []
                for text in mine:
                    bare, places = letter_places(shown[text]) if form == "letters" else (shown[text], None)
                    seen = set()
                    for last, quote in automaton.iter(bare):
                        if every or quote not in seen:
                            seen.add(quote)
                            first = last - len(quote) + 1
                            found.append((text, quote, *((first, last + 1) if places is None else (int(places[first]), int(places[last]) + 1))))
                # Each of several texts at one place answers for all of them that hold the excerpt.
                alike = len({spots[text] for text in mine}) < len(mine)
                holders = Counter((spots[text], quote) for text, quote in {f[:2] for f in found}) if alike else {}
                for text, quote, start, end in found:
                    out += [(k, item, text, start, end) for item in named[quote] for _ in range(holders.get((spots[text], quote), 1))]
                    if len(out) > _PART:
                        yield taken()
                        out = []
            yield taken()

    return held.join(asked, scope).mapInArrow(run, StructType(types))


def located(
    texts: DataFrame, excerpts: DataFrame, scope: list[str], place: list[str], form: str = "letters", every: bool = True
) -> DataFrame:
    """``excerpt_id``, ``scope``, ``place``, ``start`` and ``end`` of the excerpts in texts of their scope.

    ``texts(scope, place, text)`` and ``excerpts(excerpt_id, scope, excerpt)``.
    ``form`` is ``exact``, or ``letters`` to compare letters and digits only,
    whatever their case; offsets are characters of the text as it stands, ends
    exclusive. ``every``: all occurrences, overlapping ones too, or only the first
    in each text. Excerpts without a character to compare are found nowhere. No
    text is copied per excerpt: one copy meets a block of them.
    """
    if not scope:
        return _indexed(texts, excerpts, scope, place, form, every)
    length = lambda rows, text: rows.select(*scope, (F.coalesce(F.length(text), F.lit(0)) + 16).cast("bigint").alias("_n"))
    weighed = length(texts, "text").unionByName(length(excerpts, "excerpt")).dropna(subset=scope)
    large = written(weighed.groupBy(*scope).agg(F.sum("_n").alias("_n")).filter(F.col("_n") > SCOPE_CHARS).select(*scope))
    if large.isEmpty():
        return _met(texts, excerpts, scope, place, form, every)
    small, wide = [[rows.join(large, scope, how) for rows in (texts, excerpts)] for how in ("left_anti", "left_semi")]
    return _met(*small, scope, place, form, every).unionByName(_indexed(*wide, scope, place, form, every))


def _indexed(texts: DataFrame, excerpts: DataFrame, scope: list[str], place: list[str], form: str, every: bool) -> DataFrame:
    """``located`` by anchors, for scopes of any size."""
    quoted = excerpts.select("excerpt_id", *scope, F.col("excerpt").alias("_quote"), F.md5("excerpt").alias("_e"))
    one = quoted.groupBy(*scope, "_e").agg(F.first("_quote").alias("_quote"))
    wanted = written(_with_anchors(one, [*scope, "_e"], "_quote", form, None))
    held = _with_anchors(texts, [*scope, *place], "text", form, list(SIZES)).select(*scope, *place, "_a")
    key = [*scope, "_a"]
    hits = held.join(wanted.select(*key).distinct(), key, "left_semi")
    spread = hits.groupBy(*key).agg(F.count(F.lit(1)).alias("_texts"))
    # Every anchor of an excerpt must be somewhere; the rarest one picks the texts.
    picked = wanted.join(spread, key, "left").groupBy(*scope, "_e").agg(
        F.min_by("_a", F.struct("_texts", "_a")).alias("_a"), F.bool_and(F.col("_texts").isNotNull()).alias("_all")
    ).filter("_all").drop("_all")
    pairs = hits.join(picked, key).select(*scope, *place, "_e").join(one, [*scope, "_e"])
    blocks = in_blocks(pairs, [*scope, *place], F.struct("_e", "_quote"), "_e")
    rows = texts.select(*scope, *place, F.col("text").alias("_t")).join(blocks, [*scope, *place]).drop("_block")
    added = StructType.fromDDL("_e string, start int, end int")
    keys = [*scope, *place]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, out = [], []
            for k, (text, items) in enumerate(zip(batch.column("_t").to_pylist(), batch.column("_items").to_pylist())):
                shown, places = letter_places(text) if form == "letters" else (text, None)
                named: dict[str, list[str]] = {}
                for item in items:
                    named.setdefault(letters(item["_quote"]) if form == "letters" else item["_quote"], []).append(item["_e"])
                for first, last, names in matches(shown, named, every):
                    span = (first, last + 1) if places is None else (int(places[first]), int(places[last]) + 1)
                    for name in names:
                        at.append(k)
                        out.append((name, *span))
            columns = list(zip(*out)) or [(), (), ()]
            taken = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(taken) for c in keys), pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int32())],
                names=[*keys, *added.names],
            )

    found = rows.mapInArrow(run, StructType([*(rows.schema[c] for c in keys), *added.fields]))
    return found.join(quoted.select("excerpt_id", *scope, "_e"), [*scope, "_e"]).select("excerpt_id", *scope, *place, "start", "end")

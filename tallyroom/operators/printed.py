"""Where numbers are printed: one pass over the texts, then joins by equality.

A number matches its digits under spacing and grouping noise: blanks and commas
may stand between the digits of its whole part, one point or comma with blanks
around it marks the decimals, and no further digit may touch it. So every match
runs from the start of one group of digits to the end of another, and the pass
names each such stretch by the plain number it spells. Only shapes (digits before
and after the point) that some needle has are named, so the index stays near the
size of the printed numbers.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Every mark that ends a line of a page, form feeds included.
LINE_END = r"\r\n|[\n\x0B\x0C\r\x1C-\x1E\x85\u2028\u2029]"

_GROUP, _LINE = re.compile("[0-9]+"), re.compile(LINE_END)
_BLANKS = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
# Magnitude words and letters after a rounded figure, and how far a sign may stand from a number.
_PHRASE = re.compile(r"([0-9]+)\s*[-\u2013]?\s*((?i:billion|million|thousand)|[BMK]\b)")
_POINT = re.compile(r"([0-9]+)\s*[.,]\s*\Z")
_BEFORE, _AFTER = 16, 8
_MINUS, _OPEN, _CLOSE = re.compile(r"[-\u2212]\s*\$?\s*\Z"), re.compile(r"\(\s*\$?\s*\Z"), re.compile(r"\s*\)")

Shapes = dict[int, frozenset[int]]


def is_negative(text: str, start: int, end: int) -> bool:
    """Whether a minus stands before the stretch, or parentheses around it."""
    before = text[max(0, start - _BEFORE) : start]
    return bool(_MINUS.search(before) or (_OPEN.search(before) and _CLOSE.match(text, end, end + _AFTER)))


def stretches(text: str, shapes: Shapes) -> Iterator[tuple[str, int, int, int, int]]:
    """Number, start, end, and first and last group of every stretch of a wanted shape."""
    groups = [(m.start(), m.end()) for m in _GROUP.finditer(text)]
    longest = max(shapes, default=0)
    gaps = [text[a[1] : b[0]] for a, b in zip(groups, groups[1:])] + ["x"]
    bare = [g.strip(_BLANKS) for g in gaps]
    grouping = [not b.strip("," + _BLANKS) for b in bare]
    for i, (start, _) in enumerate(groups):
        whole = ""
        for j in range(i, len(groups)):
            whole += text[groups[j][0] : groups[j][1]]
            if len(whole) > longest:
                break
            decimals = shapes.get(len(whole))
            if decimals:
                if 0 in decimals:
                    yield whole, start, groups[j][1], i, j
                if bare[j] in (".", ","):
                    part, most = "", max(decimals)
                    for k in range(j + 1, len(groups)):
                        part += text[groups[k][0] : groups[k][1]]
                        if len(part) > most:
                            break
                        if len(part) in decimals:
                            yield f"{whole}.{part}", start, groups[k][1], i, k
                        if bare[k]:
                            break
            if not grouping[j]:
                break


def phrases(text: str) -> Iterator[tuple[str, int, int]]:
    """Rounded figures in words, ``1.5 million`` or ``887 M``: every ending of the
    digits that stand before the word, and with one decimal every ending of the
    digits before that."""
    for m in _PHRASE.finditer(text):
        word = m[2].lower() if len(m[2]) > 1 else m[2]
        ends = [(m.start(1) + k, m[1][k:]) for k in range(len(m[1]))]
        point = len(m[1]) == 1 and _POINT.search(text, max(0, m.start() - 60), m.start())
        if point:
            ends += [(point.start(1) + k, f"{point[1][k:]}.{m[1]}") for k in range(len(point[1]))]
        for start, number in ends:
            yield f"{number} {word}", start, m.end()


def indexed(text: str, shapes: Shapes, words: bool) -> dict[str, list]:
    """Per number: lines that hold it whole, and how often it stands there without
    and with a negative sign."""
    found: dict[str, list] = {}
    breaks = [m.start() for m in _LINE.finditer(text)]

    def add(number: str, start: int, end: int) -> None:
        one = found.setdefault(number, [set(), 0, 0, 0])
        if start < one[3]:
            return  # it overlaps the match before it
        one[3] = end
        line = bisect_right(breaks, start)
        if bisect_right(breaks, end - 1) == line:
            one[0].add(line)
        one[1 + is_negative(text, start, end)] += 1

    for number, start, end, _, _ in stretches(text, shapes):
        add(number, start, end)
    if words:
        for number, start, end in phrases(text):
            add(number, start, end)
    return found


def wanted_shapes(needles: DataFrame, number: str = "number") -> tuple[Shapes, bool]:
    """Digits before the point and after it that needles have: one entry per count
    of digits, not per needle. And whether any is a phrase."""
    value = F.col(number)
    whole, part = F.length(F.substring_index(value, ".", 1)), F.length(F.substring_index(value, ".", -1))
    is_phrase = value.contains(" ")
    rows = needles.select(
        F.when(is_phrase, -1).otherwise(whole).alias("w"), F.when(~is_phrase & value.contains("."), part).otherwise(0).alias("p")
    ).distinct().collect()
    shapes: dict[int, set[int]] = {}
    for r in rows:
        if r.w is not None and r.w >= 0:
            shapes.setdefault(r.w, set()).add(r.p)
    return {k: frozenset(v) for k, v in shapes.items()}, any(r.w == -1 for r in rows)


def number_index(texts: DataFrame, keys: list[str], wanted: tuple[Shapes, bool], text: str = "text") -> DataFrame:
    """One row per text and number: ``keys``, ``number``, ``lines`` (from 0, those
    that hold it whole), ``positives`` and ``negatives``; numbers of the shapes in
    ``wanted`` (see ``wanted_shapes``)."""
    shapes, words = wanted
    source = texts.select(*keys, F.coalesce(F.col(text), F.lit("")).alias("_indexed")).filter(F.col("_indexed").rlike("[0-9]"))
    added = StructType.fromDDL("number string, lines array<int>, positives int, negatives int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [indexed(t, shapes, words) for t in batch.column("_indexed").to_pylist()]
            at = pa.array([k for k, f in enumerate(found) for _ in f], pa.int64())
            held = [v for f in found for v in f.values()]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(k).take(at) for k in keys), pa.array([n for f in found for n in f], pa.string()),
                    pa.array([sorted(v[0]) for v in held], pa.list_(pa.int32())),
                    pa.array([v[1] for v in held], pa.int32()), pa.array([v[2] for v in held], pa.int32()),
                ],
                names=[*keys, *added.names],
            )

    return source.mapInArrow(run, StructType([*(source.schema[k] for k in keys), *added.fields]))

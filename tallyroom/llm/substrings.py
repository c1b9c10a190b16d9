"""Repeated byte strings across documents, found with run-length indexes.

Every byte that lies in a ``WINDOW``-byte string which also starts in a document
with a smaller id is marked, exactly:

1. Each window has a minimiser, the ``GRAM``-byte string in it of smallest hash,
   so equal windows have equal minimisers at equal places. One pass deals the
   minimisers of all documents to buckets of hashes and keeps those that occur
   in two documents at least; the others need no further look.
2. A second pass cuts the context around each kept minimiser, as far as a window
   with it can reach, and merges equal contexts of a task before it deals them.
   Minimisers that very many documents share are dealt by longer strings around
   them (every window holds one of ``FAMILIES`` such strings), so that a common
   line does not end in one task.
3. A bucket builds a run-length index over its distinct contexts and streams
   matching statistics of the contexts through it. Where a match is a window
   long, the row's block of equal windows tells the earliest document.
4. The marked intervals of a document are joined and cut out.

A document equal to one with a smaller id is marked whole at once (from
``WINDOW`` bytes on), so groups of copies never meet. Null texts are empty.
Rows with an equal id are equally early and mark nothing in each other. Rows
without an id stand outside the order: they mark nothing and keep their text.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyroom.llm.runindex import RunIndex
from tallyroom.llm.words import slices
from tallyroom.session import cut_lineage

WINDOW, GRAM = 50, 20
REACH = WINDOW - GRAM
#: Entries of a minimiser from which its contexts are dealt by longer strings, and their step.
HOT, STEP = 1000, 8
FAMILIES = range(0, REACH + 1, STEP)
#: Minimisers of one bucket of the first pass, contexts of one of the second, contexts of one index.
BUCKET, CONTEXTS, INDEX = 250_000, 25_000, 20_000
SPACE = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def grams(data: np.ndarray, size: int) -> np.ndarray:
    """A hash of every ``size``-byte string of ``data``, by doubling."""
    power, width = data.astype(np.uint64) + np.uint64(1), 1
    out, covered, scale = None, 0, SPACE
    while True:
        if size & width:
            if out is None:
                out, covered = power, width
            else:
                n = len(data) - covered - width + 1
                if n <= 0:
                    return np.zeros(0, np.uint64)
                out = out[:n] * scale + power[covered : covered + n]
                covered += width
        if 2 * width > size:
            break
        if len(power) <= width:
            return np.zeros(0, np.uint64)
        power = power[:-width] * scale + power[width:]
        scale = np.uint64(int(scale) * int(scale) & 0xFFFFFFFFFFFFFFFF)
        width *= 2
    return _mix(out)


def _lowest(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours."""
    reach = 1
    while 2 * reach <= width:
        values = np.minimum(values[:-reach], values[reach:])
        reach *= 2
    rest = width - reach
    return np.minimum(values[:-rest], values[rest:]) if rest else values


def minimisers(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the minimisers of all windows (with all ties)."""
    if len(text) < WINDOW:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    hashed = grams(np.frombuffer(text, np.uint8), GRAM)
    width = REACH + 1
    least = _lowest(hashed, width)
    # a gram is a minimiser if one of the windows around it has no smaller one
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    padded = np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)])
    most = top - _lowest(top - padded, width)
    at = np.flatnonzero(hashed == most[: len(hashed)])
    return at, hashed[at]


def _blobs(bucket: np.ndarray, columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    """One row per bucket with the compressed bytes of every column."""
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    begin = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    end = np.append(begin[1:], len(bucket))
    cut = {name: values[order] for name, values in columns.items()}
    return pa.RecordBatch.from_arrays(
        [pa.array(bucket[begin], pa.int32())]
        + [pa.array([zlib.compress(v[a:b].tobytes(), 1) for a, b in zip(begin, end)], pa.binary()) for v in cut.values()],
        names=["bucket", *cut],
    )


def _read(group: pa.Table, name: str, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(map(zlib.decompress, group.column(name).to_pylist())), kind)


def repeated(documents: DataFrame, buckets: int) -> DataFrame:
    """name, places: minimisers that occur in several texts (a text goes by its
    name, so copies are one); a place is twice its offset, plus one if it is hot."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent, held, size = set(), [], 0

        def flush() -> pa.RecordBatch:
            hashed, name, place = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(hashed, kind="stable")
            hashed, name, place = hashed[order], name[order], place[order]
            return _blobs((hashed % np.uint64(buckets)).astype(np.int64), {"hash": hashed, "name": name, "place": place})

        for batch in batches:
            for part, texts in slices(batch, "text"):
                for name, text in zip(part.column("name").to_pylist(), texts):
                    data = text.encode("utf-8", "surrogatepass")
                    digest = hashlib.blake2b(data, digest_size=12).digest()
                    # a text is sent once by a task, however many copies there are
                    if len(data) < WINDOW or digest in sent:
                        continue
                    sent.add(digest)
                    at, hashed = minimisers(data)
                    held.append((hashed, np.full(len(at), name, np.int64), at))
                    size += len(at)
                if size > 1_500_000:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    def keep(key: tuple, group: pa.Table) -> pa.Table:
        hashed, name, place = _read(group, "hash", "<u8"), _read(group, "name", "<i8"), _read(group, "place", "<i8")
        order = np.argsort(hashed, kind="stable")
        hashed, name, place = hashed[order], name[order], place[order]
        begin = np.flatnonzero(np.append(True, hashed[1:] != hashed[:-1])) if len(hashed) else np.zeros(0, np.int64)
        size = np.diff(np.append(begin, len(hashed)))
        several = np.minimum.reduceat(name, begin) < np.maximum.reduceat(name, begin) if len(begin) else np.zeros(0, bool)
        good = np.repeat(several, size)
        name, place = name[good], 2 * place[good] + np.repeat(size >= HOT, size)[good]
        order = np.lexsort((place, name))
        name, place = name[order], place[order]
        at = np.flatnonzero(np.append(True, name[1:] != name[:-1])) if len(name) else np.zeros(0, np.int64)
        end = np.append(at[1:], len(name))
        return pa.table({
            "name": pa.array(name[at], pa.int64()),
            "places": pa.array([place[a:b].astype("<i8").tobytes() for a, b in zip(at, end)], pa.binary()),
        })

    dealt = documents.mapInArrow(send, "bucket int, hash binary, name binary, place binary")
    found = dealt.groupBy("bucket").applyInArrow(keep, "name bigint, places binary")
    # at most the minimisers of a text
    return found.groupBy("name").agg(F.collect_list("places").alias("places"))


def _cuts(place: int, hot: int, size: int) -> list[tuple[int, int, int, int]]:
    """Contexts (begin, end) of a minimiser and the string (begin, end) that deals each."""
    if not hot:
        return [(max(place - REACH, 0), min(place + WINDOW, size), place, place + GRAM)]
    cuts = []
    for left in FAMILIES:  # windows that begin left .. left + step - 1 before the minimiser
        step = min(STEP, REACH - left + 1)
        begin, end = max(place - left - step + 1, 0), min(place - left + WINDOW, size)
        cuts.append((begin, end, place - left, place - left - step + 1 + WINDOW))
    return [c for c in cuts if c[1] - c[0] >= WINDOW and c[2] >= 0 and c[3] <= size]


#: Signed sizes: a context has its bytes in ``bytes``; an interval that needs no look at others has -length.
ENTRY = "bucket int, key binary, doc binary, name binary, begin binary, size binary, bytes binary"


def contexts(met: DataFrame, buckets: int) -> DataFrame:
    """Blobs of contexts by bucket. Of equal contexts a task sends the earliest
    document's; the others are marked there and then."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first: dict[tuple[bytes, bytes], list[tuple]] = {}
        told: list[tuple] = []
        bulk = 0

        def flush() -> pa.RecordBatch:
            rows = sorted(((k[0], k[1], *e) for k, es in first.items() for e in es), key=lambda r: r[:2])
            key = np.array([int.from_bytes(r[0], "little") for r in rows] + [0] * len(told), np.uint64)
            mine = _mix(np.array([t[0] for t in told], np.int64).astype(np.uint64))
            bucket = (np.concatenate([key[: len(rows)], mine]) % np.uint64(buckets)).astype(np.int64)
            size = np.array([len(r[1]) for r in rows] + [-t[3] for t in told], np.int64)
            column = lambda i: np.array([r[i + 2] for r in rows] + [t[i] for t in told], np.int64)
            blobs = _blobs(bucket, {"key": key, "doc": column(0), "name": column(1), "begin": column(2), "size": size})
            order = np.argsort(bucket, kind="stable")
            edge = np.flatnonzero(np.append(True, np.diff(bucket[order]) != 0))
            data = [
                zlib.compress(b"".join(rows[k][1] for k in order[a:b] if k < len(rows)), 1)
                for a, b in zip(edge, np.append(edge[1:], len(order)))
            ]
            return pa.RecordBatch.from_arrays([*blobs.columns, pa.array(data, pa.binary())], names=[*blobs.schema.names, "bytes"])

        for batch in batches:
            for doc, name, packed, places in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "name", "data", "places"))):
                data = zlib.decompress(packed)
                place = np.unique(np.frombuffer(b"".join(places), "<i8"))
                for p, hot in zip((place >> 1).tolist(), (place & 1).tolist()):
                    if p + GRAM > len(data) or len(data) < WINDOW:
                        continue  # a place of another text under the same id
                    for begin, end, a, b in _cuts(p, hot, len(data)):
                        around = data[begin:end]
                        key = hashlib.blake2b(data[a:b], digest_size=8).digest()
                        entry, known = (doc, name, begin), first.get((key, around))
                        if known is None or doc < known[0][0]:
                            if known:
                                told += [(*e, len(around)) for e in known]
                            first[key, around] = [entry]
                            bulk += len(around) + 200
                        elif doc > known[0][0]:
                            told.append((*entry, len(around)))
                            bulk += 100
                        else:
                            known.append(entry)
                            bulk += 100
                if bulk > 60_000_000:
                    yield flush()
                    first, told, bulk = {}, [], 0
        if first or told:
            yield flush()

    return met.mapInArrow(send, ENTRY)


def early(asked: list[bytes], asked_in: np.ndarray, held: list[bytes], held_in: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows of the ``asked`` strings that a string of ``held`` with a
    smaller document has too: number of the string, first and last start. More
    strings than an index takes go through the indexes of all blocks."""
    far = np.iinfo(np.int64).max
    blocks = range(0, len(asked), INDEX)
    least: list[np.ndarray | None] = [None] * len(blocks)
    for at in range(0, len(held), INDEX):
        index = RunIndex(held[at : at + INDEX], WINDOW)
        first = index.earliest(held_in[at : at + INDEX])
        for k, other in enumerate(blocks):
            _, length, _, row = index.stream(asked[other : other + INDEX])
            value = np.where(length >= WINDOW, first[row], far)
            least[k] = value if least[k] is None else np.minimum(least[k], value)
    # A match never passes the end of its string, so no run of places does.
    offset = np.cumsum([0, *(len(s) + 1 for s in asked)])
    hits = np.concatenate([x for x in least if x is not None] or [np.zeros(0, np.int64)])
    hits = np.flatnonzero(hits < np.repeat(asked_in, np.diff(offset))[: len(hits)])
    edge = np.flatnonzero(np.append(True, np.diff(hits) > 1)) if len(hits) else np.zeros(0, np.int64)
    begin, end = hits[edge], hits[np.append(edge[1:], len(hits)) - 1] if len(hits) else hits
    string = np.searchsorted(offset, begin, "right") - 1
    return string, begin - offset[string], end - offset[string]


def _near(firsts: list[tuple[bytes, list[int]]]) -> list[tuple[bytes, list[int]]]:
    """The contexts of one minimiser that can hold a window of another one: a window
    reaches half of ``REACH`` to one side of the minimiser at least, so the two
    agree there. Contexts cut by an edge of their text are not told apart."""
    half = REACH // 2
    if len(firsts) < 2 or any(len(t) != REACH + WINDOW for t, _ in firsts):
        return firsts
    left = Counter(t[half:REACH] for t, _ in firsts)
    right = Counter(t[WINDOW : WINDOW + half] for t, _ in firsts)
    return [(t, e) for t, e in firsts if left[t[half:REACH]] > 1 or right[t[WINDOW : WINDOW + half]] > 1]


def marks(dealt: DataFrame) -> DataFrame:
    """doc_id, name, spans (begin, end, begin, end, ...) from the buckets."""

    def match(key: tuple, group: pa.Table) -> pa.Table:
        keys, doc, name, begin, size = (
            _read(group, c, k) for c, k in (("key", "<u8"), ("doc", "<i8"), ("name", "<i8"), ("begin", "<i8"), ("size", "<i8"))
        )
        data = b"".join(map(zlib.decompress, group.column("bytes").to_pylist()))
        told = size < 0
        out = [(doc[told], name[told], begin[told], begin[told] - size[told])]
        ends = np.cumsum(np.maximum(size, 0))
        by_key: dict[int, dict[bytes, list[int]]] = {}
        met = np.flatnonzero(~told)
        _, group_of, members = np.unique(keys[met], return_inverse=True, return_counts=True)
        met = met[members[group_of] > 1]  # a context alone meets nothing
        for at, key, left, right in zip(met.tolist(), keys[met].tolist(), (ends - np.abs(size))[met].tolist(), ends[met].tolist()):
            by_key.setdefault(key, {}).setdefault(data[left:right], []).append(at)
        where = doc.tolist()
        found: list[tuple[int, int, int]] = []
        asked: list[bytes] = []
        owners: list[list[int]] = []
        held: list[bytes] = []
        held_in: list[int] = []

        def look() -> None:
            asked_in = np.array([where[o[0]] for o in owners], np.int64)
            string, first, last = early(asked, asked_in, held, np.array(held_in, np.int64))
            copies = np.array([len(o) for o in owners], np.int64)
            entry, start = np.array([e for o in owners for e in o], np.int64), np.cumsum(copies) - copies
            times = copies[string]
            step = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            entry = entry[np.repeat(start[string], times) + step]
            left, right = np.repeat(first, times), np.repeat(last, times) + WINDOW
            out.append((doc[entry], name[entry], begin[entry] + left, begin[entry] + right))
            for part in (asked, owners, held, held_in):
                part.clear()

        for texts in by_key.values():
            firsts = []
            for text, entries in texts.items():
                if len(entries) > 1:
                    least = min(where[e] for e in entries)
                    found += [(e, 0, len(text)) for e in entries if where[e] > least]
                    entries = [e for e in entries if where[e] == least]
                firsts.append((text, entries))
            if len(firsts) < 2:
                continue
            firsts = _near(firsts)
            documents = [where[e[0]] for _, e in firsts]
            low, high = min(documents, default=0), max(documents, default=0)
            # Nothing here is earlier than the first document, or later than the last.
            for (text, entries), at in zip(firsts, documents):
                if at > low:
                    asked.append(text)
                    owners.append(entries)
                if at < high:
                    held.append(text)
                    held_in.append(at)
            if len(asked) >= INDEX or len(held) >= INDEX:
                look()
        if asked:
            look()
        hit = np.array(found, np.int64).reshape(-1, 3)
        out.append((doc[hit[:, 0]], name[hit[:, 0]], begin[hit[:, 0]] + hit[:, 1], begin[hit[:, 0]] + hit[:, 2]))
        doc, name, left, right = (np.concatenate(x) for x in zip(*out))
        order = np.lexsort((left, name, doc))
        doc, name, left, right = doc[order], name[order], left[order], right[order]
        new = np.append(True, (np.diff(doc) != 0) | (np.diff(name) != 0)) if len(doc) else np.zeros(0, bool)
        # The texts side by side, so far apart that no interval touches the next text's.
        shift = (np.cumsum(new) - 1) * (right.max(initial=0) + 1)
        spans = union(np.stack([left + shift, right + shift], axis=1))
        at = np.flatnonzero(new)
        edge = np.searchsorted(spans[:, 0], shift[at])
        spans -= np.repeat(shift[at], np.diff(np.append(edge, len(spans))))[:, None]
        return pa.table({
            "doc_id": pa.array(doc[at], pa.int64()), "name": pa.array(name[at], pa.int64()),
            "spans": pa.ListArray.from_arrays(pa.array(2 * np.append(edge, len(spans)), pa.int32()), pa.array(spans.ravel(), pa.int64())),
        })

    return dealt.groupBy("bucket").applyInArrow(match, "doc_id bigint, name bigint, spans array<bigint>")


def union(spans: np.ndarray) -> np.ndarray:
    """Maximal intervals of a list of intervals; touching ones join."""
    if not len(spans):
        return spans
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.append(True, spans[1:, 0] > reach[:-1])
    last = np.append(np.flatnonzero(new)[1:], len(spans)) - 1
    return np.stack([spans[new, 0], reach[last]], axis=1)


def packed_texts(rows: DataFrame) -> DataFrame:
    """doc_id, name, and the compressed bytes of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, "text"):
                data = [zlib.compress(t.encode("utf-8", "surrogatepass"), 3) for t in texts]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("name"), pa.array(data, pa.binary())], names=["doc_id", "name", "data"])

    return rows.mapInArrow(run, "doc_id bigint, name bigint, data binary")


def remove_repeats(documents: DataFrame, text: str = "text", with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row; with
    ``with_text=True`` also ``removed`` (begin, end, ...) and ``kept`` bytes."""
    rows = documents.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")
    ).withColumn("name", F.xxhash64("text"))
    known = rows.filter(F.col("doc_id").isNotNull())
    total = known.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    places = cut_lineage(repeated(known.select("name", "text"), max(8, -(-total // (16 * BUCKET)))))
    held = F.aggregate("places", F.lit(0), lambda n, b: n + F.octet_length(b))
    count = (places.agg(F.sum(held)).first()[0] or 0) // 8

    # Equal texts: all but the earliest are marked whole, and need no search.
    whole = known.select("doc_id", "name", F.sha2("text", 256).alias("sha"), F.octet_length("text").cast("bigint").alias("n")).filter(F.col("n") >= WINDOW)
    earliest = whole.groupBy("sha").agg(F.min("doc_id").alias("first"))
    judged = cut_lineage(whole.join(earliest, "sha").select("doc_id", "name", "n", (F.col("doc_id") > F.col("first")).alias("copy")))
    copies = judged.filter("copy").select("doc_id", "name", F.array(F.lit(0).cast("bigint"), "n").alias("spans"))
    search = places.join(judged.filter("NOT copy").select("doc_id", "name").distinct(), "name")

    met = packed_texts(known).join(search, ["doc_id", "name"]).select("doc_id", "name", "data", "places")
    found = marks(contexts(met, max(8, -(-count // CONTEXTS))))
    spans = found.unionAll(copies).groupBy("doc_id", "name").agg(F.flatten(F.collect_list("spans")).alias("spans"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for packed, marked in zip(batch.column("data").to_pylist(), batch.column("spans").to_pylist()):
                data = zlib.decompress(packed)
                runs = union(np.array(marked or [], np.int64).reshape(-1, 2)).tolist()
                edge = [0, *(x for run in runs for x in run), len(data)]
                kept = b"".join(data[a:b] for a, b in zip(edge[::2], edge[1::2]))
                out.append((len(data), len(data) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), edge[1:-1], kept))
            columns = list(zip(*out)) or [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.binary()][: 6 if with_text else 4]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id")] + [pa.array(list(c), k) for c, k in zip(columns, kinds)],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed", "kept"][: 1 + len(kinds)],
            )

    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
    return packed_texts(rows).join(spans, ["doc_id", "name"], "left").select("doc_id", "data", "spans").mapInArrow(
        cut, schema + ", removed array<bigint>, kept binary" * with_text
    )

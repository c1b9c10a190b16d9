"""Documents linked by the Jaccard similarity of their five-word shingles.

1. One pass makes a row per document (size and number of its set) and counts
   shingles in 2 ** COUNTERS counters. Equal sets are one node from here on.
2. A second pass orders every set from rare to frequent by those counters (any
   fixed order is exact, this one keeps lists short) and deals its prefix, the
   part that two linked sets must share an element of, to buckets of elements.
   A map task sends a set once, however many copies of it there are. A bucket
   keeps the elements that several sets of compatible sizes share; there sets
   meet by parity sketches. The sketch of a set has a bit for every class of a
   hash, flipped by each element of it, so two sketches differ in no more bits
   than the sets differ in elements: a pair that is linked always passes, and
   sets that share a passage hardly ever do. What passes gives candidate groups.
3. Groups, split into pairs of blocks where they are large, are joined exactly
   by set-relation skipping. Index lists are ordered by set size, so a lookup
   jumps over all positions whose sizes cannot match. The overlaps of a set
   follow from those of the highly similar set before it: only the lists of the
   elements in which the two differ are read. Groups send a spanning forest of
   their links, never all pairs.

A null, empty or blank text has no shingles and links with nothing. Repeated
rows are equal sets. Rows without an id keep their size but have no component.
A node is a 64-bit hash of the whole set and its size.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyroom.llm.components import components
from tallyroom.llm.shingles import Shingler
from tallyroom.llm.words import all_columns, gather, share, shared, slices
from tallyroom.session import cut_lineage

#: Links: WHOLE * intersection >= PART * union.
PART, WHOLE = 75, 100
COUNTERS, SLOT = 22, 1 << 16
#: Tasks whose counters are summed apart at first.
PARTS = 256
#: Shingles of one bucket of prefixes, and of one block of a candidate group.
BUCKET, BLOCK = 4_000_000, 1_000_000
#: Entries of shared elements in one task, and the longest list whose sets meet one by one there.
LISTS, LONGEST = 40_000, 4096
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def counter(hashed: np.ndarray) -> np.ndarray:
    return ((hashed * GOLDEN) >> np.uint64(64 - COUNTERS)).astype(np.int64)


def sets_of(texts: list[str], shingler: Shingler) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of every text (ascending), their offsets and the node of each set."""
    hashed, offset = shingler.run(texts)
    owner = np.repeat(np.arange(len(texts)), np.diff(offset))
    for a, b in zip(offset[:-1].tolist(), offset[1:].tolist()):
        hashed[a:b].sort()
    first = np.ones(len(hashed), bool)
    first[1:] = (hashed[1:] != hashed[:-1]) | (owner[1:] != owner[:-1])
    hashed, owner = hashed[first], owner[first]
    size = np.bincount(owner, minlength=len(texts))
    offset = np.concatenate([[0], np.cumsum(size)])
    mixed = (hashed ^ (hashed >> np.uint64(32))) * GOLDEN
    mixed ^= mixed >> np.uint64(29)
    total = np.concatenate([[np.uint64(0)], np.cumsum(mixed * np.uint64(0xBF58476D1CE4E5B9), dtype=np.uint64)])
    node = (total[offset[1:]] - total[offset[:-1]]) * GOLDEN + size.astype(np.uint64)
    return hashed, offset, node.view(np.int64)


def sketch(hashed: np.ndarray) -> bytes:
    """Parity of the elements in every class; as many classes as elements, at least 128."""
    classes = max(128, 1 << max(len(hashed) - 1, 0).bit_length())
    mixed = (hashed ^ (hashed >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    odd = np.bincount(((mixed >> np.uint64(20)) & np.uint64(classes - 1)).astype(np.int64), minlength=classes) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def halved(sketches: np.ndarray) -> np.ndarray:
    """Sketches with half as many classes."""
    words = sketches.shape[1] // 2
    return sketches[:, :words] ^ sketches[:, words:]


def profile(documents: DataFrame, text: str) -> DataFrame:
    """Rows of two kinds: (doc_id, mark, n, node, sketch) per document, mark a hash of its
    text; (slot, part, counts) per task and slot of counters, packed."""
    source = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text).alias("mark"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, counts = Shingler(), np.zeros(1 << COUNTERS, np.uint32)
        part_of = TaskContext.get().partitionId() % PARTS

        def rows(ids, mark, n, node, bits, slot, count) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(mark, pa.int64()), pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(bits, pa.binary()),
                 pa.array(slot, pa.int32()), pa.array([None if s is None else part_of for s in slot], pa.int32()), pa.array(count, pa.binary())],
                names=["doc_id", "mark", "n", "node", "sketch", "slot", "part", "counts"],
            )

        for batch in batches:
            for part, texts in slices(batch, "text"):
                hashed, offset, node = sets_of(texts, shingler)
                counts += np.bincount(counter(hashed), minlength=1 << COUNTERS).astype(np.uint32)
                none = [None] * len(texts)
                bits = [sketch(hashed[a:b]) for a, b in zip(offset[:-1].tolist(), offset[1:].tolist())]
                yield rows(part.column("doc_id"), part.column("mark"), np.diff(offset), node, bits, none, none)
        used = [k for k in range(0, 1 << COUNTERS, SLOT) if counts[k : k + SLOT].any()]
        none = [None] * len(used)
        yield rows(none, none, none, none, none, [k // SLOT for k in used], [zlib.compress(counts[k : k + SLOT].tobytes(), 1) for k in used])

    return source.mapInArrow(run, "doc_id bigint, mark bigint, n bigint, node bigint, sketch binary, slot int, part int, counts binary")


def frequencies(profiled: DataFrame) -> np.ndarray:
    """The counters over all documents, as steps of a quarter of a power of two: a
    list of fixed length, one byte each. Tasks are summed in two levels."""

    def add(key: tuple, group: pa.Table) -> pa.Table:
        total = np.zeros(SLOT, np.uint64)
        for packed in group.column("counts").to_pylist():
            data = zlib.decompress(packed)
            total += np.frombuffer(data, "<u4" if len(data) == 4 * SLOT else "<u8").astype(np.uint64)
        return pa.table({"slot": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})

    out = "slot int, counts binary"
    rows = profiled.filter("slot IS NOT NULL").select("slot", "part", "counts")
    some = rows.groupBy("slot", "part").applyInArrow(add, out)
    steps = np.zeros(1 << COUNTERS, np.uint8)
    for r in some.groupBy("slot").applyInArrow(add, out).collect():
        count = np.frombuffer(zlib.decompress(r.counts), "<u8").astype(float)
        steps[r.slot * SLOT : (r.slot + 1) * SLOT] = np.round(4 * np.log2(count + 1)).astype(np.uint8)
    return steps


def shared_elements(documents: DataFrame, text: str, frequency: np.ndarray, buckets: int) -> DataFrame:
    """element, node: prefix elements that several nodes of compatible sizes share."""
    handle = share(documents.sparkSession, frequency)  # 2 ** COUNTERS numbers
    source = documents.filter(F.col("doc_id").isNotNull()).select(F.col(text).alias("text"))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, count, sent, held, size = Shingler(), shared(handle), set(), [], 0

        def flush() -> pa.RecordBatch:
            element, node, n = (np.concatenate(x) for x in zip(*held))
            bucket = (element % np.uint64(buckets)).astype(np.int64)
            order = np.lexsort((element, bucket))
            element, node, n, bucket = element[order], node[order], n[order], bucket[order]
            begin = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
            end = np.append(begin[1:], len(bucket))
            return pa.RecordBatch.from_arrays(
                [pa.array(bucket[begin], pa.int32())]
                + [pa.array([x[a:b].tobytes() for a, b in zip(begin, end)], pa.binary()) for x in (element, node, n)],
                names=["bucket", "element", "node", "n"],
            )

        for batch in batches:
            for _, texts in slices(batch, "text"):
                hashed, offset, node = sets_of(texts, shingler)
                fresh = []
                for at, name in enumerate(node.tolist()):
                    if offset[at + 1] > offset[at] and name not in sent:
                        sent.add(name)
                        fresh.append(at)
                fresh = np.array(fresh, np.int64)
                hashed, offset = gather(hashed, offset, fresh)
                n = np.diff(offset)
                length = n - -(-PART * n // WHOLE) + 1
                step = count[counter(hashed)]
                order = [
                    a + np.argsort(step[a:b], kind="stable")[:k]
                    for a, b, k in zip(offset[:-1].tolist(), offset[1:].tolist(), length.tolist())
                ]
                if order:
                    held.append((hashed[np.concatenate(order)], np.repeat(node[fresh], length), np.repeat(n.astype(np.int32), length)))
                    size += int(length.sum())
                if size > 2_000_000:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    def chain(key: tuple, group: pa.Table) -> pa.Table:
        read = lambda name, kind: np.frombuffer(b"".join(group.column(name).to_pylist()), kind)
        element, node, n = read("element", "<u8"), read("node", "<i8"), read("n", "<i4").astype(np.int64)
        order = np.lexsort((node, n, element))
        element, node, n = element[order], node[order], n[order]
        new = np.ones(len(node), bool)
        new[1:] = (element[1:] != element[:-1]) | (WHOLE * n[:-1] < PART * n[1:])
        # one list per element and stretch of compatible sizes, each node once
        again = ~new
        again[1:] &= node[1:] == node[:-1]
        first, node, n = np.cumsum(new)[~again] - 1, node[~again], n[~again]
        lists = element[new]
        size = np.bincount(first, minlength=len(lists))
        several = size[first] > 1
        name = (lists * GOLDEN + np.arange(len(lists), dtype=np.uint64))[first[several]]
        return pa.table({"element": pa.array(name.view(np.int64), pa.int64()), "node": pa.array(node[several], pa.int64())})

    dealt = source.mapInArrow(prefixes, "bucket int, element binary, node binary, n binary")
    return dealt.groupBy("bucket").applyInArrow(chain, "element bigint, node bigint")


def near_pairs(nodes: np.ndarray, sizes: np.ndarray, sketches: list[bytes]) -> list[tuple[int, int]]:
    """A forest over the pairs of one list whose sizes and sketches allow a link."""
    root = {}

    def top(k: int) -> int:
        while root.setdefault(k, k) != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    edges = []
    words = np.array([len(s) // 8 for s in sketches])
    for width in np.unique(words).tolist():  # sizes of linked sets differ by less than two
        own = np.flatnonzero((words == width) | (words == 2 * width))
        bits = np.stack([
            w if len(w) == width else halved(w[None])[0] for w in (np.frombuffer(sketches[k], "<u8") for k in own.tolist())
        ])
        for i in range(len(own) - 1):
            apart = np.bitwise_count(bits[i + 1 :] ^ bits[i]).sum(axis=1, dtype=np.int64)
            # WHOLE * (s - d) >= PART * (s + d) for total size s and difference d
            both = sizes[own[i + 1 :]] + sizes[own[i]]
            # two sets with finer sketches meet at their own width
            here = (words[own[i]] == width) | (words[own[i + 1 :]] == width)
            for j in np.flatnonzero(here & ((WHOLE + PART) * apart <= (WHOLE - PART) * both)).tolist():
                a, b = top(int(own[i])), top(int(own[i + 1 + j]))
                if a != b:
                    root[max(a, b)] = min(a, b)
                    edges.append((int(nodes[own[i]]), int(nodes[own[i + 1 + j]])))
    return edges


def candidates(shared_: DataFrame, sizes: DataFrame) -> DataFrame:
    """Edges (a, b) of candidate groups, from lists of nodes that share an element."""
    count = shared_.count()
    parts = max(8, -(-count // LISTS))
    met = shared_.join(sizes.select("node", "n", "sketch"), "node").withColumn("part", F.pmod(F.xxhash64("element"), F.lit(parts)).cast("int"))

    def meet(key: tuple, group: pa.Table) -> pa.Table:
        group = group.sort_by([("element", "ascending"), ("n", "ascending"), ("node", "ascending")])
        element, node, n = (group.column(c).to_numpy() for c in ("element", "node", "n"))
        begin = np.flatnonzero(np.append(True, element[1:] != element[:-1]))
        edges: set[tuple[int, int]] = set()
        bits = group.column("sketch")
        for a, b in zip(begin.tolist(), np.append(begin[1:], len(element)).tolist()):
            if b - a > LONGEST:  # too many to meet here: all of them stay candidates
                edges.update((int(node[a]), int(x)) for x in node[a + 1 : b])
            else:
                edges.update(near_pairs(node[a:b], n[a:b], bits.slice(a, b - a).to_pylist()))
        pair = np.array(sorted(edges), np.int64).reshape(-1, 2)
        return pa.table({"a": pa.array(pair[:, 0], pa.int64()), "b": pa.array(pair[:, 1], pa.int64())})

    return met.groupBy("part").applyInArrow(meet, "a bigint, b bigint")


def linked(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """A spanning forest of the links among sets (ascending arrays), as index pairs."""
    count = len(sets)
    if count < 2:
        return []
    order = sorted(range(count), key=lambda k: len(sets[k]))
    size = np.array([len(sets[k]) for k in order], np.int64)
    flat = np.concatenate([sets[k] for k in order])
    token = np.unique(flat, return_inverse=True)[1]
    offset = np.concatenate([[0], np.cumsum(size)])
    owner = np.repeat(np.arange(count), size)
    # Index lists one after another; positions in a list ascend with the size of the set.
    place = np.sort(token * count + owner)
    lists = lambda tokens, low, high: (
        np.searchsorted(place, tokens * count + low), np.searchsorted(place, tokens * count + high)
    )

    def overlap(tokens: np.ndarray, low: int, high: int) -> np.ndarray:
        begin, end = lists(tokens, low, high)  # jumps over the blocks of other sizes
        flat_place = gather(place, np.stack([begin, end], axis=1).ravel(), np.arange(0, 2 * len(tokens), 2))[0]
        return np.bincount(flat_place % count - low, minlength=high - low)

    parent = list(range(count))

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    edges = []
    own = [token[offset[k] : offset[k + 1]] for k in range(count)]
    # Similar sets follow one another: they often share their smallest elements.
    walk = sorted(range(count), key=lambda k: flat[offset[k] : offset[k] + 4].tolist())
    last, answer, low, high = -1, None, 0, 0
    for k in walk:
        least, most = (int(np.searchsorted(size, -(-PART * size[k] // WHOLE), "left")),
                       int(np.searchsorted(size, size[k] * WHOLE // PART, "right")))
        derived = False
        if last >= 0 and low <= least and most <= high:
            gone, came = np.setdiff1d(own[last], own[k], True), np.setdiff1d(own[k], own[last], True)
            if 2 * (len(gone) + len(came)) < size[k]:
                answer = answer - overlap(gone, low, high) + overlap(came, low, high)
                derived = True
        if not derived:
            # a wider window than this set needs, so that similar sets can reuse it
            low, high = (int(np.searchsorted(size, size[k] * 6 // 10, "left")), int(np.searchsorted(size, size[k] * 10 // 6 + 1, "right")))
            answer = overlap(own[k], low, high)
        last = k
        both = size[low:high] + size[k] - answer
        for other in (np.flatnonzero(WHOLE * answer >= PART * both) + low).tolist():
            a, b = root(k), root(other)
            if a != b:
                parent[max(a, b)] = min(a, b)
                edges.append((order[k], order[other]))
    return edges


def links(documents: DataFrame, text: str, groups: DataFrame, sizes: DataFrame) -> DataFrame:
    """Edges (a, b) of a spanning forest inside every part of every candidate group.

    ``groups``: node, root; ``sizes``: node, n and one document (doc) of each node.
    """
    known = groups.join(sizes, "node")
    blocks = known.groupBy("root").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("blocks"))
    dealt = known.join(blocks, "root").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    source = documents.select(F.col("doc_id").cast("bigint").alias("doc"), F.col(text).alias("text"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, "text"):
                data = [zlib.compress(t.encode("utf-8", "surrogatepass"), 1) for t in texts]
                yield pa.RecordBatch.from_arrays([part.column("doc"), pa.array(data, pa.binary())], names=["doc", "data"])

    met = source.mapInArrow(pack, "doc bigint, data binary").join(dealt.select("doc", "node", "root", "blocks", "own"), "doc")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    parts = met.withColumn("_other", other).select(
        "node", "data", "root", F.least("own", "_other").alias("left"), F.greatest("own", "_other").alias("right")
    )

    def join(key: tuple, group: pa.Table) -> pa.Table:
        shingler, found = Shingler(), {}
        packed, names = group.column("data").to_pylist(), group.column("node").to_pylist()
        for at in range(0, len(names), 256):
            texts = [zlib.decompress(d).decode("utf-8", "surrogatepass") for d in packed[at : at + 256]]
            hashed, offset, node = sets_of(texts, shingler)
            for name, wanted, a, b in zip(node.tolist(), names[at : at + 256], offset[:-1], offset[1:]):
                if name == wanted:  # of several texts under one id, the one that is the node
                    found[name] = hashed[a:b].copy()
        nodes = sorted(found)
        pair = np.array(linked([found[n] for n in nodes]), np.int64).reshape(-1, 2)
        node = np.array(nodes, np.int64)
        return pa.table({"a": pa.array(node[pair[:, 0]], pa.int64()), "b": pa.array(node[pair[:, 1]], pa.int64())})

    return parts.groupBy("root", "left", "right").applyInArrow(join, "a bigint, b bigint")


def rooted(documents: DataFrame, text: str) -> tuple[DataFrame, DataFrame]:
    """doc_id, mark, n, node of every row; node, root, n of every set that has an id,
    with the smallest id (doc) of its rows and the text (mark) of that."""
    profiled = cut_lineage(profile(documents, text))
    rows = profiled.filter("slot IS NULL").select("doc_id", "mark", "n", "node")
    nodes = (
        profiled.filter("slot IS NULL AND n > 0 AND doc_id IS NOT NULL")
        .groupBy("node").agg(F.min(F.struct("doc_id", "mark")).alias("least"), F.max("n").alias("n"), F.min("sketch").alias("sketch"))
        .select("node", F.col("least.doc_id").alias("doc"), F.col("least.mark").alias("mark"), "n", "sketch")
    )
    total = rows.agg(F.sum("n")).first()[0] or 0
    lists = cut_lineage(shared_elements(documents, text, frequencies(profiled), max(8, -(-total // BUCKET))))
    groups = components(candidates(lists, nodes))
    roots = components(links(documents, text, groups, nodes.select("node", "doc", "n")))
    return rows, nodes.drop("sketch").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def jaccard_components(documents: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    rows, named = rooted(documents, text)
    least = named.groupBy("root").agg(F.min("doc").alias("component_id"))
    of_node = named.join(least, "root").select("node", "component_id")
    alone = F.when(F.col("n") == 0, F.col("doc_id"))
    # Blank texts all have the node of the empty set; they must not meet in one task.
    key = F.when(F.col("n") > 0, F.col("node")).otherwise(F.xxhash64("doc_id"))
    return (
        rows.withColumn("node", key).join(of_node, "node", "left")
        .select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce(alone, "component_id")).alias("component_id"))
    )


def one_of_each(documents: DataFrame) -> DataFrame:
    """``documents`` with one row of each group of linked ones: the smallest id, and of
    several texts under that id the smallest node. Rows are judged by id and text, so
    unlinked texts under one id all stay; a repeated row (same id and text) stays once.
    Rows without an id stay."""
    rows, named = rooted(documents, "text")
    first = named.groupBy("root").agg(F.min(F.struct("doc", "node", "mark")).alias("r")).select(F.col("r.doc").alias("_doc"), F.col("r.mark").alias("_mark"))
    blank = rows.filter("n = 0 AND doc_id IS NOT NULL").select(F.col("doc_id").alias("_doc"), F.col("mark").alias("_mark")).distinct()
    ordered = [f"`{f.name}`" for f in documents.schema if not re.search("map<|variant", f.dataType.simpleString())]
    key = [F.col("doc_id").cast("bigint"), F.xxhash64("text")]
    row = F.struct(*all_columns(documents)).alias("_row")
    marked = documents.filter(F.col("doc_id").isNotNull()).select(row, key[0].alias("_doc"), key[1].alias("_mark"))
    same = Window.partitionBy("_doc", "_mark").orderBy(*[F.col(f"_row.{c}") for c in ordered])
    kept = marked.join(first.unionAll(blank), ["_doc", "_mark"], "left_semi").withColumn("_at", F.row_number().over(same))
    return kept.filter("_at = 1").select("_row.*").unionAll(documents.filter(F.col("doc_id").isNull()))

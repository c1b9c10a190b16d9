"""Short benchmark items inside long documents: containment search on sketches.

Items are partitioned by the size of their shingle set, and a partition fixes
how many minima of a hash (a bottom-k MinHash sketch) stand for each of its
items: one more than a quarter of the largest set. A document that holds three
quarters of an item's shingles misses fewer than that, so it holds at least one
of the sketched ones: no such document can be overlooked, whatever its length.
Every document is searched against all sketches, and each candidate is verified
by the exact containment of the shingles themselves.

The items are the stated query set. They are taken in blocks of at most
``BLOCK_CHARS`` characters (one item more at most), each broadcast and searched
in one pass over the documents; how many blocks there are depends on the data.

An item of one to four words is a single shingle, its whole sequence. Documents of
five words or more have five-word shingles only, so such an item is found in a
document of the same words and nothing else, and never inside a longer one.

Null and empty texts hold and leak nothing. Repeated items give one result;
repeated documents give one each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyroom.llm.shingles import Shingler, exact
from tallyroom.llm.words import share, shared, slices

#: Share of an item's shingles that makes a leak, as a fraction.
PART, WHOLE = 3, 4
#: Characters of the items that are broadcast at once.
BLOCK_CHARS = 16_000_000
FILTER_BITS = 22


@dataclass
class Index:
    value: np.ndarray  # sketched shingles, ascending
    item: np.ndarray  # the item of each
    items: list[tuple[int, str]]

    def bitmap(self) -> np.ndarray:
        bits = np.zeros(1 << FILTER_BITS, bool)
        bits[(self.value >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
        return bits


def build(items: list[tuple[int, str]]) -> Index:
    hashed, offset = Shingler().run([t for _, t in items])
    values, owners = [], []
    sets = [np.unique(hashed[a:b]) for a, b in zip(offset[:-1], offset[1:])]
    for at, own in enumerate(sets):
        if not len(own):
            continue
        # Partition: sizes up to the next power of two share one sketch length.
        largest = 1 << (len(own) - 1).bit_length()
        sketch = np.sort(own)[: largest - -(-PART * largest // WHOLE) + 1]
        values.append(sketch)
        owners.append(np.full(len(sketch), at))
    if not values:
        return Index(np.zeros(0, np.uint64), np.zeros(0, np.int64), items)
    value, owner = np.concatenate(values), np.concatenate(owners)
    order = np.argsort(value, kind="stable")
    return Index(value[order], owner[order], items)


def search(texts: list[str], shingler: Shingler, index: Index, bits: np.ndarray, sets: dict) -> list[tuple[int, int, int, int]]:
    """Verified (text, item, shingles of the item, of these in the text)."""
    hashed, offset = shingler.run(texts)
    near = np.flatnonzero(bits[(hashed >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
    left = np.searchsorted(index.value, hashed[near], "left")
    count = np.searchsorted(index.value, hashed[near], "right") - left
    row = np.repeat(np.searchsorted(offset, near, "right") - 1, count)
    at = np.repeat(left, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    found = []
    for text, group in _groups(row, index.item[at]):
        own = exact(texts[text])
        for item in sorted(set(group.tolist())):
            if item not in sets:
                sets[item] = exact(index.items[item][1])
            held = len(sets[item] & own)
            if WHOLE * held >= PART * len(sets[item]):
                found.append((text, item, len(sets[item]), held))
    return found


def _groups(row: np.ndarray, item: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    begin = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else []
    for a, b in zip(begin, [*begin[1:], len(row)]):
        yield int(row[a]), item[a:b]


OUT = "doc_id bigint, item_id bigint, n_item bigint, n_shared bigint"


def item_blocks(benchmark: DataFrame) -> list[Index]:
    """Indexes of all items, each over a block of bounded size."""
    items = (
        benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").alias("text"))
        .filter(F.col("item_id").isNotNull() & F.col("text").isNotNull()).distinct()
    )
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-total // (BLOCK_CHARS // 2)))  # half full on average, as a hash deals them
    parts = (items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block) for block in range(blocks))
    return [build(sorted((r.item_id, r.text) for r in part.collect())) for part in parts]


def leaks(documents: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """One row per document and item it holds to three quarters or more."""
    source = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    result = None
    for index in item_blocks(benchmark):
        handle = share(documents.sparkSession, index)

        def run(batches: Iterator[pa.RecordBatch], handle=handle) -> Iterator[pa.RecordBatch]:
            index, shingler, sets = shared(handle), Shingler(), {}
            bits = index.bitmap()
            for batch in batches:
                for part, texts in slices(batch, "text"):
                    found = search(texts, shingler, index, bits, sets)
                    ids = part.column("doc_id").to_pylist()
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([ids[f[0]] for f in found], pa.int64()),
                            pa.array([index.items[f[1]][0] for f in found], pa.int64()),
                            pa.array([f[2] for f in found], pa.int64()), pa.array([f[3] for f in found], pa.int64()),
                        ],
                        names=["doc_id", "item_id", "n_item", "n_shared"],
                    )

        part = source.mapInArrow(run, OUT)
        result = part if result is None else result.unionAll(part)
    return result


def clean(documents: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """``documents`` without the rows that hold an item, in one pass per block of items."""
    schema = documents.schema
    for index in item_blocks(benchmark):
        handle = share(documents.sparkSession, index)

        def keep(batches: Iterator[pa.RecordBatch], handle=handle) -> Iterator[pa.RecordBatch]:
            index, shingler, sets = shared(handle), Shingler(), {}
            bits = index.bitmap()
            for batch in batches:
                for part, texts in slices(batch, text):
                    held = {f[0] for f in search(texts, shingler, index, bits, sets)}
                    yield part.filter(pa.array([k not in held for k in range(len(texts))]))

        documents = documents.mapInArrow(keep, schema)
    return documents

"""Exact top-k by inner product with MaxScore over integer vectors.

A dimension is a term: its postings in a shard are the components of the
shard's vectors, and with the smallest and largest of them a query knows the
least and the most that the term can add to a score there. Terms of a block of
queries sort by how far these lie apart. Those that cannot lift any vector over
the k-th score so far, even where all others add their least, are
non-essential: the others are traversed for all vectors of a group, and the
non-essential ones, a few at a time and the widest first, while many vectors
still can compete; they are probed for the rest. A task keeps the k best of
each query with ties from shard to shard, and a window merges the tasks.

Queries go in packed blocks of bounded size, so many at a time are broadcast,
and the vectors pass by once for each such set: no vector and no query is
copied to meet the others, and what a task holds depends on the size of a shard
and of a set alone. Every query meets every vector, which is the work that exact
search of a given query set needs. Ties go to the smaller id. Vectors that are
null, hold a null or non-finite component, or have no id take no part; vectors
of other lengths are not compared. Rows that repeat an id are candidates each,
and a query of a repeated id is its smallest vector.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyroom.llm.words import share, shared
from tallyroom.session import cut_lineage

SHARD_ROWS, QUERY_ROWS = 4096, 1024
GROUP = 512
#: Shards of a task, at most.
TASK_SHARDS = 8
#: Components of the queries that are broadcast at once, about.
QUERY_VALUES = 4 << 20
#: Terms traversed at a time, and the share of vectors still alive (one in so many) that is probed instead.
STEP, PROBE = 16, 256


def quantised(vector: Column, scale: float = 256.0) -> Column:
    """floor(scale * x) of every component, or null where the vector takes no part."""
    sound = vector.isNotNull() & F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))
    )
    return F.when(sound, F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("bigint")))


def packed(rows: DataFrame, count: int, size: int, name: str) -> DataFrame:
    """Rows (id, vector, dim) in blocks: (dim, ``name``, ids, values) with about ``size`` rows each.
    What a row holds decides its block, so a task that runs again deals its rows alike."""
    blocks = max(1, -(-count // size))
    dealt = rows.withColumn(name, F.pmod(F.xxhash64("id", "vector"), F.lit(blocks)).cast("int"))

    def pack(key: tuple, group: pa.Table) -> pa.Table:
        ids = group.column("id").to_numpy().astype("<i8")
        flat = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in group.column("vector").chunks] or [np.zeros(0)])
        return pa.table({
            "dim": pa.array([key[0].as_py()], pa.int32()), name: pa.array([key[1].as_py()], pa.int32()),
            "ids": pa.array([ids.tobytes()], pa.binary()), "vectors": pa.array([flat.astype("<i8").tobytes()], pa.binary()),
        })

    return dealt.groupBy("dim", name).applyInArrow(pack, f"dim int, {name} int, ids binary, vectors binary")


def _largest(vectors: np.ndarray) -> int:
    return max(int(vectors.max(initial=0)), -int(vectors.min(initial=0)))


class Shard:
    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors.T  # postings by term
        self.low, self.high = self.vectors.min(axis=1), self.vectors.max(axis=1)
        self.largest = _largest(vectors)
        self._as: dict = {}

    def values(self, kind: type) -> np.ndarray:
        if kind not in self._as:
            self._as[kind] = np.ascontiguousarray(self.vectors, dtype=kind)
        return self._as[kind]


class Asked:
    """A block of queries with the ``k`` best vectors of each so far."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.vectors, self.k = ids, vectors, k
        self.largest, self.seen = _largest(vectors), 0
        self.owner = self.found = self.score = np.zeros(0, np.int64)
        self.limit = np.full(len(ids), -1 << 62, np.int64)

    def meet(self, shard: Shard) -> None:
        dim = self.vectors.shape[1]
        largest = self.largest * shard.largest * max(dim, 1)
        if largest >= 1 << 61:
            raise ValueError("inner products leave the 64-bit range")
        # floats are exact where no sum of products, bounds and limits leaves their whole numbers
        kind = np.float32 if largest < 1 << 21 else np.float64 if largest < 1 << 50 else np.int64
        q = self.vectors.astype(kind)
        ends = np.stack([q * shard.low.astype(kind), q * shard.high.astype(kind)])
        ends = np.stack([ends.min(axis=0), ends.max(axis=0)])
        term = np.argsort(-(ends[1] - ends[0]).sum(axis=0, dtype=float), kind="stable")
        q, x, ends = q[:, term], shard.values(kind)[term], ends[:, :, term]
        # least[:, i], most[:, i]: what the terms from i on add at least and at most
        least, most = np.zeros((2, len(q), dim + 1), kind)
        least[:, :-1], most[:, :-1] = np.cumsum(ends[:, :, ::-1], axis=2)[:, :, ::-1]
        reach = least[:, :1] - least + most
        begin = 0
        while begin < len(shard.ids):
            # the first groups are small, so that limits come early
            end = min(begin + min(GROUP, max(self.seen, 4 * self.k)), len(shard.ids))
            limit = np.clip(self.limit, -largest - 1, largest + 1).astype(kind)
            at = min(max(int((reach >= limit[:, None]).sum(axis=1).max()), 1), dim)
            score = q[:, :at] @ x[:at, begin:end]
            while True:
                alive = score >= (limit - most[:, at])[:, None]
                if at == dim or np.count_nonzero(alive) * PROBE < alive.size:
                    break
                score += q[:, at : at + STEP] @ x[at : at + STEP, begin:end]
                at = min(at + STEP, dim)
            row, column = np.nonzero(alive)
            value = score[row, column]
            for i in range(at, dim):
                value = value + q[row, i] * x[i, begin + column]
                keep = value >= limit[row] - most[row, i + 1]
                row, column, value = row[keep], column[keep], value[keep]
                if not len(row):
                    break
            ids = shard.ids[begin + column]
            keep = ids != self.ids[row]
            self._take(row[keep], ids[keep], value[keep].astype(np.int64))
            self.seen += end - begin
            begin = end

    def _take(self, owner: np.ndarray, found: np.ndarray, score: np.ndarray) -> None:
        if not len(owner):
            return
        owner, found, score = np.append(self.owner, owner), np.append(self.found, found), np.append(self.score, score)
        order = np.lexsort((found, -score, owner))
        owner = owner[order]
        place = np.arange(len(owner)) - np.searchsorted(owner, owner)
        best = order[place < self.k]
        self.owner, self.found, self.score = owner[place < self.k], found[best], score[best]
        last = order[place == self.k - 1]
        self.limit[owner[place == self.k - 1]] = score[last]


def _shards(batches: Iterator[pa.RecordBatch], dims: set[int]) -> Iterator[tuple[int, Shard]]:
    """The vectors of a task, by length, in shards."""
    waiting: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {dim: [] for dim in dims}

    def shard(dim: int) -> tuple[int, Shard]:
        parts, waiting[dim] = waiting[dim], []
        return dim, Shard(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))

    for batch in batches:
        lengths = batch.column("dim").to_numpy()
        for dim in dims.intersection(np.unique(lengths).tolist()):
            part = batch.filter(pa.array(lengths == dim))
            ids = part.column("id").to_numpy()
            vectors = part.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(len(ids), dim)
            while len(ids):
                room = SHARD_ROWS - sum(len(w[0]) for w in waiting[dim])
                waiting[dim].append((ids[:room], vectors[:room]))
                ids, vectors = ids[room:], vectors[room:]
                if sum(len(w[0]) for w in waiting[dim]) == SHARD_ROWS:
                    yield shard(dim)
    for dim in dims:
        if waiting[dim]:
            yield shard(dim)


def _query_sets(queries: DataFrame, count: int, dim: int) -> Iterator[list[tuple[int, bytes, bytes]]]:
    """Packed blocks of queries, so many at a time as may be broadcast."""
    blocks = packed(queries, count, QUERY_ROWS, "block")
    number = max(1, -(-count // QUERY_ROWS))
    step = max(1, QUERY_VALUES // (QUERY_ROWS * max(dim, 1)))
    if number > step:
        blocks = cut_lineage(blocks)
    for begin in range(0, number, step):
        part = blocks.filter((F.col("block") >= begin) & (F.col("block") < begin + step))
        yield [(r.dim, bytes(r.ids), bytes(r.vectors)) for r in part.collect()]


def top_k(vectors: DataFrame, is_query: Column, k: int, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` best other rows of every query row."""
    sound = (
        vectors.select(F.col(vec_id).cast("bigint").alias("id"), quantised(F.col(embedding)).alias("vector"), is_query.alias("query"))
        .filter(F.col("id").isNotNull() & F.col("vector").isNotNull())
        .withColumn("dim", F.size("vector"))
    )
    count, asked, widest = sound.agg(F.count(F.lit(1)), F.count(F.when(F.col("query"), 1)), F.max(F.when(F.col("query"), F.col("dim")))).first()
    queries = sound.filter("query").groupBy("id", "dim").agg(F.min("vector").alias("vector")).select("id", "vector", "dim")
    spark = vectors.sparkSession
    shards = max(1, -(-count // SHARD_ROWS))
    tasks = max(-(-shards // TASK_SHARDS), min(shards, spark.sparkContext.defaultParallelism))
    dealt = sound.select("id", "vector", "dim").repartition(tasks)
    found = None
    for blocks in _query_sets(queries, asked, widest or 0):
        handle = share(spark, blocks)

        def run(batches: Iterator[pa.RecordBatch], handle=handle) -> Iterator[pa.RecordBatch]:
            asked: dict[int, list[Asked]] = {}
            for dim, ids, values in shared(handle):
                ids = np.frombuffer(ids, "<i8")
                asked.setdefault(dim, []).append(Asked(ids, np.frombuffer(values, "<i8").reshape(len(ids), dim), k))
            for dim, shard in _shards(batches, set(asked)):
                for block in asked[dim]:
                    block.meet(shard)
            for block in (b for same in asked.values() for b in same):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(block.ids[block.owner], pa.int64()), pa.array(block.found, pa.int64()), pa.array(block.score, pa.int64())],
                    names=["query_id", "vec_id", "score"],
                )

        part = dealt.mapInArrow(run, "query_id bigint, vec_id bigint, score bigint")
        found = part if found is None else found.unionAll(part)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")

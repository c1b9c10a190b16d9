"""Chat formatting into one prefix tree.

A turn becomes ``### Role: text </turn>`` and a line end. Backslash, ``#`` and
``<`` inside texts (and ``:`` in roles) get a backslash, so no text can spell a
mark, and taking the backslashes away gives the text back.

A node of the tree is a turn after all turns before it, numbered by a chained
hash, so conversations that begin alike share nodes. Conversations sorted by
their node numbers give the depth-first order; a node stands where the first of
its conversations has it, and its tokens are stored once. ``start`` is its place
in the stream of all nodes, ``position`` the number of tokens of its ancestors
(position ids continue from there), and ``ancestors`` the half-open token
intervals it may attend to besides itself: those of its ancestors, joined where
they touch, so that an unbranched conversation has a single one.

A null text or role is empty. Turns go by ``turn`` (nulls first), equal ones by
role and text; repeated rows stay. Rows without ``conv_id`` are in no
conversation. Extra columns are not read. One conversation is formatted as a
sequence in one task; no tree and no turn that many share is gathered anywhere.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyroom.llm.tokenfiles import worker_words
from tallyroom.operators.ordering import positions
from tallyroom.session import cut_lineage

NAMES = {"system": "System", "user": "User", "assistant": "Assistant"}
ROLES = {v: k for k, v in NAMES.items()}
END = " </turn>\n"
LEARNT = "assistant"
UNESCAPE = re.compile(r"\\([\s\S])")
TURN = re.compile(r"### ((?:[^:\\]|\\[\s\S])*): ((?:[^<\\]|\\[\s\S])*) </turn>\n")


def escape(text: str, marks: str = "\\#<") -> str:
    for mark in marks:
        text = text.replace(mark, "\\" + mark)
    return text


def unescape(text: str) -> str:
    return UNESCAPE.sub(r"\1", text)


def turn_parts(role: str, text: str) -> tuple[str, str, str]:
    """Head, body and end of a formatted turn."""
    name = NAMES.get(role) or "=" + escape(role, "\\:#<")
    return f"### {name}: ", escape(text), END


def parse(formatted: str) -> tuple[str, str]:
    """Role and text of one formatted turn."""
    found = TURN.fullmatch(formatted)
    if not found:
        raise ValueError("not a formatted turn")
    name = found[1]
    return ROLES.get(name) or unescape(name[1:]), unescape(found[2])


def numbered(conversations: DataFrame) -> DataFrame:
    """conv_id, k, node, role, text: every turn with its place and its tree node."""
    rows = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("conv_id"), "turn",
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, k, state = None, 0, b""
        for batch in batches:
            places, nodes = [], []
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
                if conv != current:
                    current, k, state = conv, 0, b""
                head = f"{len(role.encode())}:{role}".encode()
                state = hashlib.blake2b(state + head + text.encode(), digest_size=16).digest()
                places.append(k)
                nodes.append(state)
                k += 1
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), pa.array(places, pa.int64()), pa.array(nodes, pa.binary()), batch.column("role"), batch.column("text")],
                names=["conv_id", "k", "node", "role", "text"],
            )

    return ordered.mapInArrow(run, "conv_id bigint, k bigint, node binary, role string, text string")


@lru_cache(maxsize=1)
def worker_decoder(tokenizer: str):
    """One per Python worker: loading it takes longer than decoding a small task."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer)


def tokens(nodes: DataFrame, tokenizer: str) -> DataFrame:
    """Nodes in range partitions by rank and k with their tokens, the partition and
    the number of tokens before them in it. Text is dealt out first, so that the
    sample of the ranges tokenises nothing."""
    ordered = nodes.repartitionByRange("rank", "k").sortWithinPartitions("rank", "k")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part, inside = worker_words(tokenizer, plain=True), TaskContext.get().partitionId(), 0
        for batch in batches:
            parts = [turn_parts(r, t) for r, t in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist())]
            coded = [words.encode([p[i] for p in parts]) for i in range(3)]
            size = [[len(c) // 4 for c in part] for part in coded]
            ids = [np.frombuffer(a + b + c, "<u4").astype(np.int32) for a, b, c in zip(*coded)]
            learnt = [r == LEARNT for r in batch.column("role").to_pylist()]
            upto = inside + np.cumsum([len(i) for i in ids], dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("node"), batch.column("rank"), batch.column("k"), pa.array(ids, pa.list_(pa.int32())),
                    pa.array([len(i) for i in ids], pa.int64()),
                    pa.array([h if y else 0 for h, y in zip(size[0], learnt)], pa.int64()),
                    pa.array([h + b if y else 0 for h, b, y in zip(size[0], size[1], learnt)], pa.int64()),
                    pa.array([part] * len(ids), pa.int32()), pa.array([inside, *upto[:-1].tolist()][: len(ids)], pa.int64()),
                ],
                names=["node", "rank", "k", "ids", "n_tokens", "loss_from", "loss_to", "_p", "_inside"],
            )
            inside = int(upto[-1]) if len(upto) else inside

    return ordered.mapInArrow(
        run,
        "node binary, rank bigint, k bigint, ids array<int>, n_tokens bigint, loss_from bigint, loss_to bigint, _p int, _inside bigint",
    )


def tree(turns: DataFrame, tokenizer: str) -> DataFrame:
    """The nodes in depth-first order: node, rank, k, head, body and tail tokens, start."""
    paths = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("k", "node"))).alias("path"))
    ranks = positions(paths.select("conv_id", F.col("path.node").alias("path")), [F.col("path"), F.col("conv_id")], "rank")
    nodes = (
        turns.join(ranks.select("conv_id", "rank"), "conv_id")
        .groupBy("node", "k", "role", "text").agg(F.min("rank").alias("rank"))
    )
    # Places in the stream: sums inside range partitions, and those of the partitions before (one row each).
    ranged = cut_lineage(tokens(nodes, tokenizer))
    earlier = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    before = ranged.groupBy("_p").agg(F.sum("n_tokens").alias("_n")).select("_p", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    return ranged.join(F.broadcast(before), "_p").withColumn("start", F.col("_inside") + F.col("_before")).drop("_p", "_inside", "_before")


def layout(turns: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, position, ancestors: what the tokens of every node attend to."""
    walked = (
        turns.select("conv_id", "k", "node").join(nodes.select("node", "start", "n_tokens"), "node")
        .repartition("conv_id").sortWithinPartitions("conv_id", "k")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, position, intervals = None, 0, []
        for batch in batches:
            at, seen = [], []
            for conv, start, size in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "start", "n_tokens"))):
                if conv != current:
                    current, position, intervals = conv, 0, []
                at.append(position)
                seen.append([{"begin": a, "end": b} for a, b in intervals])
                position += size
                if intervals and intervals[-1][1] == start:
                    intervals[-1] = (intervals[-1][0], start + size)
                else:
                    intervals.append((start, start + size))
            kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), pa.array(at, pa.int64()), pa.array(seen, kind)], names=["node", "position", "ancestors"]
            )

    walked = walked.mapInArrow(run, "node binary, position bigint, ancestors array<struct<begin:bigint,end:bigint>>")
    return walked.dropDuplicates(["node"])  # the ancestors of a node are the same in all its conversations


def format_chats(conversations: DataFrame, tokenizer: str) -> tuple[DataFrame, DataFrame]:
    """The prefix tree (one row per node, order by ``start``) and the paths
    (conv_id, k, node) of the conversations in it."""
    turns = cut_lineage(numbered(conversations))
    nodes = tree(turns, tokenizer)
    laid = layout(turns, nodes)
    return nodes.join(laid, "node").drop("rank", "k"), turns.select("conv_id", "k", "node")


def read_back(nodes: DataFrame, paths: DataFrame, tokenizer: str) -> DataFrame:
    """Digests of every conversation, from the tokens and loss masks of its nodes."""
    rows = (
        paths.join(nodes.select("node", "ids", "loss_from", "loss_to"), "node")
        .repartition("conv_id").sortWithinPartitions("conv_id", "k")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = worker_decoder(tokenizer)
        current, state, done = None, None, []

        def emit() -> pa.RecordBatch:
            columns = list(zip(*((c, s[0], s[1].hexdigest(), s[2], s[3].hexdigest(), s[4]) for c, s in done))) or [[]] * 6
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            return pa.RecordBatch.from_arrays(
                [pa.array(list(c), k) for c, k in zip(columns, kinds)],
                names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
            )

        for batch in batches:
            done = []
            convs, all_ids, begins, ends = (batch.column(c).to_pylist() for c in ("conv_id", "ids", "loss_from", "loss_to"))
            texts = decoder.decode_batch(all_ids, skip_special_tokens=False)
            masked = decoder.decode_batch([ids[a:b] for ids, a, b in zip(all_ids, begins, ends)], skip_special_tokens=False)
            for conv, formatted, loss in zip(convs, texts, masked):
                if conv != current:
                    if state:
                        done.append((current, state))
                    current, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text = parse(formatted)
                learnt = unescape(loss)
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                state[2] += len(learnt)
                state[3].update(learnt.encode())
                state[4] += len(formatted)
            yield emit()
        if state:
            done = [(current, state)]
            yield emit()

    return rows.mapInArrow(
        run, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    )

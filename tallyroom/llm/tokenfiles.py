"""Token-id files compressed by Re-Pair grammars.

Documents are range-partitioned and sorted by id, tokenised, and gathered into
blocks of about ``BLOCK`` ids. In every block frequent neighbouring pairs are
replaced by new symbols, again and again; each pass replaces every pair that is
more frequent than both pairs it overlaps, so many rules arise at once. A block
stores its rules, the expansion length of each, the remaining sequence and the
ends of its documents: prefix sums of expansion lengths find any document
without expanding the rest. A block is one binary value of a Parquet row,
written by Spark's committer to a shared folder, so a lost executor costs a
retry and never a half file.

Null and empty texts hold the end id alone. Every input row is one document:
repeated ids stay next to each other in order of text. Null ids come first.
"""

from __future__ import annotations

import os
import re
import string
import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyroom.llm.words import gather, lasting, slices
from tallyroom.session import checkpoint_folder

#: Ids of a block; a longer document is a block of its own.
BLOCK = 1 << 19
#: A pass that shortens the sequence by less than this share is the last one.
LEAST_GAIN = 0.02
MOST_PASSES = 24
COUNTERS = 20
MAGIC = b"RPB2"


def repair(ids: np.ndarray, first: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Sequence and rules (left, right) by pass; new symbols count up from ``first``."""
    sequence, rules = ids.astype(np.uint32), []
    for _ in range(MOST_PASSES):
        if len(sequence) < 4:
            break
        slot = (((sequence[:-1] * np.uint32(0x9E3779B1)) ^ sequence[1:]) * np.uint32(0x85EBCA6B) >> np.uint32(32 - COUNTERS)).astype(np.int64)
        # Counters may merge two pairs: that only changes which pair goes first.
        standing = (np.bincount(slot, minlength=1 << COUNTERS)[slot] << COUNTERS) | slot
        pick = standing >= (2 << COUNTERS)
        pick[1:] &= standing[1:] > standing[:-1]
        pick[:-1] &= standing[:-1] >= standing[1:]
        at = np.flatnonzero(pick)
        key = (sequence[at].astype(np.uint64) << np.uint64(32)) | sequence[at + 1]
        pair, which, count = np.unique(key, return_inverse=True, return_counts=True)
        worth = count >= 3
        if not worth.any():
            break
        number = np.cumsum(worth) - 1 + first
        hit = worth[which]
        at, symbol = at[hit], number[which[hit]]
        before = len(sequence)
        sequence[at] = symbol
        stay = np.ones(before, bool)
        stay[at + 1] = False
        sequence = sequence[stay]
        kept = pair[worth]
        rules.append(np.stack([kept >> np.uint64(32), kept & np.uint64(0xFFFFFFFF)], axis=1).astype(np.uint32))
        first += len(kept)
        if len(sequence) > before * (1 - LEAST_GAIN):
            break
    return sequence, rules


def pack(ids: np.ndarray, ends: np.ndarray, first: int) -> bytes:
    """A block: documents end at ``ends`` in ``ids``; rule symbols start at ``first``."""
    sequence, rules = repair(ids, first)
    length = np.ones(first, np.uint32)
    for rule in rules:
        length = np.concatenate([length, length[rule[:, 0]] + length[rule[:, 1]]])
    flat = np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32)
    body = b"".join((
        np.array([len(r) for r in rules], np.uint32).tobytes(), flat.tobytes(), length[first:].tobytes(),
        sequence.astype(np.uint32).tobytes(), ends.astype(np.uint64).tobytes(),
    ))
    head = struct.pack("<4sIIIQQ", MAGIC, first, len(rules), len(flat), len(sequence), len(ends))
    return head + pa.compress(body, "zstd", asbytes=True)


class Block:
    """Reader of one packed block."""

    def __init__(self, data: bytes):
        size = struct.calcsize("<4sIIIQQ")
        magic, self.first, passes, count, length, documents = struct.unpack("<4sIIIQQ", data[:size])
        if magic != MAGIC:
            raise ValueError("not a token block")
        body, at = pa.decompress(data[size:], 4 * (passes + 3 * count + length) + 8 * documents, "zstd", asbytes=True), 0

        def take(kind, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(body, kind, n, at)
            at += out.nbytes
            return out

        self.passes = take("<u4", passes)
        self.rules = take("<u4", 2 * count).reshape(-1, 2)
        self.length = take("<u4", count)
        self.sequence = take("<u4", length)
        self.ends = take("<u8", documents).astype(np.int64)

    def expand(self, sequence: np.ndarray) -> np.ndarray:
        """The ids behind symbols, undoing the passes from the last to the first."""
        bound = self.first + np.concatenate([[0], np.cumsum(self.passes)])
        for base in bound[-2::-1] if len(self.passes) else ():
            rule = np.flatnonzero(sequence >= base)
            pair = self.rules[sequence[rule] - self.first]
            sequence = np.repeat(sequence, 1 + (sequence >= base))
            at = rule + np.arange(len(rule))
            sequence[at], sequence[at + 1] = pair[:, 0], pair[:, 1]
        return sequence

    def ids(self) -> np.ndarray:
        return self.expand(self.sequence.copy())

    def document(self, number: int) -> np.ndarray:
        """The ids of one document; only the symbols that cover it are expanded."""
        begin, end = int(self.ends[number - 1]) if number else 0, int(self.ends[number])
        size = np.ones(len(self.sequence), np.int64)
        rule = self.sequence >= self.first
        size[rule] = self.length[self.sequence[rule] - self.first]
        upto = np.cumsum(size)
        left = int(np.searchsorted(upto, begin, "right"))
        right = int(np.searchsorted(upto, end, "left")) + 1
        skipped = int(upto[left - 1]) if left else 0
        return self.expand(self.sequence[left:right].copy())[begin - skipped : end - skipped]


def _classes() -> np.ndarray:
    kind = np.zeros(256, np.uint8)  # 0: control characters, later bytes of a character, and what may begin a wide space
    kind[0xC3:0xF5] = 7  # begins another character that is no white space
    kind[[0xE1, 0xE2, 0xE3]] = 0
    for number, some in enumerate((" ", "\t\n\v\f\r", string.ascii_letters, string.digits, string.punctuation, "'"), 1):
        kind[list(some.encode())] = number  # the apostrophe last: it also begins endings such as 's
    return kind


def _level() -> np.ndarray:
    """Printable Latin-1 bytes stand for themselves, the others for characters from 256 on."""
    level = np.arange(256, dtype="<u2")
    hidden = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b)]
    level[hidden] = 256 + np.arange(len(hidden))
    return level


def _ends(*pairs: tuple[str, str]) -> np.ndarray:
    """By 8 * class + next class, true for the given ones."""
    out = np.zeros(64, bool)
    for left, right in pairs:
        out[[8 * int(x) + int(y) for x in left for y in right]] = True
    return out


class Pieces:
    """Pieces by number and their ids one after another. Number 0 has no ids."""

    def __init__(self):
        self.number, self.count, self.size = {}, 1, 0
        self.flat, self.bound = np.zeros(1 << 12, "<u4"), np.zeros(1 << 10, np.int64)

    def find(self, pieces: list[str]) -> np.ndarray:
        return np.fromiter(map(self.number.get, pieces, repeat(-1)), np.int64, len(pieces))

    def ids(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ids, bound = gather(self.flat, self.bound, numbers)
        return ids, np.diff(bound)

    def add(self, pieces: list[str], ids: np.ndarray, count: np.ndarray, longest: int | None = None) -> np.ndarray:
        """The numbers of ``count`` new lists of ids; pieces up to ``longest`` characters are found again."""
        numbers = np.arange(self.count, self.count + len(count))
        self.flat = _room(self.flat, self.size + len(ids))
        self.bound = _room(self.bound, self.count + len(count) + 1)
        self.flat[self.size : self.size + len(ids)] = ids
        self.bound[self.count + 1 : self.count + len(count) + 1] = self.size + np.cumsum(count)
        self.size, self.count = self.size + len(ids), self.count + len(count)
        named = zip(pieces, numbers.tolist())
        self.number.update(named if longest is None else [(p, k) for p, k in named if len(p) <= longest])
        return numbers


def _room(values: np.ndarray, size: int) -> np.ndarray:
    if size <= len(values):
        return values
    return np.concatenate([values, np.zeros(max(size, len(values) * 3 // 2) - len(values), values.dtype)])


class Words:
    """Byte-level BPE through the tokenizers library, once per word of a Python worker.

    The vocabulary splits a text before the last white space of a run, after it
    unless it is a space, and where letters, digits and punctuation meet; pieces
    between such places can be encoded alone. They are cut and numbered side by
    side, so only the distinct ones of a slice become strings. A text that spells
    a special token is encoded whole. New pieces without inner white space are
    encoded as one text: the ids that begin with a space, or line ends set
    between them, part them. Spaced letters need no further split: the library
    gets them in the characters of its vocabulary. Of the pieces seen, the recent
    ones are kept.
    """

    CLASS = _classes()
    #: A piece begins at the second of two bytes ...
    AT_SECOND = _ends(("2", "34567"), ("34", "56"), ("5", "34"), ("3", "4"), ("4", "3"))
    #: ... or at the first.
    AT_FIRST = _ends(("12", "34567"))
    #: A space and letters that are letters in every version of Unicode; a space and any; no space. None is long.
    WORD = re.compile("( [A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]{1,64})|( \\S{1,64})|(\\S{1,64})")
    #: The character of each byte in the vocabulary.
    LEVEL = _level()
    #: Pieces of a generation; those of the last one come over when they are met again.
    KEPT = 150_000
    #: Longer pieces are not kept.
    LONG = 65

    def __init__(self, path: str, plain: bool = False):
        """``plain``: special tokens spelled in a text are ordinary text."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has one task per core already
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.ready = Tokenizer(self.tokenizer.model)
        self.ready.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        self.tokenizer.encode_special_tokens = plain
        self.special = [] if plain else [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.spaced, self.line = np.zeros(self.size, bool), np.zeros(self.size, bool)
        for token, number in self.tokenizer.get_vocab().items():
            if number < self.size:
                self.spaced[number] = token.startswith("\u0120")  # the space byte
                self.line[number] = token == "\u010a"  # a line end
        self.now, self.before = Pieces(), Pieces()

    def _library(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and how many each has."""
        coded = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return np.array([i for e in coded for i in e.ids], "<u4"), np.array([len(e) for e in coded], np.int64)

    def _parted(self, words: list[str], tokenizer, joined: str, mark: np.ndarray, line: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """The same of words that were joined to one text: each begins at an id in ``mark``; a line end is no part of it."""
        if any(s in joined for s in self.special):
            return self._library(words)
        coded = np.array(tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, "<u4")
        marked = mark[coded]
        begins = np.flatnonzero(marked)
        if len(begins) != len(words):
            return self._library(words)
        return coded[~marked] if line else coded, np.diff(begins, append=len(coded)) - line

    def _letters(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        joined = self.LEVEL[np.frombuffer("".join(words).encode(), np.uint8)].tobytes().decode("utf-16-le")
        return self._parted(words, self.ready, joined.replace("\u0120", " \u0120"), self.spaced)

    def _spaced(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return self._parted(words, self.tokenizer, "".join(words), self.spaced)

    def _bare(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return self._parted(words, self.tokenizer, "\n" + "\n".join(words), self.line, True)

    def pieces(self, pieces: list[str]) -> np.ndarray:
        """Numbers of distinct pieces in ``self.now``."""
        if len(self.now.number) > self.KEPT or self.now.size > 16 * self.KEPT:
            self.now, self.before = Pieces(), self.now
        number = self.now.find(pieces)
        missing = np.flatnonzero(number < 0)
        if len(missing):
            new = [pieces[k] for k in missing.tolist()]
            old = self.before.find(new)
            kind = np.array([m.lastindex if m else 0 for m in map(self.WORD.fullmatch, new)])
            kind[old >= 0] = 4
            for code, some in enumerate((self._library, self._letters, self._spaced, self._bare, None)):
                at = np.flatnonzero(kind == code)
                for part in np.array_split(at, -(-len(at) // 8192)) if len(at) else ():
                    texts = [new[k] for k in part.tolist()]
                    ids, count = some(texts) if some else self.before.ids(old[part])
                    number[missing[part]] = self.now.add(texts, ids, count, self.LONG if code == 0 else None)
        return number

    def cut(self, data: np.ndarray, marks: np.ndarray, whole: list[bool]) -> np.ndarray:
        """Where pieces of ``data`` begin: texts, each with a mark after it. Marks are pieces."""
        kind = self.CLASS[data]
        kind[marks] = 0
        pair = (kind[:-1] << 3) | kind[1:]
        begins = np.append(self.AT_FIRST[pair], False)
        begins[1:] |= self.AT_SECOND[pair]
        for text in np.flatnonzero(whole):
            begins[marks[text - 1] + 1 if text else 0 : marks[text]] = False
        begins[marks] = True
        begins[0] = True
        begins[marks[:-1] + 1] = True
        return np.flatnonzero(begins)

    def encode(self, texts: list[str], end: int | None = None) -> list[bytes]:
        """Little-endian 32-bit ids of each text, with the end id if there is one."""
        if not texts:
            return []
        coded = [t.encode() for t in texts]
        data = np.frombuffer(b"\0".join([*coded, b""]), np.uint8)
        marks = np.cumsum([len(c) + 1 for c in coded]) - 1
        begins = self.cut(data, marks, [any(s in t for s in self.special) for t in texts])
        offsets = pa.py_buffer(np.append(begins, len(data)))
        numbered = pa.LargeStringArray.from_buffers(len(begins), offsets, pa.py_buffer(data)).dictionary_encode()
        number = self.pieces(numbered.dictionary.to_numpy(zero_copy_only=False).tolist())[numbered.indices.to_numpy()]
        last = np.searchsorted(begins, marks)
        number[last] = 0 if end is None else self.now.add([], np.array([end], "<u4"), np.array([1]))  # a mark stands for the end id
        ids, bounds = gather(self.now.flat, self.now.bound, number)
        flat, ends = ids.tobytes(), (4 * bounds[last + 1]).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends)]


def worker_words(path: str, plain: bool = False) -> Words:
    """One per Python worker: its next task finds the words of the one before."""
    return lasting(("words", path, plain), lambda: Words(path, plain))


FILE = "shard int, block int, first_symbol int, doc_ids array<bigint>, n_tokens bigint, payload binary"


def write(documents: DataFrame, tokenizer: str, end: int, folder: str, text: str = "text") -> None:
    """Tokenise and write the blocks, in ascending order of ``doc_id``, to ``folder``."""
    ordered = (
        documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(text).alias("text"))
        .repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, shard, number = worker_words(tokenizer), TaskContext.get().partitionId(), 0
        names, held, size = [], [], 0

        def flush() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(held), "<u4")
            ends = np.cumsum([len(h) // 4 for h in held])
            first = max(words.size, end + 1)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([shard], pa.int32()), pa.array([number], pa.int32()), pa.array([first], pa.int32()),
                    pa.array([names], pa.list_(pa.int64())), pa.array([len(ids)], pa.int64()),
                    pa.array([pack(ids, ends, first)], pa.binary()),
                ],
                names=["shard", "block", "first_symbol", "doc_ids", "n_tokens", "payload"],
            )

        for batch in batches:
            for part, texts in slices(batch, "text"):
                for name, coded in zip(part.column("doc_id").to_pylist(), words.encode(texts, end)):
                    if size and size + len(coded) > 4 * BLOCK:
                        yield flush()
                        names, held, size, number = [], [], 0, number + 1
                    names.append(name)
                    held.append(coded)
                    size += len(coded)
        if held:
            yield flush()

    ordered.mapInArrow(run, FILE).write.mode("errorifexists").parquet(folder)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document of the files: doc_id, start, n_tokens, ids_crc32."""
    files = spark.read.schema(FILE).parquet(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.select(["shard", "block", "doc_ids", "payload"]).to_pylist():
                block = Block(row["payload"])
                ids, begin = block.ids().astype("<u4"), np.concatenate([[0], block.ends[:-1]])
                size = len(block.ends)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["shard"]] * size, pa.int32()), pa.array([row["block"]] * size, pa.int32()),
                        pa.array(row["doc_ids"], pa.int64()), pa.array(begin, pa.int64()),
                        pa.array(block.ends - begin, pa.int64()),
                        pa.array([zlib.crc32(ids[a:b].tobytes()) for a, b in zip(begin, block.ends)], pa.int64()),
                    ],
                    names=["shard", "block", "doc_id", "_inside", "n_tokens", "ids_crc32"],
                )

    documents = files.mapInArrow(
        run, "shard int, block int, doc_id bigint, _inside bigint, n_tokens bigint, ids_crc32 bigint"
    )
    # Ids before a block: those of earlier shards (one row each) and of earlier blocks of its shard.
    sizes = files.select("shard", "block", F.col("n_tokens").alias("_n"))
    shards = sizes.groupBy("shard").agg(F.sum("_n").alias("_all"))
    running = lambda value, window: F.coalesce(
        F.sum(value).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    shards = shards.select("shard", running("_all", Window.orderBy("shard")).alias("_shards"))
    blocks = sizes.withColumn("_blocks", running("_n", Window.partitionBy("shard").orderBy("block")))
    before = blocks.join(shards, "shard").select("shard", "block", (F.col("_shards") + F.col("_blocks")).alias("_before"))
    return documents.join(before, ["shard", "block"]).select(
        "doc_id", (F.col("_before") + F.col("_inside")).alias("start"), "n_tokens", "ids_crc32"
    )


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own below the shared checkpoint folder."""
    return f"{checkpoint_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"

"""Words and hashed word features on Arrow batches (numpy inside tasks)."""

from __future__ import annotations

import pickle
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

WORD = re.compile(r"\w+")
#: An executor's Python worker forgets its words beyond this many, so memory stays bounded.
VOCABULARY = 400_000


class Vocabulary(dict):
    """Word to running number; unseen words are numbered on first use."""

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        return number


def slices(batch: pa.RecordBatch, text: str, limit: int = 4 << 20) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Parts of a batch with about ``limit`` characters of text (at least one row); null reads as empty.
    Only the texts of one part are Python strings at a time."""
    lengths = pc.fill_null(pc.utf8_length(batch.column(text)), 0).to_pylist()
    begin = size = 0
    for at, length in enumerate([*lengths, 0]):
        if at == len(lengths) or size and size + length > limit:
            if begin < at:
                part = batch.slice(begin, at - begin)
                yield part, [t or "" for t in part.column(text).to_pylist()]
            begin, size = at, 0
        size += length


_LASTING: dict = {}


def lasting(kind, make: Callable):
    """What a Python worker keeps from task to task. It holds one kind: the next one takes its place, so
    memories of several operators never add up in a worker."""
    if kind not in _LASTING:
        _LASTING.clear()
        _LASTING[kind] = make()
    return _LASTING[kind]


def forget() -> None:
    """For tasks with a fitted object of their own: the worker drops what an operator before them kept."""
    _LASTING.clear()


def word_hash(words: list[str], salt: str = "") -> np.ndarray:
    """A 64-bit number per word, the same on every machine."""
    if not words:
        return np.zeros(0, np.uint64)
    return pd.util.hash_array(np.array(words, dtype=object), hash_key=f"{salt:0<16}"[:16], categorize=False)


def buckets(hashed: np.ndarray, bits: int) -> np.ndarray:
    return ((hashed * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


def ngram_features(words: list[str], sizes: tuple[int, ...], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of each word and their offsets: character n-grams of the
    word between two boundary marks (those at a mark are its affixes), and the
    whole word."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(1, np.int64)
    code = np.frombuffer(("\x02" + "\x03\x02".join(words) + "\x03").encode("utf-32-le"), np.uint32).astype(np.uint64)
    owner = np.cumsum(code == 2) - 1
    owners, found = [np.arange(len(words))], [buckets(word_hash(words, "word"), bits)]
    rolled = np.zeros(len(code), np.uint64)
    for n in range(1, max(sizes) + 1):
        if len(code) < n:
            break
        rolled = rolled[: len(code) - n + 1] * np.uint64(1_000_003) + code[n - 1 :] + np.uint64(n)
        if n in sizes:
            inside = owner[: len(code) - n + 1] == owner[n - 1 :]
            owners.append(owner[: len(code) - n + 1][inside])
            found.append(buckets(rolled[inside], bits))
    owner, feature = np.concatenate(owners), np.concatenate(found)
    feature = feature[np.argsort(owner, kind="stable")]
    return feature, np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(words)))])


def gather(values: np.ndarray, offsets: np.ndarray, picked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The value lists of the picked rows, one after another, with their offsets."""
    count = (offsets[1:] - offsets[:-1])[picked]
    ends = np.cumsum(count)
    at = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - count, count) + np.repeat(offsets[:-1][picked], count)
    return values[at], np.concatenate([[0], ends])


def share(spark: SparkSession, value):
    """Broadcast a small fitted object together with its class; read it in a task with ``shared``."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def shared(handle):
    forget()
    return pickle.loads(handle.value)


def output(source: DataFrame, keep: list[str], added: str) -> StructType:
    """The kept columns of ``source`` and those that a DDL string adds."""
    return StructType([source.schema[c] for c in keep] + StructType.fromDDL(added).fields)


def all_columns(documents: DataFrame) -> list[Column]:
    """Every column by its quoted name."""
    return [F.col(f"`{c}`") for c in documents.columns]

"""Toxic spans by a linear-chain conditional random field.

Documents carry a label, tokens do not. Token labels follow from the sampled
rows: a word is an offence when it is far more frequent in toxic rows than in
others and stands there in many different contexts (copies of one text repeat
one context). The field is trained on those labels with features of the word,
its affixes and its neighbours; forward-backward marginals of every token of
every document then give the offsets of offending words. A document score is a
logistic function of the marginals together: the two largest, their sum, their
share of the words, and how many words offend. It is fitted on marginals of
rows that the field did not see (two halves of the sample score each other), and
set so that THRESHOLD is the highest point whose F1 there is within a hundredth
of the best: one odd syllable in a long clean text is not enough, but a word that
is CERTAIN to offend is.

Nulls: a null text is an empty text with score 0. Rows are scored one by one,
so repeated rows and clashing extra columns change nothing. Without labels of
both kinds every score is 0.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyroom.llm import crf
from tallyroom.llm.words import VOCABULARY, WORD, Vocabulary, buckets, gather, ngram_features, output, share, shared, slices, word_hash

BITS = 16
#: Character n-grams of a word, whole affixes among them; the word itself is a feature too.
SIZES = (4, 5, 6)
#: Labelled rows the field is fitted on, per label, and the longest text among them.
SAMPLE_ROWS, SAMPLE_CHARS = 600, 20_000
#: A document is toxic from this score on.
THRESHOLD = 0.3
#: A word with this marginal is enough, however long its text.
CERTAIN = 0.99
#: Characters whose words and messages a task holds at once.
SLICE = 1 << 20


@dataclass
class Gauge:
    """From summaries of a document's marginals to its score."""

    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    bias: float

    def scores(self, summary: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip((summary - self.mean) / self.scale @ self.weight + self.bias, -50, 50)))


@dataclass
class Model:
    weight: np.ndarray
    start: np.ndarray
    transition: np.ndarray
    gauge: Gauge | None = None

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores of each word itself, as the word before and as the word after."""
        low = [w.lower() for w in words]
        feature, offset = ngram_features(low, SIZES, BITS)
        own = np.add.reduceat(self.weight[feature], offset[:-1], axis=0) if words else np.zeros((0, 2))
        return own, self.weight[buckets(word_hash(low, "before"), BITS)], self.weight[buckets(word_hash(low, "after"), BITS)]


def offences(rows: list[tuple[list[str], int]], ratio: float = 10.0, contexts: int = 5) -> set[str]:
    count = {0: Counter(), 1: Counter()}
    around = defaultdict(set)
    for words, label in rows:
        count[label].update(set(words))
        if label:
            for at, word in enumerate(words):
                if len(around[word]) < contexts:
                    around[word].add((words[at - 1] if at else "", words[at + 1] if at + 1 < len(words) else ""))
    toxic = max(1, sum(label for _, label in rows))
    clean = max(1, len(rows) - toxic)
    return {
        word for word, n in count[1].items()
        if len(around[word]) >= contexts and (n + 0.5) / toxic >= ratio * (count[0][word] + 0.5) / clean
    }


def summaries(p: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Per document: its largest and second marginal, their sum, share of the words,
    and the words that offend (the last three as logarithms)."""
    most = np.maximum.reduceat(p, begin)
    owner = np.repeat(np.arange(len(begin)), length)
    top = np.flatnonzero(p == most[owner])
    rest = p.copy()
    rest[top[np.unique(owner[top], return_index=True)[1]]] = 0.0
    total = np.add.reduceat(p, begin)
    return np.stack([
        most, np.maximum.reduceat(rest, begin), np.log1p(total), np.log1p(100 * total / length), np.log1p(np.add.reduceat(p >= 0.5, begin)),
    ], axis=1)


def gauged(summary: np.ndarray, label: np.ndarray) -> Gauge:
    """Logistic regression by Newton steps, shifted to the operating point."""
    mean, scale = summary.mean(axis=0), summary.std(axis=0) + 1e-9
    x = np.column_stack([(summary - mean) / scale, np.ones(len(summary))])
    weight = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ weight, -50, 50)))
        curve = (x * (p * (1 - p))[:, None]).T @ x + 0.01 * np.eye(len(weight))
        weight -= np.linalg.solve(curve, x.T @ (p - label) + 0.01 * weight)
    z = x @ weight
    order = np.argsort(-z, kind="stable")
    hits = np.cumsum(label[order])
    f1 = 2 * hits / (np.arange(1, len(z) + 1) + label.sum())
    last = np.append(z[order][1:] != z[order][:-1], True)  # a point takes all equal values
    at = np.flatnonzero(last & (f1 >= f1[last].max() - 0.01))[0]
    return Gauge(mean, scale, weight[:-1], float(weight[-1] - z[order][at] + np.log(THRESHOLD / (1 - THRESHOLD)) + 1e-9))


def fit(sample: list[tuple[str, int]]) -> Model | None:
    """``sample``: text and label of a bounded number of rows. Without a field for
    both halves the whole sample gauges itself."""
    rows = sorted({(text, label) for text, label in sample if WORD.search(text)})
    model = field(rows)
    if model is None:
        return None
    halves = rows[::2], rows[1::2]
    fields = [field(half) for half in halves]
    judged = [(model, rows)] if None in fields else [(fields[0], halves[1]), (fields[1], halves[0])]
    summary = np.concatenate([marginal_summaries([text for text, _ in part], by) for by, part in judged])
    model.gauge = gauged(summary, np.array([label for _, part in judged for _, label in part], float))
    return model


def field(sample: list[tuple[str, int]]) -> Model | None:
    """The field alone, without the gauge of documents."""
    rows = [([w.lower() for w in WORD.findall(text)], label) for text, label in sorted(set(sample))]
    rows = [(words, label) for words, label in rows if words]
    bad = offences(rows)
    if not bad:
        return None
    vocabulary = Vocabulary()
    code = np.array([vocabulary[w] for words, _ in rows for w in words])
    starts = np.zeros(len(code), bool)
    starts[np.cumsum([0] + [len(words) for words, _ in rows[:-1]])] = True
    # An offence in a row labelled clean keeps the tag of its row.
    tag = np.array([int(label and w in bad) for words, label in rows for w in words])
    words = list(vocabulary)
    feature, offset = gather(*ngram_features(words, SIZES, BITS), code)
    before, after = buckets(word_hash(words, "before"), BITS)[code], buckets(word_hash(words, "after"), BITS)[code]
    none = 1 << BITS  # an always-zero row stands for "no neighbour"
    left = np.where(starts, none, np.roll(before, 1))
    right = np.where(np.append(starts[1:], True), none, np.roll(after, -1))
    feature = np.insert(feature, np.repeat(offset[1:], 2), np.stack([left, right], axis=1).ravel())
    offset = offset + 2 * np.arange(len(offset))
    weight, start, transition = crf.train(feature, offset, tag, starts, (1 << BITS) + 1, 2, rounds=20)
    return Model(weight, start, transition)


def sample_rows(documents: DataFrame, labels: DataFrame, allowed: Column, rows: int = SAMPLE_ROWS) -> list[tuple[str, int]]:
    """At most ``rows`` rows of each label, of those with a text of at most
    SAMPLE_CHARS characters, picked by a hash of their id. The broadcast list holds
    at most twice that many ids."""
    fitting = documents.filter(F.length("text").between(1, SAMPLE_CHARS)).select("doc_id")
    known = (
        labels.filter(allowed & F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1))
        .groupBy("doc_id").agg(F.max("toxic").alias("label")).join(fitting, "doc_id", "left_semi")
    )
    picked = None
    for label in (0, 1):
        part = known.filter(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
        picked = part if picked is None else picked.unionAll(part)
    texts = (
        documents.select("doc_id", "text").filter(F.length("text").between(1, SAMPLE_CHARS))
        .join(F.broadcast(picked), "doc_id").select("text", "label")
    )
    return [(r.text, int(r.label)) for r in texts.collect()]


OUT = "score double, offending array<struct<start:int,end:int,p:double>>"
SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))


def marginal_words(texts: list[str], model: Model, vocabulary: Vocabulary, tables: list[np.ndarray]):
    """Marginals of all words, words of each text, and where the texts that have any begin."""
    found = [WORD.findall(t) for t in texts]
    seen = len(vocabulary)
    code = np.array([vocabulary[w] for words in found for w in words], np.int64)
    if len(vocabulary) > seen:
        new = model.words(list(vocabulary)[seen:])
        tables[:] = [np.concatenate([old, x]) for old, x in zip(tables, new)] if tables else list(new)
    length = np.array([len(words) for words in found], np.int64)
    full = np.flatnonzero(length)
    begin = (np.cumsum(length) - length)[full]
    if not len(code):
        return np.zeros(0), length, full, begin
    starts = np.zeros(len(code), bool)
    starts[begin] = True
    emission = tables[0][code].astype(float)
    inner = np.flatnonzero(~starts)
    emission[inner] += tables[1][code[inner - 1]]
    emission[inner - 1] += tables[2][code[inner]]
    return crf.marginals(emission, starts, model.start, model.transition)[0][:, 1], length, full, begin


def marginal_summaries(texts: list[str], model: Model) -> np.ndarray:
    """Summaries of texts that all have words."""
    vocabulary, tables, out = Vocabulary(), [], []
    for at in range(0, len(texts), 200):
        p, length, _, begin = marginal_words(texts[at : at + 200], model, vocabulary, tables)
        out.append(summaries(p, begin, length))
    return np.concatenate(out)


def tag_texts(texts: list[str], model: Model, vocabulary: Vocabulary, tables: list[np.ndarray]) -> tuple[list[float], list[list[dict]]]:
    """Score and offending spans (code points, end exclusive) of each text."""
    p, length, full, begin = marginal_words(texts, model, vocabulary, tables)
    scores, spans = [0.0] * len(texts), [[] for _ in texts]
    if not len(full):
        return scores, spans
    summary = summaries(p, begin, length[full])
    value = model.gauge.scores(summary)
    value = np.where(summary[:, 0] >= CERTAIN, np.maximum(value, summary[:, 0] / 2), value)
    for row, at, score, peak in zip(full.tolist(), begin.tolist(), value.tolist(), summary[:, 0].tolist()):
        scores[row] = score
        if peak >= 0.5:
            own = p[at : at + length[row]]
            hits = set(np.flatnonzero(own >= 0.5).tolist())
            spans[row] = [
                {"start": m.start(), "end": m.end(), "p": float(own[k])}
                for k, m in enumerate(WORD.finditer(texts[row])) if k in hits
            ]
    return scores, spans


def score(documents: DataFrame, model: Model | None, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` of every row, ``score`` and ``offending``."""
    if model is None:
        return documents.select(*keep, F.lit(0.0).alias("score"), F.array().cast(OUT.split(" ", 3)[3]).alias("offending"))
    source = documents.select(*keep, F.col(text).alias("_text"))
    handle = share(documents.sparkSession, model)  # 2 ** BITS weights of two tags

    def tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted, vocabulary, tables = shared(handle), Vocabulary(), []
        for batch in batches:
            for part, texts in slices(batch, "_text", SLICE):
                if len(vocabulary) > VOCABULARY:
                    vocabulary, tables = Vocabulary(), []
                scores, spans = tag_texts(texts, fitted, vocabulary, tables)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in keep), pa.array(scores, pa.float64()), pa.array(spans, SPANS)],
                    names=[*keep, "score", "offending"],
                )

    return source.mapInArrow(tag, output(source, keep, OUT))


def reject(documents: DataFrame, model: Model | None, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """``documents`` without the rows whose score reaches ``threshold``."""
    if model is None:
        return documents
    handle = share(documents.sparkSession, model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted, vocabulary, tables = shared(handle), Vocabulary(), []
        for batch in batches:
            for part, texts in slices(batch, text, SLICE):
                if len(vocabulary) > VOCABULARY:
                    vocabulary, tables = Vocabulary(), []
                scores, _ = tag_texts(texts, fitted, vocabulary, tables)
                yield part.filter(pa.array([s < threshold for s in scores]))

    return documents.mapInArrow(keep, documents.schema)


def toxicity(documents: DataFrame, labels: DataFrame, learn_from: Column, keep: list[str] | None = None) -> DataFrame:
    """Scores of every document; the field learns from the labelled rows that
    ``learn_from`` (a condition on ``doc_id``) allows."""
    return score(documents, fit(sample_rows(documents, labels, learn_from)), keep or ["doc_id"])

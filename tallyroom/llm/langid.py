"""Language of every word by a linear-chain conditional random field.

States are the languages found in the sample. Features of a word: character
n-grams between boundary marks (prefixes, suffixes, inner n-grams) and the
whole word as a lexicon entry; transitions are learned from rows of the sample
cut into pieces and spliced, so that a chain switches language now and then.
Forward-backward marginals label each word; a document takes the language with
the largest share of its letters.

A null text, or one without letters, is ``und`` with score 0. A null or blank
label teaches nothing. Without any label every document is ``und``. Rows are
judged one by one: repeated rows and clashing extra columns change nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyroom.llm import crf
from tallyroom.llm.words import VOCABULARY, Vocabulary, gather, ngram_features, output, share, shared, slices

LETTERS = re.compile(r"[^\W\d_]+")
BITS = 17
SIZES = (1, 2, 3, 4)
#: Rows the field is fitted on, per language; words of a piece and pieces of a row.
SAMPLE_ROWS, PIECE_WORDS, PIECES = 250, 25, 8
#: Longer texts are not used to fit.
SAMPLE_CHARS = 50_000
UNKNOWN = "und"


@dataclass
class Model:
    languages: list[str]
    weight: np.ndarray
    start: np.ndarray
    transition: np.ndarray

    def words(self, words: list[str]) -> np.ndarray:
        feature, offset = ngram_features([w.lower() for w in words], SIZES, BITS)
        out = np.empty((len(words), len(self.languages)), np.float32)
        for at in range(0, len(words), 50_000):
            own = offset[at : at + 50_001]
            out[at : at + 50_000] = np.add.reduceat(self.weight[feature[own[0] : own[-1]]], own[:-1] - own[0], axis=0)
        return out


def fit(sample: list[tuple[str, str]]) -> Model | None:
    """``sample``: text and language of a bounded number of rows."""
    languages = sorted({lang for _, lang in sample})
    pieces = []
    for text, lang in sorted(set(sample)):
        words = [w.lower() for w in LETTERS.findall(text)]
        step = max(PIECE_WORDS, -(-len(words) // PIECES))
        pieces += [(words[at : at + PIECE_WORDS], languages.index(lang)) for at in range(0, len(words), step)]
    if not pieces:
        return None
    # Chains of four pieces in a fixed random order: about as many switches as pieces.
    order = np.random.default_rng(7).permutation(len(pieces))
    vocabulary = Vocabulary()
    code, tag, starts = [], [], []
    for place, at in enumerate(order):
        words, lang = pieces[at]
        code += [vocabulary[w] for w in words]
        tag += [lang] * len(words)
        starts += [place % 4 == 0] + [False] * (len(words) - 1)
    starts = np.array(starts)
    starts[0] = True
    feature, offset = gather(*ngram_features(list(vocabulary), SIZES, BITS), np.array(code))
    weight, start, transition = crf.train(
        feature, offset, np.array(tag), starts, 1 << BITS, len(languages), rounds=15
    )
    return Model(languages, weight, start, transition)


def sample_rows(documents: DataFrame, allowed: Column, rows: int = SAMPLE_ROWS) -> list[tuple[str, str]]:
    """At most ``rows`` rows of each language, of those with at most SAMPLE_CHARS
    characters, picked by a hash of the id; up to PIECES pieces spread over each of
    their texts are used to fit."""
    known = documents.filter(
        allowed & F.col("doc_id").isNotNull() & (F.trim("lang") != "") & (F.length("text") <= SAMPLE_CHARS)
    )
    # Each task keeps its first rows of a language before they meet, so a common one is no hot key.
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    ids = known.select("doc_id", "lang").distinct().withColumn("_place", place).filter(F.col("_place") <= rows).drop("_place")
    texts = documents.select("doc_id", "lang", "text").join(F.broadcast(ids), ["doc_id", "lang"]).filter(F.length("text") <= SAMPLE_CHARS)
    return [(r.text, r.lang) for r in texts.select("text", "lang").collect()]


def label_texts(texts: list[str], model: Model, vocabulary: Vocabulary, tables: list[np.ndarray]):
    """Per text: language, its share of the letters, and runs of equal word labels
    as (language, words)."""
    found = [LETTERS.findall(t) for t in texts]
    seen = len(vocabulary)
    code = np.array([vocabulary[w] for words in found for w in words], np.int64)
    if len(vocabulary) > seen:
        new = model.words(list(vocabulary)[seen:])
        tables[:] = [np.concatenate([tables[0], new])] if tables else [new]
    length = np.array([len(words) for words in found], np.int64)
    best, share, runs = [UNKNOWN] * len(texts), [0.0] * len(texts), [[] for _ in texts]
    if not len(code):
        return best, share, runs
    full = np.flatnonzero(length)
    begin = (np.cumsum(length) - length)[full]
    starts = np.zeros(len(code), bool)
    starts[begin] = True
    p = crf.marginals(tables[0][code].astype(float), starts, model.start, model.transition)[0]
    letters = np.array([len(w) for words in found for w in words], float)
    total = np.add.reduceat(p * letters[:, None], begin, axis=0)
    total /= total.sum(axis=1, keepdims=True)
    word = p.argmax(axis=1)
    edge = starts | np.append(True, word[1:] != word[:-1])
    run_at = np.flatnonzero(edge)
    run_length = np.diff(np.append(run_at, len(word)))
    run_row = np.repeat(full, length[full])[run_at]
    for row, values in zip(full.tolist(), total):
        k = int(values.argmax())
        best[row], share[row] = model.languages[k], float(values[k])
    for row, at, n in zip(run_row.tolist(), run_at.tolist(), run_length.tolist()):
        runs[row].append({"lang": model.languages[word[at]], "words": n})
    return best, share, runs


RUNS = pa.list_(pa.struct([("lang", pa.string()), ("words", pa.int32())]))


def predict(documents: DataFrame, model: Model | None, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` of every row, ``lang_pred``, ``score`` and ``runs``."""
    out = "lang_pred string, score double, runs array<struct<lang:string,words:int>>"
    if model is None:
        return documents.select(
            *keep, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"),
            F.array().cast("array<struct<lang:string,words:int>>").alias("runs"),
        )
    source = documents.select(*keep, F.col(text).alias("_text"))
    handle = share(documents.sparkSession, model)  # 2 ** BITS weights per language

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted, vocabulary, tables = shared(handle), Vocabulary(), []
        for batch in batches:
            for part, texts in slices(batch, "_text"):
                if len(vocabulary) > VOCABULARY:
                    vocabulary, tables = Vocabulary(), []
                best, share, runs = label_texts(texts, fitted, vocabulary, tables)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in keep), pa.array(best, pa.string()), pa.array(share, pa.float64()), pa.array(runs, RUNS)],
                    names=[*keep, "lang_pred", "score", "runs"],
                )

    return source.mapInArrow(label, output(source, keep, out))


def language(documents: DataFrame, learn_from: Column, keep: list[str] | None = None) -> DataFrame:
    """Languages of every document; the field learns from the rows that
    ``learn_from`` (a condition on ``doc_id``) allows."""
    return predict(documents, fit(sample_rows(documents, learn_from)), keep or ["doc_id"])

"""Five-word shingles as 64-bit numbers, on Arrow batches.

A-Z become lower case; words are runs of bytes other than space and 0x09-0x0D.
A text with fewer words than a shingle has its whole sequence as one shingle;
a text without words has none. Two different shingles share a number with a
chance of about 2 ** -64 per pair compared.
"""

from __future__ import annotations

import numpy as np

from tallyroom.llm.words import Vocabulary, word_hash

SIZE = 5
#: A Python worker forgets its words beyond this many.
KEPT = 400_000


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()  # bytes: only ASCII changes case or separates


class Shingler:
    def __init__(self) -> None:
        self.vocabulary, self.hashed = Vocabulary(), np.zeros(0, np.uint64)

    def run(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Shingle numbers of all texts in order, and the offsets of each text (repeats kept)."""
        if len(self.vocabulary) > KEPT:
            self.vocabulary, self.hashed = Vocabulary(), np.zeros(0, np.uint64)
        split = [words_of(t) for t in texts]
        seen = len(self.vocabulary)
        code = np.array([self.vocabulary[w] for words in split for w in words], np.int64)
        if len(self.vocabulary) > seen:
            self.hashed = np.concatenate([self.hashed, word_hash(list(self.vocabulary)[seen:])])
        length = np.array([len(words) for words in split], np.int64)
        word = self.hashed[code]
        count = np.where(length == 0, 0, np.maximum(length - SIZE + 1, 1))
        offset = np.concatenate([[0], np.cumsum(count)])
        begin = np.cumsum(length) - length
        at = np.repeat(begin, count) + np.arange(offset[-1]) - np.repeat(offset[:-1], count)
        out = np.full(offset[-1], SIZE, np.uint64)
        short = np.repeat((length > 0) & (length < SIZE), count)
        for j in range(SIZE):
            step = at + j
            # a short text ends early: its length goes in instead of the missing words
            present = ~short | (j < np.repeat(length, count))
            value = np.where(present, word[np.minimum(step, max(len(word) - 1, 0))], np.uint64(j + 1)) if len(word) else out
            out = fold(out, value)
        return out, offset


def fold(state: np.ndarray, value: np.ndarray) -> np.ndarray:
    state = (state ^ (state >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + value
    return (state ^ (state >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def exact(text: str) -> set[tuple[bytes, ...]]:
    """The shingles themselves, for checks."""
    words = words_of(text)
    if not words:
        return set()
    return {tuple(words[i : i + SIZE]) for i in range(max(1, len(words) - SIZE + 1))}

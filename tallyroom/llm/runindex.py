"""A run-length (r-) index over a collection of short byte strings.

The Burrows-Wheeler transform is kept as runs, with the text position (suffix
array sample) of the first and last row of every run. Patterns are streamed
from right to left, all at once: a pattern that cannot be extended in its row
moves to the nearest run of the wanted character above or below, whichever
shares more with what is matched, and takes the sampled position there. That
gives matching statistics: for each place in a pattern the length of the
longest match that starts there (up to ``depth``) and one place in the
collection where it occurs.
"""

from __future__ import annotations

import numpy as np


class RunIndex:
    def __init__(self, strings: list[bytes], depth: int):
        self.depth = depth
        length = np.array([len(s) for s in strings], np.int64)
        count = len(strings)
        # Symbols: 0 .. count-1 end the strings (all different), bytes follow.
        self.base = count
        data = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8).astype(np.int64) + count
        self.ends = np.cumsum(length + 1) - 1
        data[self.ends] = np.arange(count)
        self.text, self.owner = data, np.repeat(np.arange(count), length + 1)
        self.begins = self.ends - length
        self.suffix = self._suffixes()
        self._runs()

    def _suffixes(self) -> np.ndarray:
        """Suffix array by prefix doubling; a round sorts only what is still tied,
        and ends differ, so the ties are gone soon. A rank is the first row of
        the suffixes that share it."""
        n = len(self.text)
        key, step = self.text, 1
        self.half = None  # equal numbers: equal first ``half_depth`` symbols
        if int(key.max()) < 1 << 15:  # four symbols fit into one number
            padded = np.concatenate([key, np.zeros(3, np.int64)])
            key, step = (padded[:n] << 45) | (padded[1 : n + 1] << 30) | (padded[2 : n + 2] << 15) | padded[3:], 4
        order, rank, rows, suffix = np.empty(n, np.int64), np.empty(n, np.int64), np.arange(n), np.arange(n)
        while True:
            by = np.argsort(key)
            suffix, key = suffix[by], key[by]
            new = np.append(True, key[1:] != key[:-1])
            order[rows] = suffix
            rank[suffix] = rows[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))]
            if 2 * step > self.depth >= step:
                self.half, self.half_depth = rank.copy(), step
            tied = ~(new & np.append(new[1:], True))
            if not tied.any():
                return order
            rows, suffix = rows[tied], suffix[tied]
            after = np.where(suffix + step < n, rank[np.minimum(suffix + step, n - 1)] + 1, 0)
            key = rank[suffix] * (n + 1) + after
            step *= 2

    def _runs(self) -> None:
        n = len(self.text)
        transform = self.text[self.suffix - 1]  # the row of position 0 wraps round to the last end
        head = np.flatnonzero(np.append(True, transform[1:] != transform[:-1]))
        self.run_start, self.run_char = head, transform[head]
        size = np.diff(np.append(head, n))
        # Sampled positions: first and last row of every run.
        self.first_at, self.last_at = self.suffix[head], self.suffix[head + size - 1]
        # LF: runs of one character, in order, fill that character's block of rows.
        by_char = np.argsort(self.run_char, kind="stable")
        self.lf = np.empty(len(head), np.int64)
        self.lf[by_char] = np.concatenate([[0], np.cumsum(size[by_char])[:-1]])
        # Runs of every character by position, for jumps.
        self.jump_run = by_char
        self.jump_key = self.run_char[by_char] * (n + 1) + head[by_char]
        self.n = n

    def common(self, place: np.ndarray, text: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Length, up to ``depth``, of what ``text`` at ``at`` shares with the collection at ``place``."""
        span = np.arange(self.depth)
        a = self.text[np.minimum(place[:, None] + span, self.n - 1)]
        b = text[np.minimum(at[:, None] + span, len(text) - 1)]
        same = (a == b) & (a >= self.base) & (place[:, None] + span < self.n) & (at[:, None] + span < len(text))
        return np.where(same.all(axis=1), self.depth, same.argmin(axis=1))

    def stream(self, patterns: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Matching statistics of all patterns, one after another: offsets of the
        patterns, match length at each place, the matched position and its row."""
        size = np.array([len(p) for p in patterns], np.int64)
        offset = np.concatenate([[0], np.cumsum(size + 1)])
        text = np.frombuffer(b"\0".join(patterns) + b"\0", np.uint8).astype(np.int64) + self.base
        text[offset[1:] - 1] = -1  # matches nothing
        length, place, row = (np.zeros(len(text), np.int64) for _ in range(3))
        at = offset[1:] - 2  # the next character to read, from the right
        active = np.flatnonzero(size > 0)
        now_row, now_place, now_length = (np.zeros(len(patterns), np.int64) for _ in range(3))
        while len(active):
            here = at[active]
            char, rows, places, matched = text[here], now_row[active], now_place[active], now_length[active]
            run = np.searchsorted(self.run_start, rows, "right") - 1
            lost = np.flatnonzero((self.run_char[run] != char) | (matched == 0))
            if len(lost):
                # The next run of the character below, and the one before it.
                wanted = char[lost] * (self.n + 1)
                below = np.searchsorted(self.jump_key, wanted + rows[lost], "left")
                above = below - 1
                has_below = (below < len(self.jump_key)) & (self.jump_key[np.minimum(below, len(self.jump_key) - 1)] < wanted + self.n + 1)
                has_above = (above >= 0) & (self.jump_key[np.maximum(above, 0)] >= wanted)
                below_run = self.jump_run[np.minimum(below, len(self.jump_key) - 1)]
                above_run = self.jump_run[np.maximum(above, 0)]
                ahead = here[lost] + 1
                below_common = np.where(has_below, self.common(self.first_at[below_run], text, ahead), -1)
                above_common = np.where(has_above, self.common(self.last_at[above_run], text, ahead), -1)
                down = below_common >= above_common
                best = np.minimum(np.maximum(below_common, above_common), matched[lost])
                run_size = np.diff(np.append(self.run_start, self.n))
                rows[lost] = np.where(down, self.run_start[below_run], self.run_start[above_run] + run_size[above_run] - 1)
                places[lost] = np.where(down, self.first_at[below_run], self.last_at[above_run])
                matched[lost] = np.where(best < 0, -1, best)
                run = np.searchsorted(self.run_start, rows, "right") - 1
            known = matched >= 0
            rows = np.where(known, self.lf[run] + rows - self.run_start[run], 0)
            places = np.where(known, places - 1, 0)
            matched = np.where(known, np.minimum(matched + 1, self.depth), 0)
            now_row[active], now_place[active], now_length[active] = rows, places, matched
            length[here], place[here], row[here] = matched, places, rows
            at[active] -= 1
            active = active[at[active] >= offset[active]]
        return offset, length, place, row

    def blocks(self) -> np.ndarray:
        """A number per row; rows with the same ``depth`` first bytes share it."""
        a, b = self.suffix[:-1], self.suffix[1:]
        if self.half is not None:  # two overlapping halves of known equality cover the depth
            apart = self.depth - self.half_depth
            at = lambda x: self.half[np.minimum(x + apart, self.n - 1)]
            same = (self.half[a] == self.half[b]) & (at(a) == at(b))
            # nothing that crosses the end of a string is long enough
            same &= a + self.depth <= self.ends[self.owner[a]]
            return np.concatenate([[0], np.cumsum(~same)])
        shared = np.empty(len(a), np.int64)
        for begin in range(0, len(a), 1 << 16):
            part = slice(begin, begin + (1 << 16))
            shared[part] = self.common(a[part], self.text, b[part])
        return np.concatenate([[0], np.cumsum(shared < self.depth)])

    def earliest(self, document: np.ndarray) -> np.ndarray:
        """Per row: the smallest number in ``document`` (one per string) among the
        strings that hold the same ``depth`` bytes."""
        block = self.blocks()
        begin = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
        return np.minimum.reduceat(document[self.owner[self.suffix]], begin)[block]

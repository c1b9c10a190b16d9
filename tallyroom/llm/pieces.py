"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

A text is one space mark and the text with spaces as marks. No piece holds a
mark after another character, so merges never cross the place before a run of
marks: the text falls into chunks that a Python worker encodes once. In a
chunk an agenda holds every adjacent pair of symbols that forms a piece; the
pair of the highest score, the leftmost among equals, is merged until none is
left. Short chunks keep their agendas side by side as the rows of one matrix,
long ones use a heap. Characters that are no piece become byte pieces. Every
new chunk is checked against the sentencepiece library, in batches; a
difference stops the job.

Null and empty texts give the end id alone and decode to the empty text. Rows
are encoded one by one: repeated rows and clashing extra columns change nothing.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tallyroom.llm.words import lasting, output, slices

MARK = "▁"
CHUNK = re.compile(f"{MARK}+[^{MARK}]*")
#: Longer chunks go through the heap; they are not kept.
LONG = 48
#: Chunks that a Python worker keeps.
KEPT = 400_000
NORMAL = 1


#: Rank of a pair that is no piece.
NONE = np.iinfo(np.int32).max


class PairTable:
    """(left symbol, right symbol) to (merged symbol, rank of its score)."""

    BITS = 20
    FREE = np.iinfo(np.int64).min

    def __init__(self, pairs: dict[int, tuple[int, int]]):
        key = np.fromiter(pairs, np.int64, len(pairs))
        value = np.array(list(pairs.values()), np.int32).reshape(-1, 2)
        slot = self._slot(key)
        # A key with a negative symbol is negative too, but no key is FREE.
        self.key = np.full(1 << self.BITS, self.FREE, np.int64)
        self.symbol = np.full(1 << self.BITS, -1, np.int32)
        self.rank = np.full(1 << self.BITS, NONE, np.int32)
        self.key[slot], self.symbol[slot], self.rank[slot] = key, value[:, 0], value[:, 1]  # of pairs in one slot the last stays
        lost = self.key[slot] != key
        self.crowded = np.zeros(1 << self.BITS, bool)
        self.crowded[slot[lost]] = True
        order = np.argsort(key[lost])
        self.other_key, self.other_value = key[lost][order], value[lost][order]

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merged symbols and ranks; rank NONE where the pair is no piece."""
        key = (left.astype(np.int64) << 32) | right
        slot = self._slot(key)
        hit = self.key[slot] == key
        merged, rank = np.where(hit, self.symbol[slot], np.int32(-1)), np.where(hit, self.rank[slot], np.int32(NONE))
        if len(self.other_key):
            rest = np.flatnonzero(self.crowded[slot] & ~hit)
            at = np.minimum(np.searchsorted(self.other_key, key[rest]), len(self.other_key) - 1)
            ok = self.other_key[at] == key[rest]
            merged[rest[ok]], rank[rest[ok]] = self.other_value[at[ok], 0], self.other_value[at[ok], 1]
        return merged, rank


class Pieces:
    """Encoder and decoder of one model file."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as schema

        proto = schema.ModelProto()
        with open(path, "rb") as file:
            proto.ParseFromString(file.read())
        spec = proto.normalizer_spec
        if proto.trainer_spec.model_type != schema.TrainerSpec.BPE or not proto.trainer_spec.byte_fallback:
            raise ValueError("a merge-type vocabulary with byte fallback is needed")
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.add_dummy_prefix:
            raise ValueError("only identity normalisation with a leading space mark is known")
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.end = self.library.eos_id()
        self.surface = [p.piece for p in proto.pieces]
        self.byte = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == schema.ModelProto.SentencePiece.BYTE}
        self.value_of = {i: b for b, i in self.byte.items()}
        self.spelled = [str(i) for i in range(len(self.surface))]
        known = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == NORMAL}
        if any(MARK in p.lstrip(MARK) for p in known):
            raise ValueError("a piece holds a space mark after another character")
        scores = sorted({proto.pieces[i].score for i in known.values()}, reverse=True)
        rank = {score: k for k, score in enumerate(scores)}
        # Symbols: pieces keep their ids; characters that are no piece follow.
        self.symbol = {p: i for p, i in known.items() if len(p) == 1}
        for piece in known:
            for char in piece:
                self.symbol.setdefault(char, len(self.surface) + len(self.symbol))
        pairs = {}
        for piece, i in known.items():
            for cut in range(1, len(piece)):
                left, right = (self.symbol[x] if len(x) == 1 else known.get(x) for x in (piece[:cut], piece[cut:]))
                if left is not None and right is not None:
                    pairs[(left << 32) | right] = (i, rank[proto.pieces[i].score])
        self.pairs, self.table = pairs, PairTable(pairs)
        self.first = np.full(0x110000, -1, np.int32)
        for char, number in self.symbol.items():
            self.first[ord(char)] = number

    def _ids(self, symbols: list[int], chars: str) -> list[int]:
        """Symbols to ids: a symbol that is no piece is one character, spelled in bytes."""
        out, at = [], 0
        size = len(self.surface)
        for s in symbols:
            if 0 <= s < size:
                out.append(s)
                at += len(self.surface[s])
            else:
                out += [self.byte[b] for b in chars[at].encode()]
                at += 1
        return out

    def agenda(self, chunk: str) -> list[int]:
        """One chunk through a heap of (rank, place) pairs."""
        symbols = [self.symbol.get(c, -1) for c in chunk]
        before, after = list(range(-1, len(symbols) - 1)), list(range(1, len(symbols) + 1))
        heap = []

        def offer(i: int, j: int) -> None:
            if symbols[i] >= 0 and symbols[j] >= 0 and (got := self.pairs.get((symbols[i] << 32) | symbols[j])):
                heapq.heappush(heap, (got[1], i, j, symbols[i], symbols[j], got[0]))

        for i in range(len(symbols) - 1):
            offer(i, i + 1)
        gone = -2
        while heap:
            _, i, j, left, right, merged = heapq.heappop(heap)
            if symbols[i] != left or symbols[j] != right or after[i] != j:
                continue
            symbols[i], symbols[j] = merged, gone
            after[i] = after[j]
            if after[i] < len(symbols):
                before[after[i]] = i
                offer(i, after[i])
            if before[i] >= 0:
                offer(before[i], i)
        return self._ids([s for s in symbols if s != gone], chunk)

    def agendas(self, chunks: list[str]) -> list[list[int]]:
        """Many short chunks at once: row r of the rank matrix is the agenda of
        chunk r, each step merges the best leftmost pair of every row, so that
        all rows at work grow shorter together."""
        width = max(map(len, chunks))
        code = np.frombuffer("".join([c.ljust(width, "\0") for c in chunks]).encode("utf-32-le"), np.uint32)
        symbols = self.first[code].reshape(-1, width)
        symbols[np.arange(width) >= np.array([len(c) for c in chunks])[:, None]] = -2
        merged, rank = np.full(symbols.shape, -1, np.int32), np.full(symbols.shape, NONE, np.int32)
        merged[:, :-1], rank[:, :-1] = self._pairs(symbols[:, :-1], symbols[:, 1:])
        out: list[list[int]] = [[]] * len(chunks)
        rows = np.arange(len(chunks))
        while True:
            at, line = rank.argmin(axis=1), np.arange(len(rows))
            live = rank[line, at] < NONE
            if not live.all():
                self._settle(symbols[~live], rows[~live], chunks, out)
                rows, symbols, merged, rank, at = rows[live], symbols[live], merged[live], rank[live], at[live]
                line = line[: len(rows)]
                if not len(rows):
                    break
            symbols[line, at] = merged[line, at]
            width -= 1
            stay = np.ones(symbols.shape, bool)
            stay[line, at + 1] = False
            symbols = symbols[stay].reshape(-1, width)
            stay[line, at + 1], stay[line, at] = True, False  # the merged pair leaves the agenda
            merged, rank = merged[stay].reshape(-1, width), rank[stay].reshape(-1, width)
            before, after = np.flatnonzero(at > 0), np.flatnonzero(at < width - 1)
            line, left = np.concatenate([before, after]), np.concatenate([at[before] - 1, at[after]])
            merged[line, left], rank[line, left] = self._pairs(symbols[line, left], symbols[line, left + 1])
        return out

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        merged, rank = self.table.find(left.ravel(), right.ravel())
        return merged.reshape(left.shape), rank.reshape(left.shape)

    def _settle(self, symbols: np.ndarray, rows: np.ndarray, chunks: list[str], out: list[list[int]]) -> None:
        """The ids of rows whose agendas are empty."""
        plain = ((symbols >= 0) & (symbols < len(self.surface)) | (symbols == -2)).all(axis=1).tolist()
        count = (symbols != -2).sum(axis=1).tolist()
        for k, row, n, ok in zip(rows.tolist(), symbols.tolist(), count, plain):
            out[k] = row[:n] if ok else self._ids(row[:n], chunks[k])

    def chunks(self, chunks: list[str]) -> list[list[int]]:
        """Ids of each chunk, compared with the library."""
        out: list[list[int] | None] = [None] * len(chunks)
        order = np.argsort([len(c) for c in chunks], kind="stable").tolist()
        for begin in range(0, len(order), 8192):
            part = [k for k in order[begin : begin + 8192] if len(chunks[k]) <= LONG]
            for k, ids in zip(part, self.agendas([chunks[k] for k in part]) if part else []):
                out[k] = ids
        out = [self.agenda(chunks[k]) if ids is None else ids for k, ids in enumerate(out)]
        # the library puts the first mark itself, but not before nothing
        spoken = [k for k, c in enumerate(chunks) if c != MARK]
        told = self.library.encode([chunks[k][1:] for k in spoken], num_threads=1)
        if told != [out[k] for k in spoken]:
            bad = next(chunks[k] for k, ids in zip(spoken, told) if ids != out[k])
            raise ValueError(f"the library encodes {bad!r} otherwise")
        return out

    def surfaces(self, ids: list[int]) -> str:
        """Text of ids, marks kept."""
        if self.value_of.keys().isdisjoint(ids):
            return "".join(map(self.surface.__getitem__, ids))
        text, pending = [], bytearray()
        for i in ids:
            if i in self.value_of:
                pending.append(self.value_of[i])
                continue
            if pending:
                text.append(pending.decode("utf-8", "replace"))
                pending.clear()
            text.append(self.surface[i])
        if pending:
            text.append(pending.decode("utf-8", "replace"))
        return "".join(text)

    def encode(self, text: str) -> list[int]:
        """Ids of one text with the end id."""
        chunks = CHUNK.findall(MARK + text.replace(" ", MARK)) if text else []
        return [i for ids in (self.chunks(chunks) if chunks else []) for i in ids] + [self.end]

    def decode(self, ids: list[int]) -> str:
        text = self.surfaces([i for i in ids if i != self.end]).replace(MARK, " ")
        return text[1:] if text.startswith(" ") else text


class ChunkMemory:
    """Ids (as text) of the chunks seen in a stream, and the decoded text of those
    that do not decode to themselves."""

    def __init__(self, pieces: Pieces):
        self.pieces, self.ids, self.other = pieces, {}, {}

    def learn(self, split: list[list[str]]) -> None:
        chunks = set().union(*split)
        if len(self.ids) > KEPT:  # those at hand stay: the frequent ones are among them
            here = chunks & self.ids.keys()
            self.ids = {c: self.ids[c] for c in here}
            self.other = {c: t for c, t in self.other.items() if c in here}
        new = list(chunks.difference(self.ids))
        if new:
            found, spelled = self.pieces.chunks(new), self.pieces.spelled.__getitem__
            self.ids.update(zip(new, [" ".join(map(spelled, ids)) for ids in found]))
            for chunk, decoded in zip(new, map(self.pieces.surfaces, found)):
                if decoded != chunk:
                    self.other[chunk] = decoded

    def decoded(self, chunks: list[str]) -> str:
        text = "".join(chunks) if self.other.keys().isdisjoint(chunks) else "".join([self.other.get(c, c) for c in chunks])
        return text.replace(MARK, " ")[1:]

    def run(self, texts: list[str]) -> tuple[list[str], list[str]]:
        """Ids of each text joined by spaces, end id included, and the decoded text."""
        split = [CHUNK.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        self.learn(split)
        end = str(self.pieces.end)
        ids = [" ".join([*map(self.ids.__getitem__, chunks), end]) for chunks in split]
        return ids, [self.decoded(chunks) for chunks in split]


def chunk_memory(model: str) -> ChunkMemory:
    """One per Python worker: its next task finds the chunks of the one before."""
    return lasting(("chunks", model), lambda: ChunkMemory(Pieces(model)))


def encode(documents: DataFrame, model: str, keep: list[str], text: str = "text", ids: bool = False) -> DataFrame:
    """The columns ``keep`` of every row with ``n_tokens``, ``ids_sha256`` and
    ``decoded_sha256`` (lowercase hex), with ``ids=True`` also ``ids`` and ``decoded``.

    ``model`` is a path that every executor can open.
    """
    source = documents.select(*keep, documents[text].alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = chunk_memory(model)
        for batch in batches:
            for part, texts in slices(batch, "_text", 2 << 20):
                coded, decoded = memory.run(texts)
                columns = [
                    *(part.column(c) for c in keep),
                    pa.array([c.count(" ") + 1 for c in coded], pa.int64()),
                    pa.array([hashlib.sha256(c.encode()).hexdigest() for c in coded]),
                    pa.array([hashlib.sha256(d.encode()).hexdigest() for d in decoded]),
                ]
                names = [*keep, "n_tokens", "ids_sha256", "decoded_sha256"]
                if ids:
                    columns += [pa.array([list(map(int, c.split(" "))) for c in coded], pa.list_(pa.int32())), pa.array(decoded)]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    added = "n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * ids
    return source.mapInArrow(run, output(source, keep, added))

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tallyroom.llm import pieces, tokenfiles

PIECES, BYTES = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")
EDGE = [
    "", " ", "  ", " a", "a ", "a  b", "   a   b  ", "\n", "a\n\n b", "foo\n \tbar", "foo \nbar", "▁", "▁▁x", "x▁y z", "😀é\0",
    "日本語テキスト", "<s> </s> <0x0A>", "a <|endoftext|> b", "don't we'll", "a" * 3000, "ab" * 100 + "  " + "zz " * 50, "é́" * 30, "  x\x1c y",
]


def texts():
    rng = random.Random(5)
    return EDGE + ["".join(rng.choice("aB  \n\t1é😀▁,.'s²\x1c_") for _ in range(rng.randrange(1, 70))) for _ in range(1500)]


def test_agendas_equal_the_library():
    model, library = pieces.Pieces(PIECES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    memory = pieces.ChunkMemory(model)
    ids, decoded = memory.run(texts())
    for text, own, back in zip(texts(), ids, decoded):
        told = library.encode(text, add_eos=True)
        assert own == " ".join(map(str, told)) and back == library.decode(told)
        assert model.encode(text) == told and model.decode(told) == back
        if text:
            assert model.agenda(pieces.MARK + text.replace(" ", pieces.MARK)) + [2] == told


def test_a_difference_from_the_library_stops(monkeypatch):
    model = pieces.Pieces(PIECES)
    monkeypatch.setattr(model, "agendas", lambda chunks: [[5] for _ in chunks])
    with pytest.raises(ValueError, match="otherwise"):
        model.chunks(["▁hello"])


def test_piece_query_columns(frame):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rows = [(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "x" * 200_000)]
    out = pieces.encode(frame(rows), PIECES, ["doc_id", "score"], ids=True).collect()
    assert len(out) == len(rows) and all(r.score == 9.0 for r in out)
    for r, (_, text) in zip(out, rows):
        told = library.encode(text or "", add_eos=True)
        assert r.ids == told and r.n_tokens == len(told)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, told)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(told).encode()).hexdigest()
    assert pieces.encode(frame([]), PIECES, ["doc_id"]).count() == 0


def test_words_equal_the_library():
    words = tokenfiles.Words(BYTES)
    plain = tokenfiles.Words(BYTES, plain=True)
    library = Tokenizer.from_file(BYTES)
    for text, own in zip(texts(), words.encode(texts(), 2)):
        assert np.frombuffer(own, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids + [2]
    library.encode_special_tokens = True
    for text, own in zip(texts(), plain.encode(texts())):
        assert np.frombuffer(own, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_new_words_are_one_text_and_those_at_hand_are_kept(monkeypatch):
    words, library = tokenfiles.Words(BYTES), Tokenizer.from_file(BYTES)
    asked, single = [], words._library
    monkeypatch.setattr(words, "_library", lambda texts: asked.extend(texts) or single(texts))
    monkeypatch.setattr(tokenfiles.Words, "KEPT", 2)
    text = 'First ▁é "97ffa8 x1y2 \u0120z don\'t\u00a0go \u0085q\n ab  cd'
    for _ in range(2):
        for t, own in zip([text, text + " new"], words.encode([text, text + " new"])):
            assert np.frombuffer(own, "<u4").tolist() == library.encode(t, add_special_tokens=False).ids
    assert " x1y2" not in asked and len(asked) == len(set(asked))
    assert tokenfiles.worker_words(BYTES) is tokenfiles.worker_words(BYTES)


def test_pieces_between_classes_of_bytes_are_encoded_once():
    words, library = tokenfiles.Words(BYTES), Tokenizer.from_file(BYTES)
    words.encode(["river, stone.\nriver (river)", "", "stone2 river"], 2)
    assert set(words.now.number) == {"river", ",", " stone", ".", "\n", " (", ")", "stone", "2", " river", "\0"}
    rng = random.Random(8)
    some = ["".join(rng.choice("aaBs  \n\t\r'',.(|1\u0661\u00b2\u00e9\u00df\u00d7\u00a0\u3000\u2009\u0085\u201c\x1c\0\u4e00\U0001f600") for _ in range(rng.randrange(1, 40))) for _ in range(6000)]
    some += ["ends with line\n", " \u00e9t\u00e9 \u00d7 ab\u00e9", "x" * 200 + " " + "y" * 200, "a <|endoftext|>b, c", "it's '\u00e9 we'll 'x", "  ", "a  "]
    for end, tail in ((2, [2]), (None, [])):
        for text, own in zip(some, words.encode(some, end)):
            assert np.frombuffer(own, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids + tail
    assert words.encode([]) == [] and max(map(len, words.now.number)) <= words.LONG


def test_chunks_at_hand_are_kept(monkeypatch):
    monkeypatch.setattr(pieces, "KEPT", 2)
    memory, asked = pieces.ChunkMemory(pieces.Pieces(PIECES)), []
    encode = memory.pieces.chunks
    monkeypatch.setattr(memory.pieces, "chunks", lambda chunks: asked.extend(chunks) or encode(chunks))
    first, again = memory.run(["one two three four"]), memory.run(["one two three four five"])
    assert first[1] == ["one two three four"] and again[1] == ["one two three four five"]
    assert len(asked) == len(set(asked)) == 5
    assert pieces.chunk_memory(PIECES) is pieces.chunk_memory(PIECES)


def test_only_chunks_that_decode_otherwise_keep_a_text(monkeypatch):
    memory = pieces.ChunkMemory(pieces.Pieces(PIECES))
    assert memory.run(["one two\n é😀\0 x▁y", "one"])[1] == ["one two\n é😀\0 x y", "one"] and not memory.other
    decode = memory.pieces.surfaces
    monkeypatch.setattr(memory.pieces, "surfaces", lambda ids: decode(ids).replace("three", "3"))
    assert memory.run(["one three two three", "one"])[1] == ["one 3 two 3", "one"] and memory.other == {"▁three": "▁3"}


def test_pairs_are_found_and_others_are_none():
    model = pieces.Pieces(PIECES)
    keys = np.array(list(model.pairs), np.int64)
    merged, rank = model.table.find((keys >> 32).astype(np.int32), keys.astype(np.int32))
    assert list(zip(merged.tolist(), rank.tolist())) == list(model.pairs.values())
    left, right = np.array([-1, 0, -2, -1, 5, 3], np.int32), np.array([0, -1, -2, -1, -2, 3], np.int32)
    assert model.table.find(left, right)[1].tolist() == [pieces.NONE] * 6


def test_grammars_expand_and_give_single_documents():
    rng = np.random.default_rng(6)
    phrase = rng.integers(0, 40, 30)
    ids = np.concatenate([phrase] * 200 + [rng.integers(0, 40, 500), np.full(301, 7)]).astype(np.uint32)
    ends = np.append(np.unique(rng.integers(1, len(ids), 50)), len(ids))
    block = tokenfiles.Block(tokenfiles.pack(ids, ends, 40))
    assert (block.ids() == ids).all() and len(block.sequence) < len(ids) / 5
    for k, (a, b) in enumerate(zip([0, *ends], ends)):
        assert (block.document(k) == ids[a:b]).all()
    for few in ([], [5], [1] * 9, [1, 2] * 40):
        few = np.array(few, np.uint32)
        assert (tokenfiles.Block(tokenfiles.pack(few, np.array([len(few)]), 10)).ids() == few).all()
    with pytest.raises(ValueError):
        tokenfiles.Block(b"nope" + bytes(60))


def test_files_are_read_back(spark, frame, monkeypatch):
    monkeypatch.setattr(tokenfiles, "BLOCK", 300)
    rng = random.Random(7)
    rows = [(i, " ".join(rng.choice(["river", "stone,", "a"]) for _ in range(rng.randrange(0, 80)))) for i in range(300)]
    rows += [(400, None), (401, ""), (7, "again"), (7, "again"), (-5, "first <|endoftext|>"), (402, "z " * 5000), (None, "no id")]
    rng.shuffle(rows)
    folder = tokenfiles.new_folder(spark, "test-tokens")
    tokenfiles.write(frame(rows).repartition(3), BYTES, 2, folder)
    got = sorted(tokenfiles.read(spark, folder).collect(), key=lambda r: r.start)
    library, at = Tokenizer.from_file(BYTES), 0
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    for r, (name, text) in zip(got, order):
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (name, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert len(got) == len(rows)
    folder = tokenfiles.new_folder(spark, "test-tokens")
    tokenfiles.write(frame([]), BYTES, 2, folder)
    assert tokenfiles.read(spark, folder).count() == 0

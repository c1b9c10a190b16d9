import hashlib
import random
import re

import numpy as np
import pytest

from tallyroom.llm import pii, substrings
from tallyroom.llm.runindex import RunIndex

# The patterns as the contract has them.
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(x) <= 255 for x in value.split("."))
    if kind == "card":
        total = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(digits[::-1]))
        return 12 <= len(digits) <= 19 and total % 10 == 0
    return kind != "phone" or 9 <= len(digits) <= 15


def base(text):
    found = [(m.start(), k, kind, m.end()) for k, kind in enumerate(PLAIN) for m in re.finditer(PLAIN[kind], text) if valid(kind, m.group())]
    return ",".join(f"{kind}:{start}:{end}" for start, _, kind, end in sorted(found))


def test_base_spans_equal_the_plain_patterns(frame):
    rng = random.Random(12)
    parts = ["4111 1111 1111 1111", "4111-1111-1111-1112", "a.b+c@d-e.co.uk", "x@y", "é@z.org_q@w.net", "1.2.3.4", "256.1.1.1", "0001.02.3.255", "1.2.3.4.5.6.7.8",
             "+1 (555) 010-9999", "+12", "+1 2345 678 90 12 34 56 78", "..", "😀", " ", "@", "a@b.c", "9" * 13, "-", "1", "\n", "+44.20.7946.0958."]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 9))) for _ in range(400)]
    texts += [None, "", "a" * 50_000, "1" * 50_000, "1." * 3_000, "+1 " + "(" * 20_000, "a@" + "b." * 9_000 + "c", "1-" * 9_000]
    found = pii.find(frame(list(enumerate(texts))))
    kept = found.selectExpr("doc_id", "filter(pii, s -> s.kind <> 'iban') AS pii")
    out = {r.doc_id: r for r in kept.select("doc_id", pii.listed(kept.pii).alias("listed"), "pii").collect()}
    assert all(out[i].listed == base(t or "") for i, t in enumerate(texts))
    assert all(0 < s.score <= 1 for r in out.values() for s in r.pii)


def test_accounts_context_and_blanking(spark, frame):
    rows = [(1, "bank account DE89 3704 0044 0532 0130 00, mail me@x.org"), (2, "DE88 3704 0044 0532 0130 00"), (3, "version 10.0.0.1"), (4, "host 10.0.0.1"), (5, None), (6, "plain")]
    out = {r.doc_id: r for r in pii.find(frame(rows)).collect()}
    assert [(s.kind, s.start, s.end) for s in out[1].pii] == [("iban", 13, 40), ("email", 47, 55)]
    assert not out[2].pii and out[4].pii[0].score > out[3].pii[0].score
    documents = frame(rows + [(7, "+49 160 4111 1111 1111 1111")])
    blank = pii.redact(documents)
    assert blank.columns == documents.columns
    text = {r.doc_id: r.text for r in blank.collect()}
    assert text[1] == "bank account [IBAN], mail [EMAIL]" and text[5] is None and text[6] == "plain" and text[3] == "version [IP]"
    assert pii.redact(frame([])).count() == 0


def test_matching_statistics_equal_brute_force():
    rng = random.Random(13)
    for trial in range(80):
        letters = b"ab" if trial % 2 else b"abc\0"
        word = lambda n: bytes(rng.choice(letters) for _ in range(rng.randrange(0, n)))
        strings = [word(30) for _ in range(rng.randrange(1, 8))] + [b"a"]
        patterns = [word(25) for _ in range(5)] + [strings[0]]
        depth = rng.choice([3, 4, 8, 50])
        index = RunIndex(strings, depth)
        document = np.array([rng.randrange(10) for _ in strings])
        offset, length, place, row = index.stream(patterns)
        first = index.earliest(document)
        for k, p in enumerate(patterns):
            for i in range(len(p)):
                best = max(n for n in range(min(depth, len(p) - i) + 1) if any(p[i : i + n] in s for s in strings))
                at = offset[k] + i
                assert length[at] == best
                if best:
                    owner = index.owner[place[at]]
                    assert strings[owner][place[at] - index.begins[owner] :][:best] == p[i : i + best]
                if best == depth:
                    assert first[row[at]] == min(d for d, s in zip(document, strings) if p[i : i + depth] in s)


def brute(rows):
    """Removed runs by the definition."""
    first, out = {}, {}
    data = [(i, (t or "").encode()) for i, t in rows]
    for i, x in data:
        for a in range(len(x) - 49):
            first[x[a : a + 50]] = min(i, first.get(x[a : a + 50], i))
    for i, x in data:
        mark = bytearray(len(x))
        for a in range(len(x) - 49):
            if first[x[a : a + 50]] < i:
                mark[a : a + 50] = b"\1" * 50
        kept = bytes(c for c, m in zip(x, mark) if not m)
        runs = sum(1 for k in range(len(x)) if mark[k] and (k == 0 or not mark[k - 1]))
        out[i] = (len(x), sum(mark), runs, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("hot, index", [(1000, 20_000), (3, 7)])
def test_removed_bytes_equal_brute_force(frame, monkeypatch, hot, index):
    monkeypatch.setattr(substrings, "HOT", hot)  # small: contexts are dealt by longer strings
    monkeypatch.setattr(substrings, "INDEX", index)  # small: several indexes for a bucket
    rng = random.Random(14)
    noise = lambda n: "".join(rng.choice("abcdefghij é\n") for _ in range(n))
    shared, line = [noise(n) for n in (49, 50, 51, 70, 130, 400)], noise(35)
    rows = []
    for i in rng.sample(range(1000), 120):
        text = "".join(rng.choice([noise(rng.randrange(0, 60)), rng.choice(shared), line, rng.choice(shared)[5:60]]) for _ in range(rng.randrange(0, 7)))
        rows.append((i, text))
    rows += [(2000, rows[5][1]), (2001, rows[5][1]), (2002, None), (2003, ""), (2004, "x" * 300), (2005, "x" * 500), (-3, shared[4]), (2006, "short"), (2007, "short")]
    out = {r.doc_id: r for r in substrings.remove_repeats(frame(rows).repartition(5), with_text=True).collect()}
    expected = brute(rows)
    assert len(out) == len(rows)
    for i, r in out.items():
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == expected[i]
        assert hashlib.sha256(r.kept).hexdigest() == r.kept_sha256


def test_repeated_ids_and_rows_without_one(frame):
    text = "0123456789" * 8
    other = "prefix " + text
    rows = [(5, text), (5, text), (5, other), (None, text), (9, text)]
    out = substrings.remove_repeats(frame(rows)).collect()
    assert sorted((r.doc_id or -1, r.n_bytes, r.n_removed) for r in out) == [(-1, 80, 0), (5, 80, 0), (5, 80, 0), (5, 87, 0), (9, 80, 80)]
    assert substrings.remove_repeats(frame([])).count() == 0


def test_a_passage_in_a_third_of_the_documents(frame):
    """More texts share a passage than ``HOT``: its minimisers are dealt by longer strings."""
    rng = random.Random(15)
    noise = lambda n: "".join(rng.choice("abcdefghij klmno") for _ in range(n))
    passage = noise(90)
    rows = [(i, noise(40) + (passage if i % 3 == 0 else noise(60)) + noise(30)) for i in range(3 * substrings.HOT + 300)]
    rng.shuffle(rows)
    expected = brute(rows)
    out = substrings.remove_repeats(frame(rows).repartition(6)).collect()
    assert len(out) == len(rows) and all((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == expected[r.doc_id] for r in out)
    assert sum(r.n_removed >= 90 for r in out) == len(rows) // 3 - 1


def test_early_windows_of_a_held_string():
    word = bytes(range(33, 33 + substrings.WINDOW + 10))
    held = [word, b"-" * 70]
    asked = [b"xx" + word[:-1] + b"y", word[: substrings.WINDOW - 1], b"z" + word + word]
    string, first, last = substrings.early(asked, np.array([5, 5, 5]), held, np.array([4, 9]))
    assert list(zip(string.tolist(), first.tolist(), last.tolist())) == [(0, 2, 11), (2, 1, 11), (2, 61, 71)]
    assert [x.tolist() for x in substrings.early(asked, np.array([4, 4, 4]), held, np.array([4, 9]))] == [[], [], []]

import random

import pytest

from tallyroom.llm import decontamination, jaccard
from tallyroom.llm.components import components
from tallyroom.llm.shingles import exact


def corpus(seed, n=140):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    line = "all rights reserved by the owners of this page"
    base = [[rng.choice(words) for _ in range(rng.randrange(1, 90))] for _ in range(n // 3)]
    rows = []
    for i in range(n):
        text = list(base[rng.randrange(len(base))] if rng.random() < 0.7 else base[0])
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            text[rng.randrange(len(text))] = rng.choice(words)
        rows.append((i, " ".join(text).upper() if i % 9 == 0 else " ".join(text) + ("\n" + line if i % 2 else "")))
    return rows + [(500, None), (501, ""), (502, " \n\t"), (503, "one two"), (504, "ONE  two"), (505, "one two three four five"), (506, "x y É é")]


def plain_components(rows):
    sets = {i: exact(t or "") for i, t in rows}
    root = {i: i for i in sets}
    moved = True
    while moved:
        moved = False
        for a in sets:
            for b in sets:
                if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) > 0 and root[a] != root[b]:
                    root[a] = root[b] = min(root[a], root[b])
                    moved = True
    return {i: (len(sets[i]), root[i]) for i in sets}


@pytest.mark.parametrize("block", [jaccard.BLOCK, 150])
def test_components_equal_all_pairs(frame, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)  # small blocks: groups are joined in pairs of blocks
    rows = corpus(8)
    out = jaccard.jaccard_components(frame(rows + [rows[3], (None, rows[3][1])]).repartition(4)).collect()
    expected = plain_components(rows)
    assert len(out) == len(rows) + 2
    assert all((r.n_shingles, r.component_id) == expected[r.doc_id] for r in out if r.doc_id is not None)
    assert [(r.n_shingles, r.component_id) for r in out if r.doc_id is None] == [(expected[3][0], None)]


def test_one_of_each_keeps_columns_and_groups(frame):
    rows = corpus(9, 40)
    documents = frame([*rows, rows[0], (None, "a b"), (None, "a b")])
    kept = jaccard.one_of_each(documents)
    assert kept.columns == documents.columns
    expected = {root for _, root in plain_components(rows).values()}
    names = [r.doc_id for r in kept.collect()]
    assert sorted(n for n in names if n is not None) == sorted(expected) and names.count(None) == 2
    assert jaccard.jaccard_components(frame([])).count() == 0


def test_unlinked_texts_under_one_id_all_stay(frame):
    alone, near = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(3, near), (7, alone), (7, near + " more"), (7, "c d e f g h"), (8, "C d  e f g h"), (9, None), (9, ""), (9, ""), (9, "k l m n o")]
    for documents in (frame(rows), frame(rows[::-1]).repartition(3)):
        kept = [(r.doc_id, r.text) for r in jaccard.one_of_each(documents).collect()]
        assert sorted(kept, key=str) == sorted([rows[0], rows[1], rows[3], (9, None), (9, ""), rows[8]], key=str)


def test_linked_gives_a_forest_of_all_links():
    import numpy as np

    rng = random.Random(10)
    for _ in range(60):
        base = rng.sample(range(400), 60)
        sets = [np.unique(np.array([x if rng.random() < 0.95 else rng.randrange(400) for x in base[: rng.randrange(20, 60)]], np.uint64)) for _ in range(15)]
        edges = jaccard.linked(sets)
        root = list(range(15))
        for a, b in edges:
            old, new = root[a], root[b]
            assert old != new  # a forest
            root = [new if r == old else r for r in root]
        near = {(a, b) for a in range(15) for b in range(a) if 100 * len(set(sets[a]) & set(sets[b])) >= 75 * len(set(sets[a]) | set(sets[b]))}
        assert all(root[a] == root[b] for a, b in near) and all((max(e), min(e)) in near for e in edges)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (200, 201), (201, 200)]
    out = components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    expected = {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}, 200: 200, 201: 200}
    assert {r.node: r.root for r in out} == expected and len(out) == len(expected)
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


@pytest.mark.parametrize("chars", [decontamination.BLOCK_CHARS, 400])
def test_leaks_equal_all_pairs(spark, frame, monkeypatch, chars):
    monkeypatch.setattr(decontamination, "BLOCK_CHARS", chars)  # several blocks of items
    rng = random.Random(11)
    words = [f"v{i}" for i in range(200)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 40)))) for i in range(25)] + [(90, None), (91, ""), (92, " "), (3, "same id other text v1 v2"), (None, "v1")]
    rows = []
    for i in range(80):
        text = [rng.choice(words) for _ in range(rng.randrange(0, 300))]
        item = items[rng.randrange(25)][1].split()
        if i % 2:
            cut = item[: max(1, int(len(item) * rng.choice([0.5, 0.7, 0.8, 0.9, 1])))]
            at = rng.randrange(len(text) + 1)
            text[at:at] = cut
        rows.append((i, " ".join(text).upper()))
    rows += [(500, None), (501, ""), rows[1]]
    benchmark = spark.createDataFrame([(*i, "z") for i in items + [items[0]]], "item_id bigint, text string, doc_id string")
    expected = sorted(
        (d, i, len(exact(t)), len(exact(t) & exact(x or "")))
        for d, x in rows for i, t in {(i, t) for i, t in items if i is not None and t}
        if exact(t) and 4 * len(exact(t) & exact(x or "")) >= 3 * len(exact(t))
    )
    documents = frame(rows)
    assert sorted(tuple(r) for r in decontamination.leaks(documents, benchmark).collect()) == expected and expected
    cleaned = decontamination.clean(documents, benchmark)
    assert cleaned.columns == documents.columns
    assert sorted(r.doc_id for r in cleaned.collect()) == sorted(d for d, _ in rows if d not in {e[0] for e in expected})
    assert decontamination.leaks(frame([]), benchmark).count() == 0
    assert decontamination.leaks(documents, benchmark.limit(0)).count() == 0


def test_sketches_never_hide_a_link():
    import numpy as np

    rng = random.Random(17)
    for _ in range(40):
        base = rng.sample(range(10**6), rng.choice([5, 100, 130, 260, 700]))
        sets = [np.unique(np.array([x if rng.random() < 0.9 else rng.randrange(10**6) for x in base[: rng.randrange(3 * len(base) // 4, len(base) + 1)]], np.uint64)) for _ in range(9)]
        sets.append(np.unique(np.array(rng.sample(range(10**6), len(base)), np.uint64)))
        sizes = np.array([len(s) for s in sets])
        root = list(range(10))
        for a, b in jaccard.near_pairs(np.arange(10), sizes, [jaccard.sketch(s) for s in sets]):
            root = [root[b] if r == root[a] else r for r in root]
        for a in range(10):
            for b in range(a):
                if 100 * len(set(sets[a]) & set(sets[b])) >= 75 * len(set(sets[a]) | set(sets[b])):
                    assert root[a] == root[b]
        if len(base) >= 100:
            assert all(root[9] != r for r in root[:9])  # an unrelated set of the same size stays apart

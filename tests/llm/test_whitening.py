import collections
import random

import numpy as np
import pytest

from tallyroom.llm import queries, whitening

SF = "/root/testdata/sf0.01"


def brute(rows, components=32):
    """(id, x) of one space: n, exact deviations, eigenvalues and directions."""
    x = np.array([v for _, v in rows], object)
    n, s = len(rows), x.sum(axis=0)
    deviation = [int(sum((n * int(a) - int(b)) ** 2 for a, b in zip(v, s))) for _, v in rows]
    centred = np.array([[float(int(n * a - b)) / n for a, b in zip(v, s)] for _, v in rows])
    value, vector = np.linalg.eigh(centred.T @ centred / n)
    value, vector = value[::-1], vector[:, ::-1]
    return n, deviation, value, centred @ vector[:, :components] / np.sqrt(np.maximum(value[:components], 1e-300)), value.sum()


def same(out, rows):
    n, deviation, value, white, trace = brute(rows)
    got = collections.defaultdict(list)
    for r in out:
        got[r.component].append(r)
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0], rows[k][1]))
    assert sorted(got) == list(range(1, min(32, len(rows[0][1])) + 1))
    for c, mine in got.items():
        assert all(r.n == n for r in mine) and len(mine) == n
        assert mine[0].explained == pytest.approx(value[c - 1] / trace, rel=1e-9)
        assert 0 <= mine[0].identity_error < 1e-9 and len({r.identity_error for r in mine}) == 1
        theirs = collections.Counter((rows[k][0], deviation[k], round(abs(float(white[k, c - 1])), 7)) for k in order)
        assert collections.Counter((r.vec_id, r.deviation, round(abs(r.whitened), 7)) for r in mine) == theirs
        # one sign for all rows
        first = {r.vec_id: r.whitened for r in mine}
        signs = {np.sign(first[rows[k][0]]) * np.sign(white[k, c - 1]) for k in order if abs(white[k, c - 1]) > 1e-6}
        assert len(signs) == 1


def test_query_equals_numpy(spark):
    given = queries.table(spark, SF, "embeddings").collect()
    rows = [(r.vec_id, [int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in r.embedding]) for r in given]
    same(queries.op11_whitening(spark, SF).collect(), rows)


def test_odd_rows_and_widths(spark, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK_ROWS", 7)
    monkeypatch.setattr(whitening, "SPLITS", 3)
    rng = random.Random(51)
    wide = [(i, [rng.uniform(-3, 3) * (k + 1) for k in range(5)]) for i in range(60)]
    wide += [(i, wide[3][1]) for i in (100, 101)] + [wide[4], wide[4]]  # ties and repeated rows
    narrow = [(i, [rng.gauss(0, 1), rng.gauss(5, 1)]) for i in range(200, 230)]
    odd = [(300, None), (301, []), (302, [1.0, None]), (303, [float("nan"), 0.0]), (304, [0.0, float("-inf")]), (305, [1e300, 0.0])]
    table = spark.createDataFrame([(i, v, 1, "n") for i, v in wide + narrow + odd], "vec_id bigint, embedding array<double>, n int, component string").repartition(5)
    out = whitening.whiten(table, ["vec_id"]).collect()
    ints = lambda rows: [(i, [int(np.floor(64 * c)) + 1_000_000 for c in v]) for i, v in rows]
    same([r for r in out if r.vec_id < 200], ints(wide))
    same([r for r in out if r.vec_id >= 200], ints(narrow))
    assert whitening.whiten(table.limit(0), ["vec_id"]).columns == whitening.whiten(table, ["vec_id"]).columns
    assert whitening.whiten(table.limit(0), ["vec_id"]).count() == 0


def test_components_without_variance(spark):
    rows = [(i, [float(i), 2.0 * i, 7.0]) for i in range(20)]
    out = whitening.whiten(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>"), ["vec_id"]).collect()
    assert len(out) == 60 and all((r.whitened is None) == (r.component > 1) for r in out)
    assert out[0].identity_error < 1e-9 and {round(r.explained, 9) for r in out} == {1.0, 0.0}
    alone = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0])], "vec_id bigint, embedding array<float>"), ["vec_id"]).collect()
    assert [(r.n, r.deviation, r.whitened, r.explained) for r in alone] == [(1, 0, None, None)] * 2
    far = whitening.whiten(spark.createDataFrame([(1, [3e13]), (2, [0.0])], "vec_id bigint, embedding array<double>"), ["vec_id"]).collect()
    assert {r.deviation for r in far} == {None} and sorted(round(r.whitened, 9) for r in far) == [-1.0, 1.0]

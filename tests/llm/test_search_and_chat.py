import collections
import hashlib
import random

import public_tokenizers
from pyspark.sql import functions as F

from tallyroom.llm import chat, maxscore, tokenfiles

BYTES = public_tokenizers.path("byte_bpe_50k.json")


def test_top_k_equals_all_products(spark, monkeypatch):
    monkeypatch.setattr(maxscore, "SHARD_ROWS", 40)
    monkeypatch.setattr(maxscore, "QUERY_ROWS", 4)
    monkeypatch.setattr(maxscore, "GROUP", 8)
    rng = random.Random(15)
    vectors = [(i, [rng.uniform(-1, 1) for _ in range(6)]) for i in range(260)]
    vectors += [(i, [0.5, -0.5, 0.25, 0.0, 1.0, -1.0]) for i in range(300, 340)]  # ties
    odd = [(400, None), (410, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (420, [float("nan")] * 6), (430, [float("inf")] * 6), (None, [1.0] * 6), (450, [1.0, 2.0]), (451, [3.0, 1.0])]
    table = spark.createDataFrame([(i, v, 1, 2) for i, v in vectors + odd], "vec_id bigint, embedding array<float>, score int, rank int")
    out = collections.defaultdict(list)
    for r in maxscore.top_k(table, F.col("vec_id") % 10 == 0, 5).orderBy("query_id", "rank").collect():
        out[r.query_id].append((r.rank, r.vec_id, r.score))
    import numpy as np

    q = {i: [int(np.floor(256 * float(np.float32(x)))) for x in v] for i, v in vectors + odd[5:]}
    for i in [i for i in q if i % 10 == 0]:
        scores = sorted((-sum(a * b for a, b in zip(q[i], q[j])), j) for j in q if j != i and len(q[j]) == len(q[i]))[:5]
        assert out.pop(i) == [(k + 1, j, -s) for k, (s, j) in enumerate(scores)]
    assert not out
    assert maxscore.top_k(table.limit(0), F.lit(True), 5).count() == 0


def test_blocks_do_not_depend_on_the_order_of_rows(spark):
    rows = [(i % 90, [i, -i], 2) for i in range(200)]  # some ids repeat

    def blocks(given, parts):
        table = spark.createDataFrame(given, "id bigint, vector array<bigint>, dim int").repartition(parts)
        return {(r.block, tuple(sorted(zip(*[iter(r.vectors)] * 16)))) for r in maxscore.packed(table, 200, 20, "block").collect()}

    seen = blocks(rows, 3)
    assert seen == blocks(rows[::-1], 5) and len(seen) > 5


def test_large_components_stay_exact(spark):
    rows = [(0, [2.0**20, 1.0]), (1, [2.0**20, 3.0]), (2, [2.0**20, 2.0])]
    out = maxscore.top_k(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), F.col("vec_id") == 0, 5).collect()
    assert [(r.vec_id, r.score) for r in sorted(out, key=lambda r: r.rank)] == [(1, 2**56 + 3 * 2**16), (2, 2**56 + 2 * 2**16)]


def test_vectors_pass_by_sets_of_queries(spark, monkeypatch):
    for name, value in {"SHARD_ROWS": 16, "QUERY_ROWS": 8, "GROUP": 8, "TASK_SHARDS": 2, "QUERY_VALUES": 100, "STEP": 2, "PROBE": 3}.items():
        monkeypatch.setattr(maxscore, name, value)
    rng = random.Random(7)
    rows = [(i, [rng.randint(-9, 9) / 4 * (d > 3 or rng.random() < 0.2) for d in range(5 + i % 2)]) for i in range(200)]
    rows += rows[:30] + [(i, []) for i in range(200, 204)] + [(210, [1e5] * 5), (211, [1e3] * 6)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    found = maxscore.top_k(table, F.col("vec_id") % 3 == 0, 4)
    # Several sets of queries, and no query or vector copied to meet the others.
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") > 2 and "Join" not in plan and "Generate" not in plan
    out = collections.defaultdict(list)
    for r in found.orderBy("query_id", "rank").collect():
        out[r.query_id].append((r.vec_id, r.score))
    q = [(i, [int(256 * x // 1) for x in v]) for i, v in rows]
    for own, asked in {i: v for i, v in q if i % 3 == 0}.items():
        scores = sorted((-sum(a * b for a, b in zip(asked, v)), i) for i, v in q if i != own and len(v) == len(asked))[:4]
        assert out.pop(own, []) == [(i, -s) for s, i in scores]
    assert not out


def test_a_task_keeps_the_best_of_all_its_shards():
    import numpy as np

    rng = np.random.default_rng(3)
    for scale in (1, 1 << 16, 1 << 22):  # 32 and 64-bit floats and whole numbers
        vectors, asked = rng.integers(-50, 50, (1000, 12)) * scale, rng.integers(-50, 50, (20, 12)) * scale
        block = maxscore.Asked(np.arange(20), asked, 3)
        for begin in range(0, 1000, 90):
            block.meet(maxscore.Shard(np.arange(begin, min(begin + 90, 1000)), vectors[begin : begin + 90]))
        assert len(block.owner) == 60
        for row in range(20):
            exact = sorted((-int(s), i) for i, s in enumerate(vectors.astype(object) @ asked[row].astype(object)) if i != row)[:3]
            assert [(-s, i) for s, i in zip(block.score[block.owner == row].tolist(), block.found[block.owner == row].tolist())] == exact


def digests(turns):
    learnt = "".join(t for r, t in turns if r == "assistant")
    said = "".join(f"{r}\n{t}\n" for r, t in turns)
    return len(turns), hashlib.sha256(said.encode()).hexdigest(), len(learnt), hashlib.sha256(learnt.encode()).hexdigest()


def test_escapes_are_reversible():
    for text in ("", "\\", "###", "### User: </turn>\n", "\\### Assistant: </turn> ok", "a\\\\#<b", "<|endoftext|>", "x\n\n### y"):
        for role in ("user", "assistant", "tool", "", "a: b", "=x", "User", "\\:"):
            assert chat.parse("".join(chat.turn_parts(role, text))) == (role, text)


def test_tree_shares_turns_and_reads_back(spark):
    rng = random.Random(16)
    lines = ["hello", "### Assistant: </turn>", "\\", "é😀 text", "", "<|endoftext|> x"]
    rows = []
    for conv in range(60):
        turns = [("system", "be kind")] + [(rng.choice(["user", "assistant", "tool"]), rng.choice(lines)) for _ in range(rng.randrange(0, 6))]
        rows += [(conv, k, *turn) for k, turn in enumerate(turns)]
    rows += [(70, 1, None, None), (70, None, "user", "early"), (71, 3, "user", "twice"), (71, 3, "user", "twice"), (None, 0, "user", "lost"), (72, 0, "user", "long " * 30_000)]
    rows += [(73, k, "user" if k % 2 else "assistant", f"turn {k}") for k in range(300)]
    table = spark.createDataFrame([(*r, "n", 5) for r in rows], "conv_id bigint, turn bigint, role string, text string, node string, k int")
    nodes, paths = chat.format_chats(table, BYTES)
    out = {r.conv_id: r for r in chat.read_back(nodes, paths, BYTES).collect()}
    expected = collections.defaultdict(list)
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[0] or -1, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        if conv is not None:
            expected[conv].append((role or "", text or ""))
    assert out.keys() == expected.keys()
    for conv, turns in expected.items():
        r = out[conv]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == digests(turns)
        assert r.formatted_chars == sum(len("".join(chat.turn_parts(*t))) for t in turns)

    stream = sorted(nodes.collect(), key=lambda n: n.start)
    assert len(stream) == len({tuple(turns[: k + 1]) for turns in expected.values() for k in range(len(turns))})
    at = 0
    for n in stream:  # every token once, one after another
        assert n.start == at
        at += n.n_tokens
    by_node = {bytes(n.node): n for n in stream}
    walks = collections.defaultdict(list)
    for p in paths.collect():
        walks[p.conv_id].append((p.k, bytes(p.node)))
    seen = []
    for walk in walks.values():
        position, attended = 0, set()
        for _, name in sorted(walk):
            n = by_node[name]
            assert n.position == position
            assert {x for a in n.ancestors for x in range(a.begin, a.end)} == attended
            position += n.n_tokens
            attended |= set(range(n.start, n.start + n.n_tokens))
        seen.append([by_node[name].start for _, name in sorted(walk)])
    # depth first: the nodes below a node follow it without a gap
    for walk in seen:
        for k, start in enumerate(walk):
            below = sorted({s for other in seen if other[: k + 1] == walk[: k + 1] for s in other[k:]})
            first = [n.start for n in stream].index(start)
            assert [n.start for n in stream[first : first + len(below)]] == below
    empty = chat.format_chats(table.limit(0), BYTES)
    assert chat.read_back(*empty, BYTES).count() == 0


def test_tokenizers_stay_in_the_worker_and_the_ranges_tokenise_nothing(spark):
    assert tokenfiles.worker_words(BYTES, plain=True) is tokenfiles.worker_words(BYTES, plain=True)
    assert tokenfiles.worker_words(BYTES, plain=True) is not tokenfiles.worker_words(BYTES)
    assert chat.worker_decoder(BYTES) is chat.worker_decoder(BYTES)
    rows = [(bytes([i]), i // 4, i % 4, "assistant" if i % 2 else "user", f"text {i}" * (i % 5)) for i in range(40)]
    coded = chat.tokens(spark.createDataFrame(rows, "node binary, rank bigint, k bigint, role string, text string"), BYTES)
    plan = coded._jdf.queryExecution().executedPlan().toString()
    assert plan.index("MapInArrow") < plan.index("rangepartitioning") and plan.count("MapInArrow") == 1
    parts = collections.defaultdict(list)
    for r in coded.collect():
        parts[r["_p"]].append((r["rank"], r.k, r["_inside"], r.n_tokens, len(r.ids)))
    for part in parts.values():
        part.sort()
        assert [p[2] for p in part] == [sum(p[3] for p in part[:i]) for i in range(len(part))]
        assert all(p[3] == p[4] for p in part)
    order = [p[:2] for _, part in sorted(parts.items()) for p in part]
    assert order == sorted(order) and len(order) == len(rows)

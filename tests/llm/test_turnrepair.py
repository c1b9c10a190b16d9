import heapq
import random
import re

from tallyroom.llm import turnrepair
from tallyroom.llm.turnrepair import Audit, at_depth, less

KINDS = "conv_id bigint, turn bigint, role string, text string, cost string, fault double"
WANTED = re.compile(r"(s?(ua)+)?")


def brute(rows):
    """Cheapest edits by a search over (row, roles so far) in order of cost, then audit."""
    seen, kinds = set(), []
    for role, text in rows:
        visible = text.strip(" \t\n\x0b\x0c\r")
        kinds.append("blank" if not visible else "duplicate" if (role, text) in seen else "truncated" if visible[-1] not in ".!?" else "")
        seen.add((role, text))
    counts = [kinds.count(k) for k in ("blank", "duplicate", "truncated")]
    heap, done = [(0, "", 0, ())], set()
    while heap:
        cost, audit, at, turns = heapq.heappop(heap)
        roles = "".join(r[:1] if r[:1] in "sua" and r else "x" for r, _ in turns)
        if at == len(rows) and WANTED.fullmatch(roles):
            return counts, cost, audit, [tuple(t) for t in turns]
        if (audit, turns) in done or len(turns) > 2 * len(rows) + 2 or cost > 4 * len(rows):
            continue
        done.add((audit, turns))
        for role in ("user", "assistant"):
            heapq.heappush(heap, (cost + 3, audit + "I", at, (*turns, (role, ""))))
        if at == len(rows):
            continue
        role, text = rows[at]
        heapq.heappush(heap, (cost + 4, audit + "D", at + 1, turns))
        if kinds[at] not in ("blank", "duplicate"):
            cut = 3 if kinds[at] else 0
            heapq.heappush(heap, (cost + cut, audit + "K", at + 1, (*turns, (role, text))))
            for other in ("user", "assistant"):
                heapq.heappush(heap, (cost + 3 + cut, audit + "R", at + 1, (*turns, (other, text))))


def test_repairs_equal_a_search_of_all_edits(spark):
    rng = random.Random(31)
    given = {}
    for conv in range(150):
        rows = [
            (rng.choice([None, 0, 1, 2, 2, 5]), rng.choice(["user", "assistant", "system", "user", "assistant", "tool", None, ""]),
             rng.choice(["Yes.", "no", "What? ", "", None, "\t\n", "so on!", f"t{rng.randrange(9)}."]))
            for _ in range(rng.randrange(1, 5))
        ]
        given[conv] = rows
    given[500] = [(0, "user", "x" * 60_000 + "."), (1, "assistant", "y" * 70_000)]
    table = spark.createDataFrame(
        [(c, *r, "c", 1.0) for c, rows in given.items() for r in rows] + [(None, 0, "user", "lost.", "c", 1.0)], KINDS
    ).repartition(7)
    out = {r.conv_id: r for r in turnrepair.repair(table).collect()}
    assert out.keys() == given.keys()
    for conv, rows in given.items():
        plain = sorted(
            ((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda v: (v[0] is not None, v[0] or 0, v[1], v[2])
        )
        counts, cost, audit, turns = brute([(r, x) for _, r, x in plain])
        got = out[conv]
        assert ([got.blank, got.duplicate, got.truncated], got.cost, got.audit) == (counts, cost, audit), plain
        assert [tuple(t) for t in got.turns] == turns
        known = {t for t, _, _ in plain if t is not None}
        assert got.gaps == (max(known) - min(known) + 1 - len(known) if known else 0)
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(plain, plain[1:])]
        assert got.illegal == sum(p not in ("su", "ua", "au") for p in pairs)
    assert turnrepair.repair(table.limit(0)).count() == 0


def test_a_long_conversation_is_one_sequence(spark):
    rows = [(1, k, "user" if k % 2 == 0 else "assistant", f"Turn {k}.") for k in range(30_000)]
    rows += [(1, 30_000, "user", "Turn 4."), (1, 30_001, "assistant", "Turn 3.")]  # repeats
    got = turnrepair.repair(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).first()
    assert (got.cost, got.duplicate, got.audit) == (8, 2, "K" * 30_000 + "DD") and len(got.turns) == 30_000


def node(text):
    at = Audit(None, "")
    for letter in text:
        at = Audit(at, letter)
    return at


def test_audits_compare_like_their_text(monkeypatch):
    rng = random.Random(32)
    for modulus in (turnrepair.MODULUS, 3):  # nearly all hashes collide under the small one
        monkeypatch.setattr(turnrepair, "MODULUS", modulus)
        for _ in range(400):
            stem = "".join(rng.choice("DIKR") for _ in range(rng.randrange(40)))
            shared = node(stem)
            tails = ["".join(rng.choice("DK") for _ in range(rng.randrange(6))) for _ in range(2)]
            ends = []
            for tail in tails:
                at = shared if rng.random() < 0.5 else node(stem)
                for letter in tail:
                    at = Audit(at, letter)
                ends.append(at)
            a, b = ends
            assert less(a, b) == (stem + tails[0] < stem + tails[1]) and a.spelled() == stem + tails[0]
            assert at_depth(a, len(stem)).spelled() == stem

"""Cheapest repair of conversations, with an audit string of the edits.

A row is at fault when it is blank, repeats an earlier role and text, or is cut
short (its last visible character ends no sentence); the first fault counts. A
repaired conversation has roles of the form ``(s?(ua)+)?`` by their initials.
Edits and costs: Keep 0, Rerole to user or assistant 3, Delete 4 (the only way
for blank and repeated rows), Insert an empty user or assistant turn 3; a kept or
reroled row that is cut short adds 3. Of the cheapest audits (the initials of the
edits in order) the least in ASCII order is taken; an audit settles all roles,
so the repair is unique.

The search goes row by row over the four states a role sequence can be in and
keeps one best audit per state. Audits are nodes linked to their prefixes, so
states share them; nodes know their ancestors at powers of two and a rolling
hash of the whole prefix. Equal costs are settled by the first letter in which
the audits differ, found by lifting both to where their hashes agree; agreeing
hashes are verified letter by letter up to the shared node, and audits are
spelled out where a hash deceived. Two audits of equal cost over the same rows
are never prefixes of each other (equal letters cost the same), so the least
prefix stays the least whatever follows.

Rows go by ``turn`` (nulls first), equal turns by role and text; repeated rows
stay and count as repeats. Null roles and texts read as one space. Rows without
``conv_id`` are in no conversation. Extra columns are not read. One conversation
is repaired as a sequence in one task; memory is that of its rows and audits.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SPACE = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, CUT = 0, 3, 4, 3, 3
SOUND, BLANK, DUPLICATE, TRUNCATED = range(4)
#: States of a role sequence: nothing yet, after system, after user, after assistant.
NONE, SYSTEM, USER, ASSISTANT = range(4)
MODULUS, BASE = (1 << 61) - 1, 911_382_323


class Audit:
    """An audit as a link to its prefix without the last letter."""

    __slots__ = ("letter", "depth", "hash", "up")

    def __init__(self, prefix: Audit | None, letter: str):
        self.letter = letter
        if prefix is None:
            self.depth, self.hash, self.up = 0, 0, ()
            return
        self.depth = prefix.depth + 1
        self.hash = (prefix.hash * BASE + ord(letter)) % MODULUS
        up, at = [], prefix
        while True:
            up.append(at)
            if len(at.up) < len(up):
                break
            at = at.up[len(up) - 1]
        self.up = tuple(up)

    def spelled(self) -> str:
        letters, at = [], self
        while at.depth:
            letters.append(at.letter)
            at = at.up[0]
        return "".join(reversed(letters))


def at_depth(node: Audit, depth: int) -> Audit:
    drop, bit = node.depth - depth, 0
    while drop:
        if drop & 1:
            node = node.up[bit]
        drop >>= 1
        bit += 1
    return node


def same(a: Audit, b: Audit) -> bool:
    """Whether two audits of one depth are letter for letter the same."""
    while a is not b and a.depth:
        if a.letter != b.letter:
            return False
        a, b = a.up[0], b.up[0]
    return True


def less(a: Audit, b: Audit) -> bool:
    """Whether ``a`` comes before ``b`` in ASCII order."""
    depth = min(a.depth, b.depth)
    x, y = at_depth(a, depth), at_depth(b, depth)
    if x.hash == y.hash:
        return a.depth < b.depth if same(x, y) else a.spelled() < b.spelled()
    # Climb as long as the hashes differ; then the parents are the longest common prefix.
    for k in range(len(x.up) - 1, -1, -1):
        if k < len(x.up) and x.up[k].hash != y.up[k].hash:
            x, y = x.up[k], y.up[k]
    if not same(x.up[0], y.up[0]):
        return a.spelled() < b.spelled()
    return x.letter < y.letter


Best = tuple[int, Audit] | None


def cheapest(options: list[tuple[int, Audit, str]], held: Best = None) -> Best:
    """The best of ``held`` and of audits made longer by a letter."""
    cost = min([o[0] for o in options] + ([held[0]] if held else []), default=None)
    if cost is None:
        return None
    best = held[1] if held and held[0] == cost else None
    for price, prefix, letter in options:
        if price == cost:
            node = Audit(prefix, letter)
            if best is None or less(node, best):
                best = node
    return cost, best


def inserted(states: list[Best]) -> list[Best]:
    """The states after any inserted turns (more than two in a row only cost)."""
    none, system, user, assistant = states
    to_user = [(s[0] + INSERT, s[1], "I") for s in (none, system, assistant) if s]
    user = cheapest(to_user, user)
    to_assistant = [(user[0] + INSERT, user[1], "I")] if user else []
    return [none, system, user, cheapest(to_assistant, assistant)]


def advanced(states: list[Best], initial: str, fault: int) -> list[Best]:
    """The states after one row."""
    states = inserted(states)
    options: list[list[tuple[int, Audit, str]]] = [[], [], [], []]
    extra = CUT if fault == TRUNCATED else 0
    for state, best in enumerate(states):
        if best is None:
            continue
        cost, node = best
        options[state].append((cost + DELETE, node, "D"))
        if fault in (BLANK, DUPLICATE):
            continue
        follows = ASSISTANT if state == USER else USER
        options[follows].append((cost + REROLE + extra, node, "R"))
        if initial == "s" and state == NONE:
            options[SYSTEM].append((cost + KEEP + extra, node, "K"))
        elif initial == ("a" if state == USER else "u"):
            options[follows].append((cost + KEEP + extra, node, "K"))
    return [cheapest(o) for o in options]


def replayed(audit: str, rows: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """The repaired turns that an audit of ``rows`` stands for."""
    out, at, follows = [], 0, "user"
    for letter in audit:
        if letter == "I":
            turn = (follows, "")
        else:
            role, text = rows[at]
            at += 1
            if letter == "D":
                continue
            turn = (role if letter == "K" else follows, text)
        out.append(turn)
        follows = "assistant" if turn[0][:1] == "u" else "user"
    return out


class Conversation:
    """One conversation while its rows stream by."""

    def __init__(self, conv_id: int):
        self.conv_id, self.rows, self.faults = conv_id, [], [0, 0, 0, 0]
        self.first = self.last = None
        self.turns = self.illegal = 0
        self.states: list[Best] = [(0, Audit(None, "")), None, None, None]

    def add(self, turn: int | None, role: str, text: str, fault: int) -> None:
        if turn is not None and turn != self.last:
            self.first, self.last, self.turns = turn if self.first is None else self.first, turn, self.turns + 1
        if self.rows and self.rows[-1][0][:1] + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.faults[fault] += 1
        self.rows.append((role, text))
        self.states = advanced(self.states, role[:1], fault)

    def done(self) -> dict:
        states = inserted(self.states)
        ends = [s for s in (states[NONE], states[ASSISTANT]) if s]
        best = ends[0] if len(ends) == 1 or ends[0][0] < ends[1][0] else ends[1]
        if len(ends) == 2 and ends[0][0] == ends[1][0]:
            best = min(ends, key=lambda s: s[1].spelled())
        audit = best[1].spelled()
        return {
            "conv_id": self.conv_id, "gaps": 0 if self.first is None else self.last - self.first + 1 - self.turns,
            "blank": self.faults[BLANK], "duplicate": self.faults[DUPLICATE], "truncated": self.faults[TRUNCATED],
            "illegal": self.illegal, "cost": best[0], "audit": audit,
            "turns": [{"role": r, "text": t} for r, t in replayed(audit, self.rows)],
        }


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
OUT = ", ".join(f"{c} bigint" for c in ("conv_id", *COUNTS)) + ", audit string, turns array<struct<role:string,text:string>>"
OUT_ARROW = pa.schema(
    [(c, pa.int64()) for c in ("conv_id", *COUNTS)]
    + [("audit", pa.string()), ("turns", pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])))]
)


def faults(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and the first ``fault`` of every row (SOUND, BLANK,
    DUPLICATE, TRUNCATED), dealt by conversation."""
    rows = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"),
    ).repartition("conv_id")
    said = F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy("turn"))
    visible = F.rtrim("text", F.lit(SPACE))
    fault = (
        F.when(visible == "", BLANK).when(said > 1, DUPLICATE)
        .when(~F.substring(visible, -1, 1).isin(".", "!", "?"), TRUNCATED).otherwise(SOUND)
    )
    return rows.withColumn("fault", fault)


def repair(conversations: DataFrame) -> DataFrame:
    """Per conversation: its gaps, faults and illegal neighbours, the ``cost`` and
    ``audit`` of the repair, and the repaired ``turns``."""
    ordered = faults(conversations).sortWithinPartitions("conv_id", "turn", "role", "text", "fault")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current = None
        for batch in batches:
            ended = []
            columns = (batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "fault"))
            for conv_id, turn, role, text, fault in zip(*columns):
                if current is None or conv_id != current.conv_id:
                    if current:
                        ended.append(current.done())
                    current = Conversation(conv_id)
                current.add(turn, role, text, fault)
            if ended:
                yield pa.RecordBatch.from_pylist(ended, OUT_ARROW)
        if current:
            yield pa.RecordBatch.from_pylist([current.done()], OUT_ARROW)

    return ordered.mapInArrow(run, OUT)

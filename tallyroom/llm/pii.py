"""Personal data by patterns, checksums and context, in built-in functions only.

A pattern proposes spans of a kind, leftmost and without overlap; a validator
(octet range, Luhn, digit count, mod 97) confirms or drops each; words near a
span raise or lower its score. Offsets are code points, ends exclusive: the
matches and the gaps between them, in turn, add up to the text.

Every pattern is the plain one with possessive repeats and a look-behind that
forbids starts which a failed earlier start has already ruled out, so a long
run of similar characters is read once.

Null texts read as empty. Rows are judged one by one: repeated rows and
clashing extra columns change nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The patterns of the base kinds.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    # Added by this method.
    "iban": r"(?<![0-9A-Za-z_])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![0-9A-Za-z_])",
}
BASE = ("email", "ip", "card", "phone")
KINDS = tuple(PATTERNS)
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9}
NEAR = 40
CONTEXT = {
    "email": "mail|contact|write", "ip": r"\bip\b|host|server|login", "card": "card|visa|credit|payment",
    "phone": r"phone|\btel|call|fax|mobile", "iban": "iban|bank|account|transfer",
}
AGAINST = "version|example|serial|order no|isbn"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    place = F.sequence(F.lit(1), F.length(digits))
    doubled = lambda d: F.when(d > 4, d * 2 - 9).otherwise(d * 2)
    digit = lambda i: F.substring(digits, i, F.lit(1)).cast("int")
    total = F.aggregate(
        place, F.lit(0),
        lambda sum_, i: sum_ + F.when((F.length(digits) - i) % 2 == 1, doubled(digit(i))).otherwise(digit(i)),
    )
    return total % 10 == 0


def mod97(value: Column) -> Column:
    """Whether an account number (letters and digits, spaces allowed) passes mod 97."""
    plain = F.replace(value, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))
    number = lambda i: F.conv(F.substring(turned, i, F.lit(1)), 36, 10).cast("int")
    rest = F.aggregate(
        F.sequence(F.lit(1), F.length(turned)), F.lit(0),
        lambda acc, i: (acc * F.when(number(i) > 9, 100).otherwise(10) + number(i)) % 97,
    )
    return F.length(plain).between(15, 34) & (rest == 1)


def valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    if kind == "card":
        digits = _digits(value)
        return F.when(F.length(digits).between(12, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    if kind == "iban":
        return mod97(value)
    return F.lit(True)


def spans(text: Column, kind: str) -> Column:
    """Confirmed spans of a kind: array of (start, rank, end, kind, score)."""
    pattern, rank = PATTERNS[kind], KINDS.index(kind)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.arrays_zip(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(hits)).alias("gap"), hits.alias("hit"))
    kind_of = "struct<start:int,rank:int,end:int,kind:string,score:double>"
    none = F.array().cast(f"array<{kind_of}>")

    # Ends of the matches: a running sum of gaps and matches.
    ends = F.aggregate(
        parts, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("ends")),
        lambda acc, part: F.struct(
            (acc["at"] + F.length(part["gap"]) + F.length(part["hit"])).alias("at"),
            F.array_append(acc["ends"], acc["at"] + F.length(part["gap"]) + F.length(part["hit"])).alias("ends"),
        ),
    )["ends"]

    def span(part: Column) -> Column:
        start = part["end"] - F.length(part["hit"])
        around = F.lower(F.substring(text, F.greatest(start - NEAR, F.lit(0)) + 1, part["end"] - start + 2 * NEAR))
        score = F.least(
            F.lit(1.0),
            F.lit(PRIOR[kind])
            + F.when(around.rlike(CONTEXT[kind]), 0.1).otherwise(0.0)
            - F.when(around.rlike(AGAINST), 0.3).otherwise(0.0),
        )
        return F.struct(
            start.alias("start"), F.lit(rank).alias("rank"), part["end"].alias("end"), F.lit(kind).alias("kind"), score.alias("score")
        )

    matched = F.arrays_zip(hits.alias("hit"), ends.alias("end"))
    confirmed = F.filter(matched, lambda part: valid(kind, part["hit"]))
    return F.when(text.rlike(pattern), F.transform(confirmed, span)).otherwise(none)


def find(documents: DataFrame, text: str = "text", out: str = "pii") -> DataFrame:
    """All columns of ``documents`` and ``out``: confirmed spans by start, then kind."""
    source = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    every = F.array_sort(F.concat(*(spans(source, kind) for kind in KINDS)))
    return documents.withColumn(out, every)


def listed(found: Column) -> Column:
    """``kind:start:end`` of spans, comma-joined."""
    return F.array_join(
        F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def redact(documents: DataFrame, text: str = "text") -> DataFrame:
    """``documents`` with every confirmed span replaced by its kind in brackets.
    Of overlapping spans the first one names the replacement of them all."""
    source, held = F.col(f"`{text}`"), "_pii"
    while held in documents.columns:
        held += "_"

    def cut(acc: Column, s: Column) -> Column:
        apart = s["start"] >= acc["at"]
        piece = F.array(
            F.substring(source, acc["at"] + 1, s["start"] - acc["at"]), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))
        )
        return F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(apart, F.concat(acc["out"], piece)).otherwise(acc["out"]).alias("out"),
        )

    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    walked = F.aggregate(F.col(held), zero, cut)
    tail = F.substring(source, walked["at"] + 1, F.length(source))
    clean = F.when(F.size(held) > 0, F.concat(F.array_join(walked["out"], ""), tail)).otherwise(source)
    found = find(documents, text, held)
    return found.select(*(clean.alias(c) if c == text else F.col(f"`{c}`") for c in documents.columns))

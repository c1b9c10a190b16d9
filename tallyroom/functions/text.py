"""Names, slugs, dates and formats as column expressions."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that describe a body's type and are left out of a slug.
SLUG_TYPE_WORDS = ["tp", "c", "t", "r", "uco", "st", "lt", "ut"]

# Name suffixes in the filing and in the current directory.
SUFFIX_TYPES = {
    "C": "City",
    "Co": "County",
    "County": "County",
    "D": "District Municipality",
    "M": "Municipality",
    "R": "Regional Municipality",
    "ST": "Separated Town",
    "T": "Town",
    "Tp": "Township",
    "UCo": "United Counties",
    "V": "Village",
}
OFFICIAL_SUFFIXES = [
    "District Municipality", "Regional Municipality", "United Counties",
    "Municipality", "Township", "Village", "County", "City", "Town",
]
# Official names without a type ending, as (display, type).
WHOLE_NAMES = {
    "Haldimand County": ("Haldimand County", "County"),
    "Norfolk County": ("Norfolk County", "County"),
    "The Nation Municipality": ("The Nation", "Municipality"),
}


@lru_cache(maxsize=1)
def fold_tables() -> tuple[dict[str, str], dict[str, str]]:
    """Characters that folding replaces by at most one, and by several. Folding
    (case, compatibility form, combining marks dropped) looks at one character
    at a time, so two tables say all of it; Hangul syllables follow a rule."""
    single: dict[str, str] = {}
    several: dict[str, str] = {}
    for point in (*range(0x41, 0x5B), *range(0x80, 0xAC00), *range(0xD7A4, 0xD800), *range(0xE000, 0x33480), *range(0xE0000, 0xE0200)):
        ch = chr(point)
        form = "".join(c for c in unicodedata.normalize("NFKD", ch.casefold()) if not unicodedata.combining(c))
        if form != ch:
            (several if len(form) > 1 else single)[ch] = form
    return single, several


def _translated(value: Column, table: dict[str, str]) -> Column:
    """Each character by its entry, which has one character or none."""
    order = sorted(table, key=lambda ch: not table[ch])
    return F.translate(value, "".join(order), "".join(table[ch] for ch in order))


def _ranges(characters: list[str]) -> str:
    """A character class of a pattern, neighbours joined to ranges."""
    points = sorted(map(ord, characters))
    starts = [p for p in points if p - 1 not in set(points)]
    ends = [p for p in points if p + 1 not in set(points)]
    return "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in zip(starts, ends))


ASCII, BEYOND_ASCII = r"[\x00-\x7f]", r"[^\x00-\x7f]"
HANGUL = r"\x{ac00}-\x{d7a3}"


def _jamo(ch: Column) -> Column:
    """A Hangul syllable as its two or three letters."""
    place = F.conv(F.hex(F.encode(ch, "UTF-16BE")), 16, 10).cast("int") - 0xAC00
    parts = [F.floor(place / 588) + 0x1100, F.floor(F.pmod(place, F.lit(588)) / 28) + 0x1161, F.pmod(place, F.lit(28)) + 0x11A7]
    letters = [F.decode(F.unhex(F.hex(p.cast("bigint"))), "UTF-16BE") for p in parts]
    return F.concat(letters[0], letters[1], F.when(F.pmod(place, F.lit(28)) > 0, letters[2]).otherwise(""))


def folded(value: Column) -> Column:
    """Case-folded text in compatibility form without combining marks, in the
    JVM: lower case where all is ASCII, else one character map, and a step by
    character only for texts that hold one which becomes several. The long class
    of those is tried on characters beyond ASCII alone."""
    single, several = fold_tables()
    wide = _ranges(list(several))
    longest = max(map(len, several.values()))

    def spelled(ch: Column) -> Column:
        # Position by position; a character without a letter there leaves nothing.
        letters = [_translated(ch, {c: form[at:at + 1] for c, form in several.items()}) for at in range(longest)]
        return F.when(ch.rlike(f"^{ASCII}"), ch).when(ch.rlike(f"[{HANGUL}]"), _jamo(ch)).when(ch.rlike(f"[{wide}]"), F.concat(*letters)).otherwise(ch)

    plain = _translated(value, single)
    pieces = F.regexp_extract_all(plain, F.lit(f"{ASCII}+|{BEYOND_ASCII}"), F.lit(0))
    apart = F.array_join(F.transform(pieces, spelled), "")
    rest = F.regexp_replace(value, f"{ASCII}+", "")
    return F.when(~value.rlike(BEYOND_ASCII), F.lower(value)).when(rest.rlike(f"[{wide}{HANGUL}]"), apart).otherwise(plain)


def normalized_name(name: Column) -> Column:
    """Join key of a name: folded, ``&`` read as ``and``, letters and digits only."""
    return F.regexp_replace(F.regexp_replace(folded(name), "&", " and "), "[^a-z0-9]+", "")


def search_text(value: Column) -> Column:
    """Folded words with single spaces between them, for search."""
    return F.trim(F.regexp_replace(folded(value), r"[^\p{L}\p{N}]+", " "))


def slug(name: Column, code: Column, ending: str = "") -> Column:
    """Lower-case words joined by ``-`` without type words; a code-based slug
    when no word is left."""
    base = F.trim(F.regexp_replace(F.lower(name), "[,.']", ""))
    words = F.filter(
        F.split(F.regexp_replace(base, "/", " "), r"\s+"),
        lambda w: (w != "") & ~w.isin(SLUG_TYPE_WORDS),
    )
    body = F.when(F.size(words) > 0, F.array_join(words, "-")).otherwise(F.concat(F.lit("muni-"), code))
    return F.concat(body, F.lit(ending))


def filing_name_parts(name: Column) -> tuple[Column, Column]:
    """(display, type) of a filing name by its last word; type null when the
    suffix is unknown. A county keeps its whole name."""
    suffix = F.regexp_extract(name, r" (\S+)$", 1)
    stem = F.regexp_extract(name, r"^(.*) \S+$", 1)
    kind = F.coalesce(*[F.when(suffix == s, F.lit(t)) for s, t in SUFFIX_TYPES.items()])
    return F.when(suffix == "County", name).when(kind.isNotNull(), stem), kind


def official_name_parts(name: Column) -> tuple[Column, Column]:
    """(display, type) of ``X, Type of`` and of the names without that ending;
    both null for another form."""
    kind = F.coalesce(*[F.when(name.endswith(f", {t} of"), F.lit(t)) for t in OFFICIAL_SUFFIXES])
    display = F.when(kind.isNotNull(), F.regexp_extract(name, r"^(.*), [A-Z][A-Za-z ]* of$", 1))
    for whole, (shown, label) in WHOLE_NAMES.items():
        display, kind = F.when(name == whole, shown).otherwise(display), F.when(name == whole, label).otherwise(kind)
    return display, kind


def is_digest(value: Column) -> Column:
    """Whether a value is a SHA-256 digest in lower-case hex; null is not."""
    return F.coalesce(value.rlike(SHA256_FORM), F.lit(False))


def is_identifier(value: Column) -> Column:
    """Whether a value is lower-case words joined by single ``-``; null is not."""
    return F.coalesce(value.rlike(ID_FORM), F.lit(False))


def compact_date(value: Column) -> Column:
    """``yyyymmdd`` as a date; null for another form or an impossible day."""
    return F.when(value.rlike("^[0-9]{8}$"), F.try_to_date(value, "yyyyMMdd"))


def slash_date(value: Column) -> Column:
    """``dd/mm/yyyy`` as a date."""
    clean = F.trim(value)
    return F.when(clean.rlike("^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$"), F.try_to_date(clean, "d/M/yyyy"))


def offset_timestamp(value: Column) -> Column:
    """A timestamp that states its offset; a naive one is null."""
    zoned = value.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}([.][0-9]+)?(Z|[+-][0-9]{2}:[0-9]{2})$")
    return F.when(zoned, value.try_cast("timestamp"))


# The accepted forms of identifiers.
SHA256_FORM = "^[0-9a-f]{64}$"
ID_FORM = "^[a-z0-9]+(-[a-z0-9]+)*$"
LANGUAGE_FORM = "^[a-z]{2,3}(-[A-Z]{2})?$"


def host_in_domains(host: Column, domains: list[str]) -> Column:
    """Whether a host is one of the domains or below one."""
    checks = [(host == d) | host.endswith("." + d) for d in domains]
    found = checks[0]
    for check in checks[1:]:
        found = found | check
    return found

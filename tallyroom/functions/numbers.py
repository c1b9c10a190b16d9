"""Printed numbers: tokens, canonical form, and what an amount may be printed as."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A printed number: grouped by space or comma, or plain, with an optional
# decimal part, not touching another digit.
TOKEN = r"(?<![0-9])(?:[0-9]{1,3}(?:[ ,\u00a0\u202f][0-9]{3})+|[0-9]+)(?:[.,][0-9]+)?(?![0-9])"


def number_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def canonical_number(token: Column) -> Column:
    """Digits with a plain decimal point, for English and French grouping.

    With both separators the later one is the decimal mark; a lone comma before
    three digits groups, before another count it is the decimal mark.
    """
    compact = F.regexp_replace(token, r"[\s\u00a0\u202f$()\u2212-]", "")
    has_comma, has_dot = compact.contains(","), compact.contains(".")
    last_comma = F.length(compact) - F.instr(F.reverse(compact), ",")
    last_dot = F.length(compact) - F.instr(F.reverse(compact), ".")
    comma_decimal = F.replace(F.replace(compact, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    dot_decimal = F.replace(compact, F.lit(","), F.lit(""))
    lone = F.size(F.split(compact, ",")) == 2
    short = F.length(F.substring_index(compact, ",", -1)) != 3
    return (
        F.when(has_comma & has_dot, F.when(last_comma > last_dot, comma_decimal).otherwise(dot_decimal))
        .when(has_comma & lone & short, F.replace(compact, F.lit(","), F.lit(".")))
        .otherwise(dot_decimal)
    )


def renderings(amount: Column, scale: Column) -> Column:
    """Plain numbers that stand for an amount where a text prints amount / scale:
    two places always, whole digits only when the printed value is whole."""
    shown = printed_value(amount, scale)
    two = F.round(shown, 2).cast("decimal(38,2)").cast("string")
    whole = F.when(shown == F.floor(shown), F.floor(shown).cast("decimal(38,0)").cast("string"))
    return F.when(shown.isNotNull(), F.array_compact(F.array(two, whole)))


def printed_value(amount: Column, scale: Column) -> Column:
    """The magnitude a text prints; null without an amount or with an unsound scale."""
    exact = F.abs(amount).cast("decimal(38,8)")
    return F.when(scale.isNull(), exact).when(scale > 0, F.try_divide(exact, scale).cast("decimal(38,8)"))


def magnitude_names(amount: Column, scale: Column) -> Column:
    """Exact figures in words: ``5 million``, ``1.5 billion``, ``887 M``. Only a
    value that is exact at no or one decimal place has one."""
    shown = printed_value(amount, scale)
    found = []
    # Magnitude words and their letters.
    for size, names in {1_000_000_000: ("billion", "B"), 1_000_000: ("million", "M"), 1_000: ("thousand", "K")}.items():
        tenths = shown / F.lit(size // 10).cast("decimal(10,0)")
        exact = (shown >= size) & (shown % F.lit(size // 10).cast("decimal(38,8)") == 0)
        text = F.regexp_replace((F.round(tenths, 0) / 10).cast("decimal(38,1)").cast("string"), r"\.0$", "")
        found += [F.when(exact, F.concat(text, F.lit(f" {name}"))) for name in names]
    return F.when(shown.isNotNull(), F.array_compact(F.array(*found)))

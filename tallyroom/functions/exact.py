"""Products of decimals without rounding: whole numbers as lists of limbs.

A number is a sign and its digits in groups of eight, lowest first. Inputs have
at most 18 digits before and 16 after the point, since Spark's own sign change
rounds a decimal to 34 digits; products have as many as they need.
``limbs`` to ``outside`` are array functions and stay in the JVM, at some 200
microseconds a formula; ``off_by`` says the same for many formulas, by Python's whole
numbers on Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable
from math import prod

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

BASE = 100_000_000
EXACT = "decimal(34,16)"
PLACES = 2  # limbs after the point
_LIMBS = "array<bigint>"
#: Factors that a double holds without overflow: each lies between 1e-16 and 1e18.
FEW = 12


def held(body: Callable[..., Column], *values: Column) -> Column:
    """``body`` of values that are computed once, however often it names them."""
    names = [f"v{i}" for i in range(len(values))]
    one = F.array(F.struct(*[v.alias(n) for v, n in zip(values, names)]))
    return F.get(F.transform(one, lambda s: body(*[s[n] for n in names])), 0)


def limbs(value: Column) -> Column:
    """Digits of the absolute value of an ``EXACT`` decimal, scaled to a whole number."""
    shown = F.to_char(F.abs(value), F.lit("0" * 18 + "." + "0" * 16))
    digits = F.concat(F.lit("000000"), F.regexp_replace(shown, "[^0-9]", ""))
    return held(lambda d: F.array(*[F.substring(d, at, 8).cast("bigint") for at in (33, 25, 17, 9, 1)]), digits)


def _carried(sums: Column) -> Column:
    """Limbs brought below the base. The last one holds the rest and, below zero,
    the sign of the whole."""
    start = F.struct(F.lit(0).cast("bigint").alias("over"), F.array().cast(_LIMBS).alias("done"))

    def step(state: Column, limb: Column) -> Column:
        total = state["over"] + limb
        low = F.pmod(total, F.lit(BASE).cast("bigint"))
        return F.struct(F.call_function("div", total - low, F.lit(BASE).cast("bigint")).alias("over"), F.concat(state["done"], F.array(low)).alias("done"))

    return F.aggregate(sums, start, step, lambda s: F.concat(s["done"], F.array(s["over"])))


def times(a: Column, b: Column) -> Column:
    """Product of two numbers without sign; ``b`` has few limbs."""
    none = F.lit(0).cast("bigint")

    def whole(a: Column, b: Column) -> Column:
        def at(place: Column) -> Column:
            return F.aggregate(
                F.sequence(F.lit(0), F.size(b) - 1), none,
                lambda total, j: total + F.when(place >= j, F.coalesce(F.get(a, place - j), none)).otherwise(none) * F.get(b, j),
            )

        return _carried(F.transform(F.sequence(F.lit(0), F.size(a) + F.size(b) - 2), at))

    return held(whole, a, b)


def product(factors: Column) -> Column:
    """Product of a list of limb lists; one for an empty list."""
    return F.aggregate(factors, F.array(F.lit(1)).cast(_LIMBS), times)


def shifted(number: Column, places: Column) -> Column:
    """Times the base to a power."""
    return F.concat(F.array_repeat(F.lit(0).cast("bigint"), places), number)


def sign_of_sum(terms: list[tuple[Column, Column]]) -> Column:
    """-1, 0 or 1 for a sum of ``(sign, limbs)``: the sign of the highest limb that
    is not zero."""
    none = F.lit(0).cast("bigint")

    def at(place: Column) -> Column:
        total = none
        for sign, number in terms:
            total = total + sign * F.coalesce(F.get(number, place), none)
        return total

    length = F.greatest(*[F.size(number) for _, number in terms])
    total = _carried(F.transform(F.sequence(F.lit(0), length - 1), at))
    return F.aggregate(total, F.lit(0), lambda so_far, limb: F.when(limb == 0, so_far).otherwise(F.sign(limb).cast("int")))


def outside(over: Column, over_sign: Column, over_factors: Column, under: Column, under_factors: Column, value: Column, tolerance: Column) -> Column:
    """Whether ``over / under`` lies farther than ``tolerance`` from ``value``,
    without a division: the difference is multiplied by the divisor first."""
    value, tolerance = value.try_cast(EXACT), tolerance.try_cast(EXACT)
    minus = F.when(value < 0, F.lit(1)).otherwise(F.lit(-1))

    def judged(quotient: Column, scaled: Column) -> Column:
        # Above the upper bound, or below the lower one.
        ends = F.transform(F.array(F.lit(-1), F.lit(1)), lambda side: side * sign_of_sum(
            [(over_sign, quotient), (minus, F.get(scaled, 0)), (side, F.get(scaled, 1))]
        ))
        return F.exists(ends, lambda x: x < 0)

    # A value that is missing, such as a control, leaves null.
    divisor = shifted(under, over_factors * PLACES)
    scaled = F.transform(F.array(value, tolerance), lambda x: times(divisor, limbs(x)))
    return F.when(value.isNotNull() & tolerance.isNotNull(), held(judged, shifted(over, (under_factors + 1) * PLACES), scaled))


def _unscaled(numbers: pa.Array) -> list[int]:
    """Whole numbers of a decimal column, at its scale; what stands for a null is any."""
    if not len(numbers):
        return []
    words = np.frombuffer(numbers.buffers()[1], np.int64)[2 * numbers.offset : 2 * (numbers.offset + len(numbers))]
    return [(high << 64) + low for low, high in zip(words[::2].view(np.uint64).tolist(), words[1::2].tolist())]


@F.arrow_udf(BooleanType())
def off_by(over: pa.Array, under: pa.Array, value: pa.Array, tolerance: pa.Array) -> pa.Array:
    """``outside`` for lists of ``EXACT`` factors; null where a list, the value or the tolerance is null."""

    def lists(column: pa.Array) -> list[list[int]]:
        numbers, at = _unscaled(column.values), column.offsets.to_pylist()
        return [numbers[a:b] for a, b in zip(at, at[1:])]

    known = [over, under, value, tolerance]
    asked = np.logical_and.reduce([c.is_valid().to_numpy(zero_copy_only=False) for c in known]).tolist()
    out: list[bool | None] = []
    for there, ups, downs, v, t in zip(asked, lists(over), lists(under), _unscaled(value), _unscaled(tolerance)):
        if not there:
            out.append(None)
            continue
        divisor, one = prod(downs), 10**16
        gap = prod(ups) * one ** (len(downs) + 1) - v * divisor * one ** len(ups)
        out.append(abs(gap) > abs(t * divisor) * one ** len(ups))
    return pa.array(out, pa.bool_())


def surely_outside(over: Column, under: Column, value: Column, tolerance: Column) -> Column:
    """The same by doubles, for lists of ``EXACT`` factors: null where the error of
    the doubles could reach the tolerance's edge, so that the exact way decides.

    A factor is rounded once when it is read and once when it is multiplied in; up
    to ``FEW`` of them neither overflow nor lose digits to underflow.
    """
    size = lambda factors: F.aggregate(factors, F.lit(1.0), lambda so_far, x: so_far * x.cast("double"))
    value, tolerance = value.cast("double"), tolerance.cast("double")

    def judged(quotient: Column) -> Column:
        slack = (F.size(over) + F.size(under) + 4) * F.lit(1e-15) * (F.abs(quotient) + F.abs(value) + F.abs(tolerance))
        gap = F.abs(quotient - value) - tolerance
        return F.when(gap > slack, True).when(gap < -slack, False)

    few = (F.size(over) <= FEW) & (F.size(under) <= FEW)
    return F.when(few, held(judged, F.try_divide(size(over), size(under))))

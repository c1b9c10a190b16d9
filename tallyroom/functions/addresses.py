"""Line addresses ``slc.<schedule>.L<line>.C<col>.<measure>`` and code tables."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ADDRESS = r"^slc\.([0-9A-Z]+)\.L([0-9]{4})\.C([0-9]{2})\.([0-9]{2})$"


def _column(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def line_of(address: str | Column) -> Column:
    return F.regexp_extract(_column(address), ADDRESS, 2)


def parse(df: DataFrame, address: str) -> DataFrame:
    """Adds schedule, line, col, measure and the rollup line; null when the
    address is not of the form."""
    a = F.col(address)

    def part(i: int) -> Column:
        return F.when(a.rlike(ADDRESS), F.regexp_extract(a, ADDRESS, i))

    return (
        df.withColumn("schedule", part(1)).withColumn("line", part(2)).withColumn("col", part(3))
        .withColumn("measure", part(4))
        .withColumn("rollup", F.concat(F.substring("line", 1, 2), F.lit("99")))
    )


def decode(code: Column, labels: dict[str, str], keep_unknown: bool = True) -> Column:
    """Label of a code; an unknown code passes through or becomes null."""
    found = F.try_element_at(F.create_map(*[F.lit(x) for x in chain.from_iterable(labels.items())]), code)
    return F.coalesce(found, code) if keep_unknown else found

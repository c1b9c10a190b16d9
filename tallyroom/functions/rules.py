"""Rule expressions shared by the record checks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def not_iff(a: Column, b: Column) -> Column:
    """True where exactly one of two conditions holds."""
    return a != b


def partly_null(*columns: str) -> Column:
    """True where some but not all of the columns are null."""
    nulls = [F.col(c).isNull().cast("int") for c in columns]
    total = sum(nulls[1:], nulls[0])
    return (total > 0) & (total < len(columns))

"""Columns of vectors: which rows can take part."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(v: Column) -> Column:
    """Whether an array of double has no null and no component that isn't finite; null for a null array."""
    return F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def commonest_width(rows: DataFrame, vector: str) -> int:
    """The commonest length of the vectors, the smallest of several; 0 without rows."""
    width = rows.groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), "d").first()
    return width["d"] if width else 0

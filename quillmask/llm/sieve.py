"""Bitmaps of bounded size that keep rows which a join doesn't need out of its shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 1 << 23


def bitmap(values: DataFrame, column: str) -> DataFrame:
    """A bit for each hash that a column has: BITS / 64 rows at most, so small enough to broadcast whatever the input."""
    bit = F.pmod(F.xxhash64(column), F.lit(BITS))
    return values.select(bit.alias("bit")).groupBy(F.shiftright("bit", 6).alias("__word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("__mask"))


def sieved(df: DataFrame, column: str, bits: DataFrame, has: bool = True) -> DataFrame:
    """Rows whose value may be in the bitmap: all that are, and a few others; or the rest."""
    marked = df.withColumn("__bit", F.pmod(F.xxhash64(column), F.lit(BITS))).withColumn("__word", F.shiftright("__bit", 6))
    found = marked.join(F.broadcast(bits), "__word", "left")
    set_ = F.coalesce(F.expr("(__mask & shiftleft(1L, cast(__bit & 63 as int))) <> 0"), F.lit(False))
    return found.filter(set_ if has else ~set_).select(*df.columns)

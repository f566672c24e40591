"""Rounding and filling cost no pass of a pattern or format where none is needed, and give what they gave."""

from pyspark.sql import functions as F

from quillmask.functions.columns import exact_round
from quillmask.operators import fakes


def test_rounding_whole_numbers(spark):
    values = [0.0, -0.0, 5.0, -7.0, 0.125, 0.375, 2.675, 1e15, 1e18, 123456789.0, float("nan"), None]
    rows = spark.createDataFrame([(v,) for v in values], "x double")
    plain = F.call_function("format_number", F.col("x"), F.lit("0.00")).cast("double")
    assert rows.filter(~exact_round(F.col("x"), 2).eqNullSafe(plain)).count() == 0


def test_filling_steps_by_slots(spark):
    rows = spark.createDataFrame([("+90 532-1",), ("",), ("abc",), ("٣4",), (None,)], "t string")
    filled = fakes.fill(F.col("t"), F.lit("5678"), fakes.DIGIT)
    assert [r[0] for r in rows.select(filled).collect()] == ["+56 780-0", "", "abc", "56", None]

"""Replacement values take time in proportion to a text's length."""

import time

from pyspark.sql import functions as F

from quillmask.operators import fakes


def test_digits_by_hand(spark):
    seeds = [str(s) for s in (0, 7, 10, 18446744073709551615, 9223372036854775809)]
    rows = spark.createDataFrame([(s, n) for s in seeds for n in (0, 1, 9, 10, 11, 24, 35)], "s string, n int")
    for r in rows.select("s", "n", fakes.digit_run(F.col("s"), F.col("n")).alias("got")).collect():
        assert r["got"] == "".join(str((int(r["s"]) - i) % 10) for i in range(r["n"]))


def test_a_long_number_is_replaced_in_time(spark):
    rows = spark.createDataFrame([("5" + "0123456789" * 400,)], "t string")
    began = time.perf_counter()
    (got,) = rows.select(fakes.fake_value(F.lit("PHONE"), F.col("t"), F.lit("s"))).first()
    assert len(got) == 4001 and got.isdigit() and time.perf_counter() - began < 10

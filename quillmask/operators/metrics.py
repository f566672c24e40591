"""Metrics of runs and days that can be merged: exact counts, and sketches for distinct texts.

A sketch (HyperLogLog with 2 ** LG_K buckets, 4 KB at most) stands for a set of texts: the union of days' sketches is the
sketch of their union, so weeks and months follow from stored days and no detection is read again. An estimate is off by
more than ERROR of the true number about once in 400 times.

write_observed() takes a run's metrics in the pass that writes its detections. The metrics are observed in the writing
stage itself, of which each partition counts once however often its task is tried; the sketches wouldn't mind repeats.

Defined results: null texts are detections, but no distinct text; no detections give counts of 0 and an empty sketch; null
days (or other keys) are a group of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F

LG_K = 12
#: Three standard errors of an estimate: 3 * 1.04 / sqrt(2 ** LG_K).
ERROR = 0.049
STORED = "run string, detections long, confident long, texts binary, pages binary"


def page_key() -> Column:
    return F.concat_ws(":", F.col("doc_id").cast("string"), F.col("page").cast("string"))


def measures(confident: float = 0.9) -> list[Column]:
    """Aggregates of detections: how many, how many at or above a confidence, sketches of their texts and pages."""
    return [
        F.count(F.lit(1)).alias("detections"),
        F.count_if(F.coalesce(F.col("confidence") >= confident, F.lit(False))).alias("confident"),
        F.hll_sketch_agg("original_text", F.lit(LG_K)).alias("texts"),
        F.hll_sketch_agg(page_key(), F.lit(LG_K)).alias("pages"),
    ]


def sketched(found: DataFrame, *by: str, confident: float = 0.9) -> DataFrame:
    """A row of mergeable metrics for each group, such as a day: counts are added up and sketches united before the shuffle."""
    return found.groupBy(*by).agg(*measures(confident))


def merged(stored: DataFrame, *by: str) -> DataFrame:
    """Stored metrics of days or runs, put together: counts as they are, distinct texts and pages as estimates."""
    united = stored.groupBy(*by).agg(
        F.coalesce(F.sum("detections"), F.lit(0)).alias("detections"), F.coalesce(F.sum("confident"), F.lit(0)).alias("confident"), F.hll_union_agg("texts").alias("t"), F.hll_union_agg("pages").alias("p")
    )
    estimate = lambda c: F.coalesce(F.hll_sketch_estimate(c), F.lit(0))
    return united.select(*by, "detections", "confident", estimate("t").alias("distinct_texts"), estimate("p").alias("pages_with_detections"))


def write_observed(found: DataFrame, path: str, confident: float = 0.9) -> Row:
    """Writes detections as Parquet and returns their metrics (see `measures`), taken in the same pass."""
    seen = Observation()
    found.observe(seen, *measures(confident)).write.mode("overwrite").parquet(path)
    return Row(**seen.get)


class MetricsStore:
    """Metrics of runs, a folder a run: a run that is tried again replaces its own row."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.base = spark, path.rstrip("/")

    def add(self, run: str, row: Row) -> None:
        values = (int(row["detections"]), int(row["confident"]), bytes(row["texts"]), bytes(row["pages"]))
        self.spark.createDataFrame([values], STORED.removeprefix("run string, ")).coalesce(1).write.mode("overwrite").parquet(f"{self.base}/run={run}")

    def write(self, run: str, found: DataFrame, path: str) -> Row:
        """Writes a run's detections and stores what was observed."""
        row = write_observed(found, path)
        self.add(run, row)
        return row

    def read(self) -> DataFrame:
        return self.spark.read.schema(STORED).parquet(self.base)

    def total(self) -> DataFrame:
        """All runs as one row."""
        return merged(self.read())

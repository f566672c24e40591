"""Anonymisation map and redaction plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import box, font_ladder, rgb, strip_space
from ..functions.textfit import fitting_size


def anonymization_map(replaced: DataFrame, found: DataFrame | None, order: Column) -> DataFrame:
    """Replacements with the style of the last detection that has their page and trimmed text, of whatever type. Without
    `found` the replacements are themselves all the detections, and a window over them spares the join."""
    key, style = strip_space(F.col("original_text")), F.struct("font", "size", "color")
    if found is None:
        rows = replaced.withColumn("key", key).withColumn("style", F.max_by(style, order).over(Window.partitionBy("doc_id", "page", "key")))
    else:
        styles = found.groupBy("doc_id", "page", key.alias("key")).agg(F.max_by(style, order).alias("style"))
        rows = replaced.drop("font", "size", "color").withColumn("key", key).join(styles, ["doc_id", "page", "key"], "left")
    return rows.select(
        "doc_id", "page", "box", "original_text", "fake_text", F.col("type").alias("pii_type"), F.col("style.font").alias("font"), F.col("style.size").alias("size"),
        F.coalesce("style.color", F.lit(0)).alias("color"), (F.col("type") == "HANDWRITING_FIELD").alias("is_handwritten"), F.col("type").isin("SIGNATURE", "SIGNATURE_FIELD", "SIGNATURE_IMAGE").alias("is_signature"),
    )


def redaction_plan(mapped: DataFrame, pages: DataFrame) -> DataFrame:
    """Adds redact_box (wider by 4 points on both sides), insert_box (up to the right margin, 200 points at least where they fit), rgb, font_sizes
    and font_size: the first of them at which the replacement fits into insert_box by the widths of the standard font, null where none does."""
    sized = mapped.join(pages.select("doc_id", "page", "width"), ["doc_id", "page"], "left")
    b = F.col("box")
    right = F.least(F.coalesce("width", F.lit(595.0)) - 30, F.greatest(b["x1"], b["x0"] + 200))
    return (
        sized.withColumn("redact_box", box(b["x0"] - 4, b["y0"], b["x1"] + 4, b["y1"]))
        .withColumn("insert_box", box(b["x0"], b["y0"], right, b["y1"]))
        .withColumn("rgb", rgb(F.col("color")))
        .withColumn("font_sizes", font_ladder(F.col("size")))
        .withColumn("font_size", fitting_size(F.col("fake_text"), F.col("insert_box.x1") - b["x0"], b["y1"] - b["y0"], F.col("font_sizes")))
        .drop("width")
    )


def without_detections(documents: DataFrame, found: DataFrame) -> DataFrame:
    """Documents to be copied as they are."""
    return documents.join(found.select("doc_id"), "doc_id", "left_anti")


def webhook_payload(found: DataFrame, names: DataFrame) -> DataFrame:
    """One row for each document with a name: what would be posted. Nothing is sent. names: doc_id, filename."""
    counts = found.groupBy("doc_id", "type").agg(F.count(F.lit(1)).alias("n"))
    summary = counts.groupBy("doc_id").agg(F.sum("n").alias("pii_detected"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "n")))).alias("summary"))
    return names.join(summary, "doc_id", "left").select("doc_id", F.lit("anonymization_complete").alias("event"), "filename", F.coalesce("pii_detected", F.lit(0)).alias("pii_detected"), "summary")


def layout_metrics(blocks: DataFrame, found: DataFrame) -> DataFrame:
    """Pages, blocks, detections and distinct texts, as one row."""
    b = blocks.agg(F.count_distinct("doc_id", "page").alias("pages"), F.count(F.lit(1)).alias("blocks"))
    return b.crossJoin(found.agg(F.count(F.lit(1)).alias("detections"), F.count_distinct("original_text").alias("distinct_texts")))

"""Detection over a stream of plain documents. All steps are per document, so a micro-batch is a small run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators import lines, rules


def detect_stream(documents: DataFrame, path: str, checkpoint: str, key: str = "doc_id", text: str = "text", available_now: bool = True) -> StreamingQuery:
    """Appends the detections of arriving documents to a Parquet folder. No state is kept: each document stands alone."""
    found = rules.detect_with_rules(lines.single_lines(documents, key, text), rules.REGEX_RULES)
    writer = found.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer).start()

"""The whole job over a stream of pages: documents are put together in keyed state, and each finished one goes through the job.

A page row is (doc_id, page, pages, width, height, blocks, images) with `pages` the number of pages that its document has. Pages
come in any order and over any number of micro-batches. A document is finished when its pages 1..n have come; it is then
given on once, whole. Its state shrinks to a mark that lasts `remember_hours`, so that pages delivered again change nothing. A
page that comes twice before that counts as it came first. A document that isn't finished `wait_minutes` after its latest page
is given on as it is, with complete = false; pages that come later are dropped, as its decision has been made. Rows
without a document or page number, or with a page outside 1..pages, are dropped; documents of null or no pages don't
exist. What lasts is one document's pages a key, so no key grows with the stream.

Finished documents run through detection, replacement and plan as one batch. Each result is a folder batch=<number>, written
whole; a micro-batch that is tried again writes the same folder again. Replacement values go by the document and the run
key, which must be the same after a restart, or by a MappingLog, whose first value of a text stays whoever wrote it. So a stream
gives what one batch over the same documents gives.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType

from ..operators import dedup, plan
from ..plans import pipeline
from ..sources import layout as lay
from ..sources.mapping_log import MappingLog

BODY = f"width double, height double, blocks {lay.BLOCKS}, images {lay.IMAGES}"
PAGE = f"doc_id long, page int, pages int, {BODY}"
WHOLE = f"doc_id long, page int, complete boolean, {BODY}"
RESULTS = ("detections", "map", "plan")
HOUR = 3_600_000


class Assemble(StatefulProcessor):
    """Keeps a document's pages until all have come."""

    def __init__(self, wait_minutes: float, remember_hours: float):
        self.wait, self.remember = int(wait_minutes * 60_000), int(remember_hours * HOUR)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pages = handle.getMapState("pages", "page int", BODY)
        self.count = handle.getValueState("count", "pages int, seen int, timer long")
        self.done = handle.getValueState("done", "done boolean", self.remember)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        if self.done.exists():
            for _ in rows:
                pass
            return
        wanted, seen, timer = self.count.get() if self.count.exists() else (0, 0, 0)
        came = False
        for r in rows:
            wanted = max(wanted, r["pages"])
            if not self.pages.containsKey((r["page"],)):
                self.pages.updateValue((r["page"],), (r["width"], r["height"], r["blocks"], r["images"]))
                seen, came = seen + 1, True
        if seen == wanted:
            yield from self._give(key[0], True, timer)
            return
        if came:
            if timer:
                self.handle.deleteTimer(timer)
            timer = timerValues.getCurrentProcessingTimeInMs() + self.wait
            self.handle.registerTimer(timer)
        self.count.update((wanted, seen, timer))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield from self._give(key[0], False, 0)

    def _give(self, doc_id: int, complete: bool, timer: int) -> Iterator[Row]:
        if timer:
            self.handle.deleteTimer(timer)
        for (page,), (width, height, blocks, images) in sorted(self.pages.iterator(), key=lambda kv: kv[0][0]):
            yield Row(doc_id=doc_id, page=page, complete=complete, width=width, height=height, blocks=blocks, images=images)
        self.pages.clear()
        self.count.clear()
        self.done.update((True,))

    def close(self) -> None:
        pass


def finished(pages: DataFrame, wait_minutes: float = 60, remember_hours: float = 24 * 7) -> DataFrame:
    """The pages of finished documents, from a stream of pages. Needs the RocksDB state store; see configured()."""
    known = pages.filter("doc_id is not null and page between 1 and pages").select(*(f.name for f in StructType.fromDDL(PAGE).fields))
    return known.groupBy("doc_id").transformWithState(Assemble(wait_minutes, remember_hours), StructType.fromDDL(WHOLE), "Append", "ProcessingTime")


@contextmanager
def configured(spark: SparkSession, available_now: bool) -> Iterator[None]:
    """Settings that a query takes over when it starts: the state store that keyed state with timers needs, and, where a run
    shall end with its input, no micro-batches without data. Without that Spark goes on for ever to look for timers."""
    wanted = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
    if available_now:
        wanted["spark.sql.streaming.noDataMicroBatches.enabled"] = "false"
    before = {name: spark.conf.get(name) for name in wanted}
    try:
        for name, value in wanted.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def results(pages: DataFrame, run_key: str | None, log: MappingLog | None = None, scope: str = "doc", kept: Callable[[str, DataFrame], DataFrame] = lambda name, rows: rows) -> dict[str, DataFrame]:
    """Detections, map and plan of whole documents. pages: rows of WHOLE. kept(name, rows) may write a result and give what is read from it,
    so that the next one doesn't compute it again."""
    spread = pipeline.Layout(lay.blocks_of(pages), lay.images_of(pages), lay.pages_of(pages))
    found = kept("detections", pipeline.detect_pii(spread))
    if log is None:
        replaced = pipeline.build_replacements(found, run_key, scope)
    else:
        replaced = log.replacements(found, dedup.order_key(), run_key, scope)
    mapped = kept("map", plan.anonymization_map(replaced, None, dedup.order_key()))
    return dict(zip(RESULTS, (found, mapped, kept("plan", plan.redaction_plan(mapped, spread.pages))), strict=True))


def batch_writer(folder: str, run_key: str | None, log_path: str | None = None, scope: str = "doc") -> Callable[[DataFrame, int], None]:
    """Writes the results of a micro-batch's documents, each to folder/<result>/batch=<number>."""

    def write(pages: DataFrame, number: int) -> None:
        spark = pages.sparkSession
        pages = pages.persist()  # the state is read once

        def kept(name: str, rows: DataFrame) -> DataFrame:
            path = f"{folder}/{name}/batch={number}"
            rows.write.mode("overwrite").parquet(path)
            return spark.read.schema(rows.schema).parquet(path)

        try:
            results(pages, run_key, None if log_path is None else MappingLog(spark, log_path), scope, kept)
            kept("documents", pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pages"), F.first("complete").alias("complete")))
        finally:
            pages.unpersist()

    return write


def run_stream(pages: DataFrame, folder: str, checkpoint: str, run_key: str | None, log_path: str | None = None, scope: str = "doc", wait_minutes: float = 60, remember_hours: float = 24 * 7, available_now: bool = True) -> StreamingQuery:
    """Starts the job over a stream of pages. scope 'run' needs a log_path: values then hold over all documents ever seen. available_now:
    the run ends with its input; documents whose time is over then go on with the next input, in this run or a later one."""
    if scope == "run" and log_path is None:
        raise ValueError("values that hold over a stream's documents need a log")
    writer = finished(pages, wait_minutes, remember_hours).writeStream.foreachBatch(batch_writer(folder, run_key, log_path, scope)).option("checkpointLocation", checkpoint).outputMode("append")
    with configured(pages.sparkSession, available_now):
        return (writer.trigger(availableNow=True) if available_now else writer).start()


def read_results(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """All that a stream has given of one result."""
    return spark.read.parquet(f"{folder}/{name}").drop("batch")

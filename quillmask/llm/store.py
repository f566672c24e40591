"""Tables and files written between the steps of a job, in the folder that all executors share."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The cluster's `spark.checkpoint.dir`; a local folder only where that is unset and the master is local."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    root = os.path.join(tempfile.gettempdir(), f"quillmask-{os.getpid()}")
    spark.conf.set("spark.checkpoint.dir", root)
    atexit.register(shutil.rmtree, root, ignore_errors=True)
    return root


#: Folders given out by the job that is going on in this thread.
_given: ContextVar[list[str] | None] = ContextVar("given", default=None)


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A path that nothing has been written to."""
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    if (given := _given.get()) is not None:
        given.append(path)
    return path


@contextmanager
def job(spark: SparkSession) -> Iterator[None]:
    """Removes the folders that operators take inside, on whatever file system, when the block ends, also by an error. Write
    results inside, to a path of your own (or a `fresh_dir` from before): what still reads those tables can't be read afterwards.

        with store.job(spark):
            mixing.mixed(docs, 32).write.parquet(path)
    """
    token = _given.set([])
    try:
        yield
    finally:
        paths = _given.get()
        _given.reset(token)
        for path in paths:
            delete(spark, path)


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: writes `df` as Parquet in the shared folder and reads it again."""
    return written_at(df, fresh_dir(df.sparkSession, name))


def written_at(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Tables:
    """Tables of one job, each of which can be removed once the next is written."""

    def __init__(self, spark: SparkSession):
        self.spark, self._at = spark, {}

    def written(self, df: DataFrame, name: str) -> DataFrame:
        path = fresh_dir(self.spark, name)
        out = written_at(df, path)
        self._at[id(out)] = out, path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for df in tables:
            delete(self.spark, self._at.pop(id(df))[1])


def delete(spark: SparkSession, path: str) -> None:
    """Removes a folder of the shared store, whatever file system it is on."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Rows of an Arrow batch for what is run inside: wide rows by the ten thousand are much memory outside the heap."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)

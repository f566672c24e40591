"""Replacement values that last from run to run: an append-only log, in which the first value of a text stays.

Entries are (scope, original_text, type, fake_text): scope is a document's id as text, or '' for a whole run's values. A
version names the commits that make up the log; a commit is a folder of Parquet files by bucket, a hash of scope and text, so
that a run reads only the buckets that its texts fall into. A writer adds what the version that it has read lacks, and
commits by creating the next version's file, which fails if another writer was first; then it reads that version and takes
out what is known by now. So each (scope, original_text) is in the log once, whoever wrote it, and a run that is
tried again finds its own values. A commit that no version names is never read. compact() makes one commit of all;
expire() removes what only old versions name, by their age, so that running readers keep their files.

The creation of a version's file is atomic where the file system's rename without overwriting is.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import fakes

BUCKETS = 64
TRIES = 20
ENTRY = "scope string, original_text string, type string, fake_text string"


class Conflict(Exception):
    """Another writer has made this version."""


def bucket() -> Column:
    return F.pmod(F.xxhash64("scope", "original_text"), F.lit(BUCKETS)).cast("int")


class MappingLog:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.base = spark, path.rstrip("/")
        self._fs, self._conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
        self._system = self._at(self.base).getFileSystem(self._conf)

    def _at(self, path: str):
        return self._fs.Path(path)

    # versions

    def versions(self) -> list[int]:
        folder = self._at(f"{self.base}/versions")
        if not self._system.exists(folder):
            return []
        return sorted(int(n[:-5]) for n in (x.getPath().getName() for x in self._system.listStatus(folder)) if n.endswith(".json") and n[:-5].isdigit())

    def commits(self, version: int | None = None) -> tuple[int, list[str]]:
        """A version's number and commits; by default of the latest, 0 and none at first."""
        known = self.versions()
        if version is None and not known:
            return 0, []
        version = known[-1] if version is None else version
        stream = self._system.open(self._at(f"{self.base}/versions/{version:012d}.json"))
        try:
            return version, json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))["commits"]
        finally:
            stream.close()

    def _commit(self, version: int, commits: list[str]) -> None:
        """Makes a version; a Conflict if it is there."""
        aside, new = (self._system.makeQualified(self._at(f"{self.base}/versions/{name}")) for name in (f".{uuid.uuid4().hex}", f"{version:012d}.json"))
        stream = self._system.create(aside)
        try:
            stream.write(bytearray(json.dumps({"commits": commits}).encode()))
        finally:
            stream.close()
        try:
            self._fs.FileContext.getFileContext(self._system.getUri(), self._conf).rename(aside, new, self.spark._sc._gateway.new_array(self._fs.Options.Rename, 0))
        except Exception as error:
            self._system.delete(aside, False)
            if version in self.versions():
                raise Conflict(version) from error
            raise

    # entries

    def read(self, wanted: DataFrame | None = None, commits: list[str] | None = None) -> DataFrame:
        """Entries of the latest version. wanted (scope, original_text): only the buckets that these fall into are read; there are BUCKETS at most."""
        commits = self.commits()[1] if commits is None else commits
        if not commits:
            return self.spark.createDataFrame([], ENTRY)
        rows = self.spark.read.schema(f"{ENTRY}, commit string, bucket int").option("basePath", f"{self.base}/data").parquet(*(f"{self.base}/data/commit={c}" for c in commits))
        if wanted is not None:
            rows = rows.filter(F.col("bucket").isin([r[0] for r in wanted.select(bucket()).distinct().collect()]))
        return rows.select("scope", "original_text", "type", "fake_text")

    def _write(self, rows: DataFrame) -> tuple[str, bool]:
        """A new commit's name, and whether it has rows. Rows are dealt out by bucket, so that a bucket is one file."""
        name = uuid.uuid4().hex
        folder = f"{self.base}/data/commit={name}"
        rows.withColumn("bucket", bucket()).repartition("bucket").write.partitionBy("bucket").parquet(folder)
        return name, any(x.isDirectory() for x in self._system.listStatus(self._at(folder)))

    def _drop(self, commit: str) -> None:
        self._system.delete(self._at(f"{self.base}/data/commit={commit}"), True)

    def add(self, values: DataFrame) -> int:
        """Adds the values of texts that have none: scope, original_text, type, fake_text. Of several for a text the smallest
        counts. Returns the version that has them all."""
        values = values.filter("fake_text is not null").groupBy("scope", "original_text").agg(F.min(F.struct("type", "fake_text")).alias("v")).select("scope", "original_text", "v.*")
        for _ in range(TRIES):
            version, commits = self.commits()
            known = self.read(values, commits)
            new, any_ = self._write(values.join(known, ["scope", "original_text"], "left_anti"))
            if not any_:
                self._drop(new)
                return version
            try:
                self._commit(version + 1, [*commits, new])
                return version + 1
            except Conflict:
                self._drop(new)
        raise RuntimeError(f"{TRIES} other writers were first")

    def compact(self) -> int:
        """One commit of all entries. Where another writer is first, it is tried again with what that one added."""
        for _ in range(TRIES):
            version, commits = self.commits()
            if len(commits) < 2:
                return version
            new, _ = self._write(self.read(commits=commits))
            try:
                self._commit(version + 1, [new])
                return version + 1
            except Conflict:
                self._drop(new)
        raise RuntimeError(f"{TRIES} other writers were first")

    def expire(self, older_than_seconds: float = 86_400) -> None:
        """Removes versions but the latest, and commits that no version left names, where they are old enough for no reader or writer to be at them."""
        limit, known = (time.time() - older_than_seconds) * 1000, self.versions()
        old = lambda status: status.getModificationTime() <= limit
        for v in known[:-1]:
            at = self._at(f"{self.base}/versions/{v:012d}.json")
            if old(self._system.getFileStatus(at)):
                self._system.delete(at, False)
        named = {c for v in self.versions() for c in self.commits(v)[1]}
        data = self._at(f"{self.base}/data")
        for status in self._system.listStatus(data) if self._system.exists(data) else ():
            name = status.getPath().getName().removeprefix("commit=")
            if name not in named and old(status):
                self._drop(name)

    # replacements

    def known(self, found: DataFrame, scope: str = "doc") -> DataFrame:
        """What replacements() takes as `known` for these detections."""
        entries = self.read(found.select(scope_of(scope), "original_text"))
        if scope == "run":
            return entries.filter("scope = ''").select("original_text", "fake_text")
        return entries.filter("scope <> ''").select(F.col("scope").cast(found.schema["doc_id"].dataType).alias("doc_id"), "original_text", "fake_text")

    def replacements(self, found: DataFrame, order: Column, run_key: str | None, scope: str = "doc", strict: bool = False) -> DataFrame:
        """Detections with replacements: texts that the log has keep their values, others get new ones, which are added first, so
        that of two runs at once both use the first one's. `found` is read twice: give a written table where it is costly."""
        given = fakes.replacements(found, order, run_key, scope, strict, self.known(found, scope))
        self.add(given.select(scope_of(scope), "original_text", F.col("first_type").alias("type"), "fake_text"))
        return fakes.replacements(found, order, run_key, scope, strict, self.known(found, scope))


def scope_of(scope: str) -> Column:
    return (F.lit("") if scope == "run" else F.col("doc_id").cast("string")).alias("scope")

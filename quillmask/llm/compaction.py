"""Sharding with size-tiered compaction, by DataFrame operations alone.

Arrivals are appended as small immutable Parquet shards. Shards are in tiers by size, each `fan` times the one below;
when a tier has `fan` shards they are merged into one, until a shard has the target size. Each change is a new version
of the manifest, a small file that is written aside and renamed to its number: the rename fails if another writer has
taken the number, so a reader sees one version or the other, never a mixture (a rename is atomic where the file system's is).
A writer that comes second reads the new version and tries again. Merging reads each group's files in one
task and writes one file, without a shuffle; a task that is lost is run again by Spark's commit protocol, and files of
a failed attempt are in no manifest.

Defined results: all rows and columns are kept as they are, nulls, empty and very long texts, repeated rows and any
column names included; an empty arrival adds a version without files; a folder without a manifest is version 0, empty.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Groups merged by one job.
GROUPS = 32
#: Times that a commit is tried while other writers are first.
TRIES = 20


@dataclass(frozen=True)
class File:
    path: str  # below the table's folder
    rows: int
    bytes: int


class ShardedTable:
    def __init__(self, spark: SparkSession, base: str, fan: int = 4, least_bytes: int = 1 << 20, target_bytes: int = 128 << 20, keep_versions: int = 2):
        self.spark, self.base, self.fan, self.least, self.target, self.keep = spark, base, fan, least_bytes, target_bytes, keep_versions
        self._fs = spark._jvm.org.apache.hadoop.fs
        self._conf = spark._jsc.hadoopConfiguration()

    # manifest

    def _path(self, name: str):
        return self._fs.Path(f"{self.base}/{name}")

    def _system(self):
        return self._path("").getFileSystem(self._conf)

    def versions(self) -> list[int]:
        folder, system = self._path("manifest"), self._system()
        if not system.exists(folder):
            return []
        names = [x.getPath().getName() for x in system.listStatus(folder)]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> tuple[int, str | None, list[File]]:
        """Number, schema (JSON) and files of a version, the latest by default."""
        known = self.versions()
        if not known:
            return 0, None, []
        version = known[-1] if version is None else version
        stream = self._system().open(self._path(f"manifest/v{version:010d}.json"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        data = json.loads(text)
        return version, data["schema"], [File(**f) for f in data["files"]]

    def commit(self, after: int, schema: str | None, files: list[File]) -> int:
        """Makes `files` version after + 1, or fails if that version exists."""
        aside, system = self._path(f"manifest/.{uuid.uuid4().hex}"), self._system()
        stream = system.create(aside)
        try:
            stream.write(bytearray(json.dumps({"schema": schema, "files": [asdict(f) for f in files]}).encode()))
        finally:
            stream.close()
        new = self._path(f"manifest/v{after + 1:010d}.json")
        context = self._fs.FileContext.getFileContext(self._system().getUri(), self._conf)
        no_options = self.spark._sc._gateway.new_array(self._fs.Options.Rename, 0)
        context.rename(system.makeQualified(aside), system.makeQualified(new), no_options)
        return after + 1

    # data

    def _write(self, df: DataFrame, folder: str, rows_per_file: int = 0) -> list[File]:
        df.write.option("maxRecordsPerFile", rows_per_file).parquet(f"{self.base}/{folder}")
        try:
            # read without columns: the footers' counts do, and no column can hide _metadata
            found = self.spark.read.schema(T.StructType([])).parquet(f"{self.base}/{folder}").groupBy(F.col("_metadata.file_name").alias("name"), F.col("_metadata.file_size").alias("bytes")).agg(F.count(F.lit(1)).alias("rows"))
            return [File(f"{folder}/{r['name']}", r["rows"], r["bytes"]) for r in sorted(found.collect(), key=lambda r: r["name"])]
        except Exception:
            self._system().delete(self._path(folder), True)
            raise

    def stage(self, df: DataFrame, rows_per_file: int) -> list[File]:
        """Writes arrivals as small shards; they are part of the table once a version names them."""
        return self._write(df, f"data/arrival-{uuid.uuid4().hex}", rows_per_file)

    def append(self, files: list[File], schema: T.StructType) -> int:
        """Adds staged files in a new version. Where another writer was first, its version is read and the commit tried again."""
        return self._committed(lambda old: old + files, schema.json())

    def _committed(self, change: Callable[[list[File]], list[File] | None], schema: str | None = None) -> int | None:
        """Commits what `change` makes of the latest version's files. Returns the new version; None, and nothing is committed, if that is None."""
        for _ in range(TRIES):
            version, known, files = self.manifest()
            new = change(files)
            if new is None:
                return None
            try:
                return self.commit(version, schema or known, new)
            except Exception:
                if version + 1 not in self.versions():
                    raise
        raise RuntimeError(f"{TRIES} other writers were first")

    def tier(self, f: File) -> int:
        return max(0, math.ceil(math.log(max(f.bytes, 1) / self.least, self.fan)))

    def due(self, files: list[File]) -> list[list[File]]:
        """Groups of `fan` shards of one tier, smallest first; a shard of half the target size or a group beyond twice that isn't merged."""
        tiers: dict[int, list[File]] = {}
        for f in sorted(files, key=lambda f: (f.bytes, f.path)):
            if 2 * f.bytes < self.target:
                tiers.setdefault(self.tier(f), []).append(f)
        groups = []
        for _, found in sorted(tiers.items()):
            for i in range(0, len(found) - self.fan + 1, self.fan):
                group = found[i : i + self.fan]
                while len(group) > 1 and sum(f.bytes for f in group) > 2 * self.target:
                    group = group[:-1]
                groups.append(group)
        return [g for g in groups if len(g) > 1]

    def compact(self) -> int:
        """Merges until no tier is due. Returns the version."""
        while True:
            version, schema, files = self.manifest()
            groups = self.due(files)[:GROUPS]
            if not groups:
                return version
            kind = T.StructType.fromJson(json.loads(schema))
            parts = [self.spark.read.schema(kind).parquet(*(f"{self.base}/{f.path}" for f in g)).coalesce(1) for g in groups]
            made = self._write(reduce(DataFrame.unionAll, parts), f"data/merged-{uuid.uuid4().hex}")
            gone = {f.path for g in groups for f in g}
            if sum(f.rows for f in made) != sum(f.rows for f in files if f.path in gone):
                raise AssertionError("merged shards don't have the rows of their sources")

            def merged(now: list[File], gone: set[str] = gone, made: list[File] = made) -> list[File] | None:
                """None if another writer has merged some of the sources already."""
                return [f for f in now if f.path not in gone] + made if gone <= {f.path for f in now} else None

            if self._committed(merged) is None:
                self._system().delete(self._path(made[0].path.rpartition("/")[0]), True)  # their rows are in the other writer's files
            self.expire()

    def expire(self) -> None:
        """Removes all but the last versions, and the files that only those name."""
        known = self.versions()
        old, kept = known[: -self.keep], known[-self.keep :]
        if not old:
            return
        needed = {f.path for v in kept for f in self.manifest(v)[2]}
        gone = {f.path for v in old for f in self.manifest(v)[2]} - needed
        for name in [*gone, *(f"manifest/v{v:010d}.json" for v in old)]:
            self._system().delete(self._path(name), False)

    def read(self, version: int | None = None) -> DataFrame:
        _, schema, files = self.manifest(version)
        if schema is None:
            raise ValueError("the table has no version")
        kind = T.StructType.fromJson(json.loads(schema))
        if not files:
            return self.spark.createDataFrame([], kind)
        return self.spark.read.schema(kind).parquet(*(f"{self.base}/{f.path}" for f in files))


def ingested(docs: DataFrame, base: str, arrivals: int = 8, rows_per_shard: int = 4096, **options) -> ShardedTable:
    """Appends `docs` in `arrivals` commits, with compaction after each."""
    table = ShardedTable(docs.sparkSession, base, **options)
    files = table.stage(docs, rows_per_shard)
    for i in range(arrivals):
        table.append(files[i::arrivals], docs.schema)
        table.compact()
    return table

"""Data sources for files of one document each: a reader that gives bad files as rows, a writer whose job appears at once.

Reading (`page_files`): a partition is a run of files of about `partition_bytes`; a larger PDF is cut into ranges of pages, each a
partition. Rows are pages, with `path`; a file that can't be read is one row with `error` and no page, whatever is wrong with it,
and a file without pages gives none. Files are JSON lists of pages, or PDFs (`.pdf`; needs PyMuPDF on the workers).

Writing (`document_files`): a task writes its files into a hidden folder of its own attempt. The job's commit moves the folders of the
attempts that count together, one move a task, and shows all of them by one rename: `folder/<job>/part-<n>/<name>`. Attempts
that fail clean up after themselves, and those that lose are removed at commit; a job that fails leaves nothing. Overwriting removes
earlier jobs after the rename. A row without a name or content, a name with a path in it, and a name twice in one task are errors;
rows of one name belong into one task (layout.envelope() has a row a document).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from . import layout

PARTITION_BYTES = 64 << 20
PAGES = f"path string, page int, width double, height double, blocks {layout.BLOCKS}, images {layout.IMAGES}, error string"


def opened(path: str):
    """The file system of a path or URI, and the path on it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


# reading


@dataclass
class Files(InputPartition):
    """Files to read whole, or a share (part k of n) of the pages of one."""

    paths: tuple[str, ...]
    part: int = 0
    of: int = 1


def planned(files: list[tuple[str, int]], partition_bytes: int) -> list[Files]:
    """Partitions of about `partition_bytes` from (path, bytes)."""
    out, held, size = [], [], 0
    for path, length in sorted(files):
        if length > partition_bytes and path.lower().endswith(".pdf"):
            n = -(-length // partition_bytes)
            out += [Files((path,), k, n) for k in range(n)]
            continue
        if held and size + length > partition_bytes:
            out.append(Files(tuple(held)))
            held, size = [], 0
        held.append(path)
        size += length
    return out + [Files(tuple(held))] if held else out


def number(value) -> float | None:
    return float(value) if isinstance(value, int | float) else None


def json_page(page: dict) -> tuple:
    """A page of a layout file, with the types that PAGES has."""
    coords = lambda x: [number(v) for v in x] if isinstance(x, list) else None
    whole = lambda x: None if number(x) is None else int(x)
    at = page.get("page") if page.get("page") is not None else page.get("page_no")
    blocks = [(b.get("text"), coords(b.get("bbox")), b.get("font"), number(b.get("size")), whole(b.get("color")), number(b.get("confidence"))) for b in page.get("blocks") or ()]
    images = [(i.get("bbox") and coords(i["bbox"]), whole(i.get("width")), whole(i.get("height"))) for i in page.get("images") or ()]
    return (whole(at) or 0, number(page.get("width")), number(page.get("height")), blocks, images)


def pages_of(path: str, data: bytes, part: int, of: int) -> Iterator[tuple]:
    if path.lower().endswith(".pdf"):
        for p in layout.pdf_pages(data, part, of):
            yield p["page"], p["width"], p["height"], [tuple(b.values()) for b in p["blocks"]], [tuple(i.values()) for i in p["images"]]
        return
    listed = json.loads(data)
    if not isinstance(listed, list):
        raise ValueError("a layout file must hold a list of pages")
    yield from map(json_page, listed)


class PageReader(DataSourceReader):
    def __init__(self, path: str, suffix: str, partition_bytes: int):
        self.path, self.suffix, self.partition_bytes = path, suffix, partition_bytes

    def partitions(self) -> list[Files]:
        from pyarrow import fs

        system, base = opened(self.path)
        listed = system.get_file_info(fs.FileSelector(base, recursive=True))
        return planned([(f.path, f.size) for f in listed if f.is_file and f.base_name.endswith(self.suffix)], self.partition_bytes) or [Files(())]

    def read(self, partition: Files) -> Iterator[tuple]:
        system, _ = opened(self.path)
        for path in partition.paths:
            try:  # a file counts as a whole: no pages of one that goes wrong halfway
                with system.open_input_stream(path) as f:
                    rows = [(path, *p, None) for p in pages_of(path, f.read(), partition.part, partition.of)]
            except ImportError:
                raise
            except Exception as error:  # whatever a file holds, the others are read
                rows = [(path, None, None, None, None, None, f"{type(error).__name__}: {error}")] if partition.part == 0 else []
            yield from rows


class PageFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "page_files"

    def schema(self) -> str:
        return PAGES

    def reader(self, schema: StructType) -> PageReader:
        return PageReader(self.options["path"], self.options.get("suffix", ".json"), int(self.options.get("partition_bytes", PARTITION_BYTES)))


def read_pages(spark: SparkSession, path: str, suffix: str = ".json", partition_bytes: int = PARTITION_BYTES) -> tuple[DataFrame, DataFrame]:
    """Layouts (doc_id and pages, as layout.read_layout() gives them) and the files that can't be read (doc_id, path, error)."""
    spark.dataSource.register(PageFiles)
    rows = spark.read.format("page_files").option("suffix", suffix).option("partition_bytes", partition_bytes).load(path).withColumn("doc_id", layout.doc_key(F.col("path")))
    good = rows.filter("error is null").select("doc_id", "page", "width", "height", "blocks", "images")
    return good, rows.filter("error is not null").select("doc_id", "path", "error")


# writing


@dataclass
class Written(WriterCommitMessage):
    """The folder of a task's attempt, with the number of the task; none if it had no rows."""

    folder: str | None
    task: int


class DocumentWriter(DataSourceArrowWriter):
    def __init__(self, folder: str, overwrite: bool):
        self.folder, self.overwrite, self.job = folder.rstrip("/"), overwrite, f"job-{uuid.uuid4().hex}"

    def _hidden(self, base: str) -> str:
        return f"{base}/.{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        system, base = opened(self.folder)
        task, at, names = TaskContext.get().partitionId(), f"{self._hidden(base)}/{uuid.uuid4().hex}", set()
        try:
            for batch in iterator:
                for name, content in zip(batch["name"], batch["content"], strict=True):
                    name, data = name.as_py(), content.as_py()
                    if not name or "/" in name or name in names or data is None:
                        raise ValueError(f"can't write a file named {name!r}: it has no name or content, a path, or came before")
                    if not names:
                        system.create_dir(at, recursive=True)
                    names.add(name)
                    with system.open_output_stream(f"{at}/{name}") as f:
                        f.write(data.encode() if isinstance(data, str) else data)
        except BaseException:
            if names:
                system.delete_dir(at)
            raise
        return Written(at if names else None, task)

    def commit(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        system, base = opened(self.folder)
        hidden = self._hidden(base)
        system.create_dir(f"{hidden}/all", recursive=True)
        for m in messages:
            if m is not None and m.folder is not None:
                system.move(m.folder, f"{hidden}/all/part-{m.task:05d}")
        earlier = [f for f in system.get_file_info(fs.FileSelector(base)) if f.base_name.startswith("job-")] if self.overwrite else []
        system.move(f"{hidden}/all", f"{base}/{self.job}")
        system.delete_dir(hidden)
        for f in earlier:
            system.delete_dir(f.path)

    def abort(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        system, base = opened(self.folder)
        if system.get_file_info(self._hidden(base)).type == fs.FileType.Directory:
            system.delete_dir(self._hidden(base))


class DocumentFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "document_files"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema: StructType, overwrite: bool) -> DocumentWriter:
        return DocumentWriter(self.options["path"], overwrite)


def write_documents(rows: DataFrame, folder: str, mode: str = "append") -> None:
    """Writes each row's `content` (binary or text) as a file `name`. mode: append or overwrite."""
    rows.sparkSession.dataSource.register(DocumentFiles)
    rows.select("name", F.col("content").cast("binary").alias("content")).write.format("document_files").mode(mode).save(folder)

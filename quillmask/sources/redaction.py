"""Redacted PDFs: a document's plan by page, drawn signatures, and the files. Writing PDFs needs PyMuPDF on the workers."""

from __future__ import annotations

import math
import random
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .layout import as_list, doc_key

# Points at the corner of a box whose colour is the background's, and the background where they are off the page.
CORNER = 2
WHITE = (1.0, 1.0, 1.0)
# Strokes of a signature (fewest, most), and how often it is underlined.
STROKES, UNDERLINED = (2, 4), 0.6


def by_page(planned: DataFrame) -> DataFrame:
    """A row per page that has redactions: doc_id, page, redactions, from the top of the page down and from left to right."""
    columns = [c for c in planned.columns if c not in ("doc_id", "page")]
    place = F.struct(F.col("box")["y0"].alias("y"), F.col("box")["x0"].alias("x"), F.col("pii_type").alias("t"), F.col("original_text").alias("o"))
    rows = planned.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct(place.alias("at"), F.struct(*columns).alias("r")))).alias("all"))
    return rows.select("doc_id", "page", F.transform("all", lambda x: x["r"]).alias("redactions"))


def signature_strokes(seed: int, width: float, height: float) -> list[list[tuple[float, float]]]:
    """Lines of a drawn signature, the same for the same seed: waves along the base line, and often a line under them."""
    rnd = random.Random(seed)
    count = rnd.randint(*STROKES)
    lines = []
    for k in range(count):
        start, end = width * (0.05 + 0.9 * k / count), width * (0.05 + 0.9 * (k + rnd.uniform(0.6, 0.95)) / count)
        waves, tall, turn, base = rnd.uniform(1, 3), height * rnd.uniform(0.12, 0.28), rnd.uniform(0, math.pi), height * rnd.uniform(0.5, 0.62)
        steps = max(8, int(end - start))
        lines.append([(start + (end - start) * i / steps, base + tall * math.sin(turn + 2 * math.pi * waves * i / steps) * (1 - 0.4 * i / steps)) for i in range(steps + 1)])
    if rnd.random() < UNDERLINED:
        under = height * rnd.uniform(0.76, 0.86)
        lines.append([(width * 0.06, under), (width * rnd.uniform(0.5, 0.9), under)])
    return lines


def signature_png(seed: int, width: int, height: int) -> bytes:
    """The strokes as a PNG with a transparent background."""
    width, height = max(1, width), max(1, height)
    ink, rows = b"\x0a\x0a\x3c\xdc", [bytearray(4 * width) for _ in range(height)]
    for line in signature_strokes(seed, width, height):
        for (x0, y0), (x1, y1) in zip(line, line[1:], strict=False):
            steps = max(1, math.ceil(2 * max(abs(x1 - x0), abs(y1 - y0))))
            for i in range(steps + 1):
                x, y = int(x0 + (x1 - x0) * i / steps), int(y0 + (y1 - y0) * i / steps)
                for v in (y, y + 1):
                    if 0 <= x < width and 0 <= v < height:
                        rows[v][4 * x : 4 * x + 4] = ink
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", width, height, 8, 6, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"IDAT", zlib.compress(b"".join(b"\x00" + bytes(r) for r in rows))) + part(b"IEND", b"")


def seed_of(text: str) -> int:
    """A signature's seed: the same in every process."""
    return zlib.crc32(text.encode())


def background(page, box) -> tuple[float, float, float]:
    """The colour of the first point of a box's corner."""
    import fitz

    clip = fitz.Rect(box[0], box[1], box[0] + CORNER, box[1] + CORNER) & page.rect
    if clip.is_empty:
        return WHITE
    image = page.get_pixmap(clip=clip, matrix=fitz.Matrix(1, 1))
    return tuple(v / 255 for v in image.samples[:3]) if image.n >= 3 else WHITE


def redacted(data: bytes, pages: list[dict], font_file: str | None = None) -> bytes:
    """A PDF with the redactions of by_page() made: what is under the boxes goes, and what replaces it is put in."""
    import fitz

    with fitz.open(stream=data, filetype="pdf") as pdf:
        for group in pages:
            if not 1 <= group["page"] <= len(pdf):
                continue
            page = pdf[group["page"] - 1]
            for r, fill in [(r, background(page, r["box"])) for r in group["redactions"]]:
                page.add_redact_annot(fitz.Rect(*r["redact_box"]), fill=fill)
            page.apply_redactions()
            for r in group["redactions"]:
                if r["is_signature"]:
                    box = fitz.Rect(*r["box"])
                    page.insert_image(box, stream=signature_png(seed_of(r["fake_text"] or ""), int(box.width), int(box.height)))
                    continue
                font = {"fontname": "own", "fontfile": font_file} if font_file else {}
                for size in r["font_sizes"]:
                    if page.insert_textbox(fitz.Rect(*r["insert_box"]), r["fake_text"] or "", fontsize=size, color=tuple(r["rgb"]), align=0, **font) >= 0:
                        break
        return pdf.tobytes(garbage=4, deflate=True)


def redact_pdfs(spark: SparkSession, path: str, planned: DataFrame, font_file: str | None = None) -> DataFrame:
    """doc_id, path and content of the PDFs of `path`, redacted by a plan; PDFs without redactions are as they were. Only a document's own
    redactions meet its bytes, in one row."""
    columns = [c for c in ("box", "redact_box", "insert_box") if c in planned.columns]
    listed = planned.select(*(as_list(F.col(c)).alias(c) if c in columns and c != "box" else F.col(c) for c in planned.columns))
    pages = by_page(listed).select("doc_id", "page", F.transform("redactions", lambda r: F.struct(as_list(r["box"]).alias("box"), r["redact_box"].alias("redact_box"), r["insert_box"].alias("insert_box"), F.array(r["rgb"]["r"], r["rgb"]["g"], r["rgb"]["b"]).alias("rgb"), r["font_sizes"].alias("font_sizes"), r["fake_text"].alias("fake_text"), r["is_signature"].alias("is_signature"))).alias("redactions"))
    documents = pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", "redactions"))).alias("pages"))
    files = spark.read.format("binaryFile").load(path).select(doc_key(F.col("path")).alias("doc_id"), "path", "content")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                content = redacted(row["content"], row["pages"], font_file) if row["pages"] else row["content"]
                yield pa.RecordBatch.from_arrays([pa.array([row["doc_id"]], pa.int64()), pa.array([row["path"]]), pa.array([content], pa.binary())], ["doc_id", "path", "content"])

    return files.join(documents, "doc_id", "left").mapInArrow(make, "doc_id long, path string, content binary")


def save_files(rows: DataFrame, folder: str) -> DataFrame:
    """Writes each row's `content` (binary or text) to `folder`/`name`, on any file system that Arrow knows (a local one must be shared by all
    executors). A task that runs again writes the same files again. Returns name and bytes; the files are written when that is read."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            sizes = []
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = content.encode() if isinstance(content, str) else content
                system, base = fs.FileSystem.from_uri(folder)
                system.create_dir(base, recursive=True)
                with system.open_output_stream(f"{base}/{name}.part") as f:
                    f.write(data)
                system.move(f"{base}/{name}.part", f"{base}/{name}")
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], ["name", "bytes"])

    return rows.select("name", "content").mapInArrow(write, "name string, bytes long")

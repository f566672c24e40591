"""Layouts: schemas, JSON readers and writers, scan routing, OCR words, plain text and PDF adapters."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import box, exact_round, parsed_box, strip_space

BLOCKS = "array<struct<text:string,bbox:array<double>,font:string,size:double,color:int,confidence:double>>"
IMAGES = "array<struct<bbox:array<double>,width:int,height:int>>"
LAYOUT = f"page int, page_no int, width double, height double, blocks {BLOCKS}, images {IMAGES}"
DETECTION = "page int, type string, original_text string, text string, value string, bbox array<double>, confidence double, method string, rule string, font string, size double, color int, label_bbox array<double>"
#: Lists that a file of detections may have them in, first found first.
LISTS = ("detections", "pii", "items", "results", "replacements")


def doc_key(path: Column) -> Column:
    """A document's id from its path."""
    return F.xxhash64(path)


def read_layout(spark: SparkSession, path: str) -> DataFrame:
    """Layout JSON, one file a document: doc_id and a row per page. The schema is given, as an empty list would be inferred wrongly. A file that isn't a list of pages is an error."""
    raw = spark.read.text(path, wholetext=True).select(doc_key(F.col("_metadata.file_path")).alias("doc_id"), "value")
    pages = F.from_json("value", f"array<struct<{LAYOUT}>>".replace(" int", ":int").replace(" double", ":double").replace("blocks array", "blocks:array").replace("images array", "images:array"))
    listed = F.when(strip_space(F.col("value")).startswith("["), pages).otherwise(F.raise_error(F.lit("a layout file must hold a list of pages")))
    return raw.select("doc_id", F.inline(listed)).withColumn("page", F.coalesce("page", "page_no", F.lit(0))).drop("page_no")


def blocks_of(layout: DataFrame) -> DataFrame:
    """doc_id, page, block_no, text, box, font, size, color, confidence."""
    rows = layout.select("doc_id", "page", F.posexplode("blocks").alias("block_no", "b"))
    return rows.select("doc_id", "page", "block_no", F.col("b.text").alias("text"), parsed_box(F.col("b.bbox")).alias("box"), "b.font", exact_round(F.col("b.size"), 2).alias("size"), "b.color", "b.confidence")


def images_of(layout: DataFrame) -> DataFrame:
    rows = layout.select("doc_id", "page", F.posexplode("images").alias("image_no", "i"))
    return rows.select("doc_id", "page", "image_no", parsed_box(F.col("i.bbox")).alias("box"), "i.width", "i.height")


def pages_of(layout: DataFrame) -> DataFrame:
    return layout.select("doc_id", "page", "width", "height")


def read_detections(spark: SparkSession, path: str) -> DataFrame:
    """A file of detections: a bare list, or the first list found under the known names. Fails where a row has no text."""
    raw = spark.read.text(path, wholetext=True).select(doc_key(F.col("_metadata.file_path")).alias("doc_id"), "value")
    kind = "array<struct<" + ",".join(f"{n}:{t}" for n, t in (c.split(" ", 1) for c in DETECTION.split(", "))) + ">>"
    named = F.from_json("value", ",".join(f"{n} {kind}" for n in LISTS))
    found = F.when(strip_space(F.col("value")).startswith("["), F.from_json("value", kind)).otherwise(F.coalesce(*(named[n] for n in LISTS)))
    rows = raw.select("doc_id", F.posexplode(F.coalesce(found, F.raise_error(F.lit("no list of detections")).cast(kind))).alias("place", "d")).select("doc_id", "place", "d.*")
    text = F.coalesce("original_text", "text", "value", F.raise_error(F.lit("a detection has no text")).cast("string"))
    return rows.withColumn("original_text", text).withColumn("box", parsed_box(F.col("bbox"))).withColumn("label_box", parsed_box(F.col("label_bbox"))).drop("text", "value", "bbox", "label_bbox")


def read_map(spark: SparkSession, path: str) -> DataFrame:
    """An anonymisation map."""
    schema = "page int, bbox array<double>, original_text string, fake_text string, pii_type string, font string, size double, color int, is_handwritten boolean, is_signature boolean"
    rows = spark.read.schema(schema).json(path, multiLine=True).select(doc_key(F.col("_metadata.file_path")).alias("doc_id"), "*")
    return rows.withColumn("box", parsed_box(F.col("bbox"))).withColumn("color", F.coalesce("color", F.lit(0))).drop("bbox")


def as_list(b: Column) -> Column:
    return F.when(b.isNotNull(), F.array(b["x0"], b["y0"], b["x1"], b["y1"]))


def write_json(rows: DataFrame, path: str) -> None:
    """Boxes as lists of four, one JSON object a line, in UTF-8. A null is an absent key."""
    boxes = [f.name for f in rows.schema.fields if f.name.endswith("box")]
    rows.select(*(as_list(F.col(c)).alias(c.replace("box", "bbox")) if c in boxes else F.col(c) for c in rows.columns)).write.json(path)


def envelope(found: DataFrame, ner_status: str = "disabled") -> DataFrame:
    """A document's detections with their counts by type, as a result file has them. One document meets in one row. ner_status: what fields.find_model() says of the entity model."""
    row = F.struct("page", "type", "original_text", as_list(F.col("box")).alias("bbox"), "confidence", "method", "rule", "font", "size", "color")
    order = F.struct("page", F.col("box")["y0"], F.col("box")["x0"], "ord")
    rows = found.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), row.alias("d")))), lambda x: x["d"]).alias("detections"))
    counts = found.groupBy("doc_id", "type").agg(F.count(F.lit(1)).alias("n")).groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "n")))).alias("summary"))
    # The tags of the result format.
    return rows.join(counts, "doc_id").select("doc_id", F.lit("person2-pii-v1").alias("schema_version"), F.lit("Person 2 - PII Detection").alias("source"), F.lit(ner_status).alias("ner_status"), "detections", "summary")


def replacement_envelope(replaced: DataFrame) -> DataFrame:
    """A document's replacements as a result file has them: doc_id, replacements."""
    row = F.struct("page", "type", "original_text", "fake_text", as_list(F.col("box")).alias("bbox"), "metadata")
    order = F.struct("page", F.col("box")["y0"], F.col("box")["x0"], "type", "original_text")
    return replaced.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), row.alias("d")))), lambda x: x["d"]).alias("replacements"))


def map_envelope(mapped: DataFrame) -> DataFrame:
    """A document's anonymisation map as a result file has it: doc_id, redactions."""
    names = ("original_text", "fake_text", "pii_type", "font", "size", "color", "is_handwritten", "is_signature")
    row = F.struct("page", as_list(F.col("box")).alias("bbox"), *names)
    order = F.struct("page", F.col("box")["y0"], F.col("box")["x0"], "pii_type", "original_text")
    return mapped.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), row.alias("d")))), lambda x: x["d"]).alias("redactions"))


def result_files(envelopes: DataFrame, suffix: str, bare: str | None = None) -> DataFrame:
    """name and content (JSON text, indented) of one file a document, for redaction.save_files(). bare: the column that is the whole file."""
    body = F.col(bare) if bare else F.struct(*(c for c in envelopes.columns if c != "doc_id"))
    return envelopes.select(F.concat(F.col("doc_id").cast("string"), F.lit(suffix)).alias("name"), F.to_json(body, {"pretty": "true", "ignoreNullFields": "false"}).alias("content"))


# scans

# Fixed value: characters a page, on average, below which a document counts as scanned.
SCANNED_BELOW = 20


def scanned(page_texts: DataFrame, documents: DataFrame, threshold: int = SCANNED_BELOW) -> DataFrame:
    """doc_id, mean_chars, is_scanned; documents without pages are scanned. page_texts: doc_id, page, text."""
    mean = page_texts.groupBy("doc_id").agg((F.sum(F.length(strip_space(F.col("text")))) / F.count(F.lit(1))).alias("mean"))
    rows = documents.select("doc_id").join(mean, "doc_id", "left").select("doc_id", F.coalesce("mean", F.lit(0.0)).alias("mean_chars"))
    return rows.withColumn("is_scanned", F.col("mean_chars") < threshold)


def ocr_blocks(words: DataFrame, dpi: int = 300, min_confidence: float = 0) -> DataFrame:
    """OCR words in pixels as blocks in points. words: doc_id, page, word_no, text, conf, left, top, width, height."""
    zoom = dpi / 72
    x0, y0 = F.col("left") / zoom, F.col("top") / zoom
    height = F.col("height") / zoom
    kept = words.filter((F.length(strip_space(F.col("text"))) > 0) & (F.col("conf") >= min_confidence))
    return kept.select("doc_id", "page", F.col("word_no").alias("block_no"), strip_space(F.col("text")).alias("text"), box(x0, y0, x0 + F.col("width") / zoom, y0 + height).alias("box"), F.lit("OCR").alias("font"), exact_round(height, 2).alias("size"), F.lit(0).alias("color"), F.col("conf").cast("double").alias("confidence"))


def routed(native: DataFrame, ocr: DataFrame, flags: DataFrame) -> DataFrame:
    """Blocks of the OCR for scanned documents, native ones for the others."""
    return native.join(flags.filter("not is_scanned"), "doc_id", "left_semi").unionByName(ocr.join(flags.filter("is_scanned"), "doc_id", "left_semi"), allowMissingColumns=True)


def pdf_pages(data: bytes, part: int = 0, of: int = 1) -> Iterator[dict]:
    """Pages of a PDF: all, or part k of n of them."""
    import fitz

    with fitz.open(stream=data, filetype="pdf") as pdf:
        first, last = (len(pdf) * k // of for k in (part, part + 1))
        for number in range(first, last):
            page, blocks, images = pdf[number], [], []
            for found in page.get_text("dict")["blocks"]:
                if found["type"] == 1:
                    images.append({"bbox": list(found["bbox"]), "width": found.get("width"), "height": found.get("height")})
                for s in (s for line in found.get("lines", ()) for s in line["spans"]):
                    blocks.append({"text": s["text"], "bbox": list(s["bbox"]), "font": s["font"], "size": round(s["size"], 2), "color": s["color"], "confidence": None})
            yield {"page": number + 1, "width": page.rect.width, "height": page.rect.height, "blocks": blocks, "images": images}


def read_pdf(spark: SparkSession, path: str) -> DataFrame:
    """Layout of PDF files, a row a page. Needs PyMuPDF on the workers; a file is parsed by one task."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = [{"doc_id": doc_id, **page} for page in pdf_pages(data)]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    coords = pa.list_(pa.float64())
    block = pa.struct([("text", pa.string()), ("bbox", coords), ("font", pa.string()), ("size", pa.float64()), ("color", pa.int32()), ("confidence", pa.float64())])
    image = pa.struct([("bbox", coords), ("width", pa.int32()), ("height", pa.int32())])
    schema = pa.schema([("doc_id", pa.int64()), ("page", pa.int32()), ("width", pa.float64()), ("height", pa.float64()), ("blocks", pa.list_(block)), ("images", pa.list_(image))])
    files = spark.read.format("binaryFile").load(path).select(doc_key(F.col("path")).alias("doc_id"), "content")
    return files.mapInArrow(parse, f"doc_id long, page int, width double, height double, blocks {BLOCKS}, images {IMAGES}")

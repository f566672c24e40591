"""Command lines for single documents: JSON in, JSON out. `python -m quillmask COMMAND --help`.

extract   PDF to layout JSON (needs PyMuPDF)
detect    layout JSON to detections
fakes     detections to replacements
redact    PDF and anonymisation map to PDF (needs PyMuPDF)
run       all of it, from a PDF or a layout JSON; what lies between is kept in a work folder

Each command runs the library's plans on one document; for many documents call the library.
"""

from __future__ import annotations

import argparse
import json
import secrets
import shutil
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import dedup, fakes, fields, plan
from .plans import pipeline
from .sources import layout, redaction


def session() -> SparkSession:
    return SparkSession.builder.master("local[*]").appName("quillmask").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.shuffle.partitions", "4").getOrCreate()


def plain(row) -> dict:
    """A row as JSON has it."""
    return row.asDict(recursive=True)


def save(path: Path, value) -> None:
    path.write_text(json.dumps(value, ensure_ascii=False, indent=2), encoding="utf-8")


def layout_of(pages: DataFrame) -> pipeline.Layout:
    return pipeline.Layout(layout.blocks_of(pages), layout.images_of(pages), layout.pages_of(pages))


def result_of(found: DataFrame, ner_status: str) -> dict:
    rows = layout.envelope(found, ner_status).drop("doc_id").collect()  # one document
    if rows:
        return plain(rows[0])
    return {"schema_version": "person2-pii-v1", "source": "Person 2 - PII Detection", "ner_status": ner_status, "detections": [], "summary": {}}


def detect(spark: SparkSession, source: str, min_confidence: float = 0.0, enable_ner: bool = False, model: str | None = None) -> dict:
    """Detections of a layout file, with their counts."""
    load, status = fields.find_model(model, enable_ner)
    return result_of(pipeline.detect_pii(layout_of(layout.read_layout(spark, source)), min_confidence, load), status)


def fake_data(spark: SparkSession, source: str, run_key: str | None = "") -> dict:
    """Replacements of a file of detections, in its order. An unsupported type is an error."""
    found = layout.read_detections(spark, source)
    replaced = fakes.replacements(found, F.col("place"), secrets.token_hex(8) if run_key == "" else run_key, strict=True)
    rows = replaced.orderBy("place").select("page", "type", "original_text", "fake_text", layout.as_list(F.col("box")).alias("bbox"), "metadata").collect()
    return {"replacements": [{k: v for k, v in plain(r).items() if k != "metadata" or v} for r in rows]}


def extract(spark: SparkSession, source: str) -> list[dict]:
    return [plain(r) for r in layout.read_pdf(spark, source).drop("doc_id").orderBy("page").collect()]


def redact(spark: SparkSession, source: str, map_path: str, output: str) -> None:
    """One PDF by one map."""
    mapped = layout.read_map(spark, map_path).withColumn("doc_id", F.lit(0).cast("long"))
    key = spark.read.format("binaryFile").load(source).select(layout.doc_key(F.col("path")).alias("k")).first()["k"]
    pages = layout.read_pdf(spark, source).select(F.lit(0).cast("long").alias("doc_id"), "page", "width", "height")
    planned = plan.redaction_plan(mapped, pages).withColumn("doc_id", F.lit(key))
    Path(output).write_bytes(bytes(redaction.redact_pdfs(spark, source, planned).first()["content"]))


def run(spark: SparkSession, source: str, output: str | None = None, work_dir: str | None = None, enable_ner: bool = False, run_key: str | None = "") -> Path:
    """The whole job. A PDF without detections is copied; for a layout file the map is the result. Returns the work folder."""
    given = Path(source)
    work = Path(work_dir) if work_dir else given.parent / f"{given.stem}_pipeline"
    work.mkdir(parents=True, exist_ok=True)
    pdf, layout_path = given.suffix.lower() == ".pdf", given
    if pdf:
        layout_path = work / "layout.json"
        save(layout_path, extract(spark, str(given)))
    load, status = fields.find_model(None, enable_ner)
    found = pipeline.detect_pii(layout_of(layout.read_layout(spark, str(layout_path))), 0.0, load)
    result = result_of(found, status)
    save(work / "pii_output.json", result)
    target = Path(output) if output else given.parent / f"{given.stem}_anonymized{given.suffix}"
    if not result["detections"]:
        shutil.copyfile(given, target)
        return work
    replaced = pipeline.build_replacements(found, secrets.token_hex(8) if run_key == "" else run_key)
    save(work / "fake_data_output.json", {"replacements": [{k: v for k, v in plain(r).items() if k != "metadata" or v} for r in layout.replacement_envelope(replaced).first()["replacements"]]})
    mapped = plan.anonymization_map(replaced, None, dedup.order_key())
    save(work / "anonymization_map.json", [plain(r) for r in layout.map_envelope(mapped).first()["redactions"]])
    if pdf:
        redact(spark, str(given), str(work / "anonymization_map.json"), str(target))
    return work


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="quillmask", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = parser.add_subparsers(dest="command", required=True)
    for name, default in (("extract", "layout.json"), ("detect", "pii_output.json"), ("fakes", "fake_data_output.json"), ("run", None)):
        sub = commands.add_parser(name)
        sub.add_argument("input")
        sub.add_argument("-o", "--output", default=default)
        if name in ("detect", "run"):
            sub.add_argument("--enable-ner", action="store_true")
        if name == "detect":
            sub.add_argument("--model")
            sub.add_argument("--min-confidence", type=float, default=0.0)
        if name == "run":
            sub.add_argument("--work-dir")
    sub = commands.add_parser("redact")
    for x in ("input", "map", "output"):
        sub.add_argument(x)
    args = parser.parse_args(argv)
    if not Path(args.input).exists():
        parser.error(f"no such file: {args.input}")
    spark = session()
    if args.command == "extract":
        save(Path(args.output), extract(spark, args.input))
    elif args.command == "detect":
        result = detect(spark, args.input, args.min_confidence, args.enable_ner, args.model)
        save(Path(args.output), result)
        print(f"{len(result['detections'])} detections {result['summary']} -> {args.output}; entity model: {result['ner_status']}")
    elif args.command == "fakes":
        result = fake_data(spark, args.input)
        save(Path(args.output), result)
        print(f"{len({r['original_text'] for r in result['replacements']})} values -> {args.output}")
    elif args.command == "redact":
        redact(spark, args.input, args.map, args.output)
    else:
        print(run(spark, args.input, args.output, args.work_dir, args.enable_ner))
    return 0

"""Command lines, result files, redaction and reuse of values, on small documents."""

import json
import struct
import sys
import types
import zlib

import pytest
from pyspark.sql import functions as F

from quillmask import cli
from quillmask.functions.columns import box
from quillmask.operators import fakes, fields, plan
from quillmask.sources import layout, redaction


def block(text, x, y, page=1):
    return {"text": text, "bbox": [x, y, x + 6.0 * len(text), y + 12], "font": "Body", "size": 12.0, "color": 255}


PAGES = [
    {"page": 1, "width": 595.0, "height": 842.0, "images": [{"bbox": [60, 700, 200, 740], "width": 1, "height": 1}], "blocks": [block("Name: Ayşe Demir", 50, 60), block("ayse@mail.example.com", 50, 90), block("Signature:", 50, 700)]},
    {"page_no": 2, "width": None, "height": None, "images": [], "blocks": [block("ayse@mail.example.com", 50, 60), block("Signature:", 480, 100), block("IBAN TR33 0006 1005 1978 6457 8413 26", 50, 200)]},
]


@pytest.fixture()
def layout_file(tmp_path):
    path = tmp_path / "in.json"
    path.write_text(json.dumps(PAGES, ensure_ascii=False), encoding="utf-8")
    return path


def test_detect_and_fakes(spark, layout_file, tmp_path, capsys):
    out, fake = tmp_path / "pii.json", tmp_path / "fake.json"
    assert cli.main(["detect", str(layout_file), "-o", str(out)]) == 0
    result = json.loads(out.read_text(encoding="utf-8"))
    assert list(result) == ["schema_version", "source", "ner_status", "detections", "summary"] and result["ner_status"] == "disabled"
    assert result["summary"] == {"EMAIL": 2, "IBAN": 1, "PERSON": 1, "SIGNATURE": 2, "SIGNATURE_IMAGE": 1}
    assert [(d["page"], d["type"]) for d in result["detections"]] == [(1, "PERSON"), (1, "EMAIL"), (1, "SIGNATURE"), (1, "SIGNATURE_IMAGE"), (2, "EMAIL"), (2, "SIGNATURE"), (2, "IBAN")]
    result["detections"] = [d for d in result["detections"] if d["type"] != "SIGNATURE_IMAGE"]
    out.write_text(json.dumps(result), encoding="utf-8")
    assert cli.main(["fakes", str(out), "-o", str(fake)]) == 0
    rows = json.loads(fake.read_text(encoding="utf-8"))["replacements"]
    assert [(r["page"], r["type"], r["original_text"]) for r in rows] == [(d["page"], d["type"], d["original_text"]) for d in result["detections"]]
    assert rows[1]["fake_text"] == rows[3]["fake_text"] != "ayse@mail.example.com" and rows[2]["metadata"]["original_length"] == len(rows[2]["original_text"])
    assert "metadata" not in rows[0] and "4 values" in capsys.readouterr().out


def test_fields_below_the_label_and_without_a_page_size(spark, layout_file):
    found = [d for d in cli.detect(spark, str(layout_file))["detections"] if d["type"] == "SIGNATURE"]
    assert [d["bbox"] for d in found] == [[110.0, 692.0, 324.0, 748.0], [480.0, 116.0, 571.0, 168.0]]


def test_run_of_a_layout_keeps_what_lies_between(spark, layout_file, tmp_path):
    work = cli.run(spark, str(layout_file), str(tmp_path / "out.json"), run_key="k")
    assert sorted(p.name for p in work.iterdir()) == ["anonymization_map.json", "fake_data_output.json", "pii_output.json"]
    mapped = json.loads((work / "anonymization_map.json").read_text(encoding="utf-8"))
    assert len(mapped) == 7 and set(mapped[0]) == {"page", "bbox", "original_text", "fake_text", "pii_type", "font", "size", "color", "is_handwritten", "is_signature"}
    read = layout.read_map(spark, str(work / "anonymization_map.json")).collect()
    assert [(r["page"], list(r["box"]), r["fake_text"], r["color"]) for r in read] == [(m["page"], m["bbox"], m["fake_text"], m["color"]) for m in mapped]
    empty = tmp_path / "empty.json"
    empty.write_text("[]")
    assert cli.detect(spark, str(empty))["detections"] == []
    cli.run(spark, str(empty), str(tmp_path / "copy.json"))
    assert (tmp_path / "copy.json").read_text() == "[]"


def test_result_files_are_one_a_document(spark, tmp_path):
    rows = spark.createDataFrame([(1, 2, "EMAIL", "a@b.example", "x@y.example"), (1, 1, "PHONE", "1", None), (2, 1, "EMAIL", "ç", "d")], "doc_id long, page int, type string, original_text string, fake_text string")
    rows = rows.withColumn("box", box(F.lit(1), F.lit(2), F.lit(3), F.lit(4))).withColumn("metadata", F.lit(None).cast("struct<placeholder:boolean>"))
    files = layout.result_files(layout.replacement_envelope(rows), "_fake.json")
    assert {r["name"] for r in redaction.save_files(files, (tmp_path / "out").as_uri()).collect()} == {"1_fake.json", "2_fake.json"}
    first = json.loads((tmp_path / "out/1_fake.json").read_text(encoding="utf-8"))["replacements"]
    assert [(r["page"], r["bbox"], r["fake_text"]) for r in first] == [(1, [1, 2, 3, 4], None), (2, [1, 2, 3, 4], "x@y.example")]


def test_values_given_before_are_used_again(spark):
    row = "doc_id long, page int, type string, original_text string"
    first = fakes.replacements(spark.createDataFrame([(1, 1, "EMAIL", "a@b.example"), (1, 1, "PERSON", "Ann Ash")], row), F.col("page"), "one")
    again = spark.createDataFrame([(1, 2, "EMAIL", "a@b.example"), (2, 1, "EMAIL", "a@b.example"), (1, 1, "PHONE", "555 123 45 67"), (1, 1, "ODD", "Ann Ash")], row)
    given = {(r["doc_id"], r["original_text"], r["type"]): r["fake_text"] for r in fakes.replacements(again, F.col("page"), "two", known=fakes.mapped_values(first)).collect()}
    new = {(r["doc_id"], r["original_text"], r["type"]): r["fake_text"] for r in fakes.replacements(again, F.col("page"), "two").collect()}
    old = {r["original_text"]: r["fake_text"] for r in first.collect()}
    assert given[1, "a@b.example", "EMAIL"] == old["a@b.example"] != new[1, "a@b.example", "EMAIL"]
    assert given[1, "555 123 45 67", "PHONE"] == new[1, "555 123 45 67", "PHONE"] and given[1, "Ann Ash", "ODD"] is None
    assert given[2, "a@b.example", "EMAIL"] == new[2, "a@b.example", "EMAIL"]


def test_denied_firms_are_passed_over(spark):
    texts = spark.range(40).select(F.col("id").cast("string").alias("t"))
    firm = lambda names: {r[0] for r in texts.select(fakes.organization(fakes.seed(F.col("t"), None), names)).collect()}
    assert firm(("PKK Ltd", "Good Ltd")) == {"Good Ltd"}
    assert firm(("PKK Ltd",)) == firm(()) and len(firm(())) > 10


def test_a_missing_model_says_why(monkeypatch):
    assert fields.find_model(wanted=False) == (None, "disabled")
    monkeypatch.setitem(sys.modules, "spacy", None)
    assert fields.find_model() == (None, "unavailable: spaCy is not installed")
    fake = types.ModuleType("spacy")
    fake.load = lambda name: {"en_core_web_sm": lambda text: None}[name]
    monkeypatch.setitem(sys.modules, "spacy", fake)
    load, status = fields.find_model()
    assert load is not None and status == "enabled"
    assert fields.find_model("other")[1].startswith("unavailable: other: ")


def test_plan_by_page(spark):
    mapped = spark.createDataFrame([(1, 1, "b", 90.0), (1, 1, "a", 20.0), (1, 2, "c", 5.0), (2, 1, "d", 1.0)], "doc_id long, page int, original_text string, y double")
    mapped = mapped.select("doc_id", "page", box(F.lit(10), F.col("y"), F.lit(50), F.col("y") + 12).alias("box"), "original_text", F.lit("z").alias("fake_text"), F.lit("EMAIL").alias("pii_type"), F.lit(None).cast("string").alias("font"), F.lit(11.0).alias("size"), F.lit(255).alias("color"), F.lit(False).alias("is_handwritten"), F.lit(False).alias("is_signature"))
    pages = mapped.select("doc_id", "page").distinct().withColumn("width", F.lit(595.0)).withColumn("height", F.lit(842.0))
    got = {(r["doc_id"], r["page"]): [x["original_text"] for x in r["redactions"]] for r in redaction.by_page(plan.redaction_plan(mapped, pages)).collect()}
    assert got == {(1, 1): ["a", "b"], (1, 2): ["c"], (2, 1): ["d"]}


def test_signatures_are_the_same_for_the_same_name():
    lines = redaction.signature_strokes(7, 200, 60)
    assert lines == redaction.signature_strokes(7, 200, 60) != redaction.signature_strokes(8, 200, 60)
    assert all(0 <= x <= 200 and 0 <= y <= 60 for line in lines for x, y in line)
    counts = [len(redaction.signature_strokes(s, 200, 60)) for s in range(300)]
    assert set(counts) <= {2, 3, 4, 5} and 5 in counts
    data = redaction.signature_png(7, 200, 60)
    assert data[:8] == b"\x89PNG\r\n\x1a\n" and struct.unpack(">II", data[16:24]) == (200, 60)
    size = struct.unpack(">I", data[33:37])[0]
    pixels = zlib.decompress(data[41 : 41 + size])
    assert len(pixels) == 60 * (4 * 200 + 1) and any(pixels)
    assert redaction.signature_png(1, 0, 0)[:4] == b"\x89PNG"


class Rect:
    def __init__(self, x0, y0, x1, y1):
        self.x0, self.y0, self.x1, self.y1 = x0, y0, x1, y1
        self.width, self.height, self.is_empty = x1 - x0, y1 - y0, x0 >= x1 or y0 >= y1

    def __and__(self, o):
        return Rect(max(self.x0, o.x0), max(self.y0, o.y0), min(self.x1, o.x1), min(self.y1, o.y1))


class Page:
    """Notes what is done to it."""

    def __init__(self, notes):
        self.notes, self.rect = notes, Rect(0, 0, 595, 842)

    def get_pixmap(self, clip, matrix):
        return types.SimpleNamespace(n=3, samples=bytes([255, 0, 51]))

    def add_redact_annot(self, box, fill):
        self.notes.append(("cover", box.x0, fill))

    def apply_redactions(self):
        self.notes.append(("apply",))

    def insert_textbox(self, box, text, fontsize, color, align):
        self.notes.append(("text", text, fontsize, box.x1))
        return 1 if fontsize < 10 else -1

    def insert_image(self, box, stream):
        self.notes.append(("image", stream[:4]))


def test_redacted_pdf(monkeypatch):
    notes = []

    class Pdf(list):
        def __enter__(self):
            return self

        def __exit__(self, *a):
            return None

        def tobytes(self, **how):
            return b"made"

    fitz = types.ModuleType("fitz")
    fitz.Rect, fitz.Matrix = Rect, lambda a, b: None
    fitz.open = lambda stream, filetype: Pdf([Page(notes)])
    monkeypatch.setitem(sys.modules, "fitz", fitz)
    text = {"box": [50, 60, 90, 72], "redact_box": [46, 60, 94, 72], "insert_box": [50, 60, 250, 72], "rgb": [0, 0, 1], "font_sizes": [12, 10.8, 9.6, 8.4], "fake_text": "new", "is_signature": False}
    signed = text | {"box": [700, 900, 720, 910], "is_signature": True, "fake_text": "Generated Signature"}
    assert redaction.redacted(b"pdf", [{"page": 1, "redactions": [text, signed]}, {"page": 9, "redactions": [text]}]) == b"made"
    assert notes == [("cover", 46, (1.0, 0.0, 0.2)), ("cover", 46, (1.0, 1.0, 1.0)), ("apply",), ("text", "new", 12, 250), ("text", "new", 10.8, 250), ("text", "new", 9.6, 250), ("image", b"\x89PNG")]

"""Files of one document each: bad ones are rows, and a job's files appear at once or not at all."""

import json
import os
import sys
import types

import pytest
from pyspark.sql import functions as F

from quillmask.sources import files, layout


def page(n):
    return {"page": n, "width": 595, "height": 842.0, "blocks": [{"text": f"text {n}", "bbox": [1, 2, 3, 4.5], "font": "Body", "size": 11, "color": 0}], "images": [{"bbox": [0, 0, 9, 9], "width": 3, "height": 3}]}


def test_one_bad_file_is_one_row(spark, tmp_path):
    for i in range(100):
        (tmp_path / f"{i:03d}.json").write_text(json.dumps([page(1), page(2)]) if i != 41 else '[{"page": 1, "blo')
    (tmp_path / "note.txt").write_text("not a layout")
    good, bad = files.read_pages(spark, str(tmp_path), partition_bytes=4000)
    assert good.select("doc_id").distinct().count() == 99 and good.count() == 198
    (row,) = bad.collect()
    assert row["path"].endswith("041.json") and row["error"].startswith("JSONDecodeError")
    assert good.rdd.getNumPartitions() > 5
    first = good.filter("page = 2").select("width", "blocks", "images").first()
    assert first["width"] == 595.0 and first["blocks"][0]["bbox"] == [1.0, 2.0, 3.0, 4.5] and first["images"][0]["width"] == 3
    assert layout.blocks_of(good).count() == 198


def test_odd_files(spark, tmp_path):
    for name, text in (("a", "{}"), ("b", "[]"), ("c", "[1]"), ("d", ""), ("e", "[{}]"), ("f", json.dumps([page(1), 7])), ("g", '[{"page_no": 3, "blocks": [{"text": "x", "bbox": "no"}]}]')):
        (tmp_path / f"{name}.json").write_text(text)
    good, bad = files.read_pages(spark, str(tmp_path))
    assert sorted(os.path.basename(r["path"])[0] for r in bad.collect()) == ["a", "c", "d", "f"]  # of f no page counts
    assert sorted(r["page"] for r in good.collect()) == [0, 3]
    empty = tmp_path / "none"
    empty.mkdir()
    assert [d.count() for d in files.read_pages(spark, str(empty))] == [0, 0]


def test_partitions_go_by_bytes_and_large_pdfs_by_pages():
    got = files.planned([("b.json", 60), ("a.json", 50), ("c.pdf", 250), ("d.json", 500), ("e.json", 10)], 100)
    assert got == [files.Files(("a.json",)), *(files.Files(("c.pdf",), k, 3) for k in range(3)), files.Files(("b.json",)), files.Files(("d.json",)), files.Files(("e.json",))]
    assert files.planned([], 100) == []


def test_parts_of_a_pdf_are_its_pages(monkeypatch):
    span = {"text": "x", "bbox": (1, 2, 3, 4), "font": "F", "size": 9.999, "color": 7}
    parts = [{"type": 0, "lines": [{"spans": [span]}]}, {"type": 1, "bbox": (0, 0, 5, 5), "width": 2, "height": 2}]
    one = types.SimpleNamespace(get_text=lambda kind: {"blocks": parts}, rect=types.SimpleNamespace(width=595.0, height=842.0))

    class Pdf(list):
        def __enter__(self):
            return self

        def __exit__(self, *_):
            return None

    fitz = types.ModuleType("fitz")
    fitz.open = lambda stream, filetype: Pdf([one] * 7)
    monkeypatch.setitem(sys.modules, "fitz", fitz)
    got = [[p for p, *_ in files.pages_of("a.PDF", b"", k, 3)] for k in range(3)]
    assert got == [[1, 2], [3, 4], [5, 6, 7]]
    assert next(files.pages_of("a.pdf", b"", 0, 9), None) is None  # a part may be empty
    assert next(files.pages_of("a.pdf", b"", 0, 1)) == (1, 595.0, 842.0, [("x", [1, 2, 3, 4], "F", 10.0, 7, None)], [([0, 0, 5, 5], 2, 2)])


def written(folder):
    return {n: open(os.path.join(at, n), "rb").read() for at, _, names in os.walk(folder) for n in names if not n.endswith(".crc")}


def test_a_job_appears_at_once_or_not_at_all(spark, tmp_path):
    out = str(tmp_path / "out")
    rows = spark.range(0, 40, 1, 5).select(F.concat(F.lit("doc"), "id", F.lit(".json")).alias("name"), F.concat(F.lit("é"), "id").alias("content"))
    files.write_documents(rows, out)
    assert written(out) == {f"doc{i}.json": f"é{i}".encode() for i in range(40)}
    broken = rows.withColumn("content", F.when(F.col("name") == "doc39.json", F.raise_error(F.lit("broken")).cast("string")).otherwise(F.col("content")))
    for wrong in (broken, rows.withColumn("name", F.lit("same")), rows.withColumn("name", F.lit("../x")), rows.withColumn("content", F.lit(None).cast("string"))):
        with pytest.raises(Exception):
            files.write_documents(wrong, out)
    assert len(written(out)) == 40 and all(n.startswith("job-") for n in os.listdir(out))
    more = spark.createDataFrame([("new.bin", b"\x00\xff")], "name string, content binary")
    files.write_documents(more, out)
    assert len(written(out)) == 41 and len(os.listdir(out)) == 2
    files.write_documents(more, out, "overwrite")
    assert written(out) == {"new.bin": b"\x00\xff"}
    files.write_documents(more.limit(0), out)
    assert written(out) == {"new.bin": b"\x00\xff"}

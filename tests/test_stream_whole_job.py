"""A stream of pages gives what one batch gives: pages out of order, repeated, late, and after a restart."""

import json

import pytest
from pyspark.sql import functions as F

from quillmask.streaming import whole_job as w

RUN_KEY = "a fixed key"


def page_rows(doc, pages):
    """Two text lines a page; a phone and an e-mail that other pages of the document have too."""
    out = []
    for p in pages:
        texts = [f"Telefon: +90 532 111 22 {10 + doc}", f"mail a{doc}.{p}@x.com und +90 555 000 11 {20 + p}"]
        blocks = [{"text": t, "bbox": [50.0, 100.0 + 40 * i, 400.0, 112.0 + 40 * i], "font": "Body", "size": 11.0, "color": 0, "confidence": None} for i, t in enumerate(texts)]
        out.append({"doc_id": doc, "page": p, "pages": max(pages), "width": 595.0, "height": 842.0, "blocks": blocks, "images": []})
    return out


ALL = [r for d in range(1, 7) for r in page_rows(d, (1, 2, 3))]


def put(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps(r) for r in rows))


def stream(spark, folder, out, **more):
    pages = spark.readStream.schema(w.PAGE).option("maxFilesPerTrigger", 1).json(str(folder))
    query = w.run_stream(pages, str(out / "results"), str(out / "checkpoint"), RUN_KEY, **more)
    query.awaitTermination(200)
    assert not query.isActive


def shown(df):
    return sorted(json.dumps(r.asDict(True), sort_keys=True, ensure_ascii=False) for r in df.collect())


def test_a_stream_gives_what_a_batch_gives_also_after_a_restart(spark, tmp_path):
    source = tmp_path / "pages"
    odd = [{"doc_id": None, "page": 1, "pages": 1}, {"doc_id": 9, "page": 4, "pages": 3}, {"doc_id": 9, "page": None, "pages": 1}]
    put(source, "a.json", ALL[::2] + odd)  # halves of documents
    stream(spark, source, tmp_path)
    assert spark.read.parquet(str(tmp_path / "results" / "documents")).count() == 0
    put(source, "b.json", ALL[1::2] + ALL[:4])  # the other halves, and some again
    stream(spark, source, tmp_path)
    put(source, "c.json", ALL[3:9])  # delivered again after their documents were given on
    stream(spark, source, tmp_path)
    documents = w.read_results(spark, str(tmp_path / "results"), "documents")
    assert sorted(map(tuple, documents.collect())) == [(d, 3, True) for d in range(1, 7)]
    batch = spark.createDataFrame(ALL, w.PAGE)
    wanted = w.results(batch.drop("pages").withColumn("complete", F.lit(True)), RUN_KEY)
    for name in w.RESULTS:
        got = shown(w.read_results(spark, str(tmp_path / "results"), name))
        assert got == shown(wanted[name]) and len(got) >= 36


def test_an_unfinished_document_goes_on_when_its_time_is_over(spark, tmp_path):
    source = tmp_path / "pages"
    for name, rows in (("a.json", page_rows(1, (1, 3)) + page_rows(2, (1,))), ("b.json", page_rows(3, (1, 2))), ("c.json", page_rows(1, (2,)) + page_rows(4, (1,)))):
        put(source, name, rows)  # the last brings a page too late for the first document
        with w.configured(spark, True):
            pages = w.finished(spark.readStream.schema(w.PAGE).json(str(source)), wait_minutes=0)
            query = pages.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start(str(tmp_path / "out"))
        query.awaitTermination(100)
        assert not query.isActive
    rows = spark.read.parquet(str(tmp_path / "out")).groupBy("doc_id", "complete").agg(F.sort_array(F.collect_list("page")).alias("pages")).collect()
    assert sorted((r["doc_id"], r["complete"], r["pages"]) for r in rows) == [(1, False, [1, 3]), (2, True, [1]), (3, True, [1, 2]), (4, True, [1])]


def test_a_log_gives_a_text_one_value_over_the_stream(spark, tmp_path):
    source = tmp_path / "pages"
    for i, d in enumerate((1, 2)):
        put(source, f"{i}.json", page_rows(d, (1, 2)))
    with pytest.raises(ValueError):
        stream(spark, source, tmp_path, scope="run")
    stream(spark, source, tmp_path, scope="run", log_path=str(tmp_path / "log"))
    rows = w.read_results(spark, str(tmp_path / "results"), "map").filter("fake_text is not null")
    assert rows.groupBy("original_text").agg(F.count_distinct("fake_text").alias("n")).filter("n > 1").count() == 0
    assert rows.groupBy("original_text").agg(F.count_distinct("doc_id").alias("n")).filter("n > 1").count() > 0

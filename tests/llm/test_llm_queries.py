import collections
import os

import duckdb
import pytest

from quillmask.llm import queries as q

from ..compare import SMALL, assert_same
from .test_small import WORDS, components_by_hand

pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")


def test_names():
    assert [n.split("_")[0] for n in q.QUERIES] == [f"op{i}" for i in range(1, 14)]
    assert set(q.SQL) <= set(q.QUERIES)


@pytest.mark.parametrize("name", sorted(q.SQL))
def test_against_sql(spark, name):
    assert_same(spark, q.QUERIES[name], q.SQL[name])


def test_pipeline(spark):
    import corpus_pipeline as p

    docs = duckdb.sql(f"SELECT * FROM '{SMALL}/documents.parquet'").fetchall()
    out = p.run(spark, SMALL).collect()
    ids = [r["doc_id"] for r in out]
    assert len(set(ids)) == len(ids) and 0 < len(ids) < len(docs)
    assert sorted(r["mix_rank"] for r in out) == list(range(len(out)))
    text = {d[0]: d[1] for d in docs}
    kept = sorted(ids)
    assert all(WORDS(text[i]) for i in kept)
    assert [c for _, c in components_by_hand([text[i] for i in kept], 80)] == list(range(len(kept)))


def test_mix_order_reaches_the_last_stage(spark, tmp_path):
    import corpus_pipeline as p
    from quillmask.llm import mixing

    read = spark.read.parquet(f"{SMALL}/documents.parquet")
    placed = p.source_mix(spark, read, SMALL)
    assert placed.columns == read.columns
    placed.write.parquet(str(tmp_path / "mix"))
    got = p.byte_bpe(spark, spark.read.parquet(str(tmp_path / "mix")), SMALL)
    ranks = [r["doc_id"] for r in got.orderBy("mix_rank").collect()]
    wanted = mixing.mixed(read, p.MIX_BLOCK_ROWS, exponent=p.MIX_EXPONENT).orderBy("mix_position").collect()
    assert ranks == [r["doc_id"] for r in wanted]
    alone = spark.createDataFrame([(1, "a b", "en", "s", 3)], read.schema)
    assert p.byte_bpe(spark, alone, SMALL).first()["mix_rank"] is None


def test_pipeline_on_odd_rows(spark, tmp_path):
    import corpus_pipeline as p

    prose = "the quick brown fox jumps over a lazy dog while seven more words follow here {} and there {}"
    rows = [(i, prose.format(f"w{i}", f"v{i}x"), "en", "s", 1) for i in range(40)] + [(None, prose.format("null", "id"), None, None, None), (50, None, "en", "s", 0), (51, "", "en", None, 0), (52, " \n ", "en", "s", 3), (53, "$ # $ # $", "en", "s", 9), (7, prose.format("w7", "v7x"), "en", "s", 1), (54, "long words " * 60_000, "en", "t", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs.write.parquet(str(tmp_path / "some/documents.parquet"))
    labels.write.parquet(str(tmp_path / "some/labels.parquet"))
    out = p.run(spark, str(tmp_path / "some")).collect()
    assert collections.Counter(r["doc_id"] for r in out) == collections.Counter([*range(40), None, 7])
    assert sorted(r["mix_rank"] for r in out) == list(range(42))
    docs.limit(0).write.parquet(str(tmp_path / "none/documents.parquet"))
    labels.write.parquet(str(tmp_path / "none/labels.parquet"))
    assert p.run(spark, str(tmp_path / "none")).count() == 0

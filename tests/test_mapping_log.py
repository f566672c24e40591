"""Values kept from run to run: first write wins, whoever writes, and however often."""

import pytest
from pyspark.sql import functions as F

from quillmask.operators import dedup
from quillmask.sources.mapping_log import Conflict, MappingLog

from .test_operators import detections


def found(spark, docs):
    rows = [(d, kind, text, (0.0, float(i), 5.0, i + 1.0), 0.9) for d in docs for i, (kind, text) in enumerate([("PHONE", "+90 532 111 22 33"), ("PHONE", f"+90 532 111 22 {10 + d}"), ("EMAIL", f"a{d % 3}@x.com"), ("LOCATION", "Ankara")])]
    return detections(spark, rows)


def values(df):
    out = {}
    for r in df.collect():
        out.setdefault((r["doc_id"], r["original_text"]), set()).add(r["fake_text"])
    return out


@pytest.mark.parametrize("scope", ["doc", "run"])
def test_two_runs_and_a_retried_one_give_each_text_one_value(spark, tmp_path, scope):
    log = MappingLog(spark, str(tmp_path / "log"))
    run = lambda docs, key: values(log.replacements(found(spark, docs), dedup.order_key(), key, scope))
    first = run(range(6), "key one")
    again = run(range(6), "another key")  # the same documents under another salt
    assert again == first and log.versions() == [1]
    more = run(range(3, 9), "a third key")  # some known, some new
    apart = run(range(20, 23), "a fourth key")
    texts = {}
    for part in (first, more, apart):
        assert all(len(v) == 1 for v in part.values())
        for (d, text), v in part.items():
            texts.setdefault(text if scope == "run" else (d, text), set()).update(v)
    assert all(len(v) == 1 for v in texts.values())
    common = {next(iter(v)) for (_, t), v in {**first, **more, **apart}.items() if t == "+90 532 111 22 33"}
    assert len(common) == 1 if scope == "run" else len(common) > 1
    before = {(r["scope"], r["original_text"]): r["fake_text"] for r in log.read().collect()}
    assert len(before) == log.read().count() and None not in before.values()
    assert log.compact() == 4 and len(log.commits()[1]) == 1
    assert {(r["scope"], r["original_text"]): r["fake_text"] for r in log.read().collect()} == before
    assert run(range(9), "a fifth key") == {**first, **more}


def entries(spark, rows):
    return spark.createDataFrame(rows, "scope string, original_text string, type string, fake_text string")


def test_the_second_writer_takes_the_first_ones_values(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "log")
    log, other = MappingLog(spark, path), MappingLog(spark, path)
    commit = log._commit

    def late(version, commits):
        if other.versions() == []:
            other.add(entries(spark, [("", "a", "T", "other"), ("", "b", "T", "other")]))
        return commit(version, commits)

    monkeypatch.setattr(log, "_commit", late)
    assert log.add(entries(spark, [("", "a", "T", "mine"), ("", "c", "T", "mine"), ("", "c", "T", "less"), ("1", "a", "T", "mine"), ("", "d", "T", None)])) == 2
    assert {(r["scope"], r["original_text"], r["fake_text"]) for r in log.read().collect()} == {("", "a", "other"), ("", "b", "other"), ("", "c", "less"), ("1", "a", "mine")}
    with pytest.raises(Conflict):
        commit(2, [])
    assert log.add(entries(spark, [("", "a", "T", "x")])) == 2 and log.add(entries(spark, [])) == 2
    log.add(entries(spark, [("", "e", "T", "x")]))
    log.compact()
    log.expire(3600)
    assert log.versions() == [1, 2, 3, 4]  # too young
    log.expire(0)
    assert log.versions() == [4] and log.read().count() == 5
    assert len([x for x in (tmp_path / "log/data").iterdir() if x.is_dir()]) == 1
    assert other.read(entries(spark, [("", "a", "", "")]).select("scope", "original_text")).filter("original_text = 'a' and scope = ''").count() == 1


def test_an_empty_log(spark, tmp_path):
    log = MappingLog(spark, str(tmp_path / "none"))
    assert log.read().count() == 0 and log.versions() == [] and log.compact() == 0
    log.expire(0)
    assert log.known(found(spark, [1]), "doc").columns == ["doc_id", "original_text", "fake_text"]
    assert log.replacements(found(spark, [1]).limit(0), dedup.order_key(), "k").count() == 0 and log.versions() == []

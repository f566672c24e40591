"""Near-duplicates: what is shuffled and kept for lists is no more than they need."""

from pyspark.sql import functions as F

from quillmask.llm import neardup, store


def documents(spark, n):
    words = F.transform(F.sequence(F.lit(0), F.lit(40)), lambda i: F.concat(F.lit("w"), F.pmod(F.xxhash64("id", i), F.lit(5000)).cast("string")))
    return spark.range(n).select(F.col("id").alias("doc_id"), F.array_join(words, " ").alias("text"))


def test_lists_are_shuffled_without_what_their_windows_compute(spark):
    s = neardup.Settings()
    classes = neardup.sketched(documents(spark, 50), s, "doc_id", "text").select("doc", "n", "sketch")
    values = neardup.listed(classes, s, neardup.frequencies(classes))
    plan = neardup.with_members(values)._jdf.queryExecution().executedPlan()
    shuffles = [line for line in plan.toString().splitlines() if "Exchange hashpartitioning" in line]
    assert len(shuffles) == 1 and "REPARTITION_BY_COL" in shuffles[0] and len(values.columns) == 4
    rows = neardup.unpacked(values).collect()
    assert {r["n"] for r in rows} == {37} and {r["place"] for r in rows} == set(range(37 - -(-85 * 37 // 100) + 1)) and all(r["score"] >= 600 for r in rows)


def test_sketches_go_before_sets_are_compared(spark, monkeypatch):
    gone = []
    drop = store.Tables.drop
    monkeypatch.setattr(store.Tables, "drop", lambda self, *tables: (gone.append([t.columns for t in tables]), drop(self, *tables))[1])
    text = " ".join(f"w{i}" for i in range(60))
    docs = documents(spark, 30).union(spark.createDataFrame([(90, text), (91, text), (92, text + " x")], "doc_id long, text string"))
    found = {r["doc"]: r["component_id"] for r in neardup.clustered(docs).collect()}
    assert found[91] == found[92] == 90 and sum(k == v for k, v in found.items()) == 31
    assert any("sketch" in c for c in gone[0])

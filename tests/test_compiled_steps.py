"""The form queries' steps run as compiled code, and lines, boxes and hits are those of the general expressions."""

import os
import random
import re

import pytest
from pyspark.sql import functions as F

from quillmask import queries as q
from quillmask.functions import columns as c
from quillmask.operators import dedup, fields, lines, rules

from .compare import SMALL

#: Methods with more bytes aren't compiled by the JVM.
HUGE = 8000


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
@pytest.mark.parametrize("name", ["q_unsupported_types", "q_min_confidence", "q_summary"])
def test_generated_methods_are_compiled(spark, name):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = q.QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan()
        code = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$").codegenString(plan)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", code)]
    assert sizes and max(sizes) <= HUGE
    # generators that aren't compiled evaluate all of their expressions one by one: only images' is left
    plain = [line for line in plan.toString().splitlines() if re.match(r"[\s:+-]*Generate ", line)]
    assert len(plain) <= 1, plain


def test_hits_are_the_patterns_matches(spark):
    rnd = random.Random(11)
    parts = ["Name: Ali Veli", "Company: Ege Ltd", "a.b@c.com", "@", " ", "+90 532 123 45 67", "5321234567", "Signature", "signed by", "TR12 1234 1234 1234 1234 1234 12", "Student ID: 20123", "index-A123", "é", rules.OPEN, rules.INNER, rules.CLOSE, "12345678901", ", "]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 9))) for _ in range(1500)] + ["x" * 300 + " a@b.co " + "c@d.com", "a@b.co " * 3, "", rules.OPEN]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").selectExpr("doc_id", "1 AS page", "0 AS line_no", "array(1) AS segments", "text")
    got = rules.hit_spans(rules.marked_lines(df, fields.ALL_RULES), fields.ALL_RULES)
    found = sorted((r["doc_id"], r["rule_no"], r["match_no"], r["raw"], r["start"], r["end"]) for r in got.collect())
    plain = F.translate("text", rules.OPEN + rules.INNER + rules.CLOSE, "\ufffd" * 3)
    wanted = []
    for no, rule in enumerate(fields.ALL_RULES):
        rows = df.filter(F.col("text").rlike(rule.prefilter or rule.pattern)).select("doc_id", F.posexplode(rules.matches(plain, rule.pattern, rule.group)).alias("n", "m")).collect()
        wanted += [(r["doc_id"], no, r["n"], *r["m"]) for r in rows]
    assert len(wanted) > 2000 and any(w[2] > 0 for w in wanted)
    assert found == sorted(wanted)


def test_one_segment_is_as_several(spark):
    kind = "array<struct<text:string,box:struct<x0:double,y0:double,x1:double,y1:double>,font:string,size:double,color:int,start:int,end:int>>"
    spans = [(s, e) for s in range(-1, 8) for e in range(-1, 8)]
    rows = [([("abcde"[:n], (1.0, 2.0, 8.7, 4.0), "f", 9.0, 3, 0, n)], s, e) for n in (0, 1, 5) for s, e in spans]
    df = spark.createDataFrame(rows, f"segments {kind}, s int, e int")
    # another segment that no span reaches makes the general expressions run
    far = F.concat("segments", F.transform("segments", lambda x: F.struct(*(x[k].alias(k) for k in ("text", "box", "font", "size", "color")), F.lit(90).alias("start"), F.lit(95).alias("end"))))
    for of in (lines.span_box, lines.span_style):
        one, several = (of(x, F.col("s"), F.col("e")) for x in (F.col("segments"), far))
        assert df.filter(~one.eqNullSafe(several)).count() == 0
        assert df.filter(one.isNotNull()).count() > 20
    with_null = F.when(F.col("s") > 0, c.box(F.lit(0.125), F.lit(1), F.lit(2.675), F.lit(None)))
    assert {tuple(r[0]) if r[0] else None for r in df.select(c.rounded_box(with_null)).collect()} == {None, (0.12, 1.0, 2.67, None)}


def test_a_group_of_one_stays(spark):
    rows = [(d, 1, t, "x", (0.0, 0.0, 1.0, 1.0), 0.5) for d in (1, 2) for t in ("A", "B")] + [(2, 1, "A", "X:", (5.0, 5.0, 6.0, 6.0), 0.4)]
    found = spark.createDataFrame(rows, "doc_id int, page int, type string, original_text string, box struct<x0:double,y0:double,x1:double,y1:double>, confidence double")
    null = lambda kind: F.lit(None).cast(kind)
    found = found.select("*", F.lit("m").alias("method"), F.lit("r").alias("rule"), null("string").alias("font"), null("double").alias("size"), null("int").alias("color"), null(dedup.BOX).alias("label_box"), F.struct(F.lit(0).alias("phase"), F.lit(0).alias("line_no"), F.lit(0).alias("rule_no"), F.lit(0).alias("match_no")).alias("ord"))
    kept = dedup.deduplicate(found)
    assert sorted((r["doc_id"], r["type"], r["original_text"]) for r in kept.collect()) == [(1, "A", "x"), (1, "B", "x"), (2, "A", "x"), (2, "B", "x")]

"""Long lines and crowded pages: the quicker ways give what the plain ones give."""

import random
import time

import numpy as np
from pyspark.sql import functions as F

from quillmask.functions import columns as c
from quillmask.functions.emails import email_matches
from quillmask.operators import dedup, lines, rules

from .test_operators import block_rows, detections, lines_by_hand, random_blocks


def test_emails_are_the_patterns_matches(spark):
    rnd = random.Random(3)
    pools = ("ab.@", "a1.-_@%+", "ab@.com x", "aş.é@-_ ́", "x@y.zz,;@@..", "A.b@C-d.eF9_@")
    texts = ["".join(rnd.choice(p) for _ in range(rnd.randint(0, 24))) for p in pools for _ in range(2500)]
    texts += ["", "@", "a@b.co@d.com@e.org", "şabc@x.com", "ş.abc@x.com", "a@b.coş", "a@b.co1.net", "..a@b.co", "x a.b@c.d.ef-g.hij, q@r.st_"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select("t", email_matches(F.col("t")).alias("got"), rules.matches(F.col("t"), rules.EMAIL, 0).alias("wanted")).collect()
    assert sum(len(r["wanted"]) for r in rows) > 300
    for r in rows:
        assert r["got"] == r["wanted"], repr(r["t"])


def seconds(df):
    """Of a second run, when code is compiled."""
    df.write.format("noop").mode("overwrite").save()
    began = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began


def test_a_line_of_a_megabyte(spark):
    texts = ["a." * 500_000 + " @", "a." * 500_000 + "@b", "x@" + "a." * 500_000, "a@b.com " * 125_000, "@" * 1_000_000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert {r["i"]: r["n"] for r in df.select("i", F.size(email_matches(F.col("t"))).alias("n")).collect()} == {0: 0, 1: 0, 2: 0, 3: 125_000, 4: 0}
    for i in range(3):
        one = df.filter(F.col("i") == i).select(F.size(email_matches(F.col("t"))).alias("n"))
        assert seconds(one) < 2


def test_strip_space_is_what_the_pattern_strips(spark):
    rnd = random.Random(4)
    texts = ["".join(rnd.choice(c.WHITE + "ab\x1c​᠎") for _ in range(rnd.randint(0, 9))) for _ in range(2000)] + ["x" + " " * 200_000 + "y"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert c.WHITE == "".join(r[0] for r in spark.range(0x10000).filter("id < 55296 or id >= 57344").select(F.expr("decode(unhex(lpad(hex(id), 4, '0')), 'UTF-16BE')").alias("x"), "id").filter(F.col("x").rlike(r"(?U)^\s\z")).orderBy("id").collect())
    short = df.filter(F.length("t") < 10)
    assert short.filter(~c.strip_space(F.col("t")).eqNullSafe(F.regexp_replace("t", r"(?U)^\s+|\s+$", ""))).count() == 0
    assert seconds(df.select(c.strip_space(F.col("t")).alias("x"))) < 5


def test_islands_against_a_plain_fold(spark):
    rnd = random.Random(7)
    docs = {d: random_blocks(d, 60) for d in range(4)}
    for d in range(10, 16):  # centres just within and just beyond the tolerance, chains of them, equal ones
        y, blocks = 0.0, []
        for i in range(120):
            y += rnd.choice([0.0, 0.1, 2.0, 3.9, 4.0, 4.0, 4.0000001, 4.0005, 4.002, 9.0])
            blocks.append((i, f"w{i}", rnd.uniform(0, 50), y, 60.0, y + rnd.choice([0.0, 0.2, 8.0])))
        rnd.shuffle(blocks)
        docs[d] = blocks
    got = lines.group_lines(block_rows(spark, docs)).orderBy("doc_id", "line_no").collect()
    for d, blocks in docs.items():
        assert [r["text"] for r in got if r["doc_id"] == d] == lines_by_hand(blocks), d


def test_a_page_of_many_blocks(spark):
    wide = [(i, f"w{i}", float(i % 4) * 100, (i // 4) * 12.0, float(i % 4) * 100 + 50, (i // 4) * 12.0 + 8) for i in range(20_000)]
    dense = [(i, f"w{i}", float(i % 100), (i // 100) * 3.9, float(i % 100) + 1, (i // 100) * 3.9 + 8) for i in range(20_000)]
    pages = lines.group_lines(block_rows(spark, {1: wide, 2: dense}))
    assert pages.filter("doc_id = 1").count() == 5000
    for d, limit in ((1, 20), (2, 60)):
        assert seconds(pages.filter(F.col("doc_id") == d)) < limit


def greedy(rows, by_text=True):
    kept, texts, at = set(), set(), np.empty((len(rows), 4))
    for i, r in sorted(enumerate(rows), key=lambda p: (-p[1][4], p[0])):
        a, b = np.array(r[3]), at[: len(kept)]
        both = np.prod(np.maximum(0, np.minimum(b[:, 2:], a[2:]) - np.maximum(b[:, :2], a[:2])), axis=1)
        union = np.prod(b[:, 2:] - b[:, :2], axis=1) + np.prod(a[2:] - a[:2]) - both
        if not (by_text and r[2] in texts) and not (both > 0.55 * union).any():
            at[len(kept)] = a
            kept.add(i)
            texts.add(r[2])
    return kept


def boxes(rnd, n, room, texts):
    out = []
    for _ in range(n):
        x, y, w, h = rnd.uniform(-room, room), rnd.uniform(0, room), rnd.choice([0.0, 0.3, 5.0, 8.0, 9.0, 31.9, 32.0, 200.0]), rnd.choice([0.0, 4.0, 7.0, 12.0, 64.0])
        near = out and rnd.random() < 0.4
        if near:
            x, y, x1, y1 = (v + rnd.uniform(-1.5, 1.5) for v in rnd.choice(out)[3])
            w, h = max(0.0, x1 - x), max(0.0, y1 - y)
        out.append((1, "A", f"t{rnd.randrange(texts)}", (x, y, x + w, y + h), rnd.choice([0.5, 0.7, 0.9])))
    return out


def test_crowds_against_a_plain_fold(spark):
    rnd = random.Random(8)
    for n, room, texts in ((300, 60, 200), (300, 15, 10_000), (120, 300, 5)):
        rows = boxes(rnd, n, room, texts)
        for by_text in (True, False):
            got = {r["ord"]["line_no"] for r in dedup.deduplicate(detections(spark, rows), by_text, crowded=0).collect()}
            assert got == greedy(rows, by_text)


def test_ten_thousand_boxes(spark):
    rows = boxes(random.Random(9), 10_000, 2000, 9000)
    df = dedup.deduplicate(detections(spark, rows))
    assert {r["ord"]["line_no"] for r in df.collect()} == greedy(rows)
    assert seconds(df) < 30
    same = [(1, "A", f"t{i}", (0.0, 0.0, 9.0, 9.0), 0.9) for i in range(10_000)]
    assert dedup.deduplicate(detections(spark, same)).count() == 1

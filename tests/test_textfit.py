"""Sizes that fit, against a plain word wrapper."""

import random

from pyspark.sql import functions as F

from quillmask.functions import textfit as t


def glyph(c):
    c = dict(zip(t.MARKED, t.PLAIN, strict=True)).get(c, c)
    return t.WIDTHS[ord(c) - 32] if 0 <= ord(c) - 32 < len(t.WIDTHS) else t.UNKNOWN


def wrapped(line, limit):
    """Lines of glyph widths, filled one after another."""
    out = [0]
    for word in line.split(" "):
        width = sum(map(glyph, word))
        if width > limit:
            if out[-1] > 0:
                out.append(0)
            for c in word:
                if out[-1] > 0 and out[-1] + glyph(c) > limit:
                    out.append(0)
                out[-1] += glyph(c)
        elif out[-1] == 0:
            out[-1] = width
        elif out[-1] + glyph(" ") + width <= limit:
            out[-1] += glyph(" ") + width
        else:
            out.append(width)
    return len(out)


def size_by_hand(text, width, height, sizes):
    for s in sizes:
        if sum(wrapped(line, width * 1000 / s) for line in (text or "").replace("\r\n", "\n").split("\n")) * s * t.LINE_HEIGHT <= height:
            return s
    return None


def test_widths():
    assert len(t.WIDTHS) == 95 and len(t.MARKED) == len(t.PLAIN)
    assert [glyph(c) for c in "iWış😀"] == [222, 944, 278, 500, t.UNKNOWN]


def test_first_size_that_fits(spark):
    rnd = random.Random(8)
    words = ["a", "Ayşe", "Yılmaz", "Elektrik", "W" * 30, "", "i", "+90 532", "x😀y", "ÇĞİ", "ve\nev", "end\r\n", "Anonim Şirketi"]
    rows = [(i, " ".join(rnd.choices(words, k=rnd.randint(0, 7))), rnd.uniform(5, 300), rnd.uniform(5, 60), rnd.choice([6.0, 11.0, 24.0])) for i in range(600)]
    rows += [(600, None, 50.0, 20.0, 11.0), (601, "x" * 20_000, 500.0, 40.0, 11.0), (602, "x", 0.0, 99.0, 11.0), (603, "x " * 5000, 595.0, 10_000.0, 11.0)]
    df = spark.createDataFrame(rows, "id int, text string, width double, height double, size double")
    sizes = F.array(*(F.col("size") * k for k in (1.0, 0.8, 0.6)))
    got = dict(df.select("id", t.fitting_size(F.col("text"), F.col("width"), F.col("height"), sizes)).collect())
    wanted = {i: size_by_hand(text, w, h, [s * k for k in (1.0, 0.8, 0.6)]) for i, text, w, h, s in rows}
    assert got == wanted
    assert len({wanted[i] is None for i in range(600)}) == 2 and len({v for v in wanted.values()}) > 6
    odd = spark.createDataFrame([(1, "x", None, 9.0, 11.0), (2, "x", 9.0, 9.0, None), (3, "x", 9.0, 90.0, 0.0)], df.schema)
    assert [r[0] for r in odd.select(t.fitting_size(F.col("text"), F.col("width"), F.col("height"), F.array("size"))).collect()] == [None] * 3

"""How much room a text takes in a box: widths of glyphs, words wrapped by a fold, the first of some sizes that fits.

Widths are those of the standard sans-serif PDF font in thousandths of its size; letters with marks are as wide as without them, and
what is unknown is as wide as a digit. Lines break at spaces; a word wider than the box is broken where it reaches the
edge. Line ends in the text begin a line. A null text is an empty one, and an empty line takes a line's height.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import let

# Advance widths of the characters from space to tilde, in the order of their codes.
WIDTHS = (
    278, 278, 355, 556, 556, 889, 667, 191, 333, 333, 389, 584, 278, 333, 278, 278,
    556, 556, 556, 556, 556, 556, 556, 556, 556, 556, 278, 278, 584, 584, 584, 556,
    1015, 667, 667, 722, 722, 667, 611, 778, 722, 278, 500, 667, 556, 833, 722, 778,
    667, 778, 722, 667, 611, 722, 667, 944, 667, 667, 611, 278, 278, 278, 469, 556,
    333, 556, 556, 500, 556, 556, 278, 556, 556, 222, 222, 500, 222, 833, 556, 556,
    556, 556, 333, 500, 278, 556, 500, 722, 500, 500, 500, 334, 260, 334, 584,
)
UNKNOWN = 556
# Letters with marks and those that they are as wide as; a dotless i is as wide as a capital one.
MARKED = "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏİÑÒÓÔÕÖŞĞÙÚÛÜÝàáâãäåçèéêëìíîïıñòóôõöşğùúûüýÿ"
PLAIN = "AAAAAACEEEEIIIIINOOOOOSGUUUUYaaaaaaceeeeIIIIInooooosguuuuyy"
#: Height of a line as a share of the size: ascender and descender of the font.
LINE_HEIGHT = 1.374


def glyph_widths(text: Column) -> Column:
    """The width of each character."""
    table = F.array(*map(F.lit, WIDTHS))
    letters = F.split(F.translate(text, MARKED, PLAIN), "")
    width = lambda c: F.coalesce(F.get(table, F.ascii(c) - 32), F.lit(UNKNOWN))
    return F.transform(F.filter(letters, lambda c: c != ""), width)


def measured(text: Column) -> Column:
    """A text's lines, each an array of its words, each with its width and those of its glyphs."""
    word = lambda w: let(glyph_widths(w), lambda g: F.struct(F.aggregate(g, F.lit(0), lambda a, x: a + x).alias("width"), g.alias("glyphs")))
    return F.transform(F.split(F.coalesce(text, F.lit("")), "\r?\n"), lambda line: F.transform(F.split(line, " "), word))


def _at(lines: Column, used: Column) -> Column:
    return F.struct(lines.cast("int").alias("lines"), used.cast("int").alias("used"))


def wrapped_lines(words: Column, limit: Column) -> Column:
    """Lines that a line's words take within `limit` thousandths of the size."""

    def broken(at: Column, glyphs: Column) -> Column:
        fresh = _at(at["lines"] + (at["used"] > 0).cast("int"), F.lit(0))
        return F.aggregate(glyphs, fresh, lambda s, g: F.when((s["used"] > 0) & (s["used"] + g > limit), _at(s["lines"] + 1, g)).otherwise(_at(s["lines"], s["used"] + g)))

    def step(at: Column, word: Column) -> Column:
        onward = at["used"] + WIDTHS[0] + word["width"]
        return (
            F.when(word["width"] > limit, broken(at, word["glyphs"]))
            .when(at["used"] == 0, _at(at["lines"], word["width"]))
            .when(onward <= limit, _at(at["lines"], onward))
            .otherwise(_at(at["lines"] + 1, word["width"]))
        )

    return F.aggregate(words, _at(F.lit(1), F.lit(0)), step, lambda s: s["lines"])


def lines_at(lines: Column, width: Column, size: Column) -> Column:
    """Lines that a text of measured() takes in a box of a width."""
    return F.aggregate(lines, F.lit(0), lambda n, words: n + wrapped_lines(words, width * 1000 / size))


def fitting_size(text: Column, width: Column, height: Column, sizes: Column) -> Column:
    """The first of the sizes at which the text fits into the box; null where none does, or nothing is known of the box or sizes."""
    fits = lambda lines, s: (s > 0) & (lines_at(lines, width, s) * s * LINE_HEIGHT <= height)
    return let(measured(text), lambda lines: F.get(F.filter(sizes, lambda s: fits(lines, s)), F.lit(0)))

"""Column functions: text cleaning, exact rounding, boxes, digits. All are built-in expressions; patterns carry (?U), so
that classes are Unicode's."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters stripped from both ends of an entity.
STRIPPED = " \t\n\r:;-–—,."


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once. An aggregate over nothing doesn't copy what body gives, as transform() does with its elements."""
    return F.aggregate(F.array().cast("array<int>"), value, lambda x, _: x, body)


def gathered(items: Column, carry: Column, step: Callable[[Column, Column], Column], hit: str, chunk: int = 128) -> Column:
    """All hits of a fold in order, as an array of `hit` (a type). step(carry, item): a struct of the next carry and an
    array of hits. Hits are put together by the chunk first, as appending one by one to a long array copies it each time."""
    none = F.array().cast(f"array<{hit}>")

    def of_chunk(state: Column, part: Column) -> Column:
        add = lambda s, x: let(step(s["carry"], x), lambda y: F.struct(y["carry"].alias("carry"), F.concat(s["found"], y["hits"]).alias("found")))
        return let(F.aggregate(part, F.struct(state["carry"].alias("carry"), none.alias("found")), add), lambda r: F.struct(r["carry"].alias("carry"), F.concat(state["found"], F.array(r["found"])).alias("found")))

    def all_of(whole: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(whole) - 1) / chunk).cast("int")), lambda i: F.slice(whole, i * chunk + 1, F.lit(chunk)))
        first = F.struct(carry.alias("carry"), F.array().cast(f"array<array<{hit}>>").alias("found"))
        return F.when(F.size(whole) > 0, F.flatten(F.aggregate(chunks, first, of_chunk)["found"])).otherwise(none)

    return let(items, all_of)


#: What (?U)\\s matches.
WHITE = "\t\n\x0b\f\r \x85\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip_space(x: Column) -> Column:
    """Without Unicode's white space at both ends. A pattern for the right end would try each run of white space inside from each of its characters."""
    return F.btrim(x, F.lit(WHITE))


def normalize_spaces(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))


def only_digits(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)\D", "")


def clean_entity(x: Column) -> Column:
    return normalize_spaces(F.btrim(x, F.lit(STRIPPED)))


def entity_key(x: Column) -> Column:
    """By this, two hits have the same text."""
    return F.lower(clean_entity(x))


#: Doubles from here on count as they did: as text.
WHOLE = 1e15


def exact_round(x: Column, places: int) -> Column:
    """Rounds the binary value half to even, which round() and bround() of a double don't. Whole numbers, as most boxes have, aren't put to text and back."""
    value = x.cast("double")
    return F.when((F.abs(value) < WHOLE) & (F.rint(value) == value), value).otherwise(F.call_function("format_number", value, F.lit("0." + "0" * places)).cast("double"))


# boxes: struct of x0, y0, x1, y1


def box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.struct(x0.cast("double").alias("x0"), y0.cast("double").alias("y0"), x1.cast("double").alias("x1"), y1.cast("double").alias("y1"))


def parsed_box(values: Column) -> Column:
    """A box from an array of four values that are numbers, else null."""

    def checked(numbers: Column) -> Column:
        whole = (F.size(numbers) == 4) & F.forall(numbers, lambda v: v.isNotNull())
        return F.when(whole, box(*(F.get(numbers, F.lit(i)) for i in range(4))))

    return let(F.transform(values, lambda v: v.try_cast("double")), checked)


def rounded_box(b: Column, places: int = 2) -> Column:
    return F.when(b.isNotNull(), box(*(exact_round(b[c], places) for c in ("x0", "y0", "x1", "y1"))))


def union_box(boxes: Column) -> Column:
    """The box around an array of boxes; null for an empty array."""

    def around(all_: Column) -> Column:
        pick = lambda c: F.transform(all_, lambda b: b[c])
        return F.when(F.size(all_) > 0, box(F.array_min(pick("x0")), F.array_min(pick("y0")), F.array_max(pick("x1")), F.array_max(pick("y1"))))

    return let(boxes, around)


def area(b: Column) -> Column:
    return F.greatest(F.lit(0.0), b["x1"] - b["x0"]) * F.greatest(F.lit(0.0), b["y1"] - b["y0"])


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 where the union is empty."""
    across = F.greatest(F.lit(0.0), F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]))
    down = F.greatest(F.lit(0.0), F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]))
    both = across * down
    return F.coalesce(F.try_divide(both, area(a) + area(b) - both), F.lit(0.0))


def sub_box(text: Column, b: Column, start: Column, end: Column) -> Column:
    """The part of a text's box that characters start to end take, in proportion; the whole box of an empty text."""
    n = F.length(text)
    low = F.greatest(F.lit(0), F.least(start, n))
    high = F.greatest(low, F.least(end, n))
    width = b["x1"] - b["x0"]
    part = box(b["x0"] + width * (low / n), b["y0"], b["x0"] + width * (high / n), b["y1"])
    return F.when(n > 0, part).otherwise(b)


# validators


def digit(digits: Column, i: int) -> Column:
    return F.substring(digits, i + 1, 1).cast("int")


def national_checks(nine: list[Column]) -> tuple[Column, Column]:
    """The tenth and eleventh digit that belong to the first nine."""
    tenth = F.pmod(7 * sum(nine[0:9:2], F.lit(0)) - sum(nine[1:8:2], F.lit(0)), F.lit(10))
    return tenth, F.pmod(sum(nine, F.lit(0)) + tenth, F.lit(10))


def valid_national_id(x: Column) -> Column:
    def check(d: Column) -> Column:
        tenth, eleventh = national_checks([digit(d, i) for i in range(9)])
        shape = d.rlike("^[1-9][0-9]{10}$") & (F.size(F.array_distinct(F.split(d, ""))) > 1)
        return F.when(shape, (digit(d, 9) == tenth) & (digit(d, 10) == eleventh)).otherwise(F.lit(False))

    return let(only_digits(x), check)


def valid_phone(x: Column) -> Column:
    local = F.regexp_replace(F.regexp_replace(only_digits(x), "^90", ""), "^0", "")
    return local.rlike("^[2-5][0-9]{9}$")


# colours and fonts


def rgb(color: Column) -> Column:
    """Red, green and blue of a packed colour, from 0 to 1."""
    part = lambda bits: F.shiftright(color, bits).bitwiseAND(F.lit(255)) / F.lit(255.0)
    return F.struct(part(16).alias("r"), part(8).alias("g"), part(0).alias("b"))


# The sizes tried for replacement text, as shares of the original size.
FONT_STEPS = (1.0, 0.9, 0.8, 0.7, 0.6)


def font_ladder(size: Column) -> Column:
    return F.array(*(size * F.lit(s) for s in FONT_STEPS))

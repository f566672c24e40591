"""Blocks of a page to visual lines, and spans of a line back to boxes and styles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import box, let, strip_space, sub_box, union_box

# Fixed value: points between a block's centre and its line's mean centre, at most.
TOLERANCE = 4.0
BLOCK = "struct<block_no:int,text:string,box:struct<x0:double,y0:double,x1:double,y1:double>,font:string,size:double,color:int>"


def usable_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks with some text and a box. Blocks: doc_id, page, block_no, text, box, font, size, color."""
    return blocks.filter((F.length(strip_space(F.col("text"))) > 0) & F.col("box").isNotNull())


#: Gap between neighbouring centres that parts a page, beyond the tolerance: what rounding may move a mean by, amply.
SLACK, RELATIVE_SLACK = 1e-3, 1e-9


def centre(b: Column) -> Column:
    return (b["box"]["y0"] + b["box"]["y1"]) / 2


def fold_clusters(items: Column, tolerance: float) -> Column:
    """Items (i, y, b) in order of i to clusters of struct(first, total, n, members). A block joins the first cluster whose mean
    centre is near, else it opens one. The mean moves with each block, so this is a fold and no window can stand for it."""
    kind = f"array<struct<first:int,total:double,n:int,members:array<{BLOCK}>>>"

    def add(found: Column, x: Column) -> Column:
        def placed(at: Column) -> Column:
            c = F.get(found, at - 1)
            joined = F.struct(c["first"].alias("first"), (c["total"] + x["y"]).alias("total"), (c["n"] + F.lit(1)).alias("n"), F.concat(c["members"], F.array(x["b"])).alias("members"))
            opened = F.struct(x["i"].alias("first"), x["y"].alias("total"), F.lit(1).alias("n"), F.array(x["b"]).alias("members"))
            return F.when(at > 0, F.concat(F.slice(found, F.lit(1), at - 1), F.array(joined), F.slice(found, at + 1, F.size(found)))).otherwise(F.concat(found, F.array(opened)))

        near = F.transform(found, lambda c: F.abs(x["y"] - c["total"] / c["n"]) <= tolerance)
        return let(F.array_position(near, F.lit(True)).cast("int"), placed)

    return F.aggregate(items, F.array().cast(kind), add)


def clusters(blocks: Column, tolerance: float) -> Column:
    """Sorted blocks to clusters, in order of their first blocks.

    Blocks are cut into islands first: between two neighbouring centres a < b of the page with b - a > tolerance. A
    cluster's mean lies between its least and its largest centre. So a cluster whose centres are all at a or below has a mean of a at
    most, which is more than the tolerance away from every centre at b or above, and the same holds the other way round:
    whatever the order, no block joins a cluster on the other side, and by induction no cluster has blocks of both sides.
    Nor does a cluster on the other side ever come first for a block. So each island folds alone, in the page's order, and the
    clusters are then put in order of their first blocks. SLACK makes up for rounding: a wider gap only means fewer cuts."""

    def islands(by_y: Column) -> Column:
        def gap(i: Column) -> Column:
            here, last = F.get(by_y, i)["y"], F.get(by_y, i - 1)["y"]
            return here - last > tolerance + SLACK + RELATIVE_SLACK * F.abs(here)

        starts = F.filter(F.sequence(F.lit(0), F.size(by_y) - 1), lambda i: (i == 0) | gap(i))
        in_order = lambda part: F.sort_array(F.transform(part, lambda x: F.struct(x["i"].alias("i"), x["y"].alias("y"), x["b"].alias("b"))))
        cut = lambda s: F.transform(s, lambda low, k: F.slice(by_y, low + 1, F.coalesce(F.get(s, k + 1), F.size(by_y)) - low))
        alone = lambda x: F.array(F.struct(x["i"].alias("first"), x["y"].alias("total"), F.lit(1).alias("n"), F.array(x["b"]).alias("members")))
        folded = F.flatten(F.transform(let(starts, cut), lambda part: F.when(F.size(part) == 1, alone(F.get(part, F.lit(0)))).otherwise(fold_clusters(in_order(part), tolerance))))
        return F.sort_array(folded)

    by_y = F.sort_array(F.transform(blocks, lambda b, i: F.struct(centre(b).alias("y"), i.alias("i"), b.alias("b"))))
    return let(by_y, islands)


def segments(members: Column) -> Column:
    """Blocks of a line, left to right, with the characters of the line's text that each takes. Most lines are of one block, which needs no
    higher-order function: those are interpreted."""
    ordered = F.transform(
        F.sort_array(F.transform(members, lambda b: F.struct(b["box"]["x0"].alias("x"), b["box"]["y0"].alias("y"), b["block_no"].alias("k"), b.alias("b")))),
        lambda s: s["b"],
    )
    kind = "struct<at:int,found:array<struct<text:string,box:struct<x0:double,y0:double,x1:double,y1:double>,font:string,size:double,color:int,start:int,end:int>>>"

    def add(state: Column, b: Column) -> Column:
        end = state["at"] + F.length(b["text"])
        one = F.struct(b["text"].alias("text"), b["box"].alias("box"), b["font"].alias("font"), b["size"].alias("size"), b["color"].alias("color"), state["at"].alias("start"), end.alias("end"))
        return F.struct((end + 1).alias("at"), F.concat(state["found"], F.array(one)).alias("found")).cast(kind)

    none = F.struct(F.lit(0).alias("at"), F.array().alias("found")).cast(kind)
    b = F.get(members, F.lit(0))
    alone = F.struct(*(b[c].alias(c) for c in ("text", "box", "font", "size", "color")), F.lit(0).alias("start"), F.length(b["text"]).alias("end"))
    return F.when(F.size(members) == 1, F.array(alone)).otherwise(F.aggregate(ordered, none, add, lambda s: s["found"]))


def group_lines(blocks: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """doc_id, page, line_no (in order of creation), text, segments, box. One page's blocks meet in one row."""
    packed = F.struct("block_no", "text", "box", "font", "size", "color").cast(BLOCK)
    pages = usable_blocks(blocks).groupBy("doc_id", "page").agg(F.collect_list(F.struct(F.col("box")["y0"].alias("y"), F.col("box")["x0"].alias("x"), F.col("block_no").alias("k"), packed.alias("b"))).alias("all"))
    found = pages.select("doc_id", "page", clusters(F.transform(F.sort_array("all"), lambda s: s["b"]), tolerance).alias("found"))
    rows = found.select("doc_id", "page", F.posexplode("found").alias("line_no", "line"))
    rows = rows.select("doc_id", "page", "line_no", segments(F.col("line")["members"]).alias("segments"))
    one, single = F.get("segments", F.lit(0)), F.size("segments") == 1
    text = F.when(single, one["text"]).otherwise(F.array_join(F.transform("segments", lambda s: s["text"]), " "))
    box_ = F.when(single, one["box"]).otherwise(union_box(F.transform("segments", lambda s: s["box"])))
    return rows.select("doc_id", "page", "line_no", text.alias("text"), "segments", box_.alias("box"))


def span_box(line_segments: Column, start: Column, end: Column) -> Column:
    """The box around what characters start to end take of the segments; null if they take nothing."""
    takes = lambda s: ~((end <= s["start"]) | (start >= s["end"]))
    part = lambda s: sub_box(s["text"], s["box"], F.greatest(start, s["start"]) - s["start"], F.least(end, s["end"]) - s["start"])
    one = F.get(line_segments, F.lit(0))
    return F.when(F.size(line_segments) == 1, F.when(takes(one), part(one))).otherwise(union_box(F.transform(F.filter(line_segments, takes), part)))


def span_style(line_segments: Column, start: Column, end: Column) -> Column:
    """Font, size and colour of the segment with most characters of the span, the first of several; null without any."""
    shared = F.transform(
        line_segments,
        lambda s, i: F.struct((F.greatest(start, s["start"]) - F.least(end, s["end"])).alias("less"), i.alias("i"), F.struct(s["font"].alias("font"), s["size"].alias("size"), s["color"].alias("color")).alias("style")),
    )
    best = F.get(F.array_sort(F.filter(shared, lambda x: x["less"] < 0)), F.lit(0))
    one = F.get(line_segments, F.lit(0))
    alone = F.when(F.greatest(start, one["start"]) < F.least(end, one["end"]), F.struct(one["font"].alias("font"), one["size"].alias("size"), one["color"].alias("color")))
    return F.when(F.size(line_segments) == 1, alone).otherwise(best["style"])


def single_lines(texts: DataFrame, key: str, text: str, per_page: int = 45) -> DataFrame:
    """Plain texts as lines: each line of a text is one block of a page of `per_page` lines."""
    rows = texts.select(F.col(key).alias("doc_id"), F.posexplode(F.split(F.col(text), "\n")).alias("i", "text")).filter(F.length(strip_space(F.col("text"))) > 0)
    y = 60 + 18 * (F.col("i") % per_page)
    b = box(F.lit(50), y, 50 + 6 * F.length("text"), y + 12)
    segment = F.struct(F.col("text"), b.alias("box"), F.lit("Body").alias("font"), F.lit(12.0).alias("size"), F.lit(0).alias("color"), F.lit(0).alias("start"), F.length("text").alias("end"))
    return rows.select("doc_id", (F.floor(F.col("i") / per_page) + 1).cast("int").alias("page"), (F.col("i") % per_page).alias("line_no"), "text", F.array(segment).alias("segments"), b.alias("box"))

"""Greedy removal of repeated detections, thresholds and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import entity_key, gathered, iou, let
from .rules import COLUMNS

# Fixed value: overlap beyond which two detections of a type are one.
OVERLAP = 0.55


def order_key(by_type: bool = True) -> Column:
    """Order of the result: top to bottom, left to right; then as the detections were kept."""
    return F.struct("page", F.col("box")["y0"].alias("y"), F.col("box")["x0"].alias("x"), F.col("type"), (-F.col("confidence")).alias("less"), "ord")


#: Detections of a page and type from which a grid takes the place of comparing each with all that are kept.
CROWDED = 48


def size_class(length: Column) -> Column:
    """k with 2^k <= length < 2^(k + 1)."""
    return F.floor(F.log2(length)).cast("int")


def cells(b: Column, kinds: Column, whole: bool, buckets: Column) -> Column:
    """Buckets of grid cells. A class of boxes (widths and heights within a power of two) has a grid with cells of twice that size.
    whole: the cells of the box in its own class's grid, four at most; else the cell of its centre in the grids of the nine
    classes that its width and height are within one of."""
    side = lambda k: F.pow(F.lit(2.0), k + 1)
    cell = lambda at, k: F.floor(at / side(k))
    number = lambda kx, ky, ix, iy: F.pmod(F.xxhash64(kx, ky, ix, iy), buckets).cast("int")
    kx, ky = kinds["x"], kinds["y"]
    if whole:
        corners = [number(kx, ky, cell(x, kx), cell(y, ky)) for x in (b["x0"], b["x1"]) for y in (b["y0"], b["y1"])]
    else:
        x, y = (b["x0"] + b["x1"]) / 2, (b["y0"] + b["y1"]) / 2
        corners = [number(kx + i, ky + j, cell(x, kx + i), cell(y, ky + j)) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    flat = (b["x1"] <= b["x0"]) | (b["y1"] <= b["y0"])  # overlaps with nothing
    return F.when(flat, F.array().cast("array<int>")).otherwise(F.array_distinct(F.array(*corners)))


def kept_of_crowd(items: Column, by_text: bool) -> Column:
    """The greedy fold over sorted items, with a hashed grid.

    Where boxes a and b overlap by more than OVERLAP (over a half), what they share is more than half as wide and as high as
    either. So their widths and heights are within a factor of two, thus in the same or in neighbouring classes; and what they
    share holds a's centre, so b covers the centre's cell in the grid of b's class. A kept box is put into the cells that it covers, 
    and another is compared only with what its centre's cells have: nothing that overlaps enough is missed. Kept boxes hardly overlap,
    so a cell has few. Keys of kept texts are in buckets likewise. The fold's state is two arrays of buckets; a bucket's
    number is a hash, so the sizes go with the root of the number of items: a step copies as much as it compares."""
    n = F.size(items)
    buckets = F.greatest(F.lit(1), (10 * F.sqrt(n)).cast("int"))

    def fold(count: Column) -> Column:
        def prepared(x: Column) -> Column:
            box_ = x["d"]["box"]
            kinds = F.struct(size_class(box_["x1"] - box_["x0"]).alias("x"), size_class(box_["y1"] - box_["y0"]).alias("y"))
            return let(kinds, lambda k: F.struct(box_.alias("box"), x["key"].alias("key"), F.pmod(F.xxhash64(x["key"]), count).cast("int").alias("slot"), cells(box_, k, True, count).alias("own"), cells(box_, k, False, count).alias("near"), x.alias("item")))

        put = lambda grid, at, value: F.concat(F.slice(grid, F.lit(1), at), F.array(F.concat(F.get(grid, at), F.array(value))), F.slice(grid, at + 2, F.size(grid)))

        def step(carry: Column, x: Column) -> Column:
            met = F.exists(x["near"], lambda c: F.exists(F.get(carry["grid"], c), lambda b: iou(b, x["box"]) > OVERLAP))
            if by_text:
                met = F.array_contains(F.get(carry["texts"], x["slot"]), x["key"]) | met
            grid = F.aggregate(x["own"], carry["grid"], lambda g, c: put(g, c, x["box"]))
            stay = F.struct(F.struct(grid.alias("grid"), put(carry["texts"], x["slot"], x["key"]).alias("texts")).alias("carry"), F.array(x["item"]).alias("hits"))
            drop = F.struct(carry.alias("carry"), F.slice(F.array(x["item"]), F.lit(1), F.lit(0)).alias("hits"))
            return F.when(met, drop).otherwise(stay)

        empty = lambda kind: F.array_repeat(F.array().cast(f"array<{kind}>"), count)
        first = F.struct(empty("struct<x0:double,y0:double,x1:double,y1:double>").alias("grid"), empty("string").alias("texts"))
        return gathered(F.transform(items, prepared), first, step, ITEM)

    return let(buckets, fold)


BOX = "struct<x0:double,y0:double,x1:double,y1:double>"
#: What deduplicate() sorts and keeps.
ITEM = f"struct<less:double,ord:struct<phase:int,line_no:int,rule_no:int,match_no:int>,key:string,d:struct<original_text:string,box:{BOX},confidence:double,method:string,rule:string,font:string,size:double,color:int,label_box:{BOX},ord:struct<phase:int,line_no:int,rule_no:int,match_no:int>>>"


def deduplicate(found: DataFrame, by_text: bool = True, crowded: int = CROWDED) -> DataFrame:
    """Strongest first, keeps a detection unless a kept one of its page and type has its text or overlaps it. As only
    equal page and type repeat, each (doc_id, page, type) folds apart; being near isn't transitive, so it is a fold and
    not a grouping. Groups of more than `crowded` fold with a grid, which takes about n^1.5 instead of n^2 steps. With by_text=False the same text
    elsewhere on the page is kept too."""
    named = found.filter("box is not null").withColumn("key", entity_key(F.col("original_text")))
    item = F.struct((-F.col("confidence")).alias("less"), F.col("ord"), F.col("key"), F.struct(*(c for c in COLUMNS if c not in ("doc_id", "page", "type"))).alias("d"))
    groups = named.groupBy("doc_id", "page", "type").agg(F.sort_array(F.collect_list(item)).alias("all"))

    def same(a: Column, b: Column) -> Column:
        over = iou(a["d"]["box"], b["d"]["box"]) > OVERLAP
        return (a["key"] == b["key"]) | over if by_text else over

    few = F.aggregate("all", F.slice("all", 1, 0), lambda acc, x: F.when(F.exists(acc, lambda k: same(k, x)), acc).otherwise(F.concat(acc, F.array(x))))
    # most groups are of one; higher-order functions are interpreted, and so is all of a generator that has some
    kept = F.when(F.size("all") == 1, F.col("all")).when(F.size("all") <= crowded, few).otherwise(kept_of_crowd(F.col("all"), by_text))
    rows = groups.select("doc_id", "page", "type", kept.alias("kept"))
    # not a bare column: of one, a filter by size would be made and pushed below, with a copy of the fold
    rows = rows.select("doc_id", "page", "type", F.inline(F.when(F.size("kept") > 0, F.col("kept"))))
    return rows.select("doc_id", "page", "type", "d.*").select(*COLUMNS)


def at_least(found: DataFrame, confidence: float) -> DataFrame:
    return found.filter(F.col("confidence") >= confidence) if confidence > 0 else found


def summarize(found: DataFrame, *by: str) -> DataFrame:
    """Detections by type, in the order of the types."""
    keys = [*(F.col(c) for c in by), F.coalesce("type", F.lit("UNKNOWN")).alias("type")]
    return found.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).orderBy(*by, "type")

"""Mixing sources to target weights by Pfair scheduling.

Rows of a source are ordered by hash and cut into blocks. The target is a fluid mix in which each source moves on in
proportion to its weight among the sources that still have blocks; a source that is used up leaves its share to the
others. Block i is released in the slot in which the fluid mix begins it, and due by the slot in which the fluid mix ends
it: with weight w, floor(i / w) and ceil((i + 1) / w) until the first source is used up. Earliest deadline first, among
released blocks, fills every slot, and each source is always less than one block from its target. Weights are taken as
they are, however many sources there are and however small their weights.

The slots are found in order, by one task from one row a source: a block costs two microseconds there (nine with 200,000
sources), so block_rows decides how long that takes. The task holds a source's next windows only and gives slots away as it finds them, so its memory
grows with the sources, not with the blocks. Everything that has a row per row or block of the input is a distributed
table; nothing is collected to the driver, and joins are left to Spark, which knows their sizes.

Defined results: a null source is a source of its own; null ids, empty or very long texts, and repeated rows are placed
like other rows, in hash order; sources without a weight (or one that isn't above 0) come after the others, evenly
mixed; an empty table gives an empty table. Added columns replace those of the same name.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import written

#: Rows, about, of a group of a source that is ordered in one task.
GROUP_ROWS = 256
#: Stands for the null source; a source's name begins with another letter.
NULL, NAMED = "-", "="
#: Groups of a source whose beginnings are found in one task, from where their span begins.
SPAN_GROUPS = 4096
#: Windows, about, that the schedule has made ahead.
AHEAD = 1 << 19
#: Part of a slot by which the ends of windows may be off, as they are floating-point numbers.
EPSILON = 1e-9


class Fluid:
    """The fluid mix of `blocks` of each source at `weights` (all above 0)."""

    def __init__(self, blocks: np.ndarray, weights: np.ndarray):
        self.blocks, self.weights = blocks.astype(np.float64), weights / weights.sum()
        order = np.argsort(self.blocks / self.weights, kind="stable")
        # by the virtual time in which a source moves on by its weight: who has ended, how many blocks they had, what weight goes on
        self.ends = (self.blocks / self.weights)[order]
        self.over = np.concatenate(([0.0], np.cumsum(self.blocks[order])))
        self.rest = np.concatenate((np.cumsum(self.weights[order][::-1])[::-1], [0.0]))

    def slot(self, virtual: np.ndarray) -> np.ndarray:
        """Slots filled at virtual times."""
        k = np.searchsorted(self.ends, virtual, side="left")
        return self.over[k] + self.rest[k] * virtual

    def windows(self, source: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The slot that a source's block is released in, and the slot that it is due by."""
        w = self.weights[source]
        release = np.floor(self.slot(block / w) + EPSILON).astype(np.int64)
        return release, np.ceil(self.slot(np.minimum((block + 1) / w, self.ends[-1])) - EPSILON).astype(np.int64)


def slots(blocks: np.ndarray, weights: np.ndarray, size: int = 10_000, ahead: int = AHEAD) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Source and number of the block of each slot, in pieces of `size` slots, by earliest deadline first among released
    blocks (ties: first source). Where none is released, the one that is released next. No blocks or weights of 0.

    A source's blocks are released in order and due in order, so that its next block stands for all that follow: `next_up` has
    one entry a source, and `ready` those that are released. Windows are made for about `ahead` blocks at a time."""
    n, total = len(blocks), int(blocks.sum())
    if not n:
        return
    fluid, counts, some = Fluid(blocks, weights), blocks.tolist(), max(4, ahead // n)
    first = np.minimum(blocks, some).astype(np.int64)
    start = np.cumsum(first) - first
    release, due = (x.tolist() for x in fluid.windows(np.repeat(np.arange(n), first), np.arange(first.sum()) - np.repeat(start, first)))
    # of each source: its windows that are made, the number of the first of them, blocks released and blocks placed
    releases, dues = ([x[i : i + k] for i, k in zip(start.tolist(), first.tolist(), strict=True)] for x in (release, due))
    base, released, placed = [0] * n, [0] * n, [0] * n
    # a slot and a source, in one number
    next_up, ready = [r[0] * n + s for s, r in enumerate(releases)], []
    heapq.heapify(next_up)
    source, block = [], []
    for slot in range(total):
        while next_up and (next_up[0] < (slot + 1) * n or not ready):
            s = next_up[0] % n
            heapq.heappush(ready, dues[s][released[s] - base[s]] * n + s)
            released[s] += 1
            if released[s] == counts[s]:
                heapq.heappop(next_up)
                releases[s] = []
                continue
            if released[s] - base[s] == len(releases[s]):
                base[s] = released[s]
                numbers = np.arange(base[s], min(base[s] + some, counts[s]))
                releases[s], dues[s] = (x.tolist() for x in fluid.windows(np.full(len(numbers), s), numbers))
            heapq.heapreplace(next_up, releases[s][released[s] - base[s]] * n + s)
        s = heapq.heappop(ready) % n
        source.append(s)
        block.append(placed[s])
        placed[s] += 1
        if len(source) == size:
            yield np.array(source), np.array(block)
            source, block = [], []
    if source:
        yield np.array(source), np.array(block)


def schedule(blocks: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All slots of `slots` at once."""
    pieces = list(slots(blocks, weights))
    return tuple(np.concatenate(x) for x in zip(*pieces, strict=True)) if pieces else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def tempered(exponent: float, rows: str = "rows"):
    """Weights in proportion to a power of the rows: below 1, small sources gain on large ones."""
    return F.pow(F.col(rows).cast("double"), F.lit(exponent))


def planned(sources: DataFrame, block_rows: int) -> DataFrame:
    """mix_source, mix_block, mix_slot of all blocks. sources: mix_source, rows, weight (null: none)."""

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        if found is None or not found.num_rows:
            return
        found = found.sort_by("mix_source")
        names, start = found.column("mix_source").combine_chunks(), 0
        blocks = -(-found.column("rows").to_numpy() // block_rows)
        weights = np.nan_to_num(found.column("weight").to_numpy().astype(np.float64), nan=0.0)
        for live, w in ((weights > 0, weights), (weights <= 0, np.ones(len(weights)))):
            at = np.flatnonzero(live)
            for source, block in slots(blocks[at], w[at]):
                taken = np.arange(start, start + len(source))
                yield pa.RecordBatch.from_arrays([names.take(pa.array(at[source])), pa.array(block), pa.array(taken)], ["mix_source", "mix_block", "mix_slot"])
                start += len(source)

    one = sources.select("mix_source", "rows", F.col("weight").cast("double")).repartition(1)
    return one.mapInArrow(plan, "mix_source string, mix_block long, mix_slot long")


def mixed(docs: DataFrame, block_rows: int, weights: dict[str | None, float] | None = None, exponent: float = 0.5, source: str = "source", key: str = "doc_id", seed: int = 3, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Adds mix_source, mix_block, mix_slot and mix_position, by which the mixed rows are ordered."""
    spark = docs.sparkSession
    name = F.when(F.col(source).isNull(), F.lit(NULL)).otherwise(F.concat(F.lit(NAMED), F.col(source).cast("string")))
    order = F.xxhash64(F.lit(seed), F.col(key), *(F.col(c) for c in docs.columns if c != key and dict(docs.dtypes)[c] in ("string", "bigint", "int")))
    counts = docs.groupBy(name.alias("mix_source")).agg(F.count(F.lit(1)).alias("rows"))
    if weights is None:
        weighed = counts.withColumn("weight", tempered(exponent))
    else:
        given = spark.createDataFrame([(NULL if s is None else NAMED + str(s), float(w)) for s, w in weights.items()], "mix_source string, weight double")
        weighed = counts.join(given, "mix_source", "left")
    sources = written(weighed, "sources")
    groups = sources.select("mix_source", F.greatest(F.lit(1), F.ceil(F.col("rows") / group_rows)).alias("__groups"))
    keyed = docs.withColumn("mix_source", name).join(groups, "mix_source")
    keyed = keyed.withColumn("__order", order).withColumn("__group", F.pmod(F.shiftrightunsigned("__order", 17), F.col("__groups"))).drop("__groups")
    # rows of a source and group are few; the groups' counts give where each begins, span by span
    sizes = written(keyed.groupBy("mix_source", "__group").agg(F.count(F.lit(1)).alias("n")), "sizes").withColumn("__span", F.floor(F.col("__group") / SPAN_GROUPS))
    earlier = lambda order, *by: Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    spans = sizes.groupBy("mix_source", "__span").agg(F.sum("n").alias("m")).withColumn("__start", F.coalesce(F.sum("m").over(earlier("__span", "mix_source")), F.lit(0)))
    inner = F.coalesce(F.sum("n").over(earlier("__group", "mix_source", "__span")), F.lit(0))
    starts = sizes.join(spans.drop("m"), ["mix_source", "__span"]).withColumn("__before", F.col("__start") + inner)
    blocks = F.sequence(F.floor(F.col("__before") / block_rows), F.floor((F.col("__before") + F.col("n") - 1) / block_rows))
    needed = starts.select("mix_source", "__group", "__before", F.explode(blocks).alias("mix_block"))
    found = needed.join(planned(sources, block_rows), ["mix_source", "mix_block"]).groupBy("mix_source", "__group").agg(F.first("__before").alias("__before"), F.array_sort(F.collect_list(F.struct("mix_block", "mix_slot"))).alias("__slots"))
    inside = Window.partitionBy("mix_source", "__group").orderBy("__order", key)
    placed = keyed.join(written(found, "slots"), ["mix_source", "__group"]).withColumn("__at", F.col("__before") + F.row_number().over(inside) - 1)
    placed = placed.withColumn("mix_block", F.floor(F.col("__at") / block_rows))
    slot = F.col("__slots")[(F.col("mix_block") - F.floor(F.col("__before") / block_rows)).cast("int")]["mix_slot"]
    placed = placed.withColumn("mix_slot", slot).withColumn("mix_position", F.col("mix_slot") * block_rows + F.col("__at") % block_rows)
    return placed.select(*(c for c in docs.columns if not c.startswith("mix_")), "mix_source", "mix_block", "mix_slot", "mix_position")

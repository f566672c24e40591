"""Near-duplicates by bottom-k sketches from one hash function.

1. Each text's set of word shingles is hashed with one 64-bit hash; a sketch keeps the `k` smallest values. Texts with
   equal sets form a class, which one row stands for from here on.
2. Inverted lists of retained values propose pairs. Two sets of Jaccard similarity t or more share at least c of their
   k retained values (but for one pair in 10^9), so it is enough to list each sketch under its k - c + 1 values that
   are rarest by a fixed-size count table, in one order for all: values of common passages are left out unless a text
   has little else. Sets of at most k shingles are their own sketches, and there the bounds are exact.
3. Members of a short list are paired. A long list emits no pairs: its members meet one pivot, the member whose values
   are the most common ones, on full sets. Members that are similar to the pivot are linked with it. If x isn't, and
   x and y are similar, then the two share a value that the pivot lacks, or else both hold nearly all of what they hold
   inside the pivot (see `met`). So the members of a pivot's lists are listed anew, under the values that the pivot lacks
   (and one list of those near it), and only lists with members of different components go on: copies of one text with
   different changes part at once. Lists that are still long get pivots of their own; what is left after `levels` rounds
   is compared in tiles of bounded size. No link is lost, and a group of n near copies costs n comparisons, not n^2.
4. A pair's similarity is estimated from the union of the two sketches; pairs far below the threshold go.
5. The rest are confirmed on the full sets, and components found by alternating large-star and small-star steps.

Defined results: a null or empty text has the empty set, is its own component and is kept; a text with fewer words than
a shingle has its whole word sequence as its one shingle; very long texts count whole; rows that share a doc_id are one
document; rows without a doc_id have no component and are kept; an empty table gives an empty table; added columns
replace those of the same name.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import remember
from .sieve import bitmap, sieved
from .store import Tables, batches_of

REMEMBERED = 200_000
#: Counters of the table that orders values from rare to common.
COUNTERS = 1 << 20
CHUNK = 1 << 12
#: Members of a side of a tile.
TILE = 512
#: Rounds for components that only spare comparisons within them.
ROUNDS = 3
#: What a list has in common after the first round: the pivot, and either a value that it lacks or being near it.
KEYS = ["group", "near", "value"]
#: Runs that the members of a hot value are dealt to.
RUNS = 64


@dataclass(frozen=True)
class Settings:
    """Pairs are linked where 100 * intersection >= percent * union."""

    percent: int = 85
    words: int = 5
    k: int = 256
    #: Chance that a linked pair's sketches share fewer values than the lists need.
    miss: float = 1e-9
    #: Members of a list that are paired without a pivot, in the first round and in later ones.
    short: int = 8
    later: int = 64
    #: Rounds of pivots; what is left then is tiled.
    levels: int = 4
    #: Values whose counter has so many sketches (and 8 times the mean) may have members for more than one task.
    hot: int = 200_000

    def shared(self, k: int | None = None) -> int:
        """Values that two sketches of k share at least: the largest c with exp(-k KL(c / k, t)) <= miss."""
        k, t = k or self.k, self.percent / 100
        c = math.floor(t * k)
        while c > 1:
            x = c / k
            if math.exp(-k * (x * math.log(x / t) + (1 - x) * math.log((1 - x) / (1 - t)))) <= self.miss:
                break
            c -= 1
        return c

    @property
    def least_estimate(self) -> float:
        """Estimates below this go: the similarity that shows as `percent` once in 10^9, by the same bound."""
        return self.shared() / self.k


class Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        h = xxhash.xxh64_intdigest(word)
        if len(self) < REMEMBERED:
            self[word] = h
        return h


_HASHES = remember.kept(Hashes())


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles. Of bytes, lower() and split() know ASCII's letters and white space alone."""
    ws = (text or "").encode().lower().split()
    if not ws:
        return np.zeros(0, np.uint64)
    h = np.array(list(map(_HASHES.__getitem__, ws)), np.uint64)
    width = min(words, len(h))
    n = len(h) - width + 1
    out = np.full(n, width, np.uint64)
    for i in range(width):
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + h[i : i + n]
    out = (out ^ (out >> np.uint64(30))) * np.uint64(0x94D049BB133111EB)
    out = np.sort(out ^ (out >> np.uint64(31)))
    return out[np.concatenate(([True], out[1:] != out[:-1]))]


def signed(values: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(v) for v in values]))).astype(np.int32)
    flat = np.concatenate(values).view(np.int64) if values else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def sketched(docs: DataFrame, s: Settings, key: str, text: str) -> DataFrame:
    """A row per row: doc, n (size of the set), signature (of the whole set), sketch."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remember.only(_HASHES)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                sets = [shingles(x, s.words) for x in part.column(1).to_pylist()]
                sign = pa.array([hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) for x in sets], pa.int64()), sign, signed([x[: s.k] for x in sets])], ["doc", "n", "signature", "sketch"])

    return docs.select(F.col(key).cast("long"), F.col(text)).mapInArrow(make, "doc long, n long, signature binary, sketch array<long>")


def sets_of(docs: DataFrame, s: Settings, key: str, text: str) -> DataFrame:
    """doc and its whole set as an array."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remember.only(_HASHES)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                yield pa.RecordBatch.from_arrays([part.column(0), signed([shingles(x, s.words) for x in part.column(1).to_pylist()])], ["doc", "whole"])

    return docs.select(F.col(key).cast("long"), F.col(text)).mapInArrow(make, "doc long, whole array<long>")


def counter(values: np.ndarray) -> np.ndarray:
    return (values >> np.uint64(7) & np.uint64(COUNTERS - 1)).astype(np.int64)


def frequencies(classes: DataFrame) -> bytes:
    """COUNTERS counts of sketch values, as bytes on a logarithmic scale."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            flat = batch.column(0).flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            sums += np.bincount(counter(flat), minlength=COUNTERS)
        for k in np.flatnonzero(sums.reshape(-1, CHUNK).any(1)).tolist():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([sums[k * CHUNK : (k + 1) * CHUNK].tobytes()], pa.binary())], ["chunk", "sums"])

    def add(groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, total = None, np.zeros(CHUNK, np.int64)
        for batch in groups:
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                chunk = k
                total += np.frombuffer(data, np.int64)
        scaled = np.minimum(np.round(6 * np.log2(total + 1.0)), 255).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([scaled.tobytes()], pa.binary())], ["chunk", "sums"])

    out = np.zeros(COUNTERS, np.uint8)
    parts = classes.select("sketch").mapInArrow(count, "chunk int, sums binary")
    for row in parts.groupBy("chunk").applyInArrow(add, "chunk int, sums binary").collect():  # COUNTERS bytes, whatever the input
        out[row["chunk"] * CHUNK : (row["chunk"] + 1) * CHUNK] = np.frombuffer(row["sums"], np.uint8)
    return out.tobytes()


def listed(classes: DataFrame, s: Settings, table: bytes) -> DataFrame:
    """A row for each rare value of a sketch: value, doc, info and run (-1, or for a hot value one of RUNS that its members are dealt to).
    info packs what unpacked() gives, as most values have one member and go after the shuffle that finds so: n, place (the
    value's rank among the sketch's values, rarest first) and score (how common the sketch's values are on the mean)."""
    share, percent, k = s.shared(), s.percent, s.k
    scale = np.frombuffer(table, np.uint8)
    hot = 6 * math.log2(max(s.hot, 8 * float(np.mean(2.0 ** (scale / 6)))) + 1)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.frombuffer(table, np.uint8)
        for batch in (b.slice(i, 500) for b in batches for i in range(0, b.num_rows, 500)):
            docs, sizes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            offsets, flat = batch.column(2).offsets.to_numpy(), batch.column(2).flatten().to_numpy().view(np.uint64)
            offsets = offsets - offsets[0]
            often = counts[counter(flat)]
            got, long, scores = [], [], []
            for i, n in enumerate(sizes.tolist()):
                a, b = offsets[i], offsets[i + 1]
                c = min(-(-percent * n // 100), share) if n <= k else share
                keep = (b - a) - c + 1
                got.append(a + np.lexsort((flat[a:b], often[a:b]))[:keep])
                long.append(keep)
                scores.append(int(100 * often[a:b].mean()))
            if long:
                at = np.concatenate(got)
                place = np.concatenate([np.arange(x, dtype=np.int64) for x in long])
                doc = np.repeat(docs, long)
                run = np.where(often[at] >= hot, doc * 0x9E3779B1 >> 13 & RUNS - 1, -1).astype(np.int8)
                info = np.repeat(np.array(scores, np.int64) << 48, long) | place << 32 | np.repeat(sizes, long)
                yield pa.RecordBatch.from_arrays([pa.array(flat[at].view(np.int64)), pa.array(doc), pa.array(info), pa.array(run)], ["value", "doc", "info", "run"])

    return classes.filter("n > 0").select("doc", "n", "sketch").mapInArrow(make, "value long, doc long, info long, run byte")


def pivot() -> Column:
    """Of a list: the member with the most common values, by hash among equals."""
    return F.max(F.struct("score", F.xxhash64("doc").alias("h"), "doc", "n"))


def unpacked(values: DataFrame) -> DataFrame:
    """Values with n, place and score in the place of info."""
    bits = lambda at, size: F.shiftright("info", at).bitwiseAND(F.lit((1 << size) - 1))
    return values.withColumns({"n": bits(0, 32), "place": bits(32, 16).cast("short"), "score": bits(48, 15).cast("short")}).drop("info")


def with_members(values: DataFrame) -> DataFrame:
    """Values of two documents or more, with `members` and `pivot` (doc, n) of each list. One shuffle; hot values are counted by runs first."""
    run = Window.partitionBy("value", "run")
    # shuffled by name, as a window's own shuffle would carry what it computes from a row, too
    dealt = unpacked(values.repartition("value", "run"))
    counted = dealt.withColumn("members", F.count(F.lit(1)).over(run)).withColumn("pivot", pivot().over(run))
    return counted.filter("members > 1 or run >= 0")


def merged_runs(lists: DataFrame) -> DataFrame:
    """Puts the runs of hot values together."""
    of = lists.filter("run >= 0").groupBy("value", "run").agg(F.max("members").alias("members"), F.max("pivot").alias("pivot"))
    of = of.groupBy("value").agg(F.sum("members").alias("all"), F.max("pivot").alias("top"))
    hot = lists.filter("run >= 0").join(of, "value").filter("all > 1")
    return lists.filter("run < 0").unionByName(hot.select(*(c for c in lists.columns if c not in ("members", "pivot")), F.col("all").alias("members"), F.col("top").alias("pivot")))


def possible(s: Settings, x: Column, y: Column) -> Column:
    """Whether the sizes of x and y, and the places of the first value that both have, leave room for the similarity."""
    need = s.percent * (x["n"] + y["n"])  # times 1 / (100 + percent): the values that both must have
    room = (need <= (x["n"] - x["place"]) * (100 + s.percent)) & (need <= (y["n"] - y["place"]) * (100 + s.percent))
    return similar_sizes(s, x, y) & (room | (F.greatest(x["n"], y["n"]) > s.k))


def similar_sizes(s: Settings, x: Column, y: Column) -> Column:
    return 100 * F.least(x["n"], y["n"]) >= s.percent * F.greatest(x["n"], y["n"])


def short_pairs(lists: DataFrame, keys: list[str], member: list[str], can: Callable[[Column, Column], Column]) -> DataFrame:
    """Pairs (a < b) of members of each list, which are so few that one row has them."""
    together = lists.groupBy(*keys).agg(F.collect_list(F.struct(*member)).alias("all"))
    pairs = F.flatten(F.transform("all", lambda x: F.transform(F.filter("all", lambda y: (x["doc"] < y["doc"]) & can(x, y)), lambda y: F.struct(x["doc"].alias("a"), y["doc"].alias("b")))))
    return together.select(F.explode(pairs).alias("pair")).select("pair.*").distinct()


def tile_pairs(lists: DataFrame, keys: list[str], s: Settings) -> DataFrame:
    """Pairs of members of different components, in tiles of TILE by TILE members. lists: keys, doc, n, of, members."""
    tiles = F.ceil(F.col("members") / TILE).cast("int")
    rows = lists.select(*keys, F.struct("doc", "n", "of").alias("x"), tiles.alias("tiles"), F.pmod(F.xxhash64("doc"), tiles).cast("int").alias("own"))
    left = rows.select(*keys, "x", F.col("own").alias("i"), F.explode(F.sequence(F.col("own"), F.col("tiles") - 1)).alias("j"))
    right = rows.select(*keys, F.col("x").alias("y"), F.explode(F.sequence(F.lit(0), F.col("own"))).alias("i"), F.col("own").alias("j"))
    meet = (F.col("i") < F.col("j")) | (F.col("x.doc") < F.col("y.doc"))
    joined = left.join(right, [*keys, "i", "j"]).filter(meet & (F.col("x.of") != F.col("y.of")) & similar_sizes(s, F.col("x"), F.col("y")))
    return joined.select(F.least("x.doc", "y.doc").alias("a"), F.greatest("x.doc", "y.doc").alias("b")).distinct()


def ends(*pairs: DataFrame) -> DataFrame:
    """The bitmap of all documents that pairs have."""
    docs = [p.select(F.explode(F.array(*p.columns[:2])).alias("doc")) for p in pairs]
    return bitmap(reduce(DataFrame.union, docs), "doc")


def promising(pairs: DataFrame, classes: DataFrame, s: Settings) -> DataFrame:
    """Drops pairs whose similarity, estimated from the k smallest values of the union of the sketches, is too small."""
    unsigned = F.transform("sketch", lambda x: x.bitwiseXOR(F.lit(-(1 << 63))))  # values are stored signed; this keeps their order
    sketches = classes.select("doc", unsigned.alias("sketch"))
    both = pairs.join(sketches.toDF("a", "sa"), "a").join(sketches.toDF("b", "sb"), "b")
    parts = F.struct(F.slice(F.sort_array(F.array_union("sa", "sb")), 1, s.k).alias("u"), F.array_intersect("sa", "sb").alias("c"))
    # bound to a lambda's variable, so that the union is made once a pair and not once an element
    like = F.transform(F.array(parts), lambda p: F.size(F.filter(p["c"], lambda x: x <= F.element_at(p["u"], -1))) >= s.least_estimate * F.size(p["u"]))
    return both.filter(F.element_at(like, 1)).select("a", "b")


def confirmed(pairs: DataFrame, sets: DataFrame, s: Settings, tables: Tables) -> DataFrame:
    """Pairs (a written table) whose full sets have the similarity."""
    sets = sieved(sets, "doc", tables.written(ends(pairs), "bits"))
    both = pairs.join(sets.toDF("a", "wa"), "a").join(sets.toDF("b", "wb"), "b")
    sized = both.select("a", "b", F.size(F.array_intersect("wa", "wb")).alias("common"), (F.size("wa") + F.size("wb")).alias("total"))
    return sized.filter(100 * F.col("common") >= s.percent * (F.col("total") - F.col("common"))).select("a", "b")


def met(pairs: DataFrame, sets: DataFrame, s: Settings, tables: Tables) -> DataFrame:
    """Members against their pivots, on full sets. pairs (a written table): doc, pivot, score, n. Adds linked, near and `outside`, the
    values that the member is listed under next.

    Let x and y be similar members of the pivot P's lists, m the size of its smallest member. They share at least
    need(x) = t / (1 + t) * (|x| + max(m, t|x|)) values, and need(y) alike. If c > 0 of them are not in P, then c is at
    least need(x) - |x & P|, so the first of these values, in the order of the arrays, is among the first
    |x - P| - max(1, need(x) - |x & P|) + 1 of x - P and of y - P alike: that is `outside`. If all are in P, then |x & P|
    is need(x) or more, and |y & P| too. If both are linked with P, nothing is to be found; if x isn't, then y is smaller than
    P, as |x & P| < t / (1 + t) * (|x| + |P|). So `near` marks members with |x & P| >= need(x) that aren't linked with P
    or are smaller than it, and those share one list.
    """
    whole = sieved(sets, "doc", tables.written(bitmap(pairs, "doc"), "bits"))
    # pivots are few, and often few enough to be broadcast if no other sets are read with them
    pivots = sieved(sets, "doc", tables.written(bitmap(pairs, "pivot"), "bits")).join(pairs.select(F.col("pivot").alias("doc")).distinct(), "doc", "left_semi")
    # the least sizes come first, so that nothing after the joins needs a pivot's rows together: Spark can split them
    sized = tables.written(pairs.join(pairs.groupBy("pivot").agg(F.min("n").alias("least")), "pivot").drop("n"), "sized")
    both = sized.join(whole, "doc").withColumnRenamed("whole", "w").join(pivots.select(F.col("doc").alias("pivot"), F.col("whole").alias("wp")), "pivot")
    known = both.select("pivot", "doc", "score", "least", F.size("w").alias("n"), F.size("wp").alias("np"), F.array_except("w", "wp").alias("rest"))
    common = F.col("n") - F.size("rest")
    need = F.ceil(s.percent * (F.col("n") + F.greatest("least", F.ceil(s.percent * F.col("n") / 100))) / (100 + s.percent)).cast("int")
    linked = 100 * common >= s.percent * (F.col("n") + F.col("np") - common)
    known = known.withColumns({"common": common, "need": need, "linked": linked})
    near = (F.col("common") >= F.col("need")) & (~F.col("linked") | (F.col("n") < F.col("np")))
    return known.select("pivot", "doc", "score", "n", "linked", near.alias("near"), F.slice("rest", F.lit(1), F.greatest(F.col("n") - F.col("need") + 1, F.lit(0))).alias("outside"))


def components(links: DataFrame, tables: Tables, rounds: int | None = None) -> DataFrame:
    """doc and the smallest document that it is linked with, for documents of the links (a < b). After `rounds` rounds, if
    given, the smallest one found so far: documents of one component may still have different ones."""
    links = tables.written(links.select("a", "b").filter("a <> b").distinct(), "links")
    seen = None
    for done in count(1):
        # large star: every larger neighbour of a node is linked to the node's smallest neighbour
        both = links.union(links.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()
        # small star: a node and its smaller neighbours are linked to the smallest of them
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(least, "b").select(F.col("m"), F.explode(F.array("a", "b")).alias("x")).filter("m < x").distinct().toDF("a", "b")
        links = tables.written(small, "links")
        if done == rounds:
            return links.groupBy(F.col("b").alias("doc")).agg(F.min("a").alias("component"))
        state = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            return links.select(F.col("b").alias("doc"), F.col("a").alias("component"))
        seen = state


def clustered(docs: DataFrame, s: Settings = Settings(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per row of `docs`: doc, n_shingles, component_id."""
    with batches_of(docs.sparkSession, 1000):
        return _clustered(docs, s, key, text, Tables(docs.sparkSession))


def _clustered(docs: DataFrame, s: Settings, key: str, text: str, tables: Tables) -> DataFrame:
    made = tables.written(sketched(docs, s, key, text), "sketches")
    rows = tables.written(made.drop("sketch"), "signatures")  # what is needed when the sketches are gone
    known, some = made.filter("n > 0 and doc is not null"), rows.filter("n > 0 and doc is not null")
    reps = some.groupBy("signature").agg(F.min("doc").alias("rep"), F.count(F.lit(1)).alias("copies"))
    # most sets are single: only rows that the bitmap of the others lets through are shuffled
    bits = tables.written(bitmap(reps.filter("copies > 1"), "signature"), "bits")
    chosen = sieved(known, "signature", bits).join(reps.select("signature", F.col("rep").alias("doc")), ["signature", "doc"], "left_semi").dropDuplicates(["signature"])
    classes = sieved(known, "signature", bits, has=False).union(chosen.select(*known.columns)).select("doc", "n", "sketch")
    links = _links(classes, docs, s, key, text, tables, made)
    component = components(links.union(_repeats(some, reps)), tables)
    named = reps.join(component.select(F.col("doc").alias("rep"), "component"), "rep", "left").select("signature", F.coalesce("component", "rep").alias("component"))
    out = rows.select("doc", "n", "signature").join(named, "signature", "left")  # one row a signature on the right: the join splits a class with many copies
    return out.select("doc", F.col("n").alias("n_shingles"), F.when(F.col("doc").isNotNull(), F.coalesce("component", "doc")).alias("component_id"))


def _links(classes: DataFrame, docs: DataFrame, s: Settings, key: str, text: str, tables: Tables, made: DataFrame) -> DataFrame:
    """Links (a, b) that give the same components as all similar pairs of classes. made: the table of sketches, which goes when they have been compared."""
    lists = tables.written(with_members(listed(classes, s, frequencies(classes))), "lists")
    whole = merged_runs(lists)
    pairs = tables.written(short_pairs(whole.filter(F.col("members") <= s.short), ["value"], ["doc", "n", "place"], lambda x, y: possible(s, x, y)), "pairs")
    meetings = tables.written(_fewer_pivots(_meetings(whole.filter(F.col("members") > s.short)), tables), "meetings")
    likely = tables.written(promising(pairs, sieved(classes, "doc", tables.written(ends(pairs), "bits")), s), "likely")
    tables.drop(lists, pairs, made)
    needed = tables.written(ends(likely, meetings.select("doc", "pivot")), "bits")
    rows = sieved(docs.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text")), "doc", needed)
    sets = tables.written(sets_of(rows, s, "doc", "text"), "sets")  # of a document that has several rows: the sets of all
    links = tables.written(confirmed(likely, sets, s, tables), "links")
    for level in range(s.levels):
        if meetings.isEmpty():
            break
        members = tables.written(met(meetings, sets, s, tables), "met")
        direct = members.filter("linked").select(F.least("doc", "pivot").alias("a"), F.greatest("doc", "pivot").alias("b"))
        links = tables.written(links.union(direct), "links")
        under = tables.written(_under(members, components(links, tables, ROUNDS)), "under")
        lists = tables.written(_relisted(under), "lists")
        tables.drop(meetings, members, under)
        short = short_pairs(lists.filter(F.col("members") <= s.later), KEYS, ["doc", "n", "of"], lambda x, y: (x["of"] != y["of"]) & similar_sizes(s, x, y))
        found = confirmed(tables.written(short, "pairs"), sets, s, tables)
        long = lists.filter(F.col("members") > s.later)
        if level < s.levels - 1:
            meetings = tables.written(_meetings(long).filter("doc <> pivot").drop("lists"), "meetings")
        else:
            found = found.union(confirmed(tables.written(tile_pairs(long, KEYS, s), "tiles"), sets, s, tables))
        links = tables.written(links.union(found), "links")
        tables.drop(lists)
    tables.drop(sets)
    return links


def _meetings(long: DataFrame) -> DataFrame:
    """Members of long lists with these lists' pivots (themselves, too): doc, pivot, lists (how many), score, n."""
    return long.groupBy("doc", F.col("pivot.doc").alias("pivot")).agg(F.count(F.lit(1)).alias("lists"), F.max("score").alias("score"), F.min("n").alias("n"))


def _fewer_pivots(meetings: DataFrame, tables: Tables) -> DataFrame:
    """Lists whose pivot P is in more lists of another pivot Q than of its own meet Q instead. Any text will do as a pivot (see `met`), if
    all members of a list meet the same one. Near copies have long lists of many subsets of them, so each had a pivot for
    every few of its lists and was listed anew for each; now most of a group of copies meet one pivot."""
    seen = tables.written(meetings, "seen")
    own = seen.join(seen.select(F.col("pivot").alias("doc")).distinct(), "doc", "left_semi")
    taken = own.groupBy("doc").agg(F.max_by("pivot", F.struct("lists", F.col("pivot") == F.col("doc"), "pivot")).alias("other"))
    moved = seen.join(taken.withColumnRenamed("doc", "pivot"), "pivot").select("doc", F.col("other").alias("pivot"), "score", "n")
    return moved.filter("doc <> pivot").groupBy("doc", "pivot").agg(F.max("score").alias("score"), F.min("n").alias("n"))


def _under(members: DataFrame, component: DataFrame) -> DataFrame:
    """Members by group (the pivot met) and value outside it, or as near it, for groups that have members of different components: KEYS, doc, n, score, of."""
    named = members.withColumnRenamed("pivot", "group").withColumnRenamed("near", "is_near").join(component, "doc", "left").withColumn("of", F.coalesce("component", "doc"))
    several = named.groupBy("group").agg(F.min("of").alias("low"), F.max("of").alias("high")).filter("low < high").select("group")
    key = lambda near, value: F.struct(F.lit(near).alias("near"), value.cast("long").alias("value"))
    under = F.concat(F.transform("outside", lambda v: key(False, v)), F.when(F.col("is_near"), F.array(key(True, F.lit(0)))).otherwise(F.array().cast("array<struct<near:boolean,value:bigint>>")))
    return named.join(several, "group", "left_semi").select("group", "doc", "n", "score", "of", F.inline(under))


def _relisted(rows: DataFrame) -> DataFrame:
    """Lists that have members of different components. rows (a written table, as it is read twice): KEYS, doc, n, score, of. Adds members and pivot."""
    lists = rows.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("members"), pivot().alias("pivot"), F.min("of").alias("low"), F.max("of").alias("high")).filter("low < high")
    return rows.join(lists.drop("low", "high"), KEYS)


def _repeats(some: DataFrame, reps: DataFrame) -> DataFrame:
    """Links between the classes of a document that has several rows."""
    several = some.groupBy("doc").agg(F.min("signature").alias("s1"), F.max("signature").alias("s2")).filter("s1 <> s2").select("doc")
    own = some.select("doc", "signature").join(several, "doc", "left_semi").join(reps.select("signature", "rep"), "signature")
    return own.filter("doc <> rep").select(F.least("doc", "rep").alias("a"), F.greatest("doc", "rep").alias("b"))


def kept_documents(docs: DataFrame, s: Settings, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that are the smallest of their component, and those without a key, with the columns of `docs`."""
    tables = Tables(docs.sparkSession)
    gone = tables.written(clustered(docs, s, key, text).filter("doc <> component_id").select("doc").distinct(), "gone")
    bits = tables.written(bitmap(gone, "doc"), "bits")
    # only rows that the bitmap doesn't clear are shuffled
    named = docs.withColumn("__doc", F.col(key).cast("long"))
    doubtful = sieved(named, "__doc", bits).join(gone.select(F.col("doc").alias("__doc")), "__doc", "left_anti")
    return sieved(named, "__doc", bits, has=False).unionByName(doubtful).select(*docs.columns)

"""Approximate nearest neighbours by inner product: a robust-pruned directed graph per shard.

Equal vectors are one node (a common vector would else fill its neighbourhood with copies of itself); of each node's
vectors the `k` + 1 smallest ids are kept beside the graph, which is all that ties by id can ask for. Nodes are dealt to
shards of bounded size by hash. For the graph, inner product becomes distance by one more coordinate that gives all
vectors of a shard the same length. The graph is built in batches: greedy searches from the medoid propose neighbours,
relaxed distance pruning (alpha) keeps edges in diverse directions, reverse edges are pruned alike. A query's beam
search goes through every shard; the nodes found are scored again in double precision on the original vectors.

Defined results: vectors that are null, empty, zero, of another length than the candidates' commonest (the smallest of
several), or that hold null or non-finite components take no part, neither as queries nor as candidates; neither do rows
with a null id; rows that repeat an id are one row if their vectors are equal, else each is a candidate by its own vector,
and as a query the id asks by the smallest of its vectors (compared component by component); with fewer than k candidates all are returned; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import written
from .vectors import commonest_width, finite

#: Nodes of a shard, about; queries of a block; blocks that one task puts to a shard.
SHARD_NODES, QUERY_BLOCK, TASK_BLOCKS = 4096, 4096, 16
DEGREE, ALPHA, BUILD_BEAM, BEAM = 32, 1.2, 64, 96
#: Nodes of a shard where searches begin.
ENTRIES = 32
SALTS = 64


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """id and v (array of double) of the rows that can take part, whatever their length."""
    v = F.col(vector).cast("array<double>")
    rows = vectors.select(F.col(key).cast("long").alias("id"), v.alias("v")).filter("id is not null and v is not null")
    return rows.filter(finite(F.col("v")) & F.exists("v", lambda x: x != 0))


def nodes(rows: DataFrame, members: int) -> DataFrame:
    """A row per distinct vector: node (the smallest id), v, ids (the `members` smallest). Copies are counted in salted groups first."""
    smallest = lambda c: F.slice(F.array_sort(F.array_distinct(c)), 1, members)
    ranked = rows.distinct().withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    first = ranked.withColumn("r", F.row_number().over(Window.partitionBy("v", "salt").orderBy("id"))).filter(F.col("r") <= members)
    return first.groupBy("v").agg(smallest(F.collect_list("id")).alias("ids")).select(F.element_at("ids", 1).alias("node"), "v", "ids")  # SALTS x members a vector at most


def distances(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Squared distances of rows of x (n, d) from their own lists of points (n, m, d)."""
    d = points - x[:, None, :]
    return np.einsum("nmd,nmd->nm", d, d)


def beam(points: np.ndarray, graph: np.ndarray, entry: np.ndarray, queries: np.ndarray, width: int, keep: bool = False) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Best-first search of all queries together, from the nodes of `entry` (`width` at most). Returns the `width` nearest found (ids, squared distances; -1 and inf where fewer) and, if asked, what each query expanded."""
    n, m = len(queries), len(points)
    ids = np.full((n, width), -1, np.int64)
    dist = np.full((n, width), np.inf, np.float32)
    done = np.ones((n, width), bool)
    first = distances(queries, np.broadcast_to(points[entry], (n, len(entry), points.shape[1])))
    order = np.argsort(first, 1, kind="stable")
    at = np.arange(len(entry))
    ids[:, at], done[:, at] = entry[order], False
    dist[:, at] = np.take_along_axis(first, order, 1)
    seen = np.zeros((n, m), bool)
    seen[:, entry] = True
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    while True:
        open_ = ~done & (ids >= 0)
        live = np.flatnonzero(open_.any(1))
        if not len(live):
            break
        first = open_[live].argmax(1)  # lists are in order of distance
        now = ids[live, first]
        done[live, first] = True
        if keep:
            steps.append((live, now))
        near = graph[now]
        fresh = (near >= 0) & ~seen[live[:, None], np.maximum(near, 0)]
        r, c = np.nonzero(near >= 0)
        seen[live[r], near[r, c]] = True
        d = np.where(fresh, distances(queries[live], points[np.maximum(near, 0)]), np.inf).astype(np.float32)
        all_ids = np.concatenate((ids[live], np.where(fresh, near, -1)), 1)
        all_d = np.concatenate((dist[live], d), 1)
        all_done = np.concatenate((done[live], ~fresh), 1)
        best = np.argsort(all_d, 1, kind="stable")[:, :width]
        ids[live], dist[live], done[live] = (np.take_along_axis(a, best, 1) for a in (all_ids, all_d, all_done))
    expanded: list[list[int]] = [[] for _ in range(n)]
    for live, now in steps:
        for q, x in zip(live.tolist(), now.tolist(), strict=True):
            expanded[q].append(x)
    return ids, dist, [np.array(x, np.int64) for x in expanded]


def pruned(points: np.ndarray, at: int, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Nearest first, each candidate that no kept one is alpha times nearer to (in distance, not its square)."""
    c = np.unique(candidates)
    c = c[(c >= 0) & (c != at)]
    if not len(c):
        return c
    d = ((points[c] - points[at]) ** 2).sum(1)
    order = np.lexsort((c, d))
    c, d = c[order], d[order]
    between = points[c]
    cross = ((between**2).sum(1)[:, None] + (between**2).sum(1)[None, :] - 2 * between @ between.T) * alpha**2
    alive, kept = np.ones(len(c), bool), []
    for i in range(len(c)):
        if alive[i]:
            kept.append(i)
            if len(kept) == degree:
                break
            alive &= cross[i] > d
    return c[kept]


def build(points: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA, width: int = BUILD_BEAM, seed: int = 1, batch: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """The graph (a row of neighbours per point, -1 where fewer) and the points where searches begin: the medoid, and others by
    chance, as points in clusters may not be reached from one."""
    n = len(points)
    degree = min(degree, max(1, n - 1))
    rng = np.random.default_rng(seed)
    medoid = int(((points - points.mean(0)) ** 2).sum(1).argmin())
    entry = np.unique(np.append(rng.choice(n, min(n, ENTRIES - 1), replace=False), medoid))
    graph = np.full((n, degree), -1, np.int64)
    for i in range(n if n > 1 else 0):
        pick = rng.integers(0, n - 1, degree)
        graph[i] = pick + (pick >= i)
    for a in (1.0, alpha):
        order = rng.permutation(n)
        for at in range(0, n, batch):
            group = order[at : at + batch]
            found, _, expanded = beam(points, graph, entry, points[group], width, keep=True)
            back: dict[int, list[int]] = {}
            for p, f, e in zip(group.tolist(), found, expanded, strict=True):
                out = pruned(points, p, np.concatenate((f, e, graph[p])), degree, a)
                graph[p] = -1
                graph[p, : len(out)] = out
                for q in out.tolist():
                    back.setdefault(q, []).append(p)
            for q, new in back.items():
                old = graph[q][graph[q] >= 0]
                both = np.unique(np.concatenate((old, new)))
                if len(both) > degree:
                    both = pruned(points, q, both, degree, a)
                graph[q] = -1
                graph[q, : len(both)] = both
    return graph, entry


def lengthened(x: np.ndarray, most: float | None = None) -> tuple[np.ndarray, float]:
    """Vectors with a coordinate more, so that their nearest neighbours by distance are those of largest inner product. For queries (most given) it is 0."""
    if most is not None:
        return np.hstack((x, np.zeros((len(x), 1)))).astype(np.float32), most
    square = (x**2).sum(1)
    most = float(square.max(initial=0))
    return np.hstack((x, np.sqrt(np.maximum(most - square, 0))[:, None])).astype(np.float32), most


INDEX = "shard int, entry binary, dim int, nodes binary, vectors binary, graph binary"


def indexed(found: DataFrame, shards: int) -> DataFrame:
    """A row per shard with its graph. found: rows of nodes()."""

    def make(t: pa.Table) -> pa.Table:
        ids = t.column("node").to_numpy()
        order = np.argsort(ids, kind="stable")
        x = np.array(t.column("v").to_pylist(), np.float64)[order]
        points, _ = lengthened(x)
        graph, entry = build(points)
        row = {"shard": [t.column("shard")[0].as_py()], "entry": [entry.astype("<i4").tobytes()], "dim": [x.shape[1]], "nodes": [ids[order].astype("<i8").tobytes()], "vectors": [x.astype("<f8").tobytes()], "graph": [graph.astype("<i4").tobytes()]}
        return pa.table(row, pa.schema([("shard", pa.int32()), ("entry", pa.binary()), ("dim", pa.int32()), ("nodes", pa.binary()), ("vectors", pa.binary()), ("graph", pa.binary())]))

    dealt = found.withColumn("shard", F.pmod(F.xxhash64("v"), F.lit(shards)).cast("int"))
    return dealt.select("shard", "node", "v").groupBy("shard").applyInArrow(make, INDEX)


class Shard:
    """A shard's graph and vectors, ready to be searched."""

    def __init__(self, index: dict):
        self.ids = np.frombuffer(index["nodes"], "<i8")
        self.x = np.frombuffer(index["vectors"], "<f8").reshape(len(self.ids), index["dim"])
        self.graph = np.frombuffer(index["graph"], "<i4").reshape(len(self.ids), -1)
        self.entry = np.frombuffer(index["entry"], "<i4")
        self.points, self.most = lengthened(self.x)

    def search(self, queries: np.ndarray, k: int, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and exact scores of the k best nodes that the beam found for each query (-1 where fewer)."""
        lengths = np.maximum(np.sqrt((queries**2).sum(1, keepdims=True)), 1e-300)
        found, _, _ = beam(self.points, self.graph, self.entry, lengthened(queries / lengths * math.sqrt(self.most), self.most)[0], width)
        scores = np.where(found >= 0, np.einsum("qd,qmd->qm", queries, self.x[np.maximum(found, 0)]), -np.inf)
        best = np.lexsort((np.where(found >= 0, self.ids[np.maximum(found, 0)], 2**62), -scores), axis=1)[:, :k]
        picked = np.take_along_axis(found, best, 1)
        return np.where(picked >= 0, self.ids[np.maximum(picked, 0)], -1), np.take_along_axis(scores, best, 1)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, key: str = "vec_id", vector: str = "embedding", shard_nodes: int = SHARD_NODES, width: int = BEAM) -> DataFrame:
    """The k nearest rows of `vectors` to each row of `queries` but itself: query_id, rank, vec_id, score."""
    rows = usable(vectors, key, vector)
    dims = commonest_width(rows, "v")
    found = written(nodes(rows.filter(F.size("v") == dims), k + 1), "nodes")
    shards = max(1, -(-found.count() // shard_nodes))
    index = written(indexed(found, shards), "graphs")
    # queries go by the vectors' width; of the vectors of an id the smallest asks, whatever the order of rows
    asked = usable(queries, key, vector).filter(F.size("v") == dims).groupBy("id").agg(F.min("v").alias("v"))
    n = asked.count()
    asked = asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(max(1, -(-n // QUERY_BLOCK)))).cast("int"))
    blocks = asked.groupBy("block").agg(F.collect_list(F.struct("id", "v")).alias("asked"))  # QUERY_BLOCK queries or so
    # a task gets a shard's index first and then, one after another, the blocks that it puts to it
    slices = max(1, -(-n // (QUERY_BLOCK * TASK_BLOCKS)))
    parts = ("entry", "dim", "nodes", "vectors", "graph")
    first = index.select("shard", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"), F.lit(-1).alias("block"), *parts, F.lit(None).cast(blocks.schema["asked"].dataType).alias("asked"))
    none = [F.lit(None).cast(index.schema[c].dataType).alias(c) for c in parts]
    then = blocks.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), (F.col("block") % slices).alias("slice"), "block", *none, "asked")
    work = first.union(then).repartition(shards * slices, "shard", "slice").sortWithinPartitions("shard", "slice", "block")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, shard = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                if batch.column("block")[i].as_py() < 0:
                    at, shard = batch.column("shard")[i].as_py(), Shard({c: batch.column(c)[i].as_py() for c in parts})
                    continue
                if batch.column("shard")[i].as_py() != at:
                    continue  # a shard without nodes
                of = batch.column("asked")[i].values
                ids, v = of.field("id").to_numpy(), np.array(of.field("v").to_pylist(), np.float64)
                for k0 in range(0, len(ids), 512):
                    got, scores = shard.search(v[k0 : k0 + 512], k + 1, width)
                    q = np.repeat(ids[k0 : k0 + 512], got.shape[1])
                    ok = got.ravel() >= 0
                    yield pa.RecordBatch.from_arrays([pa.array(q[ok]), pa.array(got.ravel()[ok]), pa.array(scores.ravel()[ok])], ["query_id", "node", "score"])

    hits = work.select("shard", "block", *parts, "asked").mapInArrow(search, "query_id long, node long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "node")
    top = hits.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k + 1).drop("r")
    rows = top.join(found.select("node", "ids"), "node").select("query_id", F.explode("ids").alias("vec_id"), "score").filter("vec_id <> query_id").distinct()
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")).cast("int"))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

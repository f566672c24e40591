"""Quality classifier by importance resampling.

Two hashed n-gram models (words and pairs of words, BUCKETS buckets) are fitted: one of the target text, the documents
labelled good and not toxic, and one of the raw text, all documents. A document's importance weight is the ratio of its
probabilities under the two, tempered: the mean over its n-grams of the log ratio, so that the weight doesn't grow with
length, times a slope (plus a constant), which a logistic regression of this one number on labelled targets and documents of low
quality gives, so that the log weight is on the scale of log odds and of the noise. The k documents with the largest log
weight plus Gumbel noise are drawn, which samples k without replacement by weight. k follows from the same labelled
documents, that the models were not fitted on: the bound on the weight that decides most of them rightly is found, and k is
the number of documents above it.

A few toxic words in a good text hardly move its ratio. So what is drawn is screened by a rule apart: from labelled targets
and toxic documents, each bucket gets the log ratio of the shares of documents that have it, and a document is toxic
if the mean of its MARKS lowest ones is below the bound that decides held-out targets and toxic documents best, a lost
target counting as CLEAN_COST toxic ones.

The fit takes at most `label_rows` labelled documents of each kind (half fit, half set the bounds), chosen by hash; everything
else covers all rows. k is exact: the k-th largest value is found by counting in ever finer bins.

Defined results: a text without n-grams (null, empty, white space) has ratio 1, so the constant as its log weight (with
targets and low quality labelled; else 0), and isn't toxic: it is drawn like a text that is as likely under both models; very
long texts count whole; rows equal in id and text get the same noise and stand or fall together; a null id is an id like
others; without labelled targets every row is kept; without any of low quality the log weight is the mean log ratio,
and k is set by the targets' lowest thousandth less their spread; without toxic ones nothing is screened; an empty table
gives an empty table. Texts must be UTF-8, as Spark's strings are unless made from bytes by a cast. Added columns replace
those of the same name; clashing columns of the labels are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import remember
from .store import Tables, batches_of, written

BUCKETS = 1 << 18
CHUNK = 1 << 12
LABEL_ROWS = 20_000
#: Pseudo-count of each bucket in either model.
SMOOTHING = 1.0
#: Pseudo-count of documents with and without a bucket, in the model of marks.
MARK_SMOOTHING = 3.0
#: Worst n-grams that are looked at.
MARKS = 3
#: A target that is screened counts as so many toxic documents that aren't.
CLEAN_COST = 3.0
#: A mean log ratio below this counts as this.
LEAST_MEAN = -2.0
#: Constant and slope by which the mean log ratio is the log weight.
AS_IT_IS = np.array([0.0, 1.0])
#: Kinds of labelled documents.
TARGET, TOXIC, LOW = 0, 1, 2
REMEMBERED = 200_000
#: Documents of an Arrow batch at most.
BATCH_ROWS = 1000


class Hashes(dict):
    """64-bit hash by token; remembers a bounded number."""

    def __missing__(self, token: str) -> int:
        import xxhash

        h = xxhash.xxh64_intdigest(token)
        if len(self) < REMEMBERED:
            self[token] = h
        return h


_HASHES = remember.kept(Hashes())
_TOKENS = re.compile(r"\w+|[^\w\s]").findall


def buckets(text: str | None) -> np.ndarray:
    """The bucket of each word and each pair of neighbouring words."""
    h = np.array(list(map(_HASHES.__getitem__, _TOKENS(text or ""))), np.uint64)
    pairs = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]
    pairs ^= pairs >> np.uint64(32)
    return (np.concatenate((h, pairs)) & np.uint64(BUCKETS - 1)).astype(np.int64)


def labelled(labels: DataFrame, rows: int, key: str = "doc_id") -> DataFrame:
    """At most `rows` labelled ids of each kind, by hash, with the half that each is in. An id labelled twice is a target only if good in all its labels."""
    kind = F.when(F.min((F.col("quality") == 1) & (F.col("toxic") == 0)), TARGET).when(F.max(F.col("toxic") == 1), TOXIC).when(F.max(F.col("quality") == 0), LOW)
    kinds = labels.groupBy(F.col(key).alias("__id")).agg(kind.alias("kind")).filter("kind is not null and __id is not null")
    order = F.xxhash64("__id", F.lit(11))
    return reduce(DataFrame.union, (kinds.filter(F.col("kind") == k).select("__id", "kind", (order % 2 == 0).alias("fits")).orderBy(order, "__id").limit(rows) for k in (TARGET, TOXIC, LOW)))


@dataclass(frozen=True)
class Models:
    """By bucket: log ratio of the target model to the raw model, and of the share of targets with the bucket to that of toxic documents."""

    ratio: np.ndarray
    marks: np.ndarray

    def features(self, text: str | None) -> tuple[float, float]:
        """Mean log ratio, and the mean of the lowest marks."""
        b = buckets(text)
        if not len(b):
            return 0.0, 0.0
        once = np.sort(b)
        once = self.marks[once[np.concatenate(([True], once[1:] != once[:-1]))]]
        most = min(MARKS, len(once))
        lowest = np.partition(once, most - 1)[:most].mean(dtype=np.float64)
        return max(float(self.ratio[b].mean(dtype=np.float64)), LEAST_MEAN), float(lowest)


def fitted(docs: DataFrame, chosen: DataFrame, key: str = "doc_id", text: str = "text") -> Models | None:
    """The models; None without targets. `chosen` has a bounded number of rows and is broadcast."""
    marked = docs.select(F.col(key).alias("__id"), F.col(text).alias("__text")).join(F.broadcast(chosen.filter("fits").select("__id", "kind")), "__id", "left")
    n = 4  # n-grams of all and of targets, targets and toxic documents that have the bucket

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remember.only(_HASHES)
        sums, sizes = np.zeros((n, BUCKETS), np.int64), [0, 0]
        for batch in batches:
            for text_, kind in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                b = buckets(text_)
                np.add.at(sums[0], b, 1)
                if kind == TARGET:
                    np.add.at(sums[1], b, 1)
                if kind in (TARGET, TOXIC):
                    sums[2 + kind, np.unique(b)] += 1
                    sizes[kind] += 1
        for k in np.flatnonzero(sums[0].reshape(-1, CHUNK).any(1)).tolist():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([sums[:, k * CHUNK : (k + 1) * CHUNK].tobytes()], pa.binary())], ["chunk", "sums"])
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([np.pad(np.array(sizes, np.int64), (0, n * CHUNK - 2)).tobytes()], pa.binary())], ["chunk", "sums"])

    def add(groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, total = None, np.zeros(n * CHUNK, np.int64)
        for batch in groups:
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                chunk = k
                total += np.frombuffer(data, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["chunk", "sums"])

    parts = marked.select("__text", "kind").mapInArrow(count, "chunk int, sums binary")
    sums, sizes = np.zeros((n, BUCKETS)), np.zeros(2)
    for row in parts.groupBy("chunk").applyInArrow(add, "chunk int, sums binary").collect():  # BUCKETS numbers a model, whatever the input
        data = np.frombuffer(row["sums"], np.int64)
        if row["chunk"] < 0:
            sizes = data[:2].astype(float)
        else:
            sums[:, row["chunk"] * CHUNK : (row["chunk"] + 1) * CHUNK] = data.reshape(n, CHUNK)
    raw, target = sums[:2]
    if not target.any():
        return None
    share = lambda x: np.log((x + SMOOTHING) / (x.sum() + SMOOTHING * BUCKETS))
    having = [np.log((sums[2 + k] + MARK_SMOOTHING) / (sizes[k] + 2 * MARK_SMOOTHING)) for k in (TARGET, TOXIC)]
    marks = having[TARGET] - having[TOXIC] if sizes[TOXIC] else np.zeros(BUCKETS)
    return Models((share(target) - share(raw)).astype(np.float32), marks.astype(np.float32))


def log_odds(x: np.ndarray, y: np.ndarray, ridge: float = 0.01) -> np.ndarray:
    """Constant and coefficients of a logistic regression of y (0 or 1) on the columns of x, by Newton's method."""
    mean, spread = x.mean(0), x.std(0)
    spread = np.where(spread > 1e-9, spread, np.inf)
    z = np.hstack((np.ones((len(x), 1)), (x - mean) / spread))
    w, hold = np.zeros(z.shape[1]), np.diag([1e-6] + [ridge] * x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + hold, z.T @ (y - p) - hold @ w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    w[1:] /= spread
    w[0] -= w[1:] @ mean
    return w


def best_bound(weights: np.ndarray, y: np.ndarray, cost: float = 1.0) -> float:
    """The bound from which most rows are decided rightly, midway between two weights; the lowest if several do. A row of y = 1 below it counts `cost` times."""
    order = np.argsort(weights, kind="stable")
    v, good = weights[order], y[order]
    # cut i: rows from i on are kept
    right = np.concatenate(([0], np.cumsum(1 - good))) + cost * (good.sum() - np.concatenate(([0], np.cumsum(good))))
    cuts = [0, *(np.flatnonzero(v[1:] > v[:-1]) + 1).tolist()]
    at = max(cuts, key=lambda i: (right[i], -i))
    return float((v[at - 1] + v[at]) / 2) if at else -np.inf


def measured(text: Column, models: Models) -> Column:
    """Struct of mean (log ratio) and marks of a text."""

    @F.arrow_udf("struct<mean:double,marks:double>")
    def measure(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        remember.only(_HASHES)
        for batch in batches:
            x = np.array([models.features(t) for t in batch.to_pylist()], np.float64).reshape(-1, 2)
            yield pa.StructArray.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1])], ["mean", "marks"])

    return measure(text)


def held_out(docs: DataFrame, chosen: DataFrame, models: Models, key: str, text: str) -> tuple[np.ndarray, np.ndarray]:
    """Features and kind of the chosen documents that the models were not fitted on; an id counts once, so the rows are bounded as `chosen`."""
    rows = docs.select(F.col(key).alias("__id"), F.col(text).alias("__text")).join(F.broadcast(chosen.filter("not fits").select("__id", "kind")), "__id")
    found = rows.select("__id", "kind", measured(F.col("__text"), models).alias("x")).groupBy("__id").agg(F.min("kind").alias("kind"), F.min("x").alias("x")).orderBy("__id").select("kind", "x").collect()
    return np.array([tuple(r["x"]) for r in found], float).reshape(len(found), 2), np.array([r["kind"] for r in found], int)


@dataclass(frozen=True)
class Fit:
    """weights: constant and slope of the log weight; bound: what k is counted above, None if every row is to be drawn; toxic_below: bound on marks."""

    weights: np.ndarray
    bound: float | None
    toxic_below: float


def decided(x: np.ndarray, kinds: np.ndarray) -> Fit:
    """What held-out documents say of the slope and the bounds."""
    targets, low, toxic = (x[kinds == k] for k in (TARGET, LOW, TOXIC))
    toxic_below = -np.inf
    if len(targets) and len(toxic):
        toxic_below = best_bound(np.concatenate((targets[:, 1], toxic[:, 1])), np.repeat([1.0, 0.0], [len(targets), len(toxic)]), CLEAN_COST)
    if not len(targets):
        return Fit(AS_IT_IS, None, toxic_below)
    if not len(low):
        lowest, q1, q3 = np.quantile(targets[:, 0], (0.001, 0.25, 0.75))
        return Fit(AS_IT_IS, float(lowest - (q3 - q1)), toxic_below)
    means, y = np.concatenate((targets[:, :1], low[:, :1])), np.repeat([1.0, 0.0], [len(targets), len(low)])
    weights = log_odds(means, y)
    return Fit(weights, best_bound(weights[0] + means @ weights[1:], y), toxic_below)


def gumbel(*of: Column, seed: int) -> Column:
    """Standard Gumbel noise that depends on the row alone, so that a task run again draws the same."""
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *of), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(-F.log(uniform))


def kth_largest(values: DataFrame, column: str, k: int, bins: int = 4096, few: int = 4096) -> float:
    """The k-th largest value of a column without nulls, found by counting in bins; what reaches the driver is bounded by `bins` and `few`."""
    low, high = values.agg(F.min(column), F.max(column)).first()
    while True:
        inside = values.filter(F.col(column).between(low, high))
        if low == high:
            return low
        n = inside.count()
        if n <= few:
            return sorted((r[0] for r in inside.select(column).collect()), reverse=True)[k - 1]
        width = (high - low) / bins
        at = F.least(F.floor((F.col(column) - low) / width), F.lit(bins - 1))
        stats = inside.groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min(column).alias("low"), F.max(column).alias("high")).collect()
        for r in sorted(stats, key=lambda r: -r["bin"]):
            if k <= r["n"]:
                low, high = r["low"], r["high"]
                break
            k -= r["n"]


#: Columns that drawn() makes.
MADE = ("log_weight", "perturbed", "marks")


@dataclass(frozen=True)
class Draw:
    """table: all rows' columns and MADE, written; drawn: the condition that a row is one of the k; toxic: the condition that it is screened."""

    table: DataFrame
    drawn: Column
    toxic: Column


def drawn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label_rows: int = LABEL_ROWS, seed: int = 5, columns: list[str] | None = None) -> Draw:
    """Weighs and draws; the table has `columns` (the key by default). Texts are read twice: for the models, and for the weights."""
    columns = [key] if columns is None else columns
    with batches_of(docs.sparkSession, BATCH_ROWS):
        tables = Tables(docs.sparkSession)
        chosen = tables.written(labelled(labels, label_rows), "targets")
        models = fitted(docs, chosen, key, text)
        fit = Fit(AS_IT_IS, None, -np.inf) if models is None else decided(*held_out(docs, chosen, models, key, text))
        tables.drop(chosen)
        measures = F.struct(F.lit(0.0).alias("mean"), F.lit(0.0).alias("marks")) if models is None else measured(F.col(text), models)
        noise = gumbel(F.col(key), F.col(text), seed=seed)
        kept = docs.select(*dict.fromkeys((key, text, *columns))).drop(*MADE)
        scored = kept.withColumn("__x", measures).withColumn("__noise", noise)
        scored = scored.withColumn("log_weight", F.col("__x")["mean"] * float(fit.weights[1]) + float(fit.weights[0]))
        table = written(scored.select(*(c for c in columns if c not in MADE), "log_weight", (F.col("log_weight") + F.col("__noise")).alias("perturbed"), F.col("__x")["marks"].alias("marks")), "weights")
    toxic = F.col("marks") < fit.toxic_below if np.isfinite(fit.toxic_below) else F.lit(False)
    if fit.bound is None:
        return Draw(table, F.lit(True), toxic)
    k = table.filter(F.col("log_weight") >= float(fit.bound)).count()
    if k == 0:
        return Draw(table, F.lit(False), toxic)
    return Draw(table, F.col("perturbed") >= F.lit(kth_largest(table, "perturbed", k)), toxic)


def resampled(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The drawn documents that aren't toxic, with the columns of `docs`. They are written once with their weights, which costs less than weighing them again."""
    own = {c: f"__own_{c}" for c in MADE if c in docs.columns}
    done = drawn(docs.withColumnsRenamed(own), labels, columns=[own.get(c, c) for c in docs.columns], **options)
    return done.table.filter(done.drawn & ~done.toxic).select(*(F.col(own.get(c, c)).alias(c) for c in docs.columns))

"""Vector code compression by integer product quantisation.

Components become integers, floor(scale * x). A vector is cut into equal consecutive parts; each part position has a
codebook, which starts as that part of the vectors with the smallest ids. A round assigns each part to its codebook's
nearest entry (squared Euclidean distance, ties to the lower index) and replaces each entry by its parts' componentwise
floor(sum / count); an entry without parts stays. All of it is exact arithmetic on integers of 64 bits, so results don't
depend on how rows are partitioned: distances are |x|^2 - 2xc + |c|^2 by integer matrix products over Arrow batches, each
task adds up its parts by entry, and a grouped shuffle merges these sums, parts x entries rows a task whatever its input.
Codebooks, parts x entries x width numbers, are all that the driver holds; they are broadcast for each round.

Defined results: rows whose vector is null or holds null or non-finite components take no part, neither do those of another
length than the commonest (the smallest of several); a vector whose length isn't a multiple of the number of parts counts
as one with zeros at its end; scaled components beyond what keeps errors within 64 bits (`largest`: 185,000 before scaling
at 64 components) count as that bound; with fewer rows than entries there are as many entries as rows; the first entries
go by id, null ids last, then by vector; rows that repeat are all kept; null labels are one label; an empty table gives no
rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Tables, batches_of
from .vectors import commonest_width, finite

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Vectors of an Arrow batch, and of a block whose distances are held at once.
BATCH_ROWS, BLOCK_ROWS = 4096, 2048
#: Labels whose totals are broadcast; more are joined by a shuffle in which each label has SALTS keys.
BROADCAST_LABELS, SALTS = 100_000, 32


def largest(width: int) -> int:
    """Bound on components, such that a sum over a vector of squared differences stays below 2^63."""
    return math.isqrt(2**61 // max(1, width))


def integers(vectors: DataFrame, key: str, vector: str, label: str | None, parts: int = PARTS, scale: int = SCALE) -> DataFrame:
    """id, label and x (array of bigint, a multiple of `parts` long) of the rows that take part."""
    v = F.col(vector).cast("array<double>")
    of = F.col(label) if label else F.lit(None).cast("int")
    rows = vectors.select(F.col(key).alias("id"), of.alias("label"), v.alias("v")).filter(finite(F.col("v")))
    width = commonest_width(rows, "v")
    bound, more = float(largest(width)), -width % parts
    x = F.transform("v", lambda c: F.floor(F.greatest(F.least(c * scale, F.lit(bound)), F.lit(-bound))))
    x = F.concat(x, F.array_repeat(F.lit(0).cast("bigint"), more)) if more else x
    return rows.filter(F.size("v") == width).select("id", "label", x.alias("x"))


@dataclass(frozen=True)
class Codebooks:
    """entries: integers by part, entry, position within the part."""

    entries: np.ndarray

    def sha256(self) -> str:
        """Of all entries' decimal components, joined by commas."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def assigned(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest entry of each part (rows x parts), and each row's squared distance to its entries."""
        parts, _, m = self.entries.shape
        codes, errors = np.empty((len(x), parts), np.int64), np.zeros(len(x), np.int64)
        for p in range(parts):
            book = self.entries[p]
            lengths, turned = (book * book).sum(1), np.ascontiguousarray(book.T)
            for at in range(0, len(x), BLOCK_ROWS):
                part = x[at : at + BLOCK_ROWS, p * m : (p + 1) * m]
                apart = (part * part).sum(1)[:, None] - 2 * (part @ turned) + lengths
                best = apart.argmin(1)  # the first of several
                codes[at : at + BLOCK_ROWS, p] = best
                errors[at : at + BLOCK_ROWS] += apart[np.arange(len(part)), best]
        return codes, errors

    def summed(self, x: np.ndarray, sums: np.ndarray, counts: np.ndarray) -> None:
        """Adds each part to its entry's sum (parts x entries x width) and count."""
        codes, _ = self.assigned(x)
        m = self.entries.shape[2]
        for p in range(len(self.entries)):
            order = np.argsort(codes[:, p], kind="stable")
            entry, first = np.unique(codes[order, p], return_index=True)
            sums[p, entry] += np.add.reduceat(x[order, p * m : (p + 1) * m], first, axis=0)
            counts[p, entry] += np.diff(np.append(first, len(x)))


def matrix(column: pa.Array) -> np.ndarray:
    """A batch's lists, all of one length, as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def first_books(rows: DataFrame, parts: int, entries: int) -> Codebooks | None:
    """Parts of the `entries` first rows; None without rows."""
    first = [r["x"] for r in rows.select("id", "x").orderBy(F.asc_nulls_last("id"), "x").limit(entries).collect()]  # `entries` rows
    if not first:
        return None
    x = np.array(first, np.int64).reshape(len(first), parts, -1)
    return Codebooks(np.ascontiguousarray(x.transpose(1, 0, 2)))


def next_books(rows: DataFrame, books: Codebooks) -> Codebooks:
    """The codebooks after a round."""
    context, shape = rows.sparkSession.sparkContext, books.entries.shape
    shared = context.broadcast(books)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros(shape, np.int64), np.zeros(shape[:2], np.int64)
        for batch in batches:
            if batch.num_rows:
                shared.value.summed(matrix(batch.column(0)), sums, counts)
        part, entry = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(counts[part, entry]), pa.array(list(sums[part, entry]), pa.list_(pa.int64()))], ["part", "entry", "n", "sums"])

    partial = rows.select("x").mapInArrow(add, "part int, entry int, n long, sums array<bigint>")
    totals = F.array(*(F.sum(F.get("sums", F.lit(k))) for k in range(shape[2])))
    merged = partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), totals.alias("sums"))
    new = books.entries.copy()
    for r in merged.collect():  # parts x entries rows at most
        new[r["part"], r["entry"]] = [s // r["n"] for s in r["sums"]]
    shared.unpersist()
    return Codebooks(new)


def trained(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks | None:
    """Codebooks of rows of integers(), which are read `rounds` + 1 times; None without rows."""
    books = first_books(rows, parts, entries)
    for _ in range(rounds if books else 0):
        books = next_books(rows, books)
    return books


def coded(rows: DataFrame, books: Codebooks) -> DataFrame:
    """Adds codes (array of bigint, an index a part) and error (squared distance, summed over parts)."""
    shared = rows.sparkSession.sparkContext.broadcast(books)

    @F.arrow_udf("struct<codes:array<bigint>,error:bigint>")
    def code(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.int64())
        for batch in batches:
            codes, errors = shared.value.assigned(matrix(batch)) if len(batch) else (np.empty((0, 1)), np.empty(0, np.int64))
            yield pa.StructArray.from_arrays([pa.array(list(codes), kind), pa.array(errors, pa.int64())], ["codes", "error"])

    out = rows.withColumn("__coded", code("x"))
    return out.withColumns({"codes": F.col("__coded")["codes"], "error": F.col("__coded")["error"]}).drop("__coded")


def restored(coded_rows: DataFrame, books: Codebooks, scale: int = SCALE) -> DataFrame:
    """Adds restored (array of double): the vector that the codes stand for."""
    shared = coded_rows.sparkSession.sparkContext.broadcast(books)

    @F.arrow_udf("array<double>")
    def restore(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            entries = shared.value.entries
            x = entries[np.arange(len(entries)), matrix(batch)].reshape(len(batch), -1) if len(batch) else np.empty((0, 1))
            yield pa.array(list(x / scale), pa.list_(pa.float64()))

    return coded_rows.withColumn("restored", restore("codes"))


def with_label_errors(rows: DataFrame, tables: Tables) -> DataFrame:
    """Adds label_error, the errors of equal labels (nulls together) summed. A label may have most of the rows: sums are added
    up before they are shuffled, and come back by broadcast or, if labels are many, under SALTS keys a label."""
    totals = tables.written(rows.groupBy(F.col("label").alias("__label")).agg(F.sum("error").alias("label_error")), "label-errors")
    same = F.col("label").eqNullSafe(F.col("__label"))
    if totals.count() <= BROADCAST_LABELS:
        return rows.join(F.broadcast(totals), same).drop("__label")
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64("id", "codes"), F.lit(SALTS)).cast("int"))
    copies = totals.withColumn("__copy", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, same & (F.col("__salt") == F.col("__copy"))).drop("__label", "__salt", "__copy")


def compressed(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str | None = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, Codebooks | None]:
    """id, label, codes, error and label_error of the rows that take part, as written tables, and the codebooks."""
    tables = Tables(vectors.sparkSession)
    with batches_of(vectors.sparkSession, BATCH_ROWS):
        rows = tables.written(integers(vectors, key, vector, label, parts, scale), "integers")
        books = trained(rows, parts, entries, rounds)
        done = coded(rows, books) if books else rows.select("id", "label", F.array().cast("array<bigint>").alias("codes"), F.lit(0).cast("bigint").alias("error"))
        out = tables.written(done.select("id", "label", "codes", "error"), "codes")
    tables.drop(rows)
    return with_label_errors(out, tables), books

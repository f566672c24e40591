"""Token-ID output as a wavelet matrix per shard.

A shard holds the ids of a run of documents in doc_id order: for each bit, from the highest, a plane with that bit of
every token, the tokens being stably partitioned by the bit before the next plane is taken. Ranks before each block of
512 bits are stored beside each plane, so that one compressed file gives access to a token, counts of an id and the
place of its k-th occurrence.

File: b"QWM1", header length (uint32), JSON header, then the sections that the header lists, each compressed with
Zstandard. All numbers are little-endian.

Defined results: a null text encodes as an empty one; a null doc_id sorts first and is kept; rows that repeat a doc_id
are all kept, in text order; an empty table gives a folder without shards and an empty result; other columns are not
read.
"""

from __future__ import annotations

import gc
import json
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import remember
from .bpe import byte_alphabet
from .chunks import Chunked, packed, splitter

MAGIC = b"QWM1"
BLOCK = 512
#: Tokens after which a shard is closed; a longer document is a shard of its own.
SHARD_TOKENS = 2_000_000


def planes_of(ids: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, int]]:
    """From the highest bit: the packed plane, and how many of its bits are 0."""
    now = ids
    for bit in range(bits - 1, -1, -1):
        if bit == 7:
            now = now.astype(np.uint8)  # half as much to move
        plane = (now & now.dtype.type(1 << bit)).astype(bool)
        zeros = np.compress(~plane, now)
        yield np.packbits(plane, bitorder="little"), len(zeros)
        if bit:
            now = np.concatenate((zeros, np.compress(plane, now)))


def block_ranks(plane: np.ndarray) -> np.ndarray:
    """Ones before each block of BLOCK bits."""
    size = BLOCK // 8
    full = np.zeros(-(-len(plane) // size) * size, np.uint8)
    full[: len(plane)] = plane
    return np.concatenate(([0], np.cumsum(np.bitwise_count(full).reshape(-1, size).sum(1, dtype=np.uint32), dtype=np.uint32))).astype("<u4")


def to_file(ids: np.ndarray, doc_ids: list[int | None], starts: np.ndarray, order: tuple[int, int]) -> bytes:
    """The file of one shard. starts: where each document begins; order: the shard's place among the shards."""
    import zstandard

    pack = zstandard.ZstdCompressor(level=1).compress
    bits = max(1, int(ids.max(initial=0)).bit_length())
    ids = ids.astype(np.uint16 if bits <= 16 else np.uint32)
    body, sections = [], []

    def add(name: str, data: bytes) -> None:
        body.append(pack(data))
        sections.append([name, len(body[-1])])

    known = np.array([d is not None for d in doc_ids], np.uint8)
    add("doc_ids", np.array([d or 0 for d in doc_ids], "<i8").tobytes())
    add("known", known.tobytes())
    add("starts", starts.astype("<u4").tobytes())
    zeros = []
    for k, (plane, z) in enumerate(planes_of(ids, bits)):
        add(f"plane{k}", plane.tobytes())
        add(f"ranks{k}", block_ranks(plane).tobytes())
        zeros.append(z)
    head = json.dumps({"tokens": len(ids), "documents": len(doc_ids), "bits": bits, "order": order, "zeros": zeros, "sections": sections}).encode()
    return b"".join([MAGIC, struct.pack("<I", len(head)), head, *body])


class Shard:
    """Reads a shard's file; a section is decompressed when it is first needed."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a shard file")
        (n,) = struct.unpack_from("<I", data, 4)
        self.head = json.loads(bytes(data[8 : 8 + n]))
        self.tokens, self.bits, self.zeros, self.order = (self.head[k] for k in ("tokens", "bits", "zeros", "order"))
        self._data, self._at, self._open, at = data, {}, {}, 8 + n
        for name, size in self.head["sections"]:
            self._at[name] = at, size
            at += size
        self.length = at

    def section(self, name: str, kind: str) -> np.ndarray:
        if name not in self._open:
            import zstandard

            at, size = self._at[name]
            self._open[name] = np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(self._data[at : at + size]), max_output_size=1 << 31), kind)
        return self._open[name]

    def documents(self) -> list[int | None]:
        return [d if k else None for d, k in zip(self.section("doc_ids", "<i8").tolist(), self.section("known", "u1").tolist(), strict=True)]

    def starts(self) -> np.ndarray:
        return self.section("starts", "<u4")

    def _bit(self, k: int, i: int) -> int:
        return int(self.section(f"plane{k}", "u1")[i >> 3] >> (i & 7)) & 1

    def _ones(self, k: int, i: int) -> int:
        """Ones among the first i bits of plane k."""
        plane, block = self.section(f"plane{k}", "u1"), i // BLOCK
        n = int(self.section(f"ranks{k}", "<u4")[block]) + int(np.bitwise_count(plane[block * BLOCK // 8 : i >> 3]).sum())
        return n + (int(plane[i >> 3] & ((1 << (i & 7)) - 1)).bit_count() if i & 7 else 0)

    def access(self, i: int) -> int:
        """Token i."""
        out = 0
        for k in range(self.bits):
            one, before = self._bit(k, i), self._ones(k, i)
            out = out << 1 | one
            i = self.zeros[k] + before if one else i - before
        return out

    def _range(self, token: int, low: int, high: int) -> tuple[int, int]:
        for k in range(self.bits):
            a, b = self._ones(k, low), self._ones(k, high)
            low, high = (self.zeros[k] + a, self.zeros[k] + b) if token >> (self.bits - 1 - k) & 1 else (low - a, high - b)
        return low, high

    def count(self, token: int, low: int = 0, high: int | None = None) -> int:
        """Occurrences of an id among tokens low to high."""
        if token >> self.bits:
            return 0
        a, b = self._range(token, low, self.tokens if high is None else high)
        return b - a

    def _select(self, k: int, one: int, n: int) -> int:
        """Place of the n-th (from 0) bit of plane k that is `one`."""
        ranks = self.section(f"ranks{k}", "<u4").astype(np.int64)
        if not one:
            ranks = np.arange(len(ranks)) * BLOCK - ranks
        block = int(np.searchsorted(ranks, n, side="right")) - 1
        part = np.unpackbits(self.section(f"plane{k}", "u1")[block * BLOCK // 8 : (block + 1) * BLOCK // 8], bitorder="little")
        return block * BLOCK + int(np.flatnonzero(part == one)[n - int(ranks[block])])

    def find(self, token: int, n: int = 0) -> int | None:
        """Place of the n-th (from 0) occurrence of an id; None if there are fewer."""
        if token >> self.bits or not 0 <= n < self.count(token):
            return None
        i = self._range(token, 0, self.tokens)[0] + n
        for k in range(self.bits - 1, -1, -1):
            one = token >> (self.bits - 1 - k) & 1
            i = self._select(k, one, i - self.zeros[k] if one else i)
        return i

    def ids(self) -> np.ndarray:
        """All tokens: the partitions are undone from the last plane to the first."""
        out = np.zeros(self.tokens, np.uint8)
        for k in range(self.bits - 1, -1, -1):
            bit = self.bits - 1 - k
            if bit in (8, 16):
                out = out.astype(np.uint16 if bit == 8 else np.uint32)
            plane = np.unpackbits(self.section(f"plane{k}", "u1"), count=self.tokens, bitorder="little").view(bool)
            back = np.empty_like(out)
            back[np.flatnonzero(~plane)] = out[: self.zeros[k]]
            back[np.flatnonzero(plane)] = out[self.zeros[k] :] | out.dtype.type(1 << bit)
            out = back
        return out


def shards_in(data: bytes) -> Iterator[Shard]:
    """The shards of a file: Spark's writer ends each with a line feed."""
    at, view = 0, memoryview(data)
    while at < len(data):
        shard = Shard(view[at:])
        yield shard
        at += shard.length + 1


class JsonTokenizer:
    """From the text of a byte-level tokenizer file of that library: packed ids, as its encode() without added special tokens gives them."""

    def __init__(self, text: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_str(text)
        merges = self.whole.model
        if hasattr(merges, "_resize_cache"):
            merges._resize_cache(0)  # pre-tokens are remembered here
        letters = {b: ord(c) for b, c in byte_alphabet().items()}
        # added tokens are cut out of a text before the pattern splits it: such texts are left to the library as they are
        self.added = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.chunked = Chunked(splitter(PATTERN), lambda t: [x.id for x in merges.tokenize(t.encode().decode("latin-1").translate(letters))])

    def encode(self, text: str | None) -> bytes:
        if text and any(t in text for t in self.added):
            return packed(self.whole.encode(text, add_special_tokens=False).ids)
        return self.chunked.encode(text)


_TOKENIZERS: dict[int, JsonTokenizer] = remember.kept({})


def write_shards(docs: DataFrame, path: str, tokenizer: str, end_id: int, shard_tokens: int = SHARD_TOKENS, key: str = "doc_id", text: str = "text") -> None:
    """Writes a file per shard to `path`, in ascending order of the key. tokenizer: the text of a byte-level tokenizer file."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remember.only(_TOKENIZERS)
        if hash(tokenizer) not in _TOKENIZERS:
            _TOKENIZERS.clear()
            _TOKENIZERS[hash(tokenizer)] = JsonTokenizer(tokenizer)
        encoder, end = _TOKENIZERS[hash(tokenizer)], np.array([end_id], "<u4").tobytes()
        part, number, docs_, parts, sizes = TaskContext.get().partitionId(), 0, [], [], []

        def close() -> pa.RecordBatch:
            starts = np.concatenate(([0], np.cumsum(sizes)))[:-1]
            data = to_file(np.frombuffer(b"".join(parts), "<u4"), docs_, starts, (part, number))
            return pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], ["data"])

        gc.disable()  # nothing here has cycles, and the many small lists would have them looked for again and again
        for batch in (b.slice(i, 500) for b in batches for i in range(0, b.num_rows, 500)):
            for doc, ids in zip(batch.column(0).to_pylist(), map(encoder.encode, batch.column(1).to_pylist()), strict=True):
                if docs_ and sum_ + len(ids) // 4 + 1 > shard_tokens:
                    yield close()
                    number, docs_, parts, sizes = number + 1, [], [], []
                sum_ = (sum_ if docs_ else 0) + len(ids) // 4 + 1
                docs_.append(doc)
                parts += (ids, end)
                sizes.append(len(ids) // 4 + 1)
        gc.enable()
        if docs_:
            yield close()

    rows = docs.select(F.col(key), F.col(text)).repartitionByRange(key).sortWithinPartitions(key, text)
    made = rows.mapInArrow(build, "data binary").select(F.col("data").cast("string").alias("value"))
    made.write.option("lineSep", "\n").option("maxRecordsPerFile", 1).text(path)


READ = T.StructType([T.StructField(n, t) for n, t in (("part", T.IntegerType()), ("number", T.IntegerType()), ("shard_tokens", T.LongType()), ("place", T.LongType()), ("doc_id", T.LongType()), ("n_tokens", T.LongType()), ("ids_crc32", T.LongType()))])


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """A row per document of the files: the shard's place (part, number) and tokens, the document's place in it, its tokens and their CRC-32."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                for shard in shards_in(data.as_buffer()):
                    ids, starts, doc_ids = shard.ids().astype("<u4"), shard.starts().astype(np.int64), shard.documents()
                    sizes = np.diff(np.append(starts, shard.tokens))
                    crc = [zlib.crc32(ids[a : a + n].tobytes()) for a, n in zip(starts.tolist(), sizes.tolist(), strict=True)]
                    n = len(doc_ids)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, shard.order[0], np.int32)), pa.array(np.full(n, shard.order[1], np.int32)), pa.array(np.full(n, shard.tokens)), pa.array(starts), pa.array(doc_ids, pa.int64()), pa.array(sizes), pa.array(crc, pa.int64())], READ.names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(read, READ)


def with_starts(read: DataFrame) -> DataFrame:
    """Adds `start`, the tokens of all documents before. `read` is used twice: give a written table. One row per shard is ordered alone."""
    from pyspark.sql import Window

    shards = read.groupBy("part", "number").agg(F.first("shard_tokens").alias("of_shard"))
    before = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    offsets = shards.select("part", "number", F.coalesce(F.sum("of_shard").over(before), F.lit(0)).alias("offset"))
    return read.join(offsets, ["part", "number"]).withColumn("start", F.col("offset") + F.col("place")).drop("offset")

"""Byte-level BPE encoding and decoding.

The sentencepiece model is serialised here from a rank file, without training: each token's bytes become a piece of
the printable byte alphabet, scored by its negative rank, so that the library's best-score-first merges are the
rank-order merges. Normalisation is the identity; text is split by the pattern first and each match is encoded alone.

Defined results: a null text encodes as an empty one (no ids, no bytes); texts of any length are encoded whole;
repeated rows are encoded alike; an empty table gives an empty table. Columns named as an output are replaced.
"""

from __future__ import annotations

import base64
import struct
import sys
from array import array
from collections.abc import Iterator
from functools import cached_property, lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import remember
from .chunks import Chunked, splitter
from .store import batches_of, written

#: Documents of an Arrow batch at most: their ids take half again as much memory as their text, in the JVM and in Python.
BATCH_ROWS = 1000


@lru_cache(1)
def byte_alphabet() -> dict[int, str]:
    """A printable character for each byte: its own where Latin-1 prints it, else the next from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = iter(range(256, 512))
    return {b: chr(b) if b in own else chr(next(others)) for b in range(256)}


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file's tokens: base64 of the bytes and the rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def model_proto(ranks: dict[bytes, int]) -> bytes:
    """The serialised sentencepiece model; piece i is the token of rank i, and the one after the last is unknown."""
    tokens = sorted(ranks, key=ranks.get)
    if [ranks[t] for t in tokens] != list(range(len(tokens))):
        raise ValueError("ranks must be 0, 1, 2 ...")
    if missing := [b for b in range(256) if bytes([b]) not in ranks]:
        raise ValueError(f"bytes without a rank: {missing[:5]}")
    letters = byte_alphabet()
    out = []
    for i, t in enumerate(tokens):
        piece = "".join(letters[b] for b in t)
        out.append(_field(1, _text(1, piece) + b"\x15" + struct.pack("<f", -float(i))))
    out.append(_field(1, _text(1, "<unk>") + b"\x15" + struct.pack("<f", 0.0) + _number(3, 2)))
    trainer = _number(3, 2) + _number(4, len(tokens) + 1) + _number(40, len(tokens)) + b"".join(_number(k, -1) for k in (41, 42, 43))
    normalizer = _text(1, "identity") + _number(3, 0) + _number(4, 0) + _number(5, 0)
    return b"".join(out) + _field(2, trainer) + _field(3, normalizer)


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, body: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(body)) + body


def _text(number: int, body: str) -> bytes:
    return _field(number, body.encode())


def _number(number: int, value: int) -> bytes:
    return _varint(number << 3) + _varint(value)


class Codec:
    """Encodes and decodes with a serialised model; `pattern` splits texts into pre-tokens."""

    def __init__(self, model: bytes, pattern: str):
        import sentencepiece

        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
        letters = {b: ord(c) for b, c in byte_alphabet().items()}
        encode = self.pieces.encode_as_ids
        self.chunked = Chunked(splitter(pattern), lambda t: encode(t.encode().decode("latin-1").translate(letters)))

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return self.chunked.encode(text)

    def decode(self, ids: bytes | None) -> bytes:
        """The bytes of packed ids; null ids have none."""
        numbers = array("I", ids or b"")
        if sys.byteorder == "big":
            numbers.byteswap()
        return b"".join(map(self.table.__getitem__, numbers))

    @cached_property
    def table(self) -> list[bytes]:
        """Bytes of each id, by the inverse of the alphabet."""
        back = {c: b for b, c in byte_alphabet().items()}
        return [bytes(back[c] for c in self.pieces.id_to_piece(i)) for i in range(self.pieces.get_piece_size() - 1)]


_CODECS: dict[tuple[int, str], Codec] = remember.kept({})


def _codec(model: bytes, pattern: str) -> Codec:
    """One for each Python worker: what it remembers serves the next task too."""
    remember.only(_CODECS)
    key = hash(model), pattern
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(model, pattern)
    return _CODECS[key]


def encoded(text: Column, model: bytes, pattern: str) -> Column:
    """Packed ids (binary) of a text column."""

    @F.arrow_udf("binary")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = _codec(model, pattern)
        for batch in batches:
            yield pa.array((codec.encode(x.as_py()) for x in batch), pa.binary())

    return encode(text)


def decoded(ids: Column, model: bytes, pattern: str) -> Column:
    """Bytes of a column of packed ids; null ids decode to no bytes."""

    @F.arrow_udf("binary")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = _codec(model, pattern)
        for batch in batches:
            yield pa.array((codec.decode(x.as_py()) for x in batch), pa.binary())

    return decode(ids)


def round_trip(text: Column, model: bytes, pattern: str) -> Column:
    """Struct of ids (packed) and decoded (the bytes that these ids decode to), in one worker."""

    @F.arrow_udf("struct<ids:binary,decoded:binary>")
    def code(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = _codec(model, pattern)
        for batch in batches:
            ids = [codec.encode(x.as_py()) for x in batch]
            yield pa.StructArray.from_arrays([pa.array(ids, pa.binary()), pa.array(map(codec.decode, ids), pa.binary())], ["ids", "decoded"])

    return code(text)


def encode_documents(docs: DataFrame, model: bytes, pattern: str, text: str = "text") -> DataFrame:
    """Adds `token_ids` (binary, packed little-endian uint32) and `n_tokens`. Run what uses it inside store.batches_of(spark,
    BATCH_ROWS): Arrow batches by the ten thousand rows, as Spark makes them by default, are much memory outside the heap."""
    out = docs.withColumn("token_ids", encoded(F.col(text), model, pattern))
    return out.withColumn("n_tokens", (F.octet_length("token_ids") / 4).cast("long"))


def decode_documents(docs: DataFrame, model: bytes, pattern: str, ids: str = "token_ids") -> DataFrame:
    """Adds `decoded` (binary), the bytes of the text that the ids came from."""
    return docs.withColumn("decoded", decoded(F.col(ids), model, pattern))


def digests(docs: DataFrame, model: bytes, pattern: str, text: str = "text") -> DataFrame:
    """The other columns, n_tokens, and SHA-256 of the ids and of the bytes decoded from them, as a written table."""
    coded = docs.withColumn("__coded", round_trip(F.col(text), model, pattern))
    ids, back = F.col("__coded")["ids"], F.col("__coded")["decoded"]
    made = {"n_tokens": (F.octet_length(ids) / 4).cast("long"), "ids_sha256": F.sha2(ids, 256), "decoded_sha256": F.sha2(back, 256)}
    with batches_of(docs.sparkSession, BATCH_ROWS):
        return written(coded.withColumns(made).drop("__coded", text), "bpe")

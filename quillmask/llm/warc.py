"""WARC archives with revisit resolution.

Headers (id, payload digest) are shuffled by digest; of the records with equal payloads the one with the largest id
stays a response and the others become revisit records that refer to it. Archives are then written with fresh headers:
new record ids, lengths and digests. A revisit record has the HTTP header of its response, without the payload.

Payloads stay where they are: bitmaps of repeated digests, and of those digests with their responses' ids, part the records
that are written as they are from those that are joined. Revisits are joined by their headers alone; of payloads only those
of responses that others refer to (and a few that the bitmaps take for such) are shuffled.

Defined results: a null payload is an empty one; payloads of fewer than `least` bytes are never resolved; records that
repeat both id and payload are all responses; a record without an id is a revisit if another of its payload has one,
else a response; an empty table gives an archive folder without records; payloads may hold any bytes, record ends
included, as the reader goes by Content-Length. Other columns are not read.

A record's id names the run (drawn anew for each call), the payload's digest and the row's id, and for rows that may share
these a number of their own, so that no two records have one id. Of records that repeat both id and payload one is without
that number, and it is the one that revisits name.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator
from datetime import UTC, datetime
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .sieve import bitmap, sieved
from .store import Tables

#: Records of a file at most.
FILE_RECORDS = 2_000
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(data: Column) -> Column:
    """Upper-case base32 of the SHA-1: ten hexadecimal digits are eight of base 32, which have other letters here."""
    digest = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(digest, 10 * k + 1, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def headers(pages: DataFrame, key: str, payload: str) -> DataFrame:
    """record, url, payload (null: empty), payload_bytes, digest (20 bytes), payload_digest."""
    body = F.coalesce(F.col(payload), F.lit(""))
    rows = pages.select(F.col(key).cast("long").alias("record"), F.col("url").cast("string").alias("url"), body.alias("payload"))
    data = F.col("payload").cast("binary")
    return rows.select("*", F.octet_length("payload").cast("long").alias("payload_bytes"), F.unhex(F.sha1(data)).alias("digest"), base32_sha1(data).alias("payload_digest"))


def resolved(records: DataFrame, least: int) -> DataFrame:
    """Adds `original`: the record that a revisit refers to, null for responses; and `copy`: null, or a number that no other
    record of this id and payload has. Revisits have no payload."""
    tables = Tables(records.sparkSession)
    large = records.filter(F.col("payload_bytes") >= least)
    equal = large.groupBy("digest", "record").agg(F.count(F.lit(1)).alias("n"))
    groups = tables.written(equal.groupBy("digest").agg(F.max("record").alias("largest"), F.sum("n").alias("n"), F.max_by("n", "record").alias("ties")), "digests")
    repeated = tables.written(bitmap(groups.filter("n > 1 and largest is not null"), "digest"), "bits")
    # all digests that the bitmap takes for repeated ones; those that aren't have a response of their own
    known = tables.written(sieved(groups, "digest", repeated).select("digest", "largest", "ties"), "repeated")
    pair = lambda record: F.xxhash64("digest", record)
    first = tables.written(bitmap(known.select(pair("largest").alias("pair")), "pair"), "bits")
    alone = sieved(large, "digest", repeated, has=False).withColumn("copy", F.when(F.col("record").isNull(), F.monotonically_increasing_id()))
    small = records.filter(F.col("payload_bytes") < least).withColumn("copy", F.monotonically_increasing_id())
    paired = sieved(large, "digest", repeated).withColumn("pair", pair("record"))
    perhaps = sieved(paired, "pair", first).join(known, "digest")
    never = sieved(paired, "pair", first, has=False).withColumn("payload", F.lit("")).join(known, "digest")
    is_largest = F.col("largest").eqNullSafe(F.col("record"))
    original = F.when(~is_largest, F.col("largest"))
    tied = is_largest & F.col("record").isNotNull() & (F.col("ties") > 1)
    # numbers are fixed by writing them, so that one of each tie can be told
    ties = tables.written(perhaps.filter(tied).withColumn("row", F.monotonically_increasing_id()), "ties")
    least_row = ties.groupBy("digest").agg(F.min("row").alias("row")).select("row", F.lit(True).alias("named"))
    told = ties.join(least_row, "row", "left").withColumn("copy", F.when(F.col("named").isNull(), F.col("row")))
    numbered = F.when(~is_largest | F.col("record").isNull(), F.monotonically_increasing_id())
    columns = ["record", "url", "payload", "payload_bytes", "payload_digest"]
    out = alone.union(small).select(*columns, F.lit(None).cast("long").alias("original"), "copy")
    for part in (perhaps.filter(~tied).withColumn("copy", numbered), told, never.withColumn("copy", numbered)):
        out = out.union(part.select(*columns, original.alias("original"), "copy"))
    return out


def record_uri(record: Column, copy: Column, run: str) -> Column:
    return F.concat(F.lit(f"<urn:quillmask:{run}:"), F.concat_ws(":", F.col("payload_digest"), F.coalesce(record.cast("string"), F.lit("none")), copy.cast("string")), F.lit(">"))


def record_text(run: str, date: str) -> Column:
    """The record without the empty lines that end it."""
    eol, revisit = "\r\n", F.col("original").isNotNull()
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{eol}Content-Type: text/html; charset=utf-8{eol}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(eol + eol))
    length = F.octet_length(http) + F.when(revisit, F.lit(0)).otherwise(F.col("payload_bytes"))
    field = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(eol))
    uri = F.regexp_replace(F.coalesce(F.col("url"), F.lit("about:blank")), r"[\x00-\x20\x7f]", "%20")
    return F.concat(
        F.lit(f"WARC/1.1{eol}"),
        field("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        field("WARC-Record-ID", record_uri(F.col("record"), F.col("copy"), run)),
        field("WARC-Date", F.lit(date)),
        field("WARC-Target-URI", uri),
        field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        F.when(revisit, F.concat(field("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), field("WARC-Refers-To", record_uri(F.col("original"), F.lit(None), run)))).otherwise(F.lit("")),
        field("Content-Type", F.lit("application/http; msgtype=response")),
        field("Content-Length", length.cast("string")),
        F.lit(eol),
        http,
        F.when(revisit, F.lit("")).otherwise(F.col("payload")),
    )


def write_archives(pages: DataFrame, path: str, key: str = "page_id", payload: str = "html", least: int = 0, run: str | None = None, date: str | None = None) -> None:
    """Writes gzip archives, one record for each row, to `path`. run and date (by default drawn, and now) stand in every record."""
    run, date = run or uuid.uuid4().hex, date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    records = resolved(headers(pages, key, payload), least)
    rows = records.select(record_text(run, date).alias("value"))
    rows.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path)


READ = T.StructType([T.StructField(n, t) for n, t in (("page_id", T.LongType()), ("url", T.StringType()), ("payload_bytes", T.LongType()), ("payload_digest", T.StringType()), ("record_type", T.StringType()), ("refers_to", T.LongType()), ("payload", T.BinaryType()))])


def parse(archive: BinaryIO) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """WARC header fields (lower-case names), HTTP header and payload of each record of an archive, one after another."""
    while version := archive.readline():
        if not version.startswith(b"WARC/"):
            raise ValueError(f"no record begins with {version[:40]!r}")
        fields = {}
        while line := archive.readline().rstrip(b"\r\n"):
            name, _, value = line.decode().partition(":")
            fields[name.lower()] = value.strip()
        block = archive.read(int(fields["content-length"]))
        cut = block.index(b"\r\n\r\n") + 4
        yield fields, block[:cut], block[cut:]
        archive.read(4)


def own_id(uri: str | None) -> int | None:
    """The row's id in a record's id: run, digest, id and perhaps a number follow the two names of the scheme."""
    parts = (uri or "").strip("<>").split(":")
    return int(parts[4]) if len(parts) > 4 and parts[4].lstrip("-").isdigit() else None


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """A row per record. A response's length and digest are those of the payload read, a revisit's those that its headers have of the full payload."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                rows, held = [], 0
                for fields, http, payload in parse(gzip.open(io.BytesIO(data.as_buffer()))):
                    kind, named = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:")
                    size = int(next(x for x in http.decode("latin-1").split("\r\n") if x.lower().startswith("content-length:")).partition(":")[2])
                    if kind == "response":
                        size, found = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
                        if found != named:
                            raise ValueError(f"payload of {fields['warc-record-id']} doesn't have its digest")
                    rows.append((own_id(fields["warc-record-id"]), fields["warc-target-uri"], size, named, kind, own_id(fields.get("warc-refers-to")), payload if kind == "response" else None))
                    held += len(payload)
                    if held > 8_000_000:
                        yield _batch(rows)
                        rows, held = [], 0
                yield _batch(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(read, READ)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], READ.names)

"""WARC archives: written as one gzip member per record, read back by tasks that each scan a range of bytes.

Spark's text writer writes the archives, so task retries, commits and any Hadoop store work as for other tables: a
row holds the bytes of some whole members, and the separator after a row is an empty gzip member, which
decompresses to nothing. The reader needs no index. A task looks for gzip's magic bytes in its range, takes a
place for a record only if what it decompresses to begins with a well-formed WARC header, and owns the records
that start inside its range, reading past the end for the last one's remainder.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAGIC = b"\x1f\x8b\x08"
EMPTY_MEMBER = b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\xff\x03\x00\x00\x00\x00\x00\x00\x00\x00\x00"
READ_AT_ONCE = 1 << 20
MOST_HEADER = 1 << 16
MOST_TASKS = 20_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SCHEMA = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None, revisit: bool = False, date: str = "2024-01-01T00:00:00Z") -> bytes:
    """One WARC record as a gzip member. A revisit has the headers of its response, with the payload's length, but no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:x-page:{'' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {quote(url, safe=''.join(map(chr, range(33, 127))).replace('%', ''))}")
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:x-page:{'' if refers_to is None else refers_to}>"]
    lines += [f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", ""]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode() + block + b"\r\n\r\n") + packer.flush()


def parse(raw: bytes) -> dict | None:
    """The record that these decompressed bytes are, or None."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    if not gap or not re.match(rb"WARC/\d+\.\d+\r\n", head):
        return None
    named = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])}
    length = named.get("content-length", "")
    if not length.isdigit() or "warc-type" not in named or len(rest) < int(length):
        return None
    http, _, payload = rest[: int(length)].partition(b"\r\n\r\n")
    said = re.search(rb"(?im)^content-length:\s*(\d+)", http)
    own = lambda name: int(m[1]) if (m := re.fullmatch(r"<urn:x-page:(-?\d+)>", named.get(name, ""))) else None
    revisit = named["warc-type"] == "revisit"
    return {
        "page_id": own("warc-record-id"), "url": unquote(named["warc-target-uri"]) if "warc-target-uri" in named else None, "record_type": named["warc-type"], "refers_to": own("warc-refers-to"),
        "payload_digest": named.get("warc-payload-digest", "").removeprefix("sha1:") if revisit else base32_sha1(payload), "payload_bytes": int(said[1]) if revisit and said else len(payload), "payload": None if revisit else payload,
    }


def scan(source, start: int, end: int) -> Iterator[dict]:
    """The records that start in `[start, end)` of a seekable file, each read whole."""
    source.seek(start)
    held, at = b"", start  # `held` begins at the file's byte `at`

    def more() -> bool:
        nonlocal held
        new = source.read(READ_AT_ONCE)
        held += new
        return bool(new)

    def member(i: int) -> tuple[bytes, int] | None:
        """What the member at held[i] decompresses to and where it ends; None unless it begins as a WARC record."""
        packer, out, j, checked = zlib.decompressobj(31), bytearray(), i, False
        while not packer.eof:
            if j >= len(held) and not more():
                return None
            step = held[j : j + (MOST_HEADER if checked else 512)]
            try:
                out += packer.decompress(step)
            except zlib.error:
                return None
            j += len(step)
            if len(out) >= 5:
                if out[:5] != b"WARC/":
                    return None
                checked = True
        return bytes(out), j - len(packer.unused_data)

    while True:
        i = held.find(MAGIC)
        if i < 0:
            keep = min(len(held), len(MAGIC) - 1)
            at, held = at + len(held) - keep, held[len(held) - keep :]
            if at >= end or not more():
                return
            continue
        if at + i >= end:
            return
        at, held = at + i, held[i:]
        found = member(0)
        parsed = parse(found[0]) if found else None
        step = found[1] if parsed else 1
        at, held = at + step, held[step:]
        if parsed:
            yield parsed


def with_revisits(pages: DataFrame, page_id: str = "page_id", url: str = "url", payload: str = "html", least_bytes: int = 0) -> DataFrame:
    """`(page_id, url, payload, record_type, refers_to)`: the response of equal payloads is that of the smallest page_id.

    Null payloads count as empty. Payloads under `least_bytes` are all responses. Rows that share a digest's smallest
    page_id are responses too, and so is a row without page_id; digests of which no row has a page_id are responses.
    """
    own = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(payload).cast("string"), F.lit("")).cast("binary").alias("payload"))
    own = own.withColumn("_digest", F.unhex(F.sha1("payload")))
    first = own.where(F.octet_length("payload") >= least_bytes).groupBy("_digest").agg(F.min("page_id").alias("_first"), F.max("page_id").alias("_last")).where("_first < _last")
    joined = own.join(first.withColumnRenamed("_digest", "_of"), F.col("_digest") == F.col("_of"), "left")
    again = F.coalesce(F.col("page_id") > F.col("_first"), F.lit(False))
    return joined.select("page_id", "url", "payload", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("_first")).alias("refers_to"))


def write(records: DataFrame, path: str, chunk_bytes: int = 1 << 20) -> None:
    """Write `with_revisits`'s rows as archives `part-*` under `path`, a file for each partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        size = 0
        for batch in batches:
            for row in range(batch.num_rows):
                page_id, url, payload, kind, refers_to = (batch.column(k)[row].as_py() for k in range(5))
                held.append(record(page_id, url, payload, refers_to, kind == "revisit"))
                size += len(held[-1])
                if size >= chunk_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["members"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["members"])

    members = records.select("page_id", "url", "payload", "record_type", "refers_to").mapInArrow(run, "members binary")
    writer = members.select(F.col("members").cast("string")).write.option("encoding", "ISO-8859-1").option("lineSep", EMPTY_MEMBER.decode("latin-1"))
    writer.mode("errorifexists").text(path)


def splits(spark: SparkSession, path: str, split_bytes: int = 8 << 20) -> DataFrame:
    """`(path, start, end)`: the byte ranges of all archives under `path`; no file is opened."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "length").where("length > 0")
    starts = files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(split_bytes).cast("long"))).alias("start"))
    return starts.select("path", "start", F.least(F.col("start") + split_bytes, "length").alias("end"))


def read(spark: SparkSession, path: str, split_bytes: int = 8 << 20) -> DataFrame:
    """Every record of the archives under `path` once, whatever the splits; a revisit's payload is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        kinds = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())])
        for batch in batches:
            for uri, start, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                store, name = fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", uri))
                with store.open_input_file(name) as source:
                    rows, size = [], 0
                    for r in scan(source, start, end):
                        rows.append(r)
                        size += len(r["payload"] or b"")
                        if size > READ_AT_ONCE or len(rows) >= 1000:
                            yield pa.RecordBatch.from_pylist(rows, kinds)
                            rows, size = [], 0
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, kinds)

    ranges = splits(spark, path, split_bytes)
    tasks = max(1, min(ranges.count(), MOST_TASKS))  # a given number, else small rows of large ranges meet in one task
    return ranges.repartition(tasks).mapInArrow(run, SCHEMA)


def digest_columns(records: DataFrame) -> list[Column]:
    return [F.col(c) for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")]

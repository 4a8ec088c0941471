"""WARC archives with an index written first and read by coalesced byte ranges.

Writing: each task streams its pages into gzip members, one per record, and returns an index row (file, offset, length,
URL, digest) for each. Reading: index rows are ordered by file and offset, neighbouring ranges are joined up to a size
limit, and each joined range is one read.

Of records with equal payloads of at least MIN_PAYLOAD bytes, that with the largest page_id is the response and the
others are revisits without payload; their HTTP header keeps the payload's length.

Digests with more than 1/1000 of all rows (1000 at most, by counting) are looked up by broadcast and their rows spread by
page; the other digests are joined by shuffle, where none is large.

Defined results: null html is the empty payload; null page_ids lose to others, and if all are null every record is a
response; rows that repeat the winning page_id are all responses; a null URL is written as urn:unknown and stays null in
the index; other columns are ignored. An empty table writes no archive.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkmill.llm.common import arrow_limits, filesystem, materialize, partitions, scratch, table

MIN_PAYLOAD = 1000
#: Bytes of an archive file, of the gap that a joined read may skip, and of a joined read.
FILE_BYTES, GAP_BYTES, READ_BYTES = 256 << 20, 64 << 10, 8 << 20
DATE = "1970-01-01T00:00:00Z"
HOT_SHARE = 1000
_INDEX = "page_id long, url string, file string, offset long, length long, payload_digest string, record_type string, refers_to long"


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def build_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record: WARC/1.1 header, HTTP header and, for a response, the payload."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id, digest)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {'urn:unknown' if url is None else quote(url, safe=':/?#[]@!$&()*+,;=%~' + chr(39))}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page-Id: {refers_to}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """The fields of one record; raises if a response's payload doesn't match its digest."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
    if kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError(f"payload of {fields['WARC-Record-ID']} doesn't match its digest")
    number = lambda x: None if x is None else int(x)
    return {
        "page_id": number(fields.get("X-Page-Id")), "payload_bytes": int(re.search(rb"Content-Length: (\d+)", http)[1]), "payload_digest": digest,
        "record_type": kind, "refers_to": number(fields.get("X-Refers-To-Page-Id")), "url": fields["WARC-Target-URI"], "payload": payload if kind == "response" else None,
    }


def plan_records(pages: DataFrame, min_payload: int = MIN_PAYLOAD) -> DataFrame:
    """page_id, url, html, payload_digest, refers_to (null for responses)."""
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), html.alias("html"), F.sha1(html).alias("payload_digest"), (F.octet_length(html) >= min_payload).alias("large"))
    copies = rows.where("large").groupBy("payload_digest").agg(F.count("*").alias("n"), F.max("page_id").alias("first_id")).where("n > 1 and first_id is not null")
    copies = materialize(copies, "warc-copies")
    least = max(1000, pages.count() // HOT_SHARE)
    hot = copies.where(F.col("n") > least).select(F.col("payload_digest").alias("hot_digest"), F.col("first_id").alias("hot_id"))
    rows = rows.join(F.broadcast(hot), (F.col("payload_digest") == F.col("hot_digest")) & F.col("large"), "left")
    lookup = F.when(F.col("large") & F.col("hot_id").isNull(), F.col("payload_digest")).otherwise(F.concat(F.lit("#"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.substring("url", 1, 40)))
    rows = rows.withColumn("lookup", lookup).join(copies.where(F.col("n") <= least).select(F.col("payload_digest").alias("lookup"), "first_id"), "lookup", "left")
    winner = F.coalesce("hot_id", "first_id")
    return rows.select("page_id", "url", "html", "payload_digest", F.when(winner.isNotNull() & ~F.col("page_id").eqNullSafe(winner), winner).alias("refers_to"))


def write_archives(pages: DataFrame, min_payload: int = MIN_PAYLOAD, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write pages as WARC files in the shared folder and return the committed index."""
    spark = pages.sparkSession
    arrow_limits(spark, 200)
    folder = scratch(spark, "warc")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = filesystem(folder)
        files.create_dir(base, recursive=True)
        attempt, number, at, out, name = uuid.uuid4().hex, 0, 0, None, ""
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                if out is None:
                    name = f"{attempt}-{number:05d}.warc.gz"
                    out, at, number = files.open_output_stream(f"{base}/{name}", compression=None), 0, number + 1
                data = gzip.compress(build_record(r["page_id"], r["url"], r["html"].encode("utf-8", "surrogatepass"), r["payload_digest"], r["refers_to"]), 3, mtime=0)
                out.write(data)
                rows.append((r["page_id"], r["url"], f"{folder}/{name}", at, len(data), r["payload_digest"], "response" if r["refers_to"] is None else "revisit", r["refers_to"]))
                at += len(data)
                if at >= file_bytes:
                    out.close()
                    out = None
            if rows:
                kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in _INDEX.split(", ")])
        if out is not None:
            out.close()

    return materialize(plan_records(pages, min_payload).mapInArrow(write, _INDEX), "warc-index")


def joined_ranges(ranges: Iterable[tuple[int, int]], gap: int = GAP_BYTES, most: int = READ_BYTES) -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
    """Sorted (offset, length) to reads (offset, length, members): neighbours join across gaps, up to most bytes."""
    start, end, own = 0, 0, []
    for offset, length in ranges:
        if own and (offset - end > gap or offset + length - start > most):
            yield start, end - start, own
            own = []
        if not own:
            start, end = offset, offset
        own.append((offset, length))
        end = max(end, offset + length)
    if own:
        yield start, end - start, own


def read_records(index: DataFrame) -> DataFrame:
    """The records of the selected index rows, from the archives: page_id, payload_bytes, payload_digest, record_type, refers_to, url."""
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = list(zip(batch.column("file").to_pylist(), batch.column("offset").to_pylist(), batch.column("length").to_pylist(), strict=True))
            k = 0
            while k < len(places):
                name, first = places[k][0], k
                while k < len(places) and places[k][0] == name:
                    k += 1
                files, path = filesystem(name)
                with files.open_input_file(path) as source:
                    for start, length, own in joined_ranges([(o, n) for _, o, n in places[first:k]]):
                        source.seek(start)
                        data = source.read(length)
                        got = [parse_record(zlib.decompress(data[o - start : o - start + n], 31)) for o, n in own]
                        yield pa.RecordBatch.from_arrays([pa.array([g[f.name] for g in got], f.type) for f in schema], schema=schema)

    chunk = F.floor(F.col("offset") / (64 << 20))
    placed = index.select("file", "offset", "length", chunk.alias("chunk")).repartition(partitions(index.sparkSession), "file", "chunk").sortWithinPartitions("file", "offset")
    return placed.select("file", "offset", "length").mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_records(write_archives(table(spark, sf_dir, "pages"))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest FROM p),
w AS (SELECT *, CASE WHEN payload_bytes >= {MIN_PAYLOAD} THEN max(page_id) OVER (PARTITION BY payload_digest) END AS first_id FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first_id IS NULL OR first_id IS NOT DISTINCT FROM page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first_id IS NOT NULL AND first_id IS DISTINCT FROM page_id THEN first_id END AS refers_to
FROM w
"""

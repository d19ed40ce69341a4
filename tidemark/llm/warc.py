"""Operator 1: WARC archives with segmented records and chunked payloads.

Write: one record per page.  Records share a payload if its bytes are equal; the one with the largest page_id carries
it as `response`, the others are `revisit` records without a body.  A body is framed as HTTP chunks, and a record
whose block is longer than `segment_bytes` goes on in `continuation` records, which may land in other files.

Read: records are grouped by the id of their origin, ordered by segment number, checked for gaps and against the
total length in the last segment, and the chunked framing is decoded.  A revisit is joined to the response that it refers
to, by record id; that record has its payload, and a revisit without one or with another digest is an error.

Defined results: null html is an empty payload; null url leaves the target out; an empty table gives no record; pages
repeated with the same id and payload are further revisits of the first; a null page_id counts below all others (a
payload seen only under null ids is a response once); other columns are ignored.  A damaged archive raises.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, open_input, open_output, shared_dir

SEGMENT_BYTES = 16 * 1024
CHUNK_BYTES = 4 * 1024
FILE_BYTES = 64 * 1024 * 1024
#: Stands for a null page_id while records are dealt out.
NULL_ID = -(1 << 63)
HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
MANIFEST = "path string, records long, bytes long"


class WarcError(ValueError):
    """The archive breaks the format."""


def base32_digest(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """HTTP chunked transfer framing."""
    out = []
    for at in range(0, len(payload), size):
        part = payload[at : at + size]
        out += [b"%x\r\n" % len(part), part, b"\r\n"]
    return b"".join([*out, b"0\r\n\r\n"])


def unchunked(framed: bytes) -> bytes:
    """Decode chunked transfer framing (extensions and trailers are skipped)."""
    out, at = [], 0
    while True:
        end = framed.find(b"\r\n", at)
        if end < 0:
            raise WarcError("chunk size line is missing")
        try:
            size = int(framed[at:end].split(b";")[0].strip(), 16)
        except ValueError as e:
            raise WarcError("chunk size is not a number") from e
        at = end + 2
        if size == 0:
            return b"".join(out)
        if framed[at + size : at + size + 2] != b"\r\n":
            raise WarcError("chunk is cut short")
        out.append(framed[at : at + size])
        at += size + 2


def http_payload(block: bytes) -> bytes:
    """The payload of an HTTP response block."""
    head, sep, body = block.partition(b"\r\n\r\n")
    if not sep:
        raise WarcError("HTTP head is not closed")
    framing = [x.partition(b":")[2].strip().lower() for x in head.split(b"\r\n")[1:] if x.lower().startswith(b"transfer-encoding:")]
    return unchunked(body) if b"chunked" in framing else body


def record(kind: str, rid: str, block: bytes, extra: list[tuple[str, object]]) -> bytes:
    fields = [("WARC-Type", kind), ("WARC-Record-ID", f"<{rid}>"), ("WARC-Date", "2024-01-01T00:00:00Z"), *extra, ("Content-Length", len(block))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None).encode() + b"\r\n" + block + b"\r\n\r\n"


def page_records(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, ordinal: int, segment_bytes: int) -> list[bytes]:
    """The records of one page: a response with its continuations, or a revisit."""
    target = None if url is None else url.replace("\r", "%0D").replace("\n", "%0A")
    common = [("WARC-Target-URI", target), ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Page-Id", page_id)]
    origin = f"urn:page:{page_id}:{digest}"
    if revisit:
        extra = [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{refers_to}:{digest}>")]
        return [record("revisit", f"{origin}:revisit:{ordinal}", b"", common + extra)]
    block = HEAD + chunked(payload)
    if len(block) <= segment_bytes:
        return [record("response", origin, block, [*common, ("Content-Type", "application/http; msgtype=response")])]
    parts = [block[at : at + segment_bytes] for at in range(0, len(block), segment_bytes)]
    out = [record("response", origin, parts[0], [*common, ("Content-Type", "application/http; msgtype=response"), ("WARC-Segment-Number", 1)])]
    for n, part in enumerate(parts[1:], 2):
        extra = [("WARC-Segment-Origin-ID", f"<{origin}>"), ("WARC-Segment-Number", n)]
        if n == len(parts):
            extra.append(("WARC-Segment-Total-Length", len(block)))
        out.append(record("continuation", f"{origin}:segment:{n}", part, extra))
    return out


def write_archive(pages: DataFrame, *, segment_bytes: int = SEGMENT_BYTES, file_bytes: int = FILE_BYTES, directory: str | None = None) -> DataFrame:
    """Write pages (page_id, url, html) as gzipped WARC files; returns the manifest of committed files.

    The payload travels through one shuffle, by (page_id, digest); which record carries a payload is found on digests
    alone.  Files of a failed attempt are in no manifest.
    """
    spark = pages.sparkSession
    base = directory or shared_dir(spark, "warc")
    page = F.coalesce(F.col("page_id").cast("long"), F.lit(NULL_ID))
    p = pages.select(page.alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("sha", F.unhex(F.sha1("html")))
    ids = p.groupBy("page_id", "sha").agg(F.count(F.lit(1)).alias("times"))
    owner = ids.groupBy("sha").agg(F.max("page_id").alias("owner"))
    role = ids.join(owner, "sha").select(F.col("page_id").alias("r_page"), F.col("sha").alias("r_sha"), "times", "owner")
    body = p.groupBy("page_id", "sha").agg(F.first("html").alias("html"), F.first("url", ignorenulls=True).alias("url"))
    known = [F.when(F.col(c) != NULL_ID, F.col(c)).alias(c) for c in ("page_id", "owner")]
    rows = body.join(role, (F.col("page_id") == F.col("r_page")) & (F.col("sha") == F.col("r_sha"))).select(known[0], "url", "html", "sha", "times", known[1])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, done, path, n, size = None, [], "", 0, 0
        try:
            for batch in batches:
                for page_id, url, html, sha, times, owner_id in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    payload, digest = html.encode(), base32_digest(sha)
                    for k in range(times):
                        revisit = k > 0 or page_id != owner_id
                        for rec in page_records(page_id, url, payload, digest, owner_id, revisit, k, segment_bytes):
                            if out is None:
                                path, n, size = f"{base}/{uuid.uuid4().hex}.warc.gz", 0, 0
                                out = open_output(path)
                            packed = gzip.compress(rec, 3, mtime=0)  # a member for each record, as readers that seek expect
                            out.write(packed)
                            n, size = n + 1, size + len(packed)
                            if size >= file_bytes:
                                out.close()
                                done.append((path, n, size))
                                out = None
        finally:
            if out is not None:
                out.close()
                done.append((path, n, size))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in done]) for i in range(3)], names=["path", "records", "bytes"])

    return materialize(rows.mapInArrow(write, MANIFEST), "warc-manifest", one_file=True)


def parse_file(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records of an uncompressed WARC stream: header fields (lower-case names) and block."""
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise WarcError(f"no WARC version line: {line[:40]!r}")
        fields: dict[str, str] = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode().partition(":")
            fields[name.strip().lower()] = value.strip()
        size = int(fields["content-length"])
        block = stream.read(size)
        if len(block) != size or stream.read(4) != b"\r\n\r\n":
            raise WarcError("record is cut short")
        yield fields, block


SEGMENT = pa.schema([("origin", pa.string()), ("segment", pa.int32()), ("total", pa.int64()), ("kind", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("digest", pa.string()), ("target", pa.string()), ("length", pa.int64()), ("block", pa.binary())])
#: A record by itself; target is the id of the record that a revisit refers to.
RECORD = pa.schema([("record_id", pa.string()), ("target", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("segments", pa.int32())])


def _number(text: str | None) -> int | None:
    return None if text in (None, "None") else int(text)


def segments(fields: dict[str, str], block: bytes) -> tuple:
    kind = fields["warc-type"]
    rid = fields["warc-record-id"].strip("<>")
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
    page = _number(fields.get("x-page-id"))
    if kind == "continuation":
        total = fields.get("warc-segment-total-length")
        return (fields["warc-segment-origin-id"].strip("<>"), int(fields["warc-segment-number"]), _number(total), kind, None, None, None, None, None, block)
    number = int(fields.get("warc-segment-number", 0))
    return (rid, number, None, kind, page, fields.get("warc-target-uri"), digest, (fields["warc-refers-to"].strip("<>") if kind == "revisit" else None), None, block)


def checked_payload(block: bytes, digest: str | None) -> bytes:
    payload = http_payload(block)
    found = base32_digest(hashlib.sha1(payload).digest())
    if found != digest:
        raise WarcError(f"payload digest is {found}, header says {digest}")
    return payload


def decoded(row: tuple, with_payload: bool) -> tuple:
    """A whole record with the length of its payload; its block becomes the payload, if wanted."""
    if row[3] != "response":
        return (*row[:-1], None)
    payload = checked_payload(row[-1], row[6])
    return (*row[:-2], len(payload), payload if with_payload else None)


def reassembled(parts: list[tuple[int, int | None, bytes]]) -> bytes:
    """The block of a record from its segments (number, total length of the record if last, bytes)."""
    parts = sorted(parts, key=lambda x: x[0])
    if [x[0] for x in parts] != list(range(1, len(parts) + 1)):
        raise WarcError(f"segments {[x[0] for x in parts]} do not follow each other")
    block = b"".join(x[2] for x in parts)
    if parts[-1][1] != len(block):
        raise WarcError(f"total length is {parts[-1][1]}, segments hold {len(block)}")
    return block


def read_archive(spark: SparkSession, manifest: DataFrame, *, with_payload: bool = True) -> DataFrame:
    """One row per WARC record of the manifest's files, continuations joined to their origin, payload decoded.

    Whole records are decoded and checked where they are read; without `with_payload` only segments travel on.
    """
    files = manifest.count()

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with open_input(path) as raw, gzip.GzipFile(fileobj=raw) as stream:
                    for fields, block in parse_file(stream):
                        row = segments(fields, block)
                        if row[1] == 0:
                            row = decoded(row, with_payload)
                        rows.append(row)
                        held += len(row[-1] or b"")
                        if held > 16_000_000 or len(rows) >= 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), SEGMENT, strict=True)], schema=SEGMENT)
                            rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), SEGMENT, strict=True)], schema=SEGMENT)

    first = ["origin", "kind", "page_id", "url", "digest", "target", "length"]
    seg = manifest.select("path").repartition(max(1, files)).mapInArrow(parse, "origin string, segment int, total long, kind string, page_id long, url string, digest string, target string, length long, block binary")
    head = F.max(F.when(F.col("segment") <= 1, F.struct(*first))).alias("head")
    whole = seg.groupBy(F.col("origin").alias("of")).agg(head, F.collect_list(F.struct("segment", "total", "block")).alias("parts")).select("head.*", "parts")
    out = RECORD.append(pa.field("payload", pa.binary())) if with_payload else RECORD

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for rid, kind, page_id, url, digest, target, length, parts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind is None:
                    raise WarcError("continuation records without their origin")
                if len(parts) == 1 and parts[0]["segment"] == 0:
                    rows.append((rid, target, page_id, url, length, digest, kind, 1, parts[0]["block"]))
                    continue
                payload = checked_payload(reassembled([(x["segment"], x["total"], x["block"]) for x in parts]), digest)
                rows.append((rid, target, page_id, url, len(payload), digest, kind, len(parts), payload))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 9
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns[: len(out)], out, strict=True)], schema=out)

    schema = "record_id string, target string, page_id long, url string, payload_bytes long, payload_digest string, record_type string, segments int" + ", payload binary" * with_payload
    return resolved(materialize(whole.mapInArrow(decode, schema), "warc-records"))


def resolved(records: DataFrame) -> DataFrame:
    """Records with the page that a revisit refers to, and its payload's length, from the response itself."""
    kept = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "segments", *(["payload"] if "payload" in records.columns else [])]
    revisits = records.where("record_type = 'revisit'").drop("payload_bytes")
    own = records.where("record_type = 'response'").withColumn("refers_to", F.lit(None).cast("long"))
    found = own.select(F.col("record_id").alias("r_id"), F.col("page_id").alias("refers_to"), "payload_bytes", F.col("payload_digest").alias("r_digest"))
    sound = F.coalesce(F.col("r_digest") == F.col("payload_digest"), F.lit(False))
    fault = F.raise_error(F.concat(F.lit("a revisit refers to no response with its digest: "), F.coalesce("record_id", F.lit("")))).cast("long")
    joined = revisits.join(found, F.col("target") == F.col("r_id"), "left").withColumn("payload_bytes", F.when(sound, F.col("payload_bytes")).otherwise(fault))
    return own.select(*kept).unionByName(joined.select(*kept))


#: What reading the archives back must give (base32 of SHA-1 by groups of 20 bits).
ORACLE = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h, coalesce(html, '') AS payload FROM pages),
o AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload) AS owner, row_number() OVER (PARTITION BY payload, page_id) AS copy FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, (i // 4) * 5 + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INT + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = owner AND copy = 1 THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = owner AND copy = 1 THEN NULL ELSE owner END AS refers_to
FROM o
"""

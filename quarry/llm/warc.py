"""WARC writing and reading with segment reassembly.

Writing: a record for each page, the payload chunk-framed in an HTTP response. Of pages with equal payloads of
``REVISIT_BYTES`` or more the one of smallest page_id is the response and the others are revisits that refer to
it. Blocks above ``SEGMENT_BYTES`` are cut into a first record and continuation records. Every record is a gzip
member of its own; a task writes the records of its partition, in page order, into files that appear when whole.

Reading: files are streamed record by record. Continuations are grouped with their first record by the origin
identifier, put in order of their segment numbers and held against the total length; the chunk framing is taken
off, and the digest is computed from the payload itself. Revisits find their response by its record identifier.

Null html is an empty payload. A null page_id is always a response. Rows that repeat a page_id and payload give
a record each, with an id of its own (the copies of a page are dealt to one task, which numbers them in order of
their urls); all of them are responses if they are the first. Payload bytes of any content survive. Only digests
and ids are shuffled to find revisits; a payload that a third of the pages share is one pre-aggregated row.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import shared_files
from quarry.llm.common import blocks, in_arrow

REVISIT_BYTES = 100
SEGMENT_BYTES = 32 << 10
CHUNK_BYTES = 8 << 10
FILE_BYTES = 64 << 20
DATE = "2024-01-01T00:00:00Z"
#: Fixed values of the public format.
VERSION = b"WARC/1.1\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
HTTP_REVISIT = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"

_RECORD = "record_id string, type string, segment int, total long, page_id long, url string, refers_id string, block binary, payload_bytes long, payload_digest string, ok boolean"


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    parts = [b"%x\r\n%b\r\n" % (len(c := payload[i : i + size]), c) for i in range(0, len(payload), size)]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes:
    """The payload of a chunk-framed body; extensions and trailers are passed over."""
    out, at = [], 0
    while True:
        line = body.index(b"\r\n", at)
        size = int(body[at:line].split(b";")[0], 16)
        if size == 0:
            return b"".join(out)
        at = line + 2
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk is cut short")
        out.append(body[at : at + size])
        at += size + 2


def payload_of(block: bytes) -> bytes:
    """The payload of an HTTP response."""
    head, _, body = block.partition(b"\r\n\r\n")
    return unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body


def record_uuid(*of) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, '/'.join(map(str, of)))}>"


def record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", len(block))] if v is not None)
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(VERSION + head.encode() + b"\r\n" + block + b"\r\n\r\n") + z.flush()


def page_records(page_id: int | None, url: str | None, payload: bytes, digest: str, first: int | None, serial: str, copy: int = 0) -> Iterator[bytes]:
    """The record of one page, or its first record and continuations; ``copy`` numbers rows of one page_id and payload."""
    revisit = first is not None
    own = record_uuid("page", page_id, digest, *([copy] if copy else [])) if page_id is not None else record_uuid("row", serial, digest)
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", own), ("WARC-Date", DATE),
        ("WARC-Target-URI", None if url is None else quote(url, safe="!#$%&'()*+,/:;=?@[]~")), ("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Page-ID", page_id),
    ]
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_uuid("page", first, digest))]
    http = ("Content-Type", "application/http; msgtype=response")
    block = HTTP_REVISIT if revisit else HTTP + chunked(payload)
    if len(block) <= SEGMENT_BYTES:
        yield record([*fields, http], block)
        return
    for k, at in enumerate(range(0, len(block), SEGMENT_BYTES), 1):
        if k > 1:
            fields = [("WARC-Type", "continuation"), ("WARC-Record-ID", record_uuid(own, k)), ("WARC-Date", DATE), ("WARC-Segment-Origin-ID", own)]
        last = at + SEGMENT_BYTES >= len(block)
        yield record([*fields, ("WARC-Segment-Number", k), ("WARC-Segment-Total-Length", len(block) if last and k > 1 else None), *([http] if k == 1 else [])], block[at : at + SEGMENT_BYTES])


def write(pages: DataFrame, folder: str) -> int:
    """Writes the archives of (page_id, url, html) below the folder; the number of records' pages."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha2("html", 256))
    long = rows.where(F.octet_length("html") >= REVISIT_BYTES).select("page_id", "digest")
    first = long.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("m")).where("m > 1")
    again = long.join(first, "digest").where(F.col("page_id") > F.col("first")).select("page_id", "digest", "first").distinct()
    # the copies of a page meet in one task, rows without page_id anywhere
    page = F.concat_ws("/", F.col("page_id").cast("string"), "digest")
    rows = rows.withColumn("key", F.when(F.col("page_id").isNull(), F.concat(F.lit("-"), F.monotonically_increasing_id().cast("string"))).otherwise(page)).repartition("key")
    rows = rows.join(again.select(page.alias("key"), "first"), "key", "left").sortWithinPartitions("page_id", "digest", "url")

    def run(batches):
        part, serial, number = TaskContext.get().partitionId(), 0, 0
        before, copy = None, 0
        todo = (r for b in blocks(batches, "html") for r in b.to_pylist())
        row = next(todo, None)
        while row is not None:
            pages_in = size = 0
            name = f"part-{part:06d}-{serial:04d}.warc.gz"
            with shared_files.written(folder, name) as f:
                while row is not None and size < FILE_BYTES:
                    same = (row["page_id"], row["digest"])
                    before, copy = same, copy + 1 if same == before else 0
                    for r in page_records(row["page_id"], row["url"], row["html"].encode(), row["digest"], row["first"], f"{part}/{number}", copy):
                        f.write(r)
                        size += len(r)
                    pages_in, number = pages_in + 1, number + 1
                    row = next(todo, None)
            serial += 1
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([pages_in]), pa.array([size])], names=["name", "pages", "bytes"])

    return in_arrow(rows.select("page_id", "url", "html", "digest", "first"), run, "name string, pages long, bytes long").agg(F.sum("pages")).first()[0] or 0


def members(stream, size: int = 1 << 20) -> Iterator[bytes]:
    """The gzip members of a stream, one by one."""
    z, out, data = zlib.decompressobj(31), [], b""
    while True:
        data = data or stream.read(size)
        if not data:
            if out and any(out):
                raise ValueError("the last record is cut short")
            return
        out.append(z.decompress(data))
        data = b""
        if z.eof:
            yield b"".join(out)
            z, out, data = zlib.decompressobj(31), [], z.unused_data


def parsed(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Fields (names in lower case) and block of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    if not head.startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode().split("\r\n")[1:])}
    block = rest[: int(fields["content-length"])]
    if len(block) != int(fields["content-length"]):
        raise ValueError("a record is cut short")
    return fields, block


def _read_files(batches):
    names = [f.split()[0] for f in _RECORD.split(", ")]
    schema = pa.schema([("record_id", pa.string()), ("type", pa.string()), ("segment", pa.int32()), ("total", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("refers_id", pa.string()), ("block", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("ok", pa.bool_())])
    assert schema.names == names
    for path in shared_files.paths(batches):
        fs, at = shared_files.open_fs(path)
        rows, held = [], 0
        with fs.open_input_stream(at, compression=None) as f:
            for raw in members(f):
                h, block = parsed(raw)
                number = lambda k, h=h: int(h[k]) if k in h else None
                r = {"record_id": h.get("warc-segment-origin-id", h["warc-record-id"]), "type": h["warc-type"], "segment": number("warc-segment-number"), "total": number("warc-segment-total-length"), "page_id": number("warc-page-id"), "url": h.get("warc-target-uri"), "refers_id": h.get("warc-refers-to"), "payload_digest": h.get("warc-payload-digest", "").removeprefix("sha256:")}
                if r["segment"] is not None:
                    r["block"] = block
                    held += len(block)
                elif r["type"] == "response":
                    payload = payload_of(block)
                    got = hashlib.sha256(payload).hexdigest()
                    r |= {"payload_bytes": len(payload), "ok": got == r["payload_digest"], "payload_digest": got}
                rows.append(r)
                if len(rows) >= 1000 or held > 4 << 20:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)


def reassembled(parts: list[dict]) -> tuple[bytes, bool]:
    """The block of a record's segments, and whether all are there and the total length is right."""
    by = {p["segment"]: p for p in sorted(parts, key=lambda p: p["segment"], reverse=True)}
    order = sorted(by)
    block = b"".join(by[k]["block"] for k in order)
    return block, order == list(range(1, len(order) + 1)) and by[order[-1]]["total"] == len(block)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each page's record in the archives of a folder, its segments put together."""
    raw = in_arrow(shared_files.files(spark, folder, "*.warc.gz"), _read_files, _RECORD)
    names = [f.split()[0] for f in _RECORD.split(", ")]
    whole = raw.groupBy("record_id", F.when(F.col("segment").isNull(), F.monotonically_increasing_id()).alias("row")).agg(F.collect_list(F.struct(*names[1:])).alias("parts"))

    def run(batches):
        for b in batches:
            out = []
            for name, parts in zip(b.column("record_id").to_pylist(), b.column("parts").to_pylist(), strict=True):
                head = next((p for p in parts if p["type"] != "continuation"), None) or parts[0]
                if head["segment"] is not None:
                    block, ok = reassembled(parts)
                    payload = payload_of(block) if ok else b""
                    got = hashlib.sha256(payload).hexdigest()
                    head = head | {"payload_bytes": len(payload), "ok": ok and got == head["payload_digest"], "payload_digest": got}
                out.append({"record_id": name} | {k: head[k] for k in ("type", "page_id", "url", "refers_id", "payload_bytes", "payload_digest", "ok")})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("record_id", pa.string()), ("type", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("refers_id", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("ok", pa.bool_())]))

    return in_arrow(whole.select("record_id", "parts"), run, "record_id string, type string, page_id long, url string, refers_id string, payload_bytes long, payload_digest string, ok boolean")


def resolved(records: DataFrame) -> DataFrame:
    """Revisits with the size of their response's payload and its page_id."""
    target = records.where("type = 'response' AND page_id IS NOT NULL").groupBy(F.col("record_id").alias("_r")).agg(F.min("page_id").alias("refers_to"), F.min("payload_bytes").alias("_bytes"), F.min("payload_digest").alias("_digest"))
    rows = records.join(target, F.col("refers_id") == F.col("_r"), "left")
    same = F.when(F.col("type") == "revisit", F.col("payload_digest") == F.col("_digest")).otherwise(F.col("ok"))
    return rows.select("page_id", F.coalesce("payload_bytes", "_bytes").alias("payload_bytes"), "payload_digest", F.col("type").alias("record_type"), "refers_to", "url", F.coalesce(same, F.lit(False)).alias("ok"))

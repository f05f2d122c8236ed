"""WARC archives: one gzip member per record, written by tasks and read back as a stream.

``write_archives`` turns rows into archive files, each a row (name, data) of whole gzip members that Spark's own writer
stores in whatever file system the path names; ``read_archives`` reads such rows sequentially.
"""

from __future__ import annotations

import gzip
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import cut, joined_by_count

#: An archive is closed once it has grown to so many bytes.
ARCHIVE_BYTES = 8 << 20
#: Bytes handed to the decompressor at once.
CHUNK = 64 << 10
ARCHIVES = "archive string, data binary"
RECORDS = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"


class BadRecord(ValueError):
    """An archive is cut short, framed wrongly, or a digest doesn't hold."""


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """One record as a gzip member. A revisit (refers_to is set) keeps the HTTP head and leaves the payload out."""
    head = HTTP.format(len(payload)).encode()
    block = head if refers_to is not None else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + "".join(c if c.isprintable() and c != " " else "".join(f"%{b:02X}" for b in c.encode()) for c in url))
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{hashlib.sha1(block).hexdigest()}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 6, mtime=0)


def members(data: bytes) -> Iterator[bytes]:
    """The decompressed gzip members of an archive, one at a time."""
    at = 0
    while at < len(data):
        inflate, out = zlib.decompressobj(31), []
        while not inflate.eof:
            piece = data[at : at + CHUNK]
            if not piece:
                raise BadRecord("the last member is cut short")
            out.append(inflate.decompress(piece))
            at += len(piece) - len(inflate.unused_data)
        yield b"".join(out)


def parse(member: bytes) -> dict:
    """A record's fields, by content-length framing, with both digests verified."""
    head, gap, rest = member.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not gap or not version.startswith("WARC/1."):
        raise BadRecord(f"not a WARC record: {version[:40]}")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    size = int(fields["content-length"])
    block = rest[:size]
    if len(block) != size or rest[size:] != b"\r\n\r\n":
        raise BadRecord("the block doesn't end where its content length says")
    if "sha1:" + hashlib.sha1(block).hexdigest() != fields["warc-block-digest"]:
        raise BadRecord("the block digest doesn't hold")
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    kind = fields["warc-type"]
    if kind == "response" and (len(payload) != length or hashlib.sha1(payload).hexdigest() != digest):
        raise BadRecord("the payload digest doesn't hold")
    number = lambda name: int(x) if (x := fields.get(name, "<urn:page:None>")[10:-1]) != "None" else None
    return {
        "page_id": number("warc-record-id"), "url": fields.get("warc-target-uri"), "record_type": kind, "payload_bytes": length, "payload_digest": digest,
        "refers_to": number("warc-refers-to"), "payload": payload if kind == "response" else None,
    }


def write_archives(pages: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """(archive, data) for rows (page_id, url, payload, payload_digest, refers_to); a record never spans two archives."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n, open_now, size = TaskContext.get().partitionId(), 0, [], 0
        flush = lambda: pa.RecordBatch.from_pydict({"archive": [f"part-{task:05d}-{n:05d}.warc.gz"], "data": [b"".join(open_now)]})
        for batch in batches:
            for row in batch.to_pylist():
                open_now.append(record(row["page_id"], row["url"], row["payload"], row["payload_digest"], row["refers_to"]))
                size += len(open_now[-1])
                if size >= archive_bytes:
                    yield flush()
                    n, open_now, size = n + 1, [], 0
        if open_now:
            yield flush()

    return pages.select("page_id", "url", "payload", "payload_digest", "refers_to").mapInArrow(pack, ARCHIVES)


def read_archives(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """A row per record of rows (archive, data); payloads=False leaves the payload column null once it is verified."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
        for batch in batches:
            for data in batch.column("data"):
                rows = []
                for member in members(data.as_py()):
                    rows.append(parse(member) | ({} if payloads else {"payload": None}))
                    if len(rows) == 500:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return archives.select("archive", "data").mapInArrow(unpack, RECORDS)


def with_revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 1000) -> DataFrame:
    """Rows for write_archives: of equal payloads of at least ``least`` bytes, that with the largest id is the response.

    A null html is an empty payload; a null id is always a response; rows repeated with one id are all responses if
    that id is the largest. Payloads are compared by SHA-1 and counted before anything is joined; digests that many
    pages share are broadcast to their pages, and the join that carries the html is on the id as well, so such a
    payload makes no hot task.
    """
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"), F.sha1(payload).alias("payload_digest"))
    sized = cut(rows.where(F.octet_length("payload") >= least).select("page_id", "payload_digest"))
    shared = sized.groupBy("payload_digest").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1")
    revisits = joined_by_count(sized, shared, "payload_digest").where("page_id < refers_to").distinct()
    return rows.join(revisits, ["page_id", "payload_digest"], "left")

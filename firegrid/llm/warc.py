"""WARC archives: records of pages written side by side, read back by byte ranges."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firegrid.llm.shared import SharedFiles, batch_of, in_batches, scratch_path, store

MAGIC = b"\x1f\x8b\x08"
CHUNK = 1 << 20
#: Bytes that a task scans for the records it owns.
SPLIT = 32 << 20
DATE = "2024-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

FILES = pa.schema([("file", pa.string()), ("bytes", pa.int64()), ("records", pa.int64())])
RECORDS = pa.schema(
    [
        ("file", pa.string()),
        ("position", pa.int64()),
        ("record_type", pa.string()),
        ("record_id", pa.string()),
        ("target_uri", pa.string()),
        ("refers_to", pa.string()),
        ("payload_digest", pa.string()),
        ("payload_bytes", pa.int64()),
        ("payload", pa.binary()),
    ]
)


def with_originals(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, url, html, first_id): first_id is the smallest page_id of an equal payload, null for that page itself.

    Payloads are told apart by SHA-256 and length. Only digests are grouped; a payload that a third of
    all pages have is one partial row per task. Pages without an id are never revisits, nor are
    payloads below ``least_bytes``; rows that share the smallest id are all originals.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    own = in_batches(pages).select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), F.unhex(F.sha2(html, 256)).alias("sha")
    )
    long = own.where(F.octet_length("html") >= least_bytes).select("page_id", "sha")
    firsts = long.groupBy("sha").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    again = store(long.join(firsts, "sha").where("page_id > first_id").distinct(), "revisits")
    return own.join(again, ["page_id", "sha"], "left").select("page_id", "url", "html", "first_id")


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, first_id: int | None) -> bytes:
    """One record: a response with its payload, or a revisit that keeps the HTTP headers alone."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if first_id is None else http
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if first_id is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {DATE}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"Content-Length: {len(block)}",
    ]
    if url:
        lines.append(f"WARC-Target-URI: {quote(url, safe=';/?:@&=+$,!~*()%#[]' + chr(39))}")
    if first_id is not None:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(first_id)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write (page_id, url, html, first_id) as archives below ``folder``; gives (file, bytes, records) per archive.

    Every record is a gzip member of its own. A repeated task replaces its archive by an equal one.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        name, n = f"part-{context.partitionId():06d}.warc.gz", 0
        with SharedFiles(folder).writer(name, f"{context.taskAttemptId()}-{uuid.uuid4().hex[:8]}") as out:
            for batch in batches:
                columns = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("page_id", "url", "html", "first_id"))
                for page_id, url, html, first_id in zip(*columns):
                    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
                    out.write(pack.compress(record(page_id, url, (html or "").encode(), first_id)) + pack.flush())
                    n += 1
        yield batch_of(FILES, {"file": [name], "bytes": [out.size], "records": [n]})

    return store(pages.mapInArrow(task, "file string, bytes long, records long"), "archives")


def members(f, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(position, content) of the gzip members with a WARC record that start in [start, end) of an open archive.

    Bytes that look like a member's head are tried: a member is what inflates to a WARC version line.
    The last member is read to its end even where that lies beyond ``end``.
    """
    at, kept = start, b""  # kept: read and not yet searched, from ``at`` on
    while at < end:
        if len(kept) < len(MAGIC):
            f.seek(at + len(kept))
            more = f.read(CHUNK)
            kept += more
            if not more:
                return
        found = kept.find(MAGIC)
        if found < 0:
            drop = max(len(kept) - len(MAGIC) + 1, 0)
            at, kept = at + drop, kept[drop:]
            if len(kept) < len(MAGIC):
                f.seek(at + len(kept))
                more = f.read(CHUNK)
                if not more:
                    return
                kept += more
            continue
        at, kept = at + found, kept[found:]
        if at >= end:
            return
        content, used = inflate(f, at)
        if content is None:
            at, kept = at + 1, kept[1:]
            continue
        yield at, content
        at, kept = at + used, kept[used:]


def inflate(f, at: int) -> tuple[bytes | None, int]:
    """The member at ``at`` and its length, or None where none with a WARC record begins."""
    f.seek(at)
    unpack, parts, read, head = zlib.decompressobj(31), [], 0, b""
    while not unpack.eof:
        data = f.read(CHUNK if head else 4096)
        read += len(data)
        try:
            parts.append(unpack.decompress(data))
        except zlib.error:
            if len(head) < 7:
                return None, 0
            raise
        if len(head) < 7:
            head = b"".join(parts)[:7]
            if not b"WARC/1.".startswith(head):
                return None, 0
        if not data and not unpack.eof:
            if len(head) < 7:
                return None, 0
            raise ValueError(f"the archive ends within the record at {at}")
    if len(head) < 7:
        return None, 0
    return b"".join(parts), read - len(unpack.unused_data)


def parse(content: bytes) -> dict:
    """Type, ids, digest and payload of a record; the digest of a response is held against its payload."""
    head, _, rest = content.partition(b"\r\n\r\n")
    fields = dict(re.findall(r"^([\w-]+):[ \t]*(.*?)\r?$", head.decode("utf-8", "replace"), re.M))
    fields = {k.lower(): v for k, v in fields.items()}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    kind, digest = fields["warc-type"], fields.get("warc-payload-digest", "").removeprefix("sha1:")
    length = re.search(rb"^content-length:\s*(\d+)", http, re.I | re.M)
    if kind == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
        raise ValueError(f"the payload of {fields['warc-record-id']} does not have its digest")
    return {
        "record_type": kind,
        "record_id": fields["warc-record-id"],
        "target_uri": fields.get("warc-target-uri"),
        "refers_to": fields.get("warc-refers-to"),
        "payload_digest": digest,
        "payload_bytes": len(payload) if kind == "response" else int(length[1]),
        "payload": payload if kind == "response" else None,
    }


def read_archives(archives: DataFrame, folder: str, split: int = SPLIT) -> DataFrame:
    """Records of the archives (file, bytes) below ``folder``, whole and once each, by tasks over byte ranges.

    A range owns the records that start in it, so any ``split`` gives the same rows. A record is held
    in memory by itself; an archive without records gives none.
    """
    last = F.greatest(F.col("bytes") - 1, F.lit(0))
    ranges = archives.select("file", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), last, F.lit(split).cast("long"))).alias("start"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = SharedFiles(folder)
        for batch in batches:
            for part in batch.to_pylist():
                rows, held = [], 0
                with files.open(part["file"]) as f:
                    for at, content in members(f, part["start"], min(part["start"] + split, part["bytes"])):
                        rows.append({"file": part["file"], "position": at} | parse(content))
                        held += len(content)
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, RECORDS)
                            rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, RECORDS)

    schema = (
        "file string, position long, record_type string, record_id string, target_uri string, refers_to string, "
        "payload_digest string, payload_bytes long, payload binary"
    )
    tasks = int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return ranges.repartition(tasks, "file", "start").mapInArrow(task, schema)


def page_records(records: DataFrame) -> DataFrame:
    """Records under the ids of their pages."""
    page = lambda c: F.expr(f"try_cast(regexp_extract({c}, '^<urn:page:(.*)>$', 1) AS bigint)")
    return records.select(
        page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to")
    )


def round_trip(spark: SparkSession, pages: DataFrame, least_bytes: int = 0, split: int = SPLIT) -> DataFrame:
    """Write a record per page to archives in the shared folder and read them back.

    Null html is an empty payload, null url leaves the target out, and every row gets a record, rows
    that repeat too. An empty table gives no records.
    """
    folder = scratch_path(spark, "warc")
    return read_archives(write_archives(with_originals(pages, least_bytes), folder), folder, split)

"""WARC archives: write with an index, read back by coalesced byte ranges.

Writing.  Each task appends gzip members, one per record, to an archive of its
own in the shared folder and returns the index of what it wrote (file, offset,
length, URL, digest).  Only the index rows of tasks that succeeded are stored,
so a file left by a lost task is never read.

Reading.  The selected index rows are dealt by file and stretch of the file,
sorted by offset, and neighbours are fetched in one read.

Defined cases.  A null html is an empty payload; a null url is an empty one.
Payloads under ``MIN_REVISIT`` bytes are always responses.  Rows that repeat
the smallest page_id of a payload are responses too.  A null page_id is never
referred to and is a response.  An empty table gives no records.  Line breaks
in a url are percent-encoded in the header.  A very long html is one record, and
columns beside page_id, url and html are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.llm.common import folder, map_rows, small_batches, stored, table

MIN_REVISIT = 100
#: An archive is closed at this size.
ROLL = 1 << 30
#: Neighbours this near are fetched together, up to so many bytes at once.
GAP, MOST = 64 << 10, 8 << 20
#: Index rows of one stretch of a file are read by one task; there are as many tasks as stretches, up to what a driver can follow.
STRETCH, MOST_TASKS = 8 << 20, 20_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "page_id bigint, url string, digest string, record_type string, file string, offset bigint, length bigint"
RECORD = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, file string, offset bigint, length bigint, payload binary"


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a shared folder, and the path in it; Hadoop's names for S3 are known too."""
    return fs.FileSystem.from_uri(re.sub("^s3[an]://", "s3://", uri))


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One gzip member that holds one WARC record."""
    uri = re.sub(r"[\r\n]", lambda m: f"%{ord(m[0]):02X}", url or "")
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if refers_to is not None else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date: 2024-01-01T00:00:00Z",
        f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha256:{digest}",
        *([f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"] if refers_to is not None else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    squeeze = zlib.compressobj(1, zlib.DEFLATED, 31)
    return squeeze.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + squeeze.flush()


def parsed(member: bytes) -> dict:
    """The record in a gzip member; a response's payload is checked against its digest."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if version != "WARC/1.1":
        raise ValueError(f"not a WARC record: {version[:40]!r}")
    field = dict(x.split(": ", 1) for x in lines)
    block = rest[: int(field["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    n = int(re.search(rb"(?i)content-length: (\d+)", http)[1])
    digest = field["WARC-Payload-Digest"].removeprefix("sha256:")
    if field["WARC-Type"] == "response" and (len(payload) != n or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"the payload of {field['WARC-Record-ID']} does not match its digest")
    page = lambda x: int(x[10:-1]) if x and x != "<urn:page:>" else None
    return {
        "page_id": page(field["WARC-Record-ID"]), "url": field["WARC-Target-URI"], "payload_bytes": n, "payload_digest": digest,
        "record_type": field["WARC-Type"], "refers_to": page(field.get("WARC-Refers-To")), "payload": payload if field["WARC-Type"] == "response" else None,
    }


def with_roles(pages: DataFrame) -> DataFrame:
    """``page_id, url, html (binary), digest, refers_to``: the last is null for responses.

    Only ids and digests meet in the search for equal payloads.  The texts are
    then dealt by id and digest, unless the revisits are few enough to be sent.
    """
    body = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    full = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), body.alias("html")).withColumn("digest", F.sha2("html", 256))
    slim = full.where(F.octet_length("html") >= MIN_REVISIT).select("page_id", "digest")
    first = slim.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    again = slim.join(first, "digest").where("page_id <> first").select("page_id", "digest", F.col("first").alias("refers_to")).distinct()
    # pages without an id are never revisits, and would all meet in one key of the join
    named = full.where("page_id is not null").join(again, ["page_id", "digest"], "left").select("page_id", "url", "html", "digest", "refers_to")
    return named.unionByName(full.where("page_id is null").select("page_id", "url", "html", "digest", F.lit(None).cast("long").alias("refers_to")))


def write(pages: DataFrame, folder: str, roll: int = ROLL) -> DataFrame:
    """Write a record per row under ``folder`` and return the stored index."""
    store, base = opened(folder)
    store.create_dir(base, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = opened(folder)
        out, name, at = None, "", 0
        for batch in batches:
            rows = []
            for page_id, url, html, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None or at >= roll:
                    if out is not None:
                        out.close()
                    name, at = f"{base}/{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(name, compression=None)
                member = record(page_id, url, html, digest, refers_to)
                out.write(member)
                rows.append((page_id, url, digest, "response" if refers_to is None else "revisit", name, at, len(member)))
                at += len(member)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["page_id", "url", "digest", "record_type", "file", "offset", "length"])
        if out is not None:
            out.close()

    small_batches(pages.sparkSession)
    return stored(with_roles(pages).mapInArrow(run, INDEX), "warc-index")


def ranges(rows: list[tuple[str, int, int]], gap: int = GAP, most: int = MOST) -> Iterator[tuple[str, int, int, list[int]]]:
    """(file, start, end, row numbers) of reads that cover ``rows`` (file, offset, length), sorted and coalesced."""
    now = None
    for k in sorted(range(len(rows)), key=rows.__getitem__):
        file, a, n = rows[k]
        if now and now[0] == file and a - now[2] <= gap and a + n - now[1] <= most:
            now[3].append(k)
            now = (file, now[1], max(now[2], a + n), now[3])
        else:
            if now:
                yield now
            now = (file, a, a + n, [k])
    if now:
        yield now


def read(index: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The records of the selected index rows; revisits have no payload of their own."""
    total = index.agg(F.sum("length")).first()[0] or 0
    stretch = F.floor(F.col("offset") / STRETCH)
    dealt = index.select("file", "offset", "length").repartition(min(1 + total // STRETCH, MOST_TASKS), "file", stretch).sortWithinPartitions("file", "offset")

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        store, _ = opened(folder)
        rows = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
        for file, start, end, own in ranges(rows):
            with store.open_input_file(file) as f:
                data = f.read_at(end - start, start)
            found = []
            for k in own:
                _, a, n = rows[k]
                r = parsed(data[a - start : a - start + n])
                found.append(r | {"file": file, "offset": a, "length": n} | ({} if payloads else {"payload": None}))
            yield {c: [r[c] for r in found] for c in found[0]}

    return map_rows(dealt, RECORD, run)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = folder(spark, "warc")
    index = write(table(spark, sf_dir, "pages"), place)
    return read(index, place, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "offset", "length")

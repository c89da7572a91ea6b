"""WARC archives: writing with revisits and segments, reading back, and reassembly of segmented records."""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.runtime import Scratch, bounded_batches, scratch_path, spread, table

CRLF = b"\r\n"
LEAST_REVISIT = 100
CHUNK, SEGMENT = 8 * 1024, 32 * 1024
#: Archives hold at most this many records of at most SEGMENT bytes and their headers, so a file can be read as a whole.
RECORDS_PER_FILE = 1000
_PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _record(headers: list[tuple[bytes, bytes]], block: bytes) -> bytes:
    """A record with the two line ends behind its block."""
    lines = [b"WARC/1.1", *(k + b": " + v for k, v in headers), b"Content-Length: %d" % len(block)]
    return CRLF.join(lines) + CRLF + CRLF + block + CRLF + CRLF


def _member(record: bytes) -> bytes:
    """A record as a gzip member of its own, without the last byte: the highest of the record's length, 0 in any below 16 MB, which the writer puts behind each row."""
    if len(record) >= 1 << 24:
        raise ValueError("a record of 16 MB or more: segments must be shorter")
    return gzip.compress(record, 6, mtime=0)[:-1]


def _name(page_id: int | None, row: str = "") -> bytes:
    """A record's id; ``row`` tells rows that share a page id apart."""
    return b"<urn:page:%b%b>" % (b"none" if page_id is None else b"%d" % page_id, b":" + row.encode() if row else b"")


def _page(name: bytes) -> int | None:
    n = name.strip(b"<>").split(b":")[2]
    return None if n == b"none" else int(n)


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    """Chunked transfer framing."""
    parts = [b"%x\r\n%b\r\n" % (len(piece := payload[at : at + size]), piece) for at in range(0, len(payload), size)]
    return b"".join(parts) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes:
    """The payload inside chunked transfer framing; chunk extensions and trailers are skipped."""
    out, at = [], 0
    while True:
        end = body.index(CRLF, at)
        n = int(body[at:end].split(b";")[0], 16)
        if n == 0:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + n])
        if len(out[-1]) != n or body[end + 2 + n : end + 4 + n] != CRLF:
            raise ValueError("broken chunk")
        at = end + 4 + n


def records_of(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, row: str = "", segment: int = SEGMENT) -> Iterator[bytes]:
    """The records of one page: a revisit, or a response whose block is cut into segments where it is long."""
    target = (url or "").encode("utf-8", "surrogatepass").replace(b"\r", b"%0D").replace(b"\n", b"%0A") or b"urn:none"
    common = [(b"WARC-Target-URI", target), (b"WARC-Date", b"2024-01-01T00:00:00Z"), (b"WARC-Payload-Digest", b"sha256:" + digest.encode())]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if refers_to is not None:
        head = [(b"WARC-Type", b"revisit"), (b"WARC-Record-ID", _name(page_id, row)), *common, (b"WARC-Profile", _PROFILE), (b"WARC-Refers-To", _name(refers_to)), (b"Content-Type", b"application/http; msgtype=response")]
        yield _record(head, http + b"Content-Length: %d\r\n\r\n" % len(payload))
        return
    block = http + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    head = [(b"WARC-Type", b"response"), (b"WARC-Record-ID", _name(page_id, row)), *common, (b"Content-Type", b"application/http; msgtype=response")]
    if len(block) <= segment:
        yield _record(head, block)
        return
    yield _record([*head, (b"WARC-Segment-Number", b"1")], block[:segment])
    for number, at in enumerate(range(segment, len(block), segment), 2):
        more = [(b"WARC-Type", b"continuation"), (b"WARC-Record-ID", _name(page_id, f"{row}:{number}")), *common, (b"WARC-Segment-Origin-ID", _name(page_id, row)), (b"WARC-Segment-Number", b"%d" % number)]
        if at + segment >= len(block):
            more.append((b"WARC-Segment-Total-Length", b"%d" % len(block)))
        yield _record(more, block[at : at + segment])


def read_records(raw: io.BufferedIOBase) -> Iterator[tuple[dict, bytes]]:
    """Headers (names in lower case) and block of each record of an archive."""
    while line := raw.readline():
        if line == CRLF:
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("not at a record's start")
        headers = {}
        while (line := raw.readline()) not in (CRLF, b""):
            k, _, v = line.partition(b":")
            headers[k.strip().lower()] = v.strip()
        n = int(headers[b"content-length"])
        block = raw.read(n)
        if len(block) != n:
            raise ValueError("a record ends early")
        yield headers, block


def payload_of(block: bytes) -> tuple[dict, bytes]:
    """HTTP headers and payload of a response's whole block."""
    head, _, body = block.partition(CRLF + CRLF)
    headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(b":") for line in head.split(CRLF)[1:])}
    return headers, dechunked(body) if headers.get(b"transfer-encoding", b"").lower() == b"chunked" else body


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST_REVISIT, segment: int = SEGMENT) -> None:
    """Write an archive of WARC files (.warc.gz, one gzip member for each record) to ``path``, through Spark's committed writer, with a response or a revisit for each row.

    Of rows with equal payloads (by SHA-256) of at least ``least`` bytes the one with the smallest id is a response and the others revisit it.
    Null payloads count as empty. Ids are whole numbers and stand for their rows: rows that repeat an id and a payload are both responses. A null id is written as none and revisits
    if an equal payload has an id. Smallest ids are combined before the shuffle, and only digests take part in finding them.
    """
    bounded_batches(pages.sparkSession)
    rows = pages.select(F.col(id_col).cast("long").alias("_id"), F.col(url_col).cast("string").alias("_url"), F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8").alias("_payload"))
    small = rows.select("_id", F.unhex(F.sha2("_payload", 256)).alias("_digest"), F.octet_length("_payload").alias("_n")).where(F.col("_n") >= least)
    first = small.groupBy("_digest").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_rows")).where("_rows > 1 and _first is not null").select("_digest", "_first")
    copies = small.join(first, "_digest").where(~F.col("_id").eqNullSafe(F.col("_first"))).select(F.col("_id").alias("_i"), F.col("_digest").alias("_d"), "_first").distinct()
    tagged = rows.withColumn("_digest", F.unhex(F.sha2("_payload", 256)))
    told = tagged.join(copies, tagged["_id"].eqNullSafe(copies["_i"]) & (tagged["_digest"] == copies["_d"]), "left").select("_id", "_url", "_payload", "_digest", "_first")

    def framed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n = TaskContext.get().partitionId(), 0
        for b in batches:
            ids, urls, firsts = (b.column(k).to_pylist() for k in (0, 1, 4))
            out, size = [], 0
            for k, page in enumerate(ids):
                n += 1
                for record in records_of(page, urls[k], b.column(2)[k].as_py(), b.column(3)[k].as_py().hex(), firsts[k], f"{task}.{n}", segment):
                    out.append(_member(record))
                    size += len(out[-1])
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])
                        out, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    records = told.mapInArrow(framed, "record binary").select(F.col("record").cast("string"))
    records.write.option("lineSep", "\0").option("compression", "none").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)
    _renamed(pages.sparkSession, path)


def _renamed(spark, path: str) -> None:
    """Give the files of a committed folder the ending .warc.gz: a rename for each, as the commit itself makes."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for status in fs.listStatus(folder):
        name = status.getPath().getName()
        if name.endswith(".txt"):
            fs.rename(status.getPath(), jvm.org.apache.hadoop.fs.Path(folder, name.removesuffix(".txt") + ".warc.gz"))


_WHOLE = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, intact boolean"
_WHOLE_TYPES = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_())
_PART = "origin string, number int, total long, digest string, block binary"
_PART_TYPES = (pa.string(), pa.int32(), pa.int64(), pa.string(), pa.binary())


def _row(headers: dict, block: bytes) -> tuple:
    told = headers.get(b"warc-payload-digest", b"").decode().removeprefix("sha256:")
    http, payload = payload_of(block)
    page = _page(headers[b"warc-record-id"])
    if headers[b"warc-type"] == b"revisit":
        return page, int(http[b"content-length"]), told, "revisit", _page(headers[b"warc-refers-to"]), True
    digest = hashlib.sha256(payload).hexdigest()
    return page, len(payload), digest, "response", None, digest == told


def read_warc(spark, path: str) -> DataFrame:
    """A row for each response and revisit of the archives below ``path``, each of which is read and inflated once.

    Continuation records are grouped with the first segment by the origin's id, put in order by segment number, and their total length is verified; then chunked transfer framing is decoded.
    Only segmented records are shuffled, each to a group of its own. A record whose segments are missing, repeated or of the wrong total length comes out with
    ``intact`` false and null payload columns, as does nothing else; a response is ``intact`` if its payload has the digest that its header tells. A revisit's bytes and digest are the full payload's, from its headers.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(path).select("content")
    schema = f"{_WHOLE}, {_PART}"
    none = (None,) * 5

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for b in batches:
            for content in b.column(0):
                for h, block in read_records(gzip.GzipFile(fileobj=io.BytesIO(content.as_py()))):
                    if b"warc-segment-number" in h:
                        total = h.get(b"warc-segment-total-length")
                        origin = h.get(b"warc-segment-origin-id", h[b"warc-record-id"]).decode()
                        rows.append((*none, None, origin, int(h[b"warc-segment-number"]), int(total) if total else None, h.get(b"warc-payload-digest", b"").decode(), block))
                        size += len(block)
                    else:
                        rows.append((*_row(h, block), *none))
                    if len(rows) == 10_000 or size > 8 << 20:
                        yield _batch(rows, (*_WHOLE_TYPES, *_PART_TYPES), schema)
                        rows, size = [], 0
        if rows:
            yield _batch(rows, (*_WHOLE_TYPES, *_PART_TYPES), schema)

    def joined(group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda r: r["number"])
        return pa.Table.from_batches([_batch([reassembled(rows)], _WHOLE_TYPES, _WHOLE)])

    found = Scratch(files.mapInArrow(parsed, schema), "warc-records").df
    segmented = found.where("origin is not null").select(*(x.split()[0] for x in _PART.split(", "))).groupBy("origin").applyInArrow(joined, _WHOLE)
    return found.where("origin is null").select(*(x.split()[0] for x in _WHOLE.split(", "))).unionByName(segmented)


def reassembled(rows: list[dict]) -> tuple:
    """One record from its segments in order."""
    origin = rows[0]["origin"].encode()
    block = b"".join(r["block"] for r in rows)
    if [r["number"] for r in rows] != list(range(1, len(rows) + 1)) or rows[-1]["total"] != len(block):
        return _page(origin), None, None, "response", None, False
    return _row({b"warc-record-id": origin, b"warc-type": b"response", b"warc-payload-digest": rows[0]["digest"].encode()}, block)


def _batch(rows: list[tuple], types: tuple, schema: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[x.split()[0] for x in schema.split(", ")])


def op7_warc(spark, sf_dir):
    """All ``pages`` written to archives in the shared folder and read back."""
    path = scratch_path(spark, "warc")
    write_warc(spread(table(spark, sf_dir, "pages").select("page_id", "url", "html")), path)
    return read_warc(spark, path)


ORACLE_SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest
)
SELECT p.page_id, p.payload_bytes, p.payload_digest,
       CASE WHEN f.first_id < p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN f.first_id < p.page_id THEN f.first_id END AS refers_to,
       true AS intact
FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest AND p.payload_bytes >= 100
"""

"""WARC archives as a chunked record table.

Writing: each page is a record; a payload past SEGMENT_BYTES goes on in
continuation records (segment numbers and origin id, as the format has them), so
no line of an archive is long; records leave one by one, cut from the payload
where Arrow holds it. Of equal payloads of REVISIT_BYTES or more, the
one with the smallest id is the response and the others are revisits that carry
only their HTTP head. Spark's text sink writes the archives, gzipped, so any
file system Spark knows will do.

Reading: a gzipped file is one stream of lines, and a small state machine turns
it into rows of (record id, chunk number): payload bytes so far, the running
SHA-256, and, if asked for, the chunk's bytes. Nothing longer than a chunk is
held. A record whose digest differs from its header stops the job.

Defined results: a null payload is empty and a null url is the empty one; a
null id is written as an empty one and read back as null; rows that repeat the
response's id and payload are responses too; an empty table gives an empty
result; columns other than id, url and payload are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phonolake.llm.common import column, materialize, scratch_path, ship, table

SEGMENT_BYTES = 1 << 18
CHUNK_BYTES = 1 << 20
REVISIT_BYTES = 100
#: Bytes of records in one batch on their way to the sink.
BATCH_BYTES = 1 << 23
DATE = "1970-01-01T00:00:00Z"
_TRAILER = b"\r\n\r\n"


def marked(pages: DataFrame, key: str, url: str, payload: str) -> DataFrame:
    """key, url, payload, digest, and refers_to: the response's key where the row is a revisit."""
    body = F.coalesce(column(pages, payload), F.lit(""))
    slim = pages.select(column(pages, key).alias("key"), F.coalesce(column(pages, url), F.lit("")).alias("url"), body.alias("payload"), F.sha2(body, 256).alias("digest"))
    long = pages.select(column(pages, key).alias("key"), F.sha2(body, 256).alias("digest"), F.octet_length(body).alias("n")).where(F.col("n") >= REVISIT_BYTES)
    shared = long.groupBy("digest").agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first")
    shared = materialize(shared, "shared")  # a table of its own, so that the join may split a crowded payload
    other = F.col("first").isNotNull() & ~F.col("key").eqNullSafe(F.col("first"))
    return slim.join(shared, "digest", "left").select("key", "url", "payload", "digest", F.when(other, F.col("first")).alias("refers_to"))


def _id(key: object) -> str:
    return f"<urn:x-page:{'' if key is None else quote(str(key), safe='')}>"


def _cuts(body: memoryview) -> Iterator[tuple[int, int]]:
    """Where the parts of SEGMENT_BYTES at most begin and end, cut between characters."""
    at = 0
    while True:
        end = min(at + SEGMENT_BYTES, len(body))
        while end < len(body) and body[end] & 0xC0 == 0x80:
            end -= 1
        yield at, end
        at = end
        if at == len(body):
            return


def records(key: object, url: str, payload: memoryview | str, digest: str, refers_to: object) -> Iterator[bytes]:
    """The WARC records of one page, one at a time, each without its last line feed, which the sink
    adds. A payload in a buffer stays where it is; only the segment at hand is copied."""
    body = memoryview(payload.encode()) if isinstance(payload, str) else payload
    own, uri = _id(key), quote(url, safe=":/?#[]@!$&'()*+,;=%~")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode()
    revisit = refers_to is not None
    several = len(body) > SEGMENT_BYTES and not revisit
    for number, (at, end) in enumerate([(0, 0)] if revisit else _cuts(body), 1):
        block = bytes(body[at:end])
        block = http + block if number == 1 else block
        head = [f"WARC-Type: {'continuation' if number > 1 else 'revisit' if revisit else 'response'}", f"WARC-Record-ID: {own if number == 1 else own[:-1] + f':{number}>'}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha256:{digest}"]
        if revisit:
            head += [f"WARC-Refers-To: {_id(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
        if several:
            head += [f"WARC-Segment-Number: {number}"] + ([f"WARC-Segment-Origin-ID: {own}"] if number > 1 else []) + ([f"WARC-Segment-Total-Length: {len(http) + len(body)}"] if end == len(body) else [])
        head += [f"Content-Type: {'application/http; msgtype=response' if number == 1 else 'application/octet-stream'}", f"Content-Length: {len(block)}"]
        yield b"WARC/1.1\r\n" + "\r\n".join(head).encode() + _TRAILER + block + _TRAILER[:-1]


def write_archives(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html") -> None:
    """Write pages as gzipped WARC files under path."""
    ship(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = lambda rows: pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()).cast(pa.string())], names=["value"])
        held: list[bytes] = []
        size = 0
        for batch in batches:
            bodies = batch.column(2).cast(pa.binary())
            for i in range(batch.num_rows):
                own, address, digest, refers_to = (batch.column(k)[i].as_py() for k in (0, 1, 3, 4))
                for record in records(own, address, memoryview(bodies[i].as_buffer()), digest, refers_to):
                    held.append(record)
                    size += len(record)
                    if size >= BATCH_BYTES:
                        yield pack(held)
                        held, size = [], 0
        if held:
            yield pack(held)

    marked(pages, key, url, payload).mapInArrow(run, "value string").write.option("compression", "gzip").text(path)


class Reader:
    """Lines of archives in, chunk rows out."""

    def __init__(self, keep: bool) -> None:
        self.keep, self.state, self.record = keep, "start", None

    def line(self, line: bytes) -> Iterator[tuple]:
        data = line + b"\n"
        if self.state == "start":
            if data.strip():
                if not data.startswith(b"WARC/"):
                    raise ValueError(f"not a record's start: {data[:80]!r}")
                self.head, self.state = {}, "head"
        elif self.state == "head":
            if data != b"\r\n":
                name, _, value = data.decode().partition(":")
                self.head[name.strip().lower()] = value.strip()
                return
            self.left, self.state, self.trailer = int(self.head["content-length"]), "block", b""
            kind = self.head["warc-type"]
            if kind != "continuation":
                yield from self.finish()
                self.record = {"head": self.head, "sha": hashlib.sha256(), "n": 0, "chunk": 0, "http": {}, "body": False, "held": [], "size": 0}
        elif self.state == "block":
            inside, rest = data[: self.left], data[self.left :]
            self.left -= len(inside)
            if inside:
                yield from self.inside(inside)
            if rest or not self.left:
                self.trailer += rest
                if self.trailer == _TRAILER:
                    self.state = "start"
                elif not _TRAILER.startswith(self.trailer):
                    raise ValueError(f"no end of record: {self.trailer[:80]!r}")

    def inside(self, data: bytes) -> Iterator[tuple]:
        r = self.record
        if not r["body"]:  # the HTTP head ends with an empty line
            if data == b"\r\n":
                r["body"] = True
            else:
                name, _, value = data.decode().partition(":")
                r["http"][name.strip().lower()] = value.strip()
            return
        for at in range(0, len(data), CHUNK_BYTES):
            part = data[at : at + CHUNK_BYTES]
            if r["size"] and r["size"] + len(part) > CHUNK_BYTES:
                yield self.row(False)
            r["sha"].update(part)
            r["n"] += len(part)
            r["size"] += len(part)
            if self.keep:
                r["held"].append(part)

    def row(self, last: bool) -> tuple:
        r = self.record
        head, revisit = r["head"], r["head"]["warc-type"] == "revisit"
        stated = head["warc-payload-digest"].removeprefix("sha256:")
        if last and not revisit and stated != r["sha"].hexdigest():
            raise ValueError(f"{head['warc-record-id']}: payload digest {r['sha'].hexdigest()}, header {stated}")
        out = (_key(head["warc-record-id"]), r["chunk"], head["warc-type"], _key(head.get("warc-refers-to")), head["warc-target-uri"], int(r["http"]["content-length"]) if revisit else r["n"], stated if revisit else r["sha"].hexdigest(), last, b"".join(r["held"]) if self.keep else None)
        r["chunk"], r["held"], r["size"] = r["chunk"] + 1, [], 0
        return out

    def finish(self) -> Iterator[tuple]:
        if self.record is not None:
            yield self.row(True)
            self.record = None


def _key(urn: str | None) -> str | None:
    """The key in a record id; None for an empty or missing one."""
    found = re.fullmatch(r"<urn:x-page:([^>:]*)(?::\d+)?>", urn or "")
    return unquote(found[1]) if found and found[1] else None


_CHUNKS = {"record_id": pa.string(), "chunk": pa.int64(), "record_type": pa.string(), "refers_to": pa.string(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "last": pa.bool_(), "payload": pa.binary()}


def read_archives(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """Chunk rows of the archives under path; payload_bytes and payload_digest run up to the row's chunk."""
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _CHUNKS.values(), strict=True)], names=list(_CHUNKS))
        reader, rows = Reader(payload), []
        for batch in batches:
            for line in batch.column(0).cast(pa.binary()).to_pylist():
                rows += reader.line(line)
                if len(rows) >= (16 if payload else 4096):
                    yield pack(rows)
                    rows = []
        rows += reader.finish()
        if rows:
            yield pack(rows)

    lines = spark.read.schema("value string").option("lineSep", "\n").text(path)
    return lines.mapInArrow(run, "record_id string, chunk long, record_type string, refers_to string, url string, payload_bytes long, payload_digest string, last boolean, payload binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    path = scratch_path(spark, "warc")
    write_archives(pages, path)
    whole = read_archives(spark, path, payload=False).where("last")
    kind = pages.schema["page_id"].dataType
    return whole.select(F.col("record_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))


ORACLE_SQL = """
WITH p AS (
  SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes,
    sha256(encode(coalesce(html, ''))) AS payload_digest
  FROM pages
), f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""

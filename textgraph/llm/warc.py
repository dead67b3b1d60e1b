"""WARC archives of web pages: records are indexed as they are written, and read back by coalesced byte ranges."""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textgraph.llm import files
from textgraph.llm.common import arrow_limits, lean, saved, shuffle_parts, work_dir

#: Payloads below this many bytes are stored even if they repeat.
REVISIT_BYTES = 100
#: Bytes of an archive, about; ranges closer than GAP are read as one, of RANGE bytes at most unless a record is larger.
ARCHIVE_BYTES, GAP, RANGE = 64 << 20, 64 << 10, 4 << 20
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
_INDEX = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("url", pa.string()), ("digest", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string())])


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _page(urn: str) -> int | None:
    n = urn.removeprefix("<urn:page:").rstrip(">")
    return None if n == "none" else int(n)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """A record, as a gzip member of its own.  refers_to: the page whose response a revisit points at."""
    head = [f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=_URL, errors='surrogatepass')}")
    head += ["Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha256:{digest}"]
    if refers_to is None:
        body = _HTTP + b"Content-Length: %d\r\n\r\n" % len(payload) + payload
    else:
        head += [f"WARC-Refers-To: {_urn(refers_to)}", f"WARC-Profile: {_PROFILE}"]
        body = _HTTP + b"\r\n"
    head.append(f"Content-Length: {len(body)}")
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(("WARC/1.1\r\n" + "\r\n".join(head) + "\r\n\r\n").encode() + body + b"\r\n\r\n") + z.flush()


_URL = "".join(map(chr, range(33, 127)))


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and payload of one record."""
    raw = zlib.decompress(data, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not re.fullmatch(r"WARC/1\.\d", lines[0]):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines[1:])}
    body = rest[: int(fields["content-length"])]
    return fields, body.partition(b"\r\n\r\n")[2]


def write_archives(pages: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Writes a record per page below folder, and returns the saved index.

    pages needs page_id, url and html; other columns are ignored.  Null html is an empty payload, a null url is left
    out.  Of pages with equal payloads of REVISIT_BYTES or more, that of the smallest page_id is the response and the
    others revisit it; equal ids among them (repeated rows) are all responses, and pages without an id are responses.
    An empty table writes nothing.
    """
    spark = pages.sparkSession
    arrow_limits(spark)
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long"), "url", payload.alias("payload"))
    slim = rows.select("page_id", F.sha2("payload", 256).alias("digest"), F.octet_length("payload").alias("n"))
    long = slim.filter((F.col("n") >= REVISIT_BYTES) & F.col("page_id").isNotNull())
    # only ids and digests are shuffled here: partial minima first, then revisits by their page_id
    firsts = long.groupBy("digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).filter("first < last").select("digest", "first")
    revisits = long.join(firsts, "digest").filter("page_id > first").select("page_id", "digest", F.col("first").alias("refers_to")).distinct()
    full = rows.withColumn("digest", F.sha2("payload", 256)).join(revisits, ["page_id", "digest"], "left")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, offset = TaskContext.get().partitionId(), 0, 0
        mine = uuid.uuid4().hex  # another attempt at this part writes other files; the index names those that count
        data: list[bytes] = []
        index: list[dict] = []

        def flush() -> pa.RecordBatch:
            nonlocal seq, offset
            files.put(index[0]["path"], b"".join(data))
            out = pa.RecordBatch.from_pylist(index, schema=_INDEX)
            data.clear()
            index.clear()
            seq, offset = seq + 1, 0
            return out

        for batch in batches:
            for page_id, url, body, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                one = record(page_id, url, body, digest, refers_to, date)
                index.append({"path": f"{folder}/archives/{part:06d}-{seq:05d}-{mine}.warc.gz", "offset": offset, "length": len(one), "url": url, "digest": digest, "page_id": page_id, "record_type": "response" if refers_to is None else "revisit"})
                data.append(one)
                offset += len(one)
                if offset >= ARCHIVE_BYTES:
                    yield flush()
        if index:
            yield flush()

    out = full.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(lean(write), "path string, offset long, length long, url string, digest string, page_id long, record_type string")
    return saved(out, f"{folder}/index")


def coalesce(spans: list[tuple[int, int]]) -> list[tuple[int, int, list[int]]]:
    """Byte ranges that cover (offset, length) spans in ascending order: offset, length, and the numbers of their spans."""
    out: list[tuple[int, int, list[int]]] = []
    for i, (offset, length) in enumerate(spans):
        if out and offset - (out[-1][0] + out[-1][1]) <= GAP and offset + length - out[-1][0] <= RANGE:
            start, size, members = out[-1]
            out[-1] = (start, max(size, offset + length - start), [*members, i])
        else:
            out.append((offset, length, [i]))
    return out


_RECORDS = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload", pa.binary()), ("digest", pa.string()), ("refers_to", pa.int64())])


def read_records(index: DataFrame) -> DataFrame:
    """The records that rows of an index point at: page_id, url, record_type, payload (null for revisits), digest, refers_to.

    The rows of an archive are sorted by offset, and neighbours are read by one range.  A response whose payload
    doesn't have the digest of its header raises ValueError.
    """
    spark = index.sparkSession
    arrow_limits(spark)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, spans = batch.column(0).to_pylist(), list(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()))
            urls, at = batch.column(3).to_pylist(), 0
            while at < len(paths):
                upto = at
                while upto < len(paths) and paths[upto] == paths[at]:
                    upto += 1
                plan = coalesce(spans[at:upto])
                for (start, _, members), data in zip(plan, files.ranges(paths[at], [p[:2] for p in plan])):
                    rows = []
                    for i in members:
                        offset, length = spans[at + i]
                        head, body = parse(data[offset - start : offset - start + length])
                        kind, digest = head["warc-type"], head["warc-payload-digest"].removeprefix("sha256:")
                        if kind == "response" and hashlib.sha256(body).hexdigest() != digest:
                            raise ValueError(f"{paths[at]} at {offset}: payload damaged")
                        rows.append({"page_id": _page(head["warc-record-id"]), "url": urls[at + i], "record_type": kind, "payload": body if kind == "response" else None, "digest": digest, "refers_to": _page(head["warc-refers-to"]) if kind == "revisit" else None})
                    yield pa.RecordBatch.from_pylist(rows, schema=_RECORDS)
                at = upto

    chosen = index.select("path", "offset", "length", "url").repartition(shuffle_parts(spark), "path", F.floor(F.col("offset") / (8 * RANGE))).sortWithinPartitions("path", "offset")
    return chosen.mapInArrow(lean(read), "page_id long, url string, record_type string, payload binary, digest string, refers_to long")


def warc_digest(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Writes the archives of pages, reads every record back, and tells size, digest and kind of each page."""
    folder = work_dir(spark, "warc")
    read = read_records(write_archives(pages, folder))
    kept = saved(read.select("page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", "refers_to"), f"{folder}/records")
    responses = kept.filter("record_type = 'response'")
    sizes = responses.groupBy(F.col("page_id").alias("refers_to"), "payload_digest").agg(F.max("payload_bytes").alias("payload_bytes"))
    revisits = kept.filter("record_type = 'revisit'").drop("payload_bytes").join(sizes, ["refers_to", "payload_digest"], "left")
    return responses.unionByName(revisits).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")

"""Token ids of documents as compressed binary files, written and read back.

A file is a run of segments.  A segment holds whole documents: a length and a crc32, then (compressed) the doc_id and
the number of ids of each document, then their ids as coded by TokenCoder (see java/TokenCoder.java): blocks that start
anew, each with the checksums of its ids and of its bytes.  Ids are made by Python tasks and coded in the JVM.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, StructType

from textgraph.llm import files, jvm
from textgraph.llm.common import arrow_limits, lean, saved, shuffle_parts, work_dir
from textgraph.llm.wordmemo import encoder

MAGIC = b"TGIDS3\n"
#: Ids of a segment, about (a longer document is a segment of its own), and bytes of a file, about.
SEGMENT_IDS, FILE_BYTES = 1 << 20, 1 << 28


def coded(spark: SparkSession, ids: Column) -> Column:
    """ids (uint32, little endian) as coded blocks."""
    return jvm.function(spark, "TokenCoder", "Encode", BinaryType(), ids)


def decoded(spark: SparkSession, blocks: Column) -> Column:
    """Coded blocks as ids; the job fails where a checksum doesn't hold."""
    return jvm.function(spark, "TokenCoder", "Decode", BinaryType(), blocks)


def pack_heads(doc_ids: list[int | None], sizes: list[int]) -> bytes:
    """A segment's documents: a byte each (0: no id), then their ids and their sizes as 64-bit integers, compressed."""
    known = np.array([i is not None for i in doc_ids], np.uint8)
    raw = known.tobytes() + np.array([i or 0 for i in doc_ids], "<i8").tobytes() + np.array(sizes, "<i8").tobytes()
    return zlib.compress(raw, 1)


def segment(heads: bytes, blocks: bytes) -> bytes:
    return struct.pack("<QQI", len(heads), len(blocks), zlib.crc32(heads)) + heads + blocks


def parse_segment(data: bytes) -> tuple[bytes, bytes]:
    """Heads and coded blocks; ValueError where the segment is damaged (blocks check themselves)."""
    if len(data) < 20:
        raise ValueError("token file: segment damaged")
    n, m, crc = struct.unpack("<QQI", data[:20])
    heads = data[20 : 20 + n]
    if len(data) != 20 + n + m or zlib.crc32(heads) != crc:
        raise ValueError("token file: segment damaged")
    return zlib.decompress(heads), data[20 + n :]


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, kind: str, end_id: int = 0) -> DataFrame:
    """Encodes whole texts and writes their ids, each document closed by end_id, in ascending doc_id order.

    docs needs doc_id and text.  Null texts are empty; null doc_ids come first; documents of equal doc_id come in the
    order of a hash of their texts, and repeated rows each count.  An empty table writes no file.  Other columns are
    ignored.  Returns the manifest, which is itself saved in the folder, a row a segment: part, seq, path, at and bytes
    (its place in the file), docs, ids, first (ids of this part before it).  Segments in the order of (part, seq) hold
    the documents in order.  A task that runs again writes files of other names, and the manifest names those that count.
    """
    spark = docs.sparkSession
    arrow_limits(spark)

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer, kind), np.array([end_id], np.uint32)
        doc_ids: list[int | None] = []
        sizes: list[int] = []
        ids: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal held
            row = pa.RecordBatch.from_pylist([{"docs": len(sizes), "n": held, "heads": pack_heads(doc_ids, sizes), "ids": np.concatenate(ids).astype("<u4").tobytes()}], schema=_TOKENS)
            held = 0
            for x in (doc_ids, sizes, ids):
                x.clear()
            return row

        for batch in batches:
            for i, got in zip(batch.column(0).to_pylist(), encode(batch.column(1).to_pylist())):
                if held and held + len(got) >= SEGMENT_IDS:
                    yield flush()
                doc_ids.append(i)
                sizes.append(len(got) + 1)
                ids += (got, end)
                held += len(got) + 1
        if sizes:
            yield flush()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, first = TaskContext.get().partitionId(), 0, 0
        path, out, at = "", None, 0
        try:
            for batch in batches:
                rows = []
                for row in batch.to_pylist():
                    if out is None or at >= FILE_BYTES:
                        if out is not None:
                            out.close()
                        path, at = f"{folder}/ids/{part:06d}-{seq:05d}-{uuid.uuid4().hex}.tgids", len(MAGIC)
                        out = files.create(path)
                        out.write(MAGIC)
                    data = segment(row["heads"], row["blocks"])
                    out.write(data)
                    rows.append({"part": part, "seq": seq, "path": path, "at": at, "bytes": len(data), "docs": row["docs"], "ids": row["n"], "first": first})
                    seq, first, at = seq + 1, first + row["n"], at + len(data)
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=_MANIFEST)
        finally:
            if out is not None:
                out.close()

    order = ["doc_id", "of"]
    ordered = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("of")).repartitionByRange(shuffle_parts(spark), *order).sortWithinPartitions(*order, "text")
    ids = ordered.select("doc_id", "text").mapInArrow(lean(tokens), "docs long, n long, heads binary, ids binary")
    blocks = ids.select("docs", "n", "heads", coded(spark, F.col("ids")).alias("blocks"))
    return saved(blocks.mapInArrow(write, "part int, seq int, path string, at long, bytes long, docs long, ids long, first long"), f"{folder}/manifest")


_TOKENS = pa.schema([("docs", pa.int64()), ("n", pa.int64()), ("heads", pa.binary()), ("ids", pa.binary())])
_MANIFEST = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("path", pa.string()), ("at", pa.int64()), ("bytes", pa.int64()), ("docs", pa.int64()), ("ids", pa.int64()), ("first", pa.int64())])


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """The documents of a folder of token files: doc_id, start (ids before it in the folder), ids (uint32, little endian)."""
    arrow_limits(spark)
    manifest = spark.read.parquet(f"{folder}/manifest")
    # one number a part of the writing job; documents aren't collected
    totals = sorted((r["part"], r["n"], r["k"]) for r in manifest.groupBy("part").agg(F.sum("ids").alias("n"), F.count(F.lit(1)).alias("k")).collect())
    base, so_far = {}, 0
    for part, n, _ in totals:
        base[part], so_far = so_far, so_far + n

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, at, size, part, first in zip(*(c.to_pylist() for c in batch.columns)):
                (data,) = files.ranges(path, [(at, size)])
                heads, blocks = parse_segment(data)
                yield pa.RecordBatch.from_arrays([pa.array([base[part] + first]), pa.array([heads], pa.binary()), pa.array([blocks], pa.binary())], names=["start", "heads", "blocks"])

    spread = manifest.select("path", "at", "bytes", "part", "first").repartition(max(1, min(sum(k for _, _, k in totals), shuffle_parts(spark))))
    segments = spread.mapInArrow(read, "start long, heads binary, blocks binary")
    documents = jvm.function(spark, "TokenCoder", "Documents", _DOCUMENTS, F.col("heads"))
    one = segments.select("start", decoded(spark, F.col("blocks")).alias("ids"), documents.alias("docs")).select("start", "ids", F.explode("docs").alias("d"))
    return one.select("d.doc_id", (F.col("start") + F.col("d.at")).alias("start"), F.substring("ids", (4 * F.col("d.at") + 1).cast("int"), (4 * F.col("d.n")).cast("int")).alias("ids"))


_DOCUMENTS = ArrayType(StructType().add("doc_id", "long").add("at", "long").add("n", "long"))


def token_ids_digest(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files that were just written."""
    spark = docs.sparkSession
    folder = work_dir(spark, "token-ids")
    write_token_files(docs, folder, tokenizer, "byte", 0)
    return read_token_files(spark, folder).select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))

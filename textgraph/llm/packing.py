"""Packing documents into sequences of fixed length: first-fit decreasing over a tournament tree of bin capacities."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textgraph.llm.common import arrow_limits, lean, shuffle_parts
from textgraph.llm.wordmemo import encoder

#: Bytes of text to a group of documents, on average; a group is packed in one task, and a task packs many.
GROUP_BYTES = 2 << 20


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each size (1 to capacity): largest first, each into the first bin that has room.

    Equal sizes go in their given order.  Leaves of the tree hold the free room of the bins and inner nodes the most
    below them, so the first bin with room is found going down once.
    """
    order = np.argsort(-sizes, kind="stable")
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    full = int((sizes == capacity).sum())
    bins[order[:full]] = np.arange(full)  # they come first, and each fills a bin
    rest = order[full:]
    leaves = 1 << max(0, int(len(rest) - 1).bit_length())
    tree = [capacity] * (2 * leaves)
    where, at = [], []
    for size in sizes[rest].tolist():
        i = 1
        while i < leaves:
            i += i
            if tree[i] < size:
                i += 1
        where.append(i - leaves)
        at.append(capacity - tree[i])
        tree[i] -= size
        while i > 1:
            i >>= 1
            left, right = tree[i + i], tree[i + i + 1]
            top = left if left >= right else right
            if tree[i] == top:
                break
            tree[i] = top
    bins[rest] = np.array(where, np.int64) + full
    offsets[rest] = at
    return bins, offsets


def pack_documents(docs: DataFrame, tokenizer: str, kind: str, end_id: int = 1, length: int = 2048) -> DataFrame:
    """Pieces of documents and their places in sequences of at most ``length`` ids.

    docs needs doc_id and text; other columns are ignored.  A document's ids are those of its text (null: none) and
    end_id.  It is cut after every ``length`` ids, so all pieces but its last fill a sequence.  Documents are dealt at
    random to groups, each packed by first-fit decreasing; pieces that fill a sequence are dealt one by one, so that a
    very long document isn't one task's.  Rows of equal or null doc_id are documents of their own, and equal rows
    without an id are dealt apart.  An empty table gives an empty result.  Returns doc_id, start, length, doc_tokens, sequence_id, offset, sequence_tokens,
    ids (uint32, little endian).
    """
    spark = docs.sparkSession
    arrow_limits(spark)
    size = docs.agg(F.sum(F.octet_length("text")).alias("b"), F.count(F.lit(1)).alias("n")).head()
    groups = max(1, -(-((size["b"] or 0) + 4 * size["n"]) // GROUP_BYTES))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, kind)
        end = np.array([end_id], np.uint32)
        copies: Counter[int] = Counter()  # of rows without an id, by their ids' hash
        for batch in batches:
            rows: list[tuple] = []
            for doc, got in zip(batch.column(0).to_pylist(), encode(batch.column(1).to_pylist())):
                ids = np.concatenate((got, end)).astype("<u4")
                # by what the document holds, so that a repeated task deals it to the same group
                whole = zlib.crc32(ids.tobytes())
                if doc is None:
                    copies[whole] += 1
                    salt = b"- %d" % copies[whole]
                else:
                    salt = b"%d" % doc
                for start in range(0, len(ids), length):
                    raw = ids[start : start + length].tobytes()
                    group = zlib.crc32(salt if len(raw) < 4 * length else salt + b" %d" % start, whole) % groups
                    rows.append((group, doc, start, len(raw) // 4, len(ids), raw))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _PIECES.types)], schema=_PIECES)

    def pack(group: pa.Table) -> pa.Table:
        by = group.sort_by([("doc_id", "ascending"), ("start", "ascending"), ("doc_tokens", "ascending"), ("ids", "ascending")])
        sizes = by["length"].to_numpy()
        bins, offsets = first_fit_decreasing(sizes, length)
        number = by["packing_group"].to_numpy().astype(np.int64)
        filled = np.bincount(bins, sizes).astype(np.int64)[bins]
        return by.drop_columns(["packing_group"]).append_column("sequence_id", pa.array((number << 32) + bins)).append_column("offset", pa.array(offsets)).append_column("sequence_tokens", pa.array(filled))

    pieces = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(cut), "packing_group int, doc_id long, start long, length long, doc_tokens long, ids binary")
    packed = pieces.repartition(max(shuffle_parts(spark), 1), "packing_group").groupBy("packing_group").applyInArrow(pack, "doc_id long, start long, length long, doc_tokens long, ids binary, sequence_id long, offset long, sequence_tokens long")
    return packed.select("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "sequence_tokens", "ids")


_PIECES = pa.schema([("packing_group", pa.int32()), ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary())])


def packing_digest(docs: DataFrame, tokenizer: str) -> DataFrame:
    """One row a piece, its ids as crc32."""
    return pack_documents(docs, tokenizer, "word", 1, 2048).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "sequence_tokens")

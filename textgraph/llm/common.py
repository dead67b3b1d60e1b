"""What the operators share: the shared folder, written tables, byte-level word scans and crc columns."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most bytes of an Arrow batch handed to Python, so that long texts don't make large batches.
BATCH_BYTES = 4 << 20
BATCH_ROWS = 2048


_OWN: dict[str, str] = {}


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``.

    Where that is unset, a local session (tests) gets a temp folder of its own; a cluster must name a shared one.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        app = spark.sparkContext
        if not app.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = _OWN.setdefault(app.applicationId, "")
        if not base:
            base = _OWN[app.applicationId] = "file://" + tempfile.mkdtemp(prefix="textgraph-")
            atexit.register(shutil.rmtree, base.removeprefix("file://"), ignore_errors=True)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, *paths: str) -> None:
    """Deletes folders made by work_dir once nothing reads them any more."""
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def saved(df: DataFrame, path: str) -> DataFrame:
    """Writes df below path and reads it back: what follows is recovered from the files, not from lineage."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def arrow_limits(spark: SparkSession, most: int = BATCH_BYTES) -> None:
    """Bounds on Arrow batches; and joins of texts with few wanted ids may drop other texts before the shuffle.

    (Spark's own runtime Bloom filter, which it uses only while its size is bounded.)
    """
    spark.conf.set("spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold", "1")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(most))


def _release() -> None:
    """Gives memory that is free, but still held by this process, back to the machine."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def lean(run: Callable) -> Callable:
    """A function for mapInArrow whose process, which other tasks use later, is left with little memory."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _release()
        for i, out in enumerate(run(batches)):
            yield out
            if i % 8 == 7:
                _release()
        _release()

    return wrapped


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_of_id(col) -> F.Column:
    """crc32 of an id written as text; null stays null."""
    return F.crc32(F.col(col).cast("string").cast("binary"))


# --- byte scans -------------------------------------------------------------------------------------------------

_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_S33 = np.uint64(33)
_POW = [np.ones(1, np.uint64)]
#: Bytes that end a word: space, tab to carriage return.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> _S33)
    x = x * _M1
    x ^= x >> _S33
    x *= _M2
    x ^= x >> _S33
    return x


def powers(n: int) -> np.ndarray:
    """1, b, b^2 ... modulo 2^64, n of them at least."""
    if len(_POW[0]) < n:
        out = np.full(max(n, _CHUNK), _BASE, np.uint64)
        out[0] = 1
        _POW[0] = np.multiply.accumulate(out)
    return _POW[0]


#: Bytes that are hashed at a time; powers of b's inverse, by which a sum over bytes at any place becomes one from 0 on.
_CHUNK = 1 << 17
_BACK: list[np.ndarray] = []


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[starts[i]:ends[i]]; spans ascend, don't overlap and aren't empty."""
    if not _BACK:
        out = np.full(_CHUNK, np.uint64(pow(int(_BASE), -1, 1 << 64)))
        out[0] = 1
        _BACK.append(np.multiply.accumulate(out))
    out, lens = np.empty(len(starts), np.uint64), (ends - starts).astype(np.uint64)
    at = 0
    while at < len(starts):
        a = int(starts[at])
        stop = max(at + 1, int(np.searchsorted(ends, a + _CHUNK, side="right")))
        b = int(ends[stop - 1])
        terms = np.zeros(b - a + 1, np.uint64)
        np.add(data[a:b], np.uint64(1), out=terms[:-1], casting="unsafe")
        terms[:-1] *= powers(b - a)[: b - a]
        edges = np.empty(2 * (stop - at), np.int64)
        edges[0::2], edges[1::2] = starts[at:stop], ends[at:stop]
        edges -= a
        sums = np.add.reduceat(terms, edges)[0::2]
        sums *= _BACK[0][np.minimum(edges[0::2], _CHUNK - 1)]  # a longer span stands alone, from 0 on
        out[at:stop] = sums
        at = stop
    return mix64(out + lens * _M2)


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of texts after A-Z became lower case, found in one pass over their bytes.

    hashes: of all words in order; first[i]:first[i+1] are those of text i.
    """

    def __init__(self, texts: list[str | None]):
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        self.data = _LOWER[np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)]
        blank = _SPACE[self.data]
        edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
        if not blank[0]:
            edge = np.concatenate(([0], edge))
        self.starts, self.ends = edge[0::2].astype(np.int64), edge[1::2].astype(np.int64)
        bounds = np.cumsum([0] + [len(r) + 1 for r in raw])
        self.first = np.searchsorted(self.starts, bounds)
        self.hashes = span_hashes(self.data, self.starts, self.ends)

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()

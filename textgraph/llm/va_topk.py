"""Exact top-k by inner product over a vector-approximation file.

Every component is quantised to a cell of one byte, so the file is a fraction of the vectors.  Two scans of the file
bound each score from both sides: the first finds, for each query, the k-th best lower bound of the whole file, the
second the vectors whose upper bound reaches it.  These are read exactly, best upper bound first, until the k-th exact
score is no less than any bound that is left.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textgraph.llm import files
from textgraph.llm.common import arrow_limits, saved, shuffle_parts, work_dir
from textgraph.llm.vectors import batches_of, by_length, classes, one_of_each, packed, ranked, unpack, valid

#: Rows of a block of the file, blocks that a task holds at once, queries of a set, and queries that are bounded at once.
FILE_ROWS, HELD_BLOCKS, QUERY_ROWS, STEP = 8192, 32, 16_384, 256
#: Rows that name cells of the whole table: tasks' extremes are merged so often.
MERGED = 64


def bounds(queries: np.ndarray, cells: np.ndarray, low: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Midpoint scores of queries with the vectors in these cells, and how far the true ones may be off, by query.

    A cell c of a component stands for the integers low + c * width to low + (c + 1) * width - 1.
    """
    half = (width - 1) / 2
    return queries @ (low + cells * width + half).T, np.abs(queries) @ half


RESULT = "query_id long, rank int, vec_id long, score long"


def exact_top_k(vectors: DataFrame, is_query: F.Column, k: int, vector: str = "embedding", cells: int = 256) -> DataFrame:
    """The k best of all other rows for each query row, exactly: query_id, rank (from 1), vec_id, score.

    vectors needs vec_id and an array of whole numbers (as any numeric type); other columns are ignored.  Scores are
    integer inner products, ties go to the smaller vec_id, and a query with fewer others gets all of them.  Null ids,
    null or empty vectors, and vectors with null or non-finite components take no part; those of different lengths
    aren't compared.  Equal vectors are one class, scored once: a class keeps its k + 1 smallest ids, as no result can
    hold more.  Repeated ids with different vectors are rows of their own.
    """
    arrow_limits(vectors.sparkSession)
    folder = work_dir(vectors.sparkSession, "va-file")
    rows = valid(vectors, vector).withColumn("v", F.transform("v", lambda x: x.cast("long")))
    return by_length(rows, lambda some, d: _search(some, is_query, k, cells, d, f"{folder}/{d}"), RESULT)


def _extremes(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The least and the greatest of each component."""

    def run(batches: Iterator[pa.RecordBatch], merge: bool) -> Iterator[pa.RecordBatch]:
        low = high = None
        for batch in batches:
            if batch.num_rows:
                a, b = (c.flatten().to_numpy().reshape(batch.num_rows, -1) for c in (batch.column(0), batch.column(1 if merge else 0)))
                low = a.min(0) if low is None else np.minimum(low, a.min(0))
                high = b.max(0) if high is None else np.maximum(high, b.max(0))
        if low is not None:
            yield pa.RecordBatch.from_arrays([pa.array([low.tolist()]), pa.array([high.tolist()])], names=["low", "high"])

    kind = "low array<long>, high array<long>"
    ends = rows.select("v").mapInArrow(lambda b: run(b, False), kind).repartition(MERGED).mapInArrow(lambda b: run(b, True), kind).collect()
    return np.min([r["low"] for r in ends], axis=0).astype(np.float64), np.max([r["high"] for r in ends], axis=0).astype(np.float64)


def _query_sets(spark: SparkSession, asked: DataFrame, m: int, folder: str) -> list[tuple[int, str]]:
    """The queries as files of some QUERY_ROWS each: (rows, path) of each; there are m / QUERY_ROWS of them."""
    sets = -(-m // QUERY_ROWS)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in batches_of(batches):
            path = f"{folder}/set-{row['s']}-{uuid.uuid4().hex}"
            files.put(path, row["ids"] + row["data"])
            yield pa.RecordBatch.from_pylist([{"n": len(row["ids"]) // 8, "path": path}])

    blocks = packed(asked.withColumn("s", F.pmod(F.xxhash64("class_id"), F.lit(sets))), ["s"], "<i8")
    return sorted((r["n"], r["path"]) for r in saved(blocks.mapInArrow(write, "n long, path string"), f"{folder}/sets").collect())


def _read_set(n: int, path: str) -> tuple[np.ndarray, np.ndarray]:
    data = files.get(path)
    return unpack(data[: 8 * n], data[8 * n :], "<i8")


def _search(rows: DataFrame, is_query: F.Column, k: int, cells: int, dim: int, folder: str) -> DataFrame:
    """exact_top_k() of vectors of one length."""
    spark = rows.sparkSession
    keyed, named = classes(rows, k + 1, f"{folder}/classes")
    asking = saved(keyed.filter(is_query), f"{folder}/asking")
    query_rows = asking.select("vec_id", "class_id").distinct()
    asked = saved(asking.groupBy("class_id").agg(F.first("v").alias("v")), f"{folder}/asked")
    m = asked.count()
    if not m:
        return spark.createDataFrame([], RESULT)
    every = one_of_each(keyed, named)
    low, high = _extremes(rows)
    width = np.maximum(1, np.ceil((high - low + 1) / cells))
    exact = float(dim * max(abs(low.min()), abs(high.max()), 1) ** 2) < 2.0**52

    def quantise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def put() -> pa.RecordBatch:
            ids, codes = (np.concatenate(x) for x in zip(*held))
            held.clear()
            return pa.RecordBatch.from_pylist([{"ids": ids.astype("<i8").tobytes(), "data": codes.tobytes()}], schema=_FILE)

        for batch in batches:
            if batch.num_rows:
                v = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1)
                held.append((batch.column(0).to_numpy(), np.minimum((v - low) // width, cells - 1).astype(np.uint8)))
                size += batch.num_rows
                if size >= FILE_ROWS:
                    yield put()
                    size = 0
        if held:
            yield put()

    file = saved(every.mapInArrow(quantise, "ids binary, data binary"), f"{folder}/file")
    sets = _query_sets(spark, asked, m, folder)

    def held_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids and codes of some blocks at a time; a class that stands twice in them counts once."""
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def put() -> tuple[np.ndarray, np.ndarray]:
            ids, codes = (np.concatenate(x) for x in zip(*held))
            held.clear()
            ids, first = np.unique(ids, return_index=True)
            return ids, codes[first]

        for row in batches_of(batches):
            held.append(unpack(row["ids"], row["data"], "<u1"))
            if len(held) == HELD_BLOCKS:
                yield put()
        if held:
            yield put()

    def bounded(codes: np.ndarray, queries: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first query, first row, midpoints, how far off) of queries with stretches of the codes."""
        for at in range(0, len(queries), STEP):
            for row in range(0, len(codes), FILE_ROWS):
                yield at, row, *bounds(queries[at : at + STEP].astype(np.float64), codes[row : row + FILE_ROWS].astype(np.float64), low, width)

    def first_scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each set: the k + 1 best lower bounds of each query among these blocks."""
        for _, codes in held_blocks(batches):
            for s, (n, path) in enumerate(sets):
                best = np.full((n, k + 1), -np.inf)
                for at, _, middle, off in bounded(codes, _read_set(n, path)[1]):
                    best[at : at + STEP] = _best_of(best[at : at + STEP], _best_of(middle[:, :0], middle, k + 1) - off[:, None] - _slack(middle, off), k + 1)
                yield pa.RecordBatch.from_pylist([{"s": s, "best": best.tobytes()}], schema=_BEST)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, np.ndarray] = {}
        for row in batches_of(batches):
            got = np.frombuffer(row["best"]).reshape(-1, k + 1)
            best[row["s"]] = _best_of(best[row["s"]], got, k + 1) if row["s"] in best else got
        for s, b in best.items():
            yield pa.RecordBatch.from_pylist([{"s": s, "best": b.tobytes()}], schema=_BEST)

    def thresholds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in merge(batches):
            (row,) = batch.to_pylist()
            path = f"{folder}/least-{row['s']}-{uuid.uuid4().hex}"
            files.put(path, np.frombuffer(row["best"]).reshape(-1, k + 1).min(axis=1).tobytes())
            yield pa.RecordBatch.from_pylist([{"s": row["s"], "path": path}], schema=_PATH)

    kind, parts = "s int, best binary", shuffle_parts(spark)
    salted = file.mapInArrow(first_scan, kind).withColumn("salt", F.pmod(F.xxhash64("best"), F.lit(8))).repartition(parts, "s", "salt").select("s", "best").mapInArrow(merge, kind)
    least = saved(salted.repartition(parts, "s").mapInArrow(thresholds, "s int, path string"), f"{folder}/least")
    paths = {r["s"]: r["path"] for r in least.collect()}  # one a set

    def second_scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The vectors of these blocks whose upper bound reaches the threshold of a query."""
        for ids, codes in held_blocks(batches):
            for s, (n, path) in enumerate(sets):
                qids, queries = _read_set(n, path)
                floor = np.frombuffer(files.get(paths[s]))
                for at, row, middle, off in bounded(codes, queries):
                    upper = middle + off[:, None] + _slack(middle, off)
                    q, c = np.nonzero(upper >= floor[at : at + STEP, None])
                    if len(q):
                        yield pa.RecordBatch.from_arrays([pa.array(qids[at + q]), pa.array(ids[row + c]), pa.array(upper[q, c])], names=["q", "c", "ub"])

    survivors = file.mapInArrow(second_scan, "q long, c long, ub double").dropDuplicates(["q", "c"])
    by_bound = Window.partitionBy("q").orderBy(F.desc("ub"), "c")
    order = saved(survivors.withColumn("at", F.row_number().over(by_bound)), f"{folder}/order")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (batch.column(i).flatten().to_numpy().reshape(batch.num_rows, -1) for i in (2, 3))
                if exact:
                    s = np.einsum("ij,ij->i", a, b)
                else:
                    s = np.array([sum(int(x) * int(y) for x, y in zip(p, q)) for p, q in zip(a, b)], np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s)], names=["q", "c", "score"])

    def read(candidates: DataFrame) -> DataFrame:
        both = every.withColumnsRenamed({"class_id": "c"}).join(candidates.select("q", "c"), "c").join(asked.select(F.col("class_id").alias("q"), F.col("v").alias("w")), "q")
        return both.select("q", "c", "v", "w").mapInArrow(score, "q long, c long, score long").distinct()

    found = first = saved(read(order.filter(F.col("at") <= 2 * (k + 1))), f"{folder}/first")
    kth = first.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "c"))).filter(F.col("r") == k + 1).select("q", "score")
    left_over = order.filter(F.col("at") > 2 * (k + 1)).join(kth, "q", "left").filter(F.col("score").isNull() | (F.col("ub") >= F.col("score")))
    if left_over.head(1):
        found = first.unionByName(read(left_over))
    return ranked(found, named, query_rows, k)


_FILE = pa.schema([("ids", pa.binary()), ("data", pa.binary())])
_BEST = pa.schema([("s", pa.int32()), ("best", pa.binary())])
_PATH = pa.schema([("s", pa.int32()), ("path", pa.string())])


def _best_of(a: np.ndarray, b: np.ndarray, keep: int) -> np.ndarray:
    """Of each row of a and b together, the ``keep`` largest, in any order; -inf where there are fewer."""
    both = np.concatenate((a, b), axis=1)
    if both.shape[1] < keep:
        return np.concatenate((both, np.full((len(both), keep - both.shape[1]), -np.inf)), axis=1)
    return np.partition(both, both.shape[1] - keep, axis=1)[:, both.shape[1] - keep :]


def _slack(middle: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Room for rounding where scores are too large for exact doubles, by query."""
    most = np.abs(middle).max(axis=1) if middle.shape[1] else np.zeros(len(middle))
    return (1.0 + (most + off) * 2.0**-40)[:, None]

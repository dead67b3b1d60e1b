"""What both vector searches share: valid vectors, classes of equal vectors, blocks of rows, and final ranks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from textgraph.llm.common import saved


def valid(df: DataFrame, vector: str) -> DataFrame:
    """Rows with an id and a vector whose components are all finite numbers: vec_id, v (array of float or double)."""
    kind = "array<float>" if df.schema[vector].dataType == ArrayType(FloatType(), df.schema[vector].dataType.containsNull) else "array<double>"
    v = F.col(vector).cast(kind)
    finite = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False)))
    return df.filter(F.col(vector).isNotNull() & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter((F.size("v") > 0) & finite)


def by_length(rows: DataFrame, search: Callable[[DataFrame, int], DataFrame], schema: str) -> DataFrame:
    """What a search gives for the rows of each length of v: only vectors of one length have an inner product."""
    found = [search(rows.filter(F.size("v") == r["d"]), r["d"]) for r in rows.select(F.size("v").alias("d")).distinct().orderBy("d").collect()]
    return reduce(DataFrame.unionByName, found) if found else rows.sparkSession.createDataFrame([], schema)


def classes(rows: DataFrame, keep: int, path: str) -> tuple[DataFrame, DataFrame]:
    """Rows with the class of their v (class_id), and the classes of equal v: class_id, ids (the ``keep`` smallest, ascending).

    Vectors aren't shuffled for this, only their hashes.  A class is named by a 64-bit hash; a second hash proves that
    no two vectors of the table share a name, and else other hashes are taken.  Ranks are bounded per task before the
    shuffle (window group limit), so a vector that many rows share sends ``keep`` rows from each task at most.
    """
    for seed in range(1, 64):
        named = rows.select("vec_id", F.xxhash64(F.lit(seed), "v").alias("class_id"), F.xxhash64(F.lit(-seed), "v").alias("proof"))
        w = Window.partitionBy("class_id", "proof").orderBy("vec_id")
        some = named.withColumn("r", F.dense_rank().over(w)).filter(F.col("r") <= keep)
        found = saved(some.groupBy("class_id", "proof").agg(F.array_sort(F.collect_set("vec_id")).alias("ids")), f"{path}-{seed}")
        if not found.groupBy("class_id").count().filter("count > 1").head(1):
            return rows.withColumn("class_id", F.xxhash64(F.lit(seed), "v")), found.select("class_id", "ids")
    raise AssertionError("64 hashes collide")


#: Classes with copies that are broadcast, at most (16 bytes a class).
SMALL = 200_000


def one_of_each(keyed: DataFrame, named: DataFrame) -> DataFrame:
    """class_id, v: the rows of the smallest id of each class (repeated rows stay; readers count a class once)."""
    copies = named.filter(F.size("ids") > 1).select("class_id", F.element_at("ids", 1).alias("least"))
    if copies.count() <= SMALL:
        copies = F.broadcast(copies)
    return keyed.join(copies, "class_id", "left").filter("least is null or least = vec_id").select("class_id", "v")


def packed(df: DataFrame, keys: list[str], dtype: str, codes: str = "v") -> DataFrame:
    """One row per key: ids (int64 bytes of class_id, ascending) and data (dtype bytes of the vectors)."""

    def pack(group: pa.Table) -> pa.Table:
        group = group.sort_by("class_id")
        v = group[codes].combine_chunks()
        values = v.flatten().to_numpy(zero_copy_only=False).astype(dtype)
        key = [pa.array([group[k][0].as_py()], pa.int32()) for k in keys]
        return pa.Table.from_arrays([*key, pa.array([group["class_id"].to_numpy().astype("<i8").tobytes()], pa.binary()), pa.array([values.tobytes()], pa.binary())], names=[*keys, "ids", "data"])

    schema = ", ".join(f"{k} int" for k in keys) + ", ids binary, data binary"
    return df.select(*[F.col(k).cast("int").alias(k) for k in keys], "class_id", codes).groupBy(*keys).applyInArrow(pack, schema)


def unpack(ids: bytes, data: bytes, dtype: str) -> tuple[np.ndarray, np.ndarray]:
    n = np.frombuffer(ids, "<i8")
    return n, np.frombuffer(data, dtype).reshape(len(n), -1)


def best_columns(scores: np.ndarray, keep: int) -> np.ndarray:
    """Of each row, the columns of its ``keep`` largest scores, and of all equal to the last of those: a boolean mask."""
    if scores.shape[1] <= keep:
        return np.ones(scores.shape, bool)
    last = np.partition(scores, scores.shape[1] - keep, axis=1)[:, scores.shape[1] - keep]
    return scores >= last[:, None]


def ranked(found: DataFrame, class_rows: DataFrame, query_rows: DataFrame, k: int) -> DataFrame:
    """Final rows from scores of class pairs.

    found: q, c (class ids), score; class_rows: class_id, ids; query_rows: vec_id, class_id of every query.  Returns
    query_id, rank, vec_id, score: the k best of other rows, ties to the smaller vec_id.
    """
    w = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    ids = found.join(class_rows.select(F.col("class_id").alias("c"), "ids"), "c").select("q", "score", F.explode("ids").alias("vec_id"))
    lists = ids.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k + 1).groupBy("q").agg(F.sort_array(F.collect_list(F.struct("r", "vec_id", "score"))).alias("best"))
    own = query_rows.select(F.col("vec_id").alias("query_id"), F.col("class_id").alias("q"))
    others = F.slice(F.filter("best", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    out = own.join(lists, "q").select("query_id", F.posexplode(others).alias("at", "x"))
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))


def batches_of(rows: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in rows:
        yield from batch.to_pylist()

"""Near-duplicate documents by circulant MinHash: sketches, banding, exact Jaccard verification, components.

Circulant MinHash needs two permutations of the universe: the first, sigma, shuffles the elements once, and all
coordinates come from the second, pi, shifted circularly: coordinate k is the least pi[(sigma(x) + k) mod D] over the
set.  The K values an element contributes are therefore a run of the table pi.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textgraph.llm.common import Words, arrow_limits, lean, mix64, remove, saved, shuffle_parts, work_dir
from textgraph.llm.components import components

SHINGLE = 5
#: Coordinates (a byte each is kept), and how often a pair at the threshold may miss every band of them.
COORDINATES, MISS = 256, 2e-6
#: Coordinates by which the last round, which verifies all that is left, chooses pairs; only rows of shared buckets have them.
WIDE = 1536
UNIVERSE = 1 << 21
#: Rows of a bucket that meet in one task; larger buckets are compared block by block.
BUCKET_ROWS = 4096
#: Partners of a row within a bucket that a round verifies at most; the last round verifies all that are left.
PARTNERS = (1, 12, None)
_TABLE: list[np.ndarray] = []


def _runs(width: int) -> np.ndarray:
    """Row v: pi[v], pi[v + 1] ... pi[v + width - 1], indices modulo the universe; a view of one table."""
    if not _TABLE:
        pi = np.random.default_rng(20240607).permutation(UNIVERSE).astype(np.uint32)
        _TABLE.append(np.concatenate((pi, pi[: WIDE - 1])))
    return np.lib.stride_tricks.sliding_window_view(_TABLE[0], width)


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """Of each text the sorted distinct 64-bit hashes of its SHINGLE-word shingles; the whole sequence if it has fewer words."""
    w = Words(texts)
    h = w.hashes
    rolled = np.zeros(len(h), np.uint64)
    for j in range(SHINGLE):
        part = h[j:] * np.uint64(2 * (0x1F3D5B79 + 0x2545F491 * j) + 1)
        rolled[: len(part)] += part
    rolled = mix64(rolled)
    out = []
    for a, b in zip(w.first[:-1], w.first[1:]):
        if b - a >= SHINGLE:
            out.append(np.unique(rolled[a : b - SHINGLE + 1]))
        elif b > a:
            short = np.array([b - a], np.uint64)
            for x in h[a:b]:
                short = mix64(short * np.uint64(0x9E3779B97F4A7C15) + x)
            out.append(short)
        else:
            out.append(np.empty(0, np.uint64))
    return out


def sketches(sets: list[np.ndarray], width: int = COORDINATES) -> np.ndarray:
    """[set, width] bytes of the first circulant MinHash coordinates; zeros for empty sets."""
    runs = _runs(width)
    out = np.zeros((len(sets), width), np.uint8)
    step = (1 << 19) // width
    for i, s in enumerate(sets):
        if len(s):
            at = (mix64(s ^ np.uint64(0x5851F42D4C957F2D)) & np.uint64(UNIVERSE - 1)).astype(np.int64)
            least = runs[at[:step]].min(axis=0)
            for j in range(step, len(at), step):
                least = np.minimum(least, runs[at[j : j + step]].min(axis=0))
            out[i] = (mix64(least.astype(np.uint64)) & np.uint64(255)).astype(np.uint8)
    return out


def equal_share(similarity: float) -> float:
    """How many coordinates of two sets are equal, on average (a byte agrees by chance once in 256 times)."""
    return similarity + (1 - similarity) / 256


def bands_for(percent: int) -> tuple[int, int]:
    """Bands, and coordinates of each, for which a pair at this similarity shares no band MISS times or less.

    28 bands of 6 at 85 %, 33 of 5 at 80 %: bands as long as a third of such pairs still agrees in each.
    """
    p = equal_share(percent / 100)
    rows = max(1, int(math.log(0.32) / math.log(p))) if p < 1 else 8
    bands = math.ceil(math.log(MISS) / math.log(1 - p**rows)) if p < 1 else 1
    return min(bands, COORDINATES // rows), rows


def band_keys(sketch: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """[set, bands] 64-bit keys; those of one band are equal if (and, but for hash collisions, only if) its bytes are."""
    part = sketch[:, : bands * rows].reshape(len(sketch), bands, rows).astype(np.uint64)
    key = np.zeros(part.shape[:2], np.uint64)
    for j in range(rows):
        if j % 7 == 6:
            key = mix64(key)
        key = (key << np.uint64(8)) | part[:, :, j]
    return mix64((key << np.uint64(8)) | np.arange(bands, dtype=np.uint64)).view(np.int64)


def least_match(similarity: float, width: int) -> int:
    """Equal coordinates below which a pair isn't verified: 5 standard deviations under those of ``similarity``."""
    p = equal_share(similarity)
    return int(width * (p - 5 * (p * (1 - p) / width) ** 0.5))


def _from_first(a: np.ndarray, b: np.ndarray, key, bands: int, rows: int) -> np.ndarray:
    """Whether key is that of the first band in which the rows of a and b agree."""
    same = (a[:, : bands * rows] == b[:, : bands * rows]).reshape(len(a), bands, rows).all(axis=2)
    return band_keys(a, bands, rows)[np.arange(len(a)), same.argmax(axis=1)] == key


def sketch_table(docs: DataFrame) -> DataFrame:
    """doc_id, of (hash of the text), n (size of the shingle set), digest (of the set; null if empty), sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(batch.column(1).to_pylist())
            digest = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            first: dict[bytes, int] = {}
            for i, d in enumerate(digest):
                if d is not None:
                    first.setdefault(d, i)
            own = list(first.values())  # equal sets of a batch are sketched once
            rows = {i: r.tobytes() for i, r in zip(own, sketches([sets[i] for i in own]))}
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array(digest, pa.binary()), pa.array([None if d is None else rows[first[d]] for d in digest], pa.binary())], names=["doc_id", "of", "n", "digest", "sketch"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("of")).mapInArrow(lean(run), "doc_id long, of long, n long, digest binary, sketch binary")


def _band_rows(reps: DataFrame, bands: int, rows: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sk = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, COORDINATES)
                yield pa.RecordBatch.from_arrays([pa.array(band_keys(sk, bands, rows).reshape(-1)), batch.column(0).take(pa.array(np.repeat(np.arange(batch.num_rows), bands)))], names=["band", "rep"])

    return reps.select("rep", "sketch").mapInArrow(run, "band long, rep long")


def _bucket_pairs(least: int, width: int, partners: int | None, bands: int, rows: int):
    """Pairs of rows of a bucket, from different components, that agree in ``least`` coordinates and more."""

    def of(rep: np.ndarray, comp: np.ndarray, side: np.ndarray, sk: np.ndarray, cross: bool, key: int) -> tuple[np.ndarray, np.ndarray]:
        a_all, b_all = [], []
        step = max(1, (4 << 20) // (width * len(rep)))
        for at in range(0, len(rep), step):
            upto = min(at + step, len(rep))
            match = np.count_nonzero(sk[at:upto, None, :] == sk[None, :, :], axis=2)
            ok = (match >= least) & (comp[at:upto, None] != comp[None, :])
            if cross:
                ok &= side[at:upto, None] != side[None, :]
            if partners is not None and len(rep) > partners:
                score = np.where(ok, match, -1)
                top = np.argpartition(-score, partners - 1, axis=1)[:, :partners]
                best = np.zeros_like(ok)
                np.put_along_axis(best, top, True, axis=1)
                ok &= best
            a, b = np.nonzero(ok)
            a_all.append(a + at)
            b_all.append(b)
        a, b = np.concatenate(a_all), np.concatenate(b_all)
        if partners is None:
            keep = a < b
            a, b = a[keep], b[keep]
        if len(a):  # a pair that shares several buckets comes from the first of them
            mine = _from_first(sk[a], sk[b], key, bands, rows)
            a, b = a[mine], b[mine]
        return a, b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None

        def emit(cols: list[np.ndarray], upto: int) -> Iterator[pa.RecordBatch]:
            key, i, j, side, rep, comp, sk = (c[:upto] for c in cols)
            start = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]))))
            size = np.diff(start, append=upto)
            two = start[(size == 2) & (i[start] == j[start])]
            xs, ys = [], []
            if len(two):
                a, b = two, two + 1
                ok = ((sk[a] == sk[b]).sum(axis=1) >= least) & (comp[a] != comp[b])
                a, b = a[ok], b[ok]
                first = _from_first(sk[a], sk[b], key[a], bands, rows) if len(a) else np.zeros(0, bool)
                xs.append(rep[a[first]])
                ys.append(rep[b[first]])
            for s, n in zip(start[(size > 2) | ((size == 2) & (i[start] != j[start]))], size[(size > 2) | ((size == 2) & (i[start] != j[start]))]):
                e = s + n
                a, b = of(rep[s:e], comp[s:e], side[s:e], sk[s:e], i[s] != j[s], key[s])
                xs.append(rep[s:e][a])
                ys.append(rep[s:e][b])
            x, y = (np.concatenate([*v, np.empty(0, np.int64)]).astype(np.int64) for v in (xs, ys))
            if len(x):
                both = np.unique(np.stack((np.minimum(x, y), np.maximum(x, y))), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], names=["x", "y"])

        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in range(6)]
            cols.append(np.frombuffer(b"".join(batch.column(6).to_pylist()), np.uint8).reshape(-1, width))
            held = cols if held is None else [np.concatenate(p) for p in zip(held, cols)]
            key, i, j = held[:3]
            change = np.flatnonzero((key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]))
            if len(change):
                upto = int(change[-1]) + 1
                yield from emit(held, upto)
                held = [c[upto:] for c in held]
        if held is not None and len(held[0]):
            yield from emit(held, len(held[0]))

    return run


def _sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """rep, set and wide sketch of the wanted classes (rep, doc, digest), from the texts of their first documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(batch.column(2).to_pylist())
            found, wide = [s.tobytes() for s in sets], sketches(sets, WIDE)
            right = [hashlib.blake2b(s, digest_size=16).digest() == d for s, d in zip(found, batch.column(1).to_pylist())]  # ids may repeat
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary()), pa.array([w.tobytes() for w in wide], pa.binary())], names=["rep", "set", "wide"]).filter(pa.array(right, pa.bool_()))

    texts = docs.select(F.col("doc_id").cast("long").alias("doc"), "text").join(wanted, "doc").select("rep", "digest", "text")
    return texts.mapInArrow(lean(run), "rep long, set binary, wide binary").dropDuplicates(["rep"])


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (x, y) whose full shingle sets have 100 * intersection >= percent * union."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xs, ys, last, keep = batch.column(2).to_pylist(), batch.column(3).to_pylist(), (b"", None), []
            for a, b in zip(xs, ys):
                if last[0] != a:
                    last = (a, np.frombuffer(a, np.uint64))
                p, q = last[1], np.frombuffer(b, np.uint64)
                at = np.searchsorted(p, q)
                at[at == len(p)] = 0
                inter = int((p[at] == q).sum())
                keep.append(100 * inter >= percent * (len(p) + len(q) - inter))
            yield batch.select(["x", "y"]).filter(pa.array(keep, pa.bool_()))

    sets = sets.select("rep", "set")
    both = pairs.join(sets.withColumnsRenamed({"rep": "x", "set": "a"}), "x").join(sets.withColumnsRenamed({"rep": "y", "set": "b"}), "y")
    return both.select("x", "y", "a", "b").mapInArrow(compare, "x long, y long")


def near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id (the smallest doc_id reachable by links), kept.

    docs needs doc_id and text; other columns are ignored.  Documents are linked if 100 * |A and B| >= percent *
    |A or B| for their full sets of shingles.  A document without words has an empty set and is linked with nothing;
    so is a row without doc_id, whose component is null and which is kept.  Documents with equal sets are one class
    and are compared once; rows of equal doc_id are documents of their own.  An empty table gives an empty result.
    """
    found = near_groups(docs, percent)
    return found.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def near_groups(docs: DataFrame, percent: int) -> DataFrame:
    """near_duplicates() with what tells rows and components of repeated ids apart.

    doc_id, of (xxhash64 of the row's text), n_shingles, component_id, group: a name of the component that no other has;
    null for rows without words or id.
    """
    spark = docs.sparkSession
    arrow_limits(spark)
    folder, parts = work_dir(spark, "near-dedup"), shuffle_parts(spark)
    by = bands_for(percent)
    sketched = saved(sketch_table(docs), f"{folder}/sketches")
    usable = sketched.filter("digest is not null and doc_id is not null")
    reps = saved(usable.groupBy("digest").agg(F.min("doc_id").alias("rep")), f"{folder}/classes")
    # a class is a node; its name comes from its digest, as ids may repeat
    node = F.xxhash64("digest")
    first = usable.join(reps, "digest").filter("doc_id = rep").dropDuplicates(["digest"]).select(node.alias("node"), "rep", "digest", "sketch")
    nodes = saved(first, f"{folder}/nodes")
    bands = saved(_band_rows(nodes.select(F.col("node").alias("rep"), "sketch"), *by), f"{folder}/bands")
    sizes = bands.groupBy("band").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    members = saved(bands.join(sizes, "band"), f"{folder}/members")
    remove(spark, f"{folder}/bands")
    in_bucket = members.select(F.col("rep").alias("node")).distinct()
    compared = saved(nodes.join(in_bucket, "node", "left_semi"), f"{folder}/compared")
    sketch_of = compared.select(F.col("node").alias("rep"), "sketch")
    sets = saved(_sets_of(docs, compared.select(F.col("node").alias("rep"), F.col("rep").alias("doc"), "digest").filter(F.col("doc") >= -(1 << 62))), f"{folder}/sets")
    links = comp = tested = None
    for r, partners in enumerate(PARTNERS):
        rows_now, width = members, COORDINATES if partners else WIDE
        if comp is not None:
            rows_now = members.join(comp.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
            mixed = rows_now.groupBy("band").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).filter("a < b").select("band")
            rows_now = rows_now.join(mixed, "band", "left_semi")
        else:
            rows_now = rows_now.withColumn("comp", F.col("rep"))
        blocks = F.ceil(F.col("rows") / (BUCKET_ROWS // 2)).cast("int")
        own = F.when(F.col("rows") > BUCKET_ROWS, F.pmod(F.xxhash64("rep", F.lit(1)), blocks)).otherwise(F.lit(0)).cast("int")
        others = F.when(F.col("rows") > BUCKET_ROWS, F.sequence(F.lit(0), blocks - 1)).otherwise(F.array(F.lit(0)))
        dealt = rows_now.withColumn("side", own).withColumn("other", F.explode(others)).join(sketch_of if partners else sets.select("rep", F.col("wide").alias("sketch")), "rep")
        dealt = dealt.select("band", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", "rep", "comp", "sketch")
        dealt = dealt.repartition(parts, "band", "i", "j").sortWithinPartitions("band", "i", "j")
        pairs = dealt.mapInArrow(lean(_bucket_pairs(least_match(percent / 100, width), width, partners, *by)), "x long, y long").distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["x", "y"], "left_anti")
        pairs = saved(pairs, f"{folder}/pairs{r}")
        if not pairs.head(1):
            continue  # pairs that a round holds back are left to the next
        tested = pairs if tested is None else tested.unionByName(pairs)
        new = saved(_verified(pairs, sets, percent), f"{folder}/links{r}")
        links = new if links is None else links.unionByName(new)
        comp = components(links, f"{folder}/components{r}")
    joined = sketched.select("doc_id", "of", F.col("n").alias("n_shingles"), "digest").join(reps, "digest", "left").withColumn("node", F.when(F.col("rep").isNotNull(), node))
    if comp is not None:
        label = comp.join(compared.select("node", "rep"), "node").groupBy("comp").agg(F.min("rep").alias("least"))
        joined = joined.join(comp.join(label, "comp").select("node", "comp", "least"), "node", "left")
    else:
        joined = joined.withColumns({"comp": F.lit(None).cast("long"), "least": F.lit(None).cast("long")})
    known = F.col("doc_id").isNotNull()
    return joined.select("doc_id", "of", "n_shingles", F.when(known, F.coalesce("least", "rep", "doc_id")).alias("component_id"), F.when(known, F.coalesce("comp", "node")).alias("group"))

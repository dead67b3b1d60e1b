"""Approximate nearest neighbours by inner product: balanced posting lists on storage, a graph of centroids in memory.

Vectors are assigned to the lists of their nearest centroids; a vector near a boundary is replicated to several.  A
search walks the graph of centroids, keeps the lists whose distance is within a ratio of the nearest, and scores the
vectors of those lists exactly.  Inner products become distances by one more component, sqrt(M^2 - |x|^2).

Queries that are near each other form groups.  A task searches a group at a time: it notes a bit for each query and list,
reads each block of these lists once, and holds the best of each query so far.  So what a task holds and what is shuffled
don't grow with the number of lists that queries read.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textgraph.llm import files
from textgraph.llm.common import arrow_limits, lean, mix64, saved, shuffle_parts, work_dir
from textgraph.llm.vectors import by_length, classes, one_of_each, ranked, valid

#: Vectors the index is fitted on, at most (centroids, search ratio, blocks a list).  Every vector is indexed.
SAMPLE, SAMPLE_OF_LIST = 32_768, 16
#: Vectors per list aimed at; centroids at most (all tasks hold MAX_LISTS x (dimension + 1 + neighbours) numbers).  Beyond
#: MAX_LISTS x LIST_ROWS vectors lists grow, in blocks.
LIST_ROWS, MAX_LISTS = 256, 16_384
#: Lists of a vector at most, and the distance (of the nearest) up to which a list takes it.
REPLICAS, REPLICA_RATIO = 4, 1.12
#: Recall that the search ratio is chosen for, on sampled queries against the sample.
AIM, AIM_QUERIES = 0.94, 512
#: Neighbours of a centroid in the graph, and centroids that a walk holds.
NEIGHBOURS, BEAM = 24, 64
#: Rows of a posting block; queries of a group, at most and (if there are few) at least; queries scored at a time.
BLOCK, GROUP, LEAST_GROUP, STEP = 4096, 8192, 128, 512


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * (a @ b.T), 0)


def balanced_centroids(x: np.ndarray, lists: int, rounds: int = 12) -> np.ndarray:
    """k-means with a price on crowded centroids, so that lists come out of similar size."""
    rng = np.random.default_rng(7)
    c = x[rng.choice(len(x), lists, replace=False)].copy()
    price, mean = np.zeros(lists), len(x) / lists
    step = max(64, (1 << 21) // lists)
    own = (x * x).sum(1)
    unit = float(np.sqrt(own.max())) or 1.0
    rough = (x / unit).astype(np.float32)
    near, least = np.empty(len(x), np.int64), np.empty(len(x))
    for _ in range(rounds):
        to, cost = (c / unit).astype(np.float32), (((c * c).sum(1) + price) / unit**2).astype(np.float32)
        for i in range(0, len(x), step):
            d = rough[i : i + step] @ (-2 * to.T)
            d += cost
            near[i : i + step] = best = d.argmin(axis=1)
            least[i : i + step] = d[np.arange(len(d)), best]
        scale = float(np.median(np.maximum(least * unit**2 + own, 0))) + 1e-12
        size = np.bincount(near, minlength=lists)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], x[rng.choice(len(x), lists)])
        price = np.clip(price + 0.1 * scale * np.log2((size + 1) / (mean + 1)), 0, scale)
    return c[side_by_side(c)]


def side_by_side(c: np.ndarray) -> np.ndarray:
    """An order in which near centroids mostly stand near each other: halves along the widest direction, again and again."""
    todo, out = [np.arange(len(c))], []
    while todo:
        some = todo.pop()
        if len(some) <= 8:
            out.append(some)
            continue
        x = c[some] - c[some].mean(axis=0)
        some = some[np.argsort(x @ np.linalg.eigh(x.T @ x)[1][:, -1], kind="stable")]
        todo += [some[len(some) // 2 :], some[: len(some) // 2]]
    return np.concatenate(out)


def neighbour_graph(c: np.ndarray) -> np.ndarray:
    """For each centroid its nearest others and, as long links, a few at random."""
    n = len(c)
    rng = np.random.default_rng(11)
    near = np.empty((n, min(NEIGHBOURS, max(n - 1, 1))), np.int32)
    for i in range(0, n, 128):
        d = squared(c[i : i + 128], c)
        d[np.arange(len(d)), np.arange(i, i + len(d))] = np.inf
        near[i : i + 128] = np.argsort(d, axis=1)[:, : near.shape[1]]
    return np.concatenate((near, rng.integers(0, n, (n, 4), dtype=np.int32)), axis=1)


@dataclass
class Index:
    """What all tasks get: bounded by MAX_LISTS."""

    centroids: np.ndarray
    graph: np.ndarray
    top: float  # largest norm
    ratio: float = 0.0  # distance ratio up to which a list is read
    parts: np.ndarray = field(default_factory=lambda: np.ones(0, np.int64))  # blocks of each list, by what the sample says

    def place(self, v: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.top**2 - (v * v).sum(1), 0))
        return np.concatenate((v, rest[:, None]), axis=1)

    def aim(self, v: np.ndarray) -> np.ndarray:
        norm = np.linalg.norm(v, axis=1, keepdims=True)
        return np.concatenate((v * (self.top / norm), np.zeros((len(v), 1))), axis=1)

    def assign(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) pairs: the nearest list, and others about as near that lie in another direction.

        A list whose centroid is nearer to that of a list already taken than to the vector holds the same boundary, and
        is passed over.
        """
        rows, lists = [], []
        unit = self.top or 1.0
        rough = (self.centroids / unit).astype(np.float32)  # the nearest few are found roughly, their distances exactly
        norms = (rough * rough).sum(1)
        for i in range(0, len(v), 256):
            x = self.place(v[i : i + 256])
            d = (x / unit).astype(np.float32) @ rough.T
            d *= -2
            d += norms
            n = min(2 * REPLICAS, d.shape[1])
            some = np.argpartition(d, n - 1, axis=1)[:, :n]
            near = ((x[:, None] - self.centroids[some]) ** 2).sum(2)
            order = np.lexsort((some, near), axis=1) if n > 1 else np.zeros_like(some)
            some, near = np.take_along_axis(some, order, axis=1), np.take_along_axis(near, order, axis=1)
            c = self.centroids[some]
            taken = np.zeros(some.shape, bool)
            taken[:, 0] = True
            for j in range(1, n):
                apart = ((c[:, :j] - c[:, j : j + 1]) ** 2).sum(2)
                behind = (taken[:, :j] & (apart < near[:, j : j + 1])).any(axis=1)
                taken[:, j] = (near[:, j] <= near[:, 0] * REPLICA_RATIO**2 + 1e-12) & ~behind & (taken.sum(axis=1) < REPLICAS)
            row, at = np.nonzero(taken)
            rows.append(row + i)
            lists.append(some[row, at])
        return np.concatenate(rows), np.concatenate(lists)

    def walk(self, queries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``width`` nearest centroids that best-first walks of the graph find: ids and distances, nearest first.

        All queries walk together: each step expands the nearest centroid of a beam that wasn't expanded yet.
        """
        n, lists = len(queries), len(self.centroids)
        width = min(width, lists)
        norms = (self.centroids * self.centroids).sum(1)
        own = (queries * queries).sum(1)
        seen = np.zeros((n, lists + 1), bool)
        rows = np.arange(n)[:, None]

        def distance(ids: np.ndarray) -> np.ndarray:
            return own[:, None] + norms[ids] - 2 * np.einsum("qd,qkd->qk", queries, self.centroids[ids])

        start = np.broadcast_to(np.unique(np.linspace(0, lists - 1, min(16, lists)).astype(np.int64)), (n, len(np.unique(np.linspace(0, lists - 1, min(16, lists)).astype(np.int64)))))
        beam, dist = start.copy(), distance(start)
        seen[rows, beam] = True
        done = np.zeros(beam.shape, bool)
        while True:
            open_ = np.where(done, np.inf, dist)
            pick = np.argsort(open_, axis=1)[:, :4]  # a few at a time: fewer, wider steps
            live = np.isfinite(np.take_along_axis(open_, pick, axis=1))
            if not live.any():
                break
            np.put_along_axis(done, pick, True, axis=1)
            more = self.graph[np.take_along_axis(beam, pick, axis=1)].reshape(n, -1).astype(np.int64)
            more[np.repeat(~live, self.graph.shape[1], axis=1)] = lists
            more.sort(axis=1)
            more[:, 1:][more[:, 1:] == more[:, :-1]] = lists
            fresh = ~seen[rows, more] & (more < lists)
            seen[rows, more] = True
            d = np.where(fresh, distance(np.minimum(more, lists - 1)), np.inf)
            beam, dist, done = (np.concatenate(p, axis=1) for p in ((beam, np.where(fresh, more, 0)), (dist, d), (done, ~fresh)))
            if beam.shape[1] > width:
                keep = np.argpartition(dist, width - 1, axis=1)[:, :width]
                beam, dist, done = (np.take_along_axis(x, keep, axis=1) for x in (beam, dist, done))
        order = np.argsort(dist, axis=1)
        return np.take_along_axis(beam, order, axis=1), np.sqrt(np.maximum(np.take_along_axis(dist, order, axis=1), 0))

    def lists_of(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) pairs that queries v read: those within the ratio of the nearest.

        Where the farthest list of a beam is still within the ratio, the query is compared with all centroids, so no
        list within the ratio is left out for room.
        """
        out_row, out_list = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for i in range(0, len(v), 128):
            aims = self.aim(v[i : i + 128])
            ids, d = self.walk(aims, BEAM)
            inside = (d <= d[:, :1] * self.ratio + 1e-9) & np.isfinite(d)
            whole = ~inside[:, -1] | (ids.shape[1] == len(self.centroids)) | (ids.shape[1] < BEAM)
            r, at = np.nonzero(inside & whole[:, None])
            out_row.append(r + i)
            out_list.append(ids[r, at])
            wide = np.flatnonzero(~whole)
            if len(wide):
                d = np.sqrt(squared(aims[wide], self.centroids))
                r, at = np.nonzero(d <= d.min(axis=1, keepdims=True) * self.ratio + 1e-9)
                out_row.append(wide[r] + i)
                out_list.append(at)
        return np.concatenate(out_row), np.concatenate(out_list)


def lists_for(count: int) -> int:
    return int(min(MAX_LISTS, max(1, round(count / LIST_ROWS))))


def fit(sample: np.ndarray, count: int, top: float, k: int) -> Index:
    """Centroids, graph and search ratio from a sample of the vectors; count: all vectors, top: their largest norm."""
    lists = min(lists_for(count), max(1, len(sample) // SAMPLE_OF_LIST))
    index = Index(np.zeros((0, 0)), np.zeros((0, 0), np.int32), top)
    index.centroids = balanced_centroids(index.place(sample), lists)
    index.graph = neighbour_graph(index.centroids)
    row, at = index.assign(sample)
    order = np.argsort(row, kind="stable")
    row, at = row[order], at[order]
    index.parts = np.maximum(1, np.ceil(np.bincount(at, minlength=lists) * (count / len(sample) / BLOCK))).astype(np.int64)
    # the least ratio at which sampled queries find AIM of the others in the sample that are of their k nearest of all:
    # as many of these are in the sample as its share of the vectors says
    first = np.searchsorted(row, np.arange(len(sample) + 1))
    chosen = np.random.default_rng(3).choice(len(sample), min(AIM_QUERIES, len(sample)), replace=False)
    kk = min(max(1, int(np.ceil(k * len(sample) / count))), len(sample) - 1)
    need = [1.0]
    for i in range(0, len(chosen), 32):
        q = sample[chosen[i : i + 32]]
        score = q @ sample.T
        score[np.arange(len(q)), chosen[i : i + 32]] = -np.inf
        d = np.sqrt(squared(index.aim(q), index.centroids))
        d /= np.maximum(d.min(axis=1, keepdims=True), 1e-9)
        if kk:
            best = np.argpartition(score, len(sample) - kk, axis=1)[:, len(sample) - kk :]
            need += [d[j, at[first[x] : first[x + 1]]].min() for j, b in enumerate(best) for x in b]
    index.ratio = float(np.quantile(need, AIM)) + 1e-6
    return index


RESULT = "query_id long, rank int, vec_id long, score double"


def nearest(vectors: DataFrame, is_query: F.Column, k: int, vector: str = "embedding") -> DataFrame:
    """About the k nearest other rows of each query row, by largest inner product: query_id, rank, vec_id, score (double).

    vectors needs vec_id and an array of numbers; other columns are ignored.  Null ids, null, empty or zero vectors, and
    vectors with null or non-finite components take no part; those of different lengths aren't compared.  Equal vectors
    are one class, scored once, of which the k + 1 smallest ids are kept (no result can hold more); ties go to the
    smaller vec_id.  A query that its lists give fewer than k others is scored against all vectors, in blocks; with fewer
    others in the table it gets all of them.
    """
    arrow_limits(vectors.sparkSession)
    folder = work_dir(vectors.sparkSession, "spann")
    rows = valid(vectors, vector).filter(F.exists("v", lambda x: x != 0.0))
    return by_length(rows, lambda some, d: _search(some, is_query, k, f"{folder}/{d}"), RESULT)


def _search(rows: DataFrame, is_query: F.Column, k: int, folder: str) -> DataFrame:
    """nearest() of vectors of one length."""
    spark = rows.sparkSession
    keyed, named = classes(rows, k + 1, f"{folder}/classes")
    asking = saved(keyed.filter(is_query), f"{folder}/asking")
    query_rows, asked = asking.select("vec_id", "class_id").distinct(), asking.groupBy("class_id").agg(F.first("v").alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    count, asks, top = named.count(), asked.count(), rows.agg(F.max(norm)).head()[0]
    if not asks:
        return spark.createDataFrame([], RESULT)
    every = one_of_each(keyed, named)
    postings, index = build_index(every, count, top, k, f"{folder}/postings")
    shared = spark.sparkContext.broadcast(index)

    blocks = spark.sparkContext.broadcast(Blocks.of(postings, len(index.centroids)))
    dim, dtype = index.centroids.shape[1] - 1, "<f4" if "float" in rows.schema["v"].dataType.simpleString() else "<f8"

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = shared.value.aim(_matrix(batch.column(1)))
                at = np.concatenate([squared(x[i : i + 128], shared.value.centroids).argmin(axis=1) for i in range(0, len(x), 128)])
                yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), *batch.columns], names=["list", "class_id", "v"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for q, v in _groups(batches):
            found = search_group(shared.value, blocks.value, v, k, min(k + 1, count), lambda path, at, n: _read(path, at, n, dim, dtype))
            for at in range(0, len(found[0]), 1 << 16):
                one, c, score = (x[at : at + (1 << 16)] for x in found)
                yield pa.RecordBatch.from_arrays([pa.array(q[one]), pa.array(c), pa.array(score)], names=["q", "c", "score"])

    groups = max(-(-asks // GROUP), min(2 * spark.sparkContext.defaultParallelism, -(-asks // LEAST_GROUP)))
    dealt = asked.select("class_id", "v").mapInArrow(near, f"list int, class_id long, v {rows.schema['v'].dataType.simpleString()}").repartitionByRange(groups, "list", "class_id").sortWithinPartitions("list", "class_id")
    found = saved(dealt.select("class_id", "v").mapInArrow(lean(search), "q long, c long, score double"), f"{folder}/found")
    return ranked(found, named, query_rows, k)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors of queries, GROUP of them at a time."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for batch in batches:
        for at in range(0, batch.num_rows, GROUP):
            part = batch.slice(at, GROUP)
            if size + part.num_rows > GROUP:
                yield tuple(np.concatenate(x) for x in zip(*held))
                held, size = [], 0
            held.append((part.column(0).to_numpy(), _matrix(part.column(1))))
            size += part.num_rows
    if size:
        yield tuple(np.concatenate(x) for x in zip(*held))


@dataclass
class Blocks:
    """Where the blocks of each list are: some 30 bytes for BLOCK vectors.  Those of list i: first[i] to first[i + 1]."""

    first: np.ndarray
    names: list[str]
    file: np.ndarray
    at: np.ndarray
    n: np.ndarray

    @classmethod
    def of(cls, postings: DataFrame, lists: int) -> Blocks:
        t = postings.select("list", "path", "at", "n").toArrow().combine_chunks()
        of = t["list"].to_numpy()
        order = np.lexsort((t["at"].to_numpy(), of))
        paths = t["path"].combine_chunks().dictionary_encode()
        paths = paths.combine_chunks() if isinstance(paths, pa.ChunkedArray) else paths
        return cls(np.searchsorted(of[order], np.arange(lists + 1)), paths.dictionary.to_pylist(), paths.indices.to_numpy()[order], t["at"].to_numpy()[order], t["n"].to_numpy()[order])

    def of_list(self, i: int) -> Iterator[tuple[str, int, int]]:
        for b in range(self.first[i], self.first[i + 1]):
            yield self.names[self.file[b]], int(self.at[b]), int(self.n[b])


class Best:
    """The k + 1 best vectors of each query so far, and all that tie with the last of these."""

    def __init__(self, queries: np.ndarray, keep: int, top: float):
        self.queries, self.keep = queries, keep
        self.floor = np.full(len(queries), -np.inf)
        norms = np.sqrt((queries * queries).sum(1))
        # products are found roughly, with a bound of the error, and those that may be good enough exactly
        self.kind = np.float32 if len(norms) and 1e-15 < min(norms.min(), top) and max(norms.max(), top) < 1e15 else np.float64
        self.rough = queries.astype(self.kind)
        self.slack = (queries.shape[1] + 8) * 2 * float(np.finfo(self.kind).eps) * norms * top
        self.held: list[tuple[np.ndarray, ...]] = []
        self.size, self.room = 0, 2 * len(queries) * keep + 50_000

    def add(self, rows: np.ndarray, ids: np.ndarray, data: np.ndarray) -> None:
        """Scores of vectors (of distinct ids) for the queries of these rows."""
        rough = data.astype(self.kind).T
        for at in range(0, len(rows), STEP):
            r = rows[at : at + STEP]
            scores = self.rough[r] @ rough
            least = self.floor[r]
            new = np.flatnonzero(np.isneginf(least))
            if len(new) and len(ids) > self.keep:
                least[new] = np.partition(scores[new], len(ids) - self.keep, axis=1)[:, len(ids) - self.keep] - self.slack[r[new]]
            q, c = np.nonzero(scores >= (least - self.slack[r])[:, None])
            # row by row, so that a pair's score doesn't depend on its block
            self.held.append((r[q], ids[c], np.einsum("ij,ij->i", self.queries[r[q]], data[c].astype(np.float64))))
            self.size += len(q)
            if self.size > self.room:
                self.settle()
                self.room = max(self.room, 2 * self.size)

    def settle(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """row, id and score of the best, by row and from the best on."""
        if not self.held:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        q, c, s = (np.concatenate(x) for x in zip(*self.held))
        order = np.lexsort((c, -s, q))
        q, c, s = q[order], c[order], s[order]
        same = np.zeros(len(q), bool)
        same[1:] = (q[1:] == q[:-1]) & (c[1:] == c[:-1])
        q, c, s = q[~same], c[~same], s[~same]
        first = np.flatnonzero(np.append(True, q[1:] != q[:-1])) if len(q) else np.empty(0, np.int64)
        sizes = np.diff(first, append=len(q))
        full = sizes >= self.keep
        self.floor[q[first[full]]] = s[first[full] + self.keep - 1]
        good = s >= self.floor[q]
        out = q[good], c[good], s[good]
        self.held, self.size = [out], len(out[0])
        return out


def search_group(index: Index, blocks: Blocks, queries: np.ndarray, k: int, need: int, read: Callable[[str, int, int], Block]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, id and score of the best of each query's lists; of all blocks, where these hold fewer than ``need``."""
    lists = len(index.centroids)
    asks = np.zeros((len(queries), -(-lists // 8)), np.uint8)  # a bit for each query and list
    for i in range(0, len(queries), 128):
        row, at = index.lists_of(queries[i : i + 128])
        mask = np.zeros((len(queries[i : i + 128]), lists), bool)
        mask[row, at] = True
        asks[i : i + 128] = np.packbits(mask, axis=1)
    asks = np.ascontiguousarray(asks.T)
    best = Best(queries, k + 1, index.top)
    for i in range(lists):
        rows = np.flatnonzero(asks[i >> 3] & (128 >> (i & 7)))
        if len(rows):
            for block in blocks.of_list(i):
                best.add(rows, *read(*block))
    few = np.flatnonzero(np.bincount(best.settle()[0], minlength=len(queries)) < need)
    if len(few):
        for i in range(lists):
            for block in blocks.of_list(i):
                best.add(few, *read(*block))
    return best.settle()


def build_index(every: DataFrame, count: int, top: float, k: int, folder: str) -> tuple[DataFrame, Index]:
    """The posting lists of every (class_id, v) as files, and what a search needs: a table of blocks and the Index.

    count and top: vectors, and their largest norm.  A row of the table names a block of a list: list, part, path, at
    (in the file), n (its vectors).  Blocks hold some BLOCK vectors, however many a list has.
    """
    spark = every.sparkSession
    kind = every.schema["v"].dataType.simpleString()
    wanted = max(SAMPLE, SAMPLE_OF_LIST * lists_for(count))
    share = min(1 << 20, int(1.2 * wanted / count * (1 << 20)) + 1)
    chosen = every.withColumn("h", F.xxhash64("class_id")).filter(F.pmod("h", F.lit(1 << 20)) < share).orderBy("h", "class_id").select("v").limit(wanted)
    found = chosen.toArrow().combine_chunks()["v"].combine_chunks()
    found = found.combine_chunks() if isinstance(found, pa.ChunkedArray) else found
    sample = _matrix(found) if len(found) else np.array([every.head()["v"]], np.float64)
    index = fit(sample, count, top, k)
    shared = spark.sparkContext.broadcast(index)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                row, at = shared.value.assign(_matrix(batch.column(1)))
                of = mix64(batch.column(0).to_numpy().view(np.uint64))[row]
                part = (of % shared.value.parts[at].astype(np.uint64)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(part), batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row))], names=["list", "part", "class_id", "v"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, out, at, done = f"{folder}/{uuid.uuid4().hex}", None, 0, []
        held: list[tuple[np.ndarray, np.ndarray]] = []
        now: tuple[int, int] | None = None

        def put() -> None:
            nonlocal out, at
            ids, v = (np.concatenate(x) for x in zip(*held))
            held.clear()
            out = out or files.create(path)
            data = ids.astype("<i8").tobytes() + v.tobytes()
            out.write(data)
            done.append({"list": now[0], "part": now[1], "path": path, "at": at, "n": len(ids)})
            at += len(data)

        for batch in batches:
            if not batch.num_rows:
                continue
            one, two, ids = (batch.column(i).to_numpy() for i in range(3))
            v = batch.column(3).flatten().to_numpy().reshape(len(ids), -1)
            new = np.flatnonzero(np.append(True, (one[1:] != one[:-1]) | (two[1:] != two[:-1])))
            for a, b in zip(new, np.append(new[1:], len(ids))):
                if held and (one[a], two[a]) != now:
                    put()
                now = (int(one[a]), int(two[a]))
                held.append((ids[a:b], v[a:b]))
        if held:
            put()
        if out:
            out.close()
            yield pa.RecordBatch.from_pylist(done, schema=_BLOCKS)

    spread = every.mapInArrow(assign, f"list int, part int, class_id long, v {kind}").repartition(shuffle_parts(spark), "list", "part").sortWithinPartitions("list", "part", "class_id")
    return saved(spread.mapInArrow(write, "list int, part int, path string, at long, n long"), f"{folder}-blocks"), index


_BLOCKS = pa.schema([("list", pa.int32()), ("part", pa.int32()), ("path", pa.string()), ("at", pa.int64()), ("n", pa.int64())])


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1).astype(np.float64)


Block = tuple[np.ndarray, np.ndarray]


def _read(path: str, at: int, n: int, dim: int, dtype: str) -> Block:
    """Ids and vectors of a block, repeated ones once."""
    (data,) = files.ranges(path, [(at, n * (8 + dim * np.dtype(dtype).itemsize))])
    ids = np.frombuffer(data[: 8 * n], "<i8")
    once = np.append(True, ids[1:] != ids[:-1])
    return ids[once], np.frombuffer(data[8 * n :], dtype).reshape(n, dim)[once]

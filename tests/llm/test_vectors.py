"""Vector searches against brute force."""

import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from textgraph.llm import spann, va_topk
from textgraph.llm.queries import op2_exact_top_k

SCHEMA = "vec_id long, embedding array<float>, label int, v int, q int, c int, ids int, score int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1, 2, 3, 4, 5) for i, v in rows], SCHEMA)


def rows(n=300, d=8, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)).astype(np.float32)
    x[40:120] = x[40]  # a large class of equal vectors
    out = [(i, [float(a) for a in v]) for i, v in enumerate(x)]
    return out + [(1000, None), (1002, []), (1004, [float("nan")] * d), (1006, [None] + [1.0] * (d - 1)), (1008, [float("inf")] * d), (None, out[0][1]), (1010, [1.0] * (d + 1)), out[5]]


def brute(vectors, every, k):
    out = set()
    for i, v in vectors.items():
        if i % every == 0:
            best = sorted(((-float(np.dot(v, w)), j) for j, w in vectors.items() if j != i))[:k]
            out |= {(i, r + 1, j, -s) for r, (s, j) in enumerate(best)}
    return out


def good(data, d=8):
    return {i: np.array(v, np.float64) for i, v in data if i is not None and v and len(v) == d and all(x is not None and np.isfinite(x) for x in v)}


def test_exact_top_k(spark):
    data = rows()
    whole = frame(spark, data).withColumn("embedding", F.transform("embedding", lambda x: F.when(F.isnan(x) | (F.abs(x) == float("inf")), x).otherwise(F.floor(x * 256).cast("float"))))
    got = {tuple(r) for r in va_topk.exact_top_k(whole, F.col("vec_id") % 10 == 0, 5).collect()}
    want = {(a, b, c, int(s)) for a, b, c, s in brute({i: np.floor(v * 256) for i, v in good(data).items()}, 10, 5)}
    assert got == want


def test_exact_top_k_few_and_none(spark):
    few = frame(spark, [(0, [1.0, 2.0]), (1, [1.0, 2.0]), (50, [3.0, -1.0])])
    got = sorted(tuple(r) for r in va_topk.exact_top_k(few, F.col("vec_id") % 50 == 0, 5).collect())
    assert got == [(0, 1, 1, 5), (0, 2, 50, 1), (50, 1, 0, 1), (50, 2, 1, 1)]
    assert va_topk.exact_top_k(frame(spark, []), F.col("vec_id") % 50 == 0, 5).count() == 0


def test_exact_top_k_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(va_topk, "FILE_ROWS", 50)
    monkeypatch.setattr(va_topk, "QUERY_ROWS", 7)
    data = [(i, [float(x) for x in np.floor(np.array(v) * 256)]) for i, v in rows() if i is not None and i < 300]
    got = {tuple(r) for r in va_topk.exact_top_k(frame(spark, data), F.col("vec_id") % 10 == 0, 5, cells=16).collect()}
    assert got == {(a, b, c, int(s)) for a, b, c, s in brute(good(data), 10, 5)}


def test_query_floors(spark, tmp_path):
    frame(spark, rows()).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {tuple(r) for r in op2_exact_top_k(spark, str(tmp_path)).collect()}
    assert got == {(a, b, c, int(s)) for a, b, c, s in brute({i: np.floor(v * 256) for i, v in good(rows()).items()}, 50, 5)}


def test_nearest_recall_and_scores(spark):
    data = rows(900, 12, 3)
    vectors = {i: v for i, v in good(data, 12).items() if v.any()}
    got = [tuple(r) for r in spann.nearest(frame(spark, data + [(2000, [0.0] * 12)]), F.col("vec_id") % 20 == 0, 20).collect()]
    want = brute(vectors, 20, 20)
    pairs = {(a, c) for a, _, c, _ in want}
    assert len(got) == len(want) and len({(a, c) for a, _, c, _ in got} & pairs) >= 0.9 * len(pairs)
    for q, _, c, s in got:
        assert abs(s - float(np.dot(vectors[q], vectors[c]))) < 1e-9


def test_vectors_of_each_length_are_compared_with_their_like(spark):
    data = [(0, [1.0, 2.0]), (1, [3.0, 4.0]), (50, [1.0, 0.0, 2.0]), (51, [1.0, 1.0, 1.0]), (100, [9.0])]
    want = [(0, 1, 1, 11), (50, 1, 51, 3)]
    assert sorted(tuple(r) for r in va_topk.exact_top_k(frame(spark, data), F.col("vec_id") % 50 == 0, 5).collect()) == want
    assert sorted(tuple(r) for r in spann.nearest(frame(spark, data), F.col("vec_id") % 50 == 0, 5).collect()) == want


def test_one_id_with_two_vectors(spark):
    data = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (1, [3.0, 0.0]), (2, [2.0, 0.0])]
    want = [(0, 1, 1, 3), (0, 2, 1, 2), (0, 3, 2, 2)]
    assert sorted(tuple(r) for r in va_topk.exact_top_k(frame(spark, data), F.col("vec_id") == 0, 5).collect()) == want
    assert sorted(tuple(r) for r in spann.nearest(frame(spark, data), F.col("vec_id") == 0, 5).collect()) == want


def test_lists_at_50000_vectors():
    """Recall, replicas and the share of vectors that a query reads, for clustered vectors of a real index size."""
    rng = np.random.default_rng(6)
    n, d, k = 50_000, 32, 20
    centres = rng.normal(size=(400, d))
    x = (centres[rng.integers(0, 400, n)] + 0.35 * rng.normal(size=(n, d))).astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    index = spann.fit(x[rng.permutation(n)[: spann.SAMPLE]], n, 1.0, k)
    row, at = index.assign(x)
    lists = len(index.centroids)
    sizes = np.bincount(at, minlength=lists)
    queries = rng.permutation(n)[:200]
    q, read = index.lists_of(x[queries])
    best = np.argsort(-(x[queries] @ x.T), axis=1)[:, : k + 1]
    found = 0
    for i in range(len(queries)):
        held = np.isin(at, read[q == i])
        found += np.isin(best[i], row[held]).sum()
    replicas, scanned = len(row) / n, sizes[read].sum() / len(queries) / n
    assert lists == round(n / spann.LIST_ROWS) and replicas < 3 and sizes.max() < 12 * n / lists
    assert found / best.size >= 0.9 and scanned < 0.25, (found / best.size, replicas, scanned)


def test_nearest_falls_back_to_all_rows(spark):
    data = [(i, [float(i), 1.0]) for i in range(30)]
    got = [tuple(r) for r in spann.nearest(frame(spark, data), F.col("vec_id") == 20, 29).collect()]
    assert {(a, c) for a, _, c, _ in got} == {(20, i) for i in range(30) if i != 20}
    assert spann.nearest(frame(spark, []), F.col("vec_id") == 1, 5).count() == 0


def test_graph_walk_finds_nearest_centroids():
    rng = np.random.default_rng(5)
    c = rng.normal(size=(300, 6))
    index = spann.Index(c, spann.neighbour_graph(c), 1.0)
    q = rng.normal(size=(40, 6))
    ids, d = index.walk(q, 32)
    true = np.argsort(spann.squared(q, c), axis=1)[:, :10]
    assert np.mean([len(set(a) & set(b[:10])) / 10 for a, b in zip(true, ids)]) > 0.95


def test_a_search_holds_little_however_many_lists_queries_read():
    """Queries that read every list: results are exact, and memory is that of a group, not of all queries and lists."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(6000, 16))
    c = rng.normal(size=(2000, 17))
    index = spann.Index(c, spann.neighbour_graph(c), float(np.linalg.norm(x, axis=1).max()), ratio=1e6)
    of = np.sort(rng.integers(0, 2000, 6000))
    first = np.searchsorted(of, np.arange(2001))
    blocks = spann.Blocks(np.arange(2001), ["a"], np.zeros(2000, int), first[:-1], np.diff(first))
    queries = x[:1500]
    tracemalloc.start()
    q, ids, score = spann.search_group(index, blocks, queries, 5, 6, lambda path, at, n: (np.arange(at, at + n), x[at : at + n].astype(np.float32)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40e6  # a row for each query and list would be 3 million vectors
    close = x.astype(np.float32).astype(np.float64)
    want = np.argsort(-(queries @ close.T), axis=1)[:, :6]
    assert (ids.reshape(1500, 6) == want).all() and (q == np.repeat(np.arange(1500), 6)).all()
    assert np.allclose(score, (queries[q] * close[ids]).sum(1))


def test_groups_of_few_queries(spark, monkeypatch):
    monkeypatch.setattr(spann, "GROUP", 7)
    monkeypatch.setattr(spann, "LEAST_GROUP", 3)
    data = rows(400, 6, 4)
    vectors = {i: v for i, v in good(data, 6).items() if v.any()}
    got = [tuple(r) for r in spann.nearest(frame(spark, data), F.col("vec_id") % 3 == 0, 10).collect()]
    want = brute(vectors, 3, 10)
    pairs = {(a, c) for a, _, c, _ in want}
    assert len(got) == len(want) and len({(a, c) for a, _, c, _ in got} & pairs) >= 0.9 * len(pairs)

"""Components against all pairs of a small corpus."""

import random

import pytest

from textgraph.llm import components as cc
from textgraph.llm import near_dedup
from textgraph.llm.near_dedup import near_duplicates

SCHEMA = "doc_id long, text string, rep string, digest string, n string, band string"


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows, percent):
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and rows[i][0] is not None and rows[j][0] is not None and 100 * both >= percent * len(sets[i] | sets[j]):
                up[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[top(i)] = min(least.get(top(i), d), d)
    return sorted((d, len(sets[i]), None if d is None else least[top(i)]) for i, (d, _) in enumerate(rows) if d is not None)


def corpus():
    random.seed(8)
    words = [f"w{i}" for i in range(400)]
    base = [random.choice(words) for _ in range(150)]
    rows = [(100 + i, " ".join(base)) for i in range(20)]
    for i in range(60):  # mutations at many distances
        w = list(base)
        for _ in range(random.choice([1, 2, 3, 4, 6, 9])):
            w[random.randrange(150)] = random.choice(words)
        rows.append((200 + i, " ".join(w)))
    rows += [(400 + i, " ".join(random.choice(words) for _ in range(random.randint(1, 60)))) for i in range(60)]
    rows += [(1, "A b c"), (2, "a B\tc"), (3, "a b"), (4, None), (5, ""), (6, " \n "), (7, "one two three four five"), (8, "ONE two three four five"), (None, " ".join(base)), (100, "another text of this very id"), (9, "z " * 30000), (10, "z " * 29000)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], SCHEMA)


@pytest.mark.parametrize("percent", [80, 85])
def test_components_equal_brute_force(spark, percent):
    rows = corpus()
    got = near_duplicates(frame(spark, rows), percent).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] is not None) == brute(rows, percent)
    none = [r for r in got if r["doc_id"] is None]
    assert len(none) == 1 and none[0]["component_id"] is None and none[0]["kept"]
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got if r["doc_id"] is not None)


def test_large_buckets_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BUCKET_ROWS", 8)
    rows = corpus()
    got = near_duplicates(frame(spark, rows), 85).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] is not None) == brute(rows, 85)


def test_empty_table(spark):
    assert near_duplicates(frame(spark, []), 80).count() == 0


def test_components_of_many_links(spark, tmp_path):
    random.seed(2)
    edges = [(i, i + 1) for i in range(0, 300)] + [(1000 + random.randrange(50), 1000 + random.randrange(50)) for _ in range(60)]
    links = spark.createDataFrame([(a, b) if random.random() < 0.5 else (b, a) for a, b in edges if a != b], "x long, y long").repartition(8)
    one = {tuple(r) for r in cc.components(links, f"file://{tmp_path}/one").collect()}
    many = {tuple(r) for r in cc.components(links, f"file://{tmp_path}/many", task_links=5).collect()}
    assert one == many and {c for n, c in one if n <= 300} == {0}

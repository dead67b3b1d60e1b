"""Base scores against plain counts; the model against the base on held-out texts."""

import collections
import math
import random
import zlib

import numpy as np
import pytest

from textgraph.llm import maxent_lm
from textgraph.llm.maxent_lm import CLASSES, ClassWeights, Classes, Evidence, Pairs, Tokens, feature_rows, lm_query


def corpus():
    random.seed(9)
    tongues = [[f"{a}{b}{c}" for a in s for b in "aeiou" for c in t] for s, t in (("bdg", ("n", "r.")), ("ptk", ("s", "l,")), ("fvz", ("x", "m")))]
    rows = []
    for i in range(400):
        words = tongues[i % 3]
        rows.append((i, " ".join(random.choice(words) for _ in range(random.randint(3, 60)))))
    return rows + [(400, None), (401, ""), (402, "never SEEN before"), (None, "bannn ban"), (10, rows[10][1]), (403, "ban " * 30000)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "a", "b") for r in rows], "doc_id long, text string, class string, score string")


@pytest.mark.parametrize("kept", [24, 1])
def test_scores(spark, monkeypatch, kept):
    monkeypatch.setattr(maxent_lm, "KEPT_SHARDS", kept)
    monkeypatch.setattr(maxent_lm, "SHARD_WORDS", 64 if kept == 1 else 1 << 20)
    rows = corpus()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    tokens = lambda t: [*(t or "").encode().lower().split(), None]
    count = collections.Counter(w for i, t in rows if not held(i) for w in tokens(t))
    n, v = sum(count.values()), len(count)
    got = lm_query(frame(spark, rows)).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
    assert len(got) == len(rows)
    better = []
    for i, t in rows:
        r, w = by[i][0], tokens(t)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held(i), len(w), sum(count[x] > 0 for x in w), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((count[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w))
        assert r["score"] < 0
        if held(i) and len(w) > 10:
            better.append(r["score"] > r["base_score"])
    assert sum(better) >= 0.9 * len(better) > 10


def test_no_training_rows_and_empty_table(spark):
    one = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    got = lm_query(frame(spark, [(one, "a b")])).collect()[0]
    assert (got["train_tokens"], got["n_known"], got["base_score"]) == (0, 0, 0) and got["score"] <= 0
    assert lm_query(frame(spark, [])).count() == 0


def test_long_texts_form_classes(spark):
    random.seed(10)
    tongues = [[f"{a}{b}{c}" for a in s for b in "aeiou" for c in "nrslxm"] for s in ("bdg", "ptk", "fvz")]
    rows = [(i, " ".join(random.choice(tongues[i % 3]) for _ in range(18000))) for i in range(39)]
    got = [r for r in lm_query(frame(spark, rows)).collect() if r["held_out"]]
    assert len(got) > 1 and all(len(t) > 1 << 16 for _, t in rows)
    assert all(r["score"] - r["base_score"] > 0.25 * r["n_tokens"] for r in got)


def test_scores_do_not_depend_on_the_tasks(spark):
    rows = corpus()
    got = [{(r["doc_id"], r["n_tokens"]): r["score"] for r in lm_query(frame(spark, rows).repartition(n)).collect()} for n in (1, 8, 64)]
    assert all(g.keys() == got[0].keys() and all(g[k] == pytest.approx(got[0][k], rel=1e-5) for k in g) for g in got[1:])


def test_pairs_and_skips_are_learnt(spark):
    """Texts whose next word follows from the last, of words that all occur alike: the base can't tell, the model can."""
    random.seed(11)
    words = [f"w{i:02d}" for i in range(60)]
    after = {w: random.sample(words, 2) for w in words}
    rows = []
    for i in range(300):
        text = [random.choice(words)]
        while len(text) < 60:
            text.append(random.choice(after[text[-1]]))
        rows.append((i, " ".join(text)))
    got = [r for r in lm_query(frame(spark, rows)).collect() if r["held_out"]]
    gain = sum(r["score"] - r["base_score"] for r in got) / sum(r["n_tokens"] for r in got)
    assert gain > 0.6 * math.log10(60 / 2)


@pytest.mark.parametrize("held", [40, 0])
def test_pairs_beyond_those_that_tasks_hold_count(spark, monkeypatch, held):
    """Scores are the same wherever the weights of pairs lie; repeated rows, null and empty texts included."""
    rows = corpus()[::3] + [(None, "bannn ban"), (10, "ban ban"), (10, "ban ban"), (401, ""), (402, None)]
    want, few = [], []
    for out in (want, few):
        out += sorted(tuple(r)[2:] for r in lm_query(frame(spark, rows)).collect())
        monkeypatch.setattr(maxent_lm, "PAIRS", held)
    assert len(want) == len(few) == len(rows)
    for a, b in zip(want, few):
        assert a[:4] == b[:4] and a[4] == pytest.approx(b[4], rel=1e-5)


def test_probabilities_sum_to_one():
    """Over all words of all classes, and one unknown word a class, after any history."""
    rng = np.random.default_rng(4)
    names = np.sort(maxent_lm.mix64(np.arange(1, 41, dtype=np.uint64)))
    classes = Classes(names, rng.integers(0, CLASSES, 40).astype(np.uint8), np.zeros(1 << 16, np.uint8))
    count = rng.integers(1, 50, 40).astype(float)
    in_class = np.bincount(classes.of_word, count + 0.1, CLASSES + 1) + 0.1
    keys = np.unique(rng.integers(0, 40, 300) << maxent_lm._KEY | rng.integers(0, 40, 300)).astype(np.int32)
    theta = rng.normal(size=len(keys)).astype(np.float32)
    first, second = keys >> maxent_lm._KEY, keys & maxent_lm._N
    change = np.zeros((maxent_lm.FREQUENT, CLASSES + 1))
    np.add.at(change, (first, classes.of_word[second]), (count[second] + 0.1) / in_class[classes.of_word[second]] * np.expm1(theta))
    pairs = Pairs(keys, theta, change)
    for w in range(40):
        share = np.log((count + 0.1) / in_class[classes.of_word]) + pairs.log_share(np.full(40, w), np.arange(40), classes.of_word)
        every = np.unique(classes.of_word)
        unknown = np.log(0.1 / in_class[every]) + pairs.log_share(np.full(len(every), w), np.full(len(every), maxent_lm._N), every)
        sums = np.bincount(classes.of_word, np.exp(share), CLASSES + 1)[every] + np.exp(unknown)
        assert np.allclose(sums, 1)


def test_evidence_is_the_gradient():
    """Came less expected is the derivative of the log likelihood, feature by feature."""
    t = Tokens(["a b c a b d " * 30, "x y"])
    cls = (t.tokens % np.uint64(CLASSES)).astype(np.int64)
    rng = np.random.default_rng(5)
    table = rng.normal(size=(1 + maxent_lm._C + maxent_lm.COMBINATIONS + maxent_lm.ROWS, CLASSES + 1)).astype(np.float32) * 0.1

    def likelihood(x):
        return sum(float(np.log(ClassWeights(x).probabilities(c, r)[np.arange(len(r)), cls[part]].astype(np.float64)).sum()) for part, c, r in feature_rows(t.tokens, cls, t.doc))

    found = Evidence()
    for part, c, r in feature_rows(t.tokens, cls, t.doc):
        found.add(ClassWeights(table).probabilities(c, r), c, r, cls[part])
    came, expected = found.rows()
    assert came.sum() == 6 * len(t.tokens)
    slope = came - expected
    for row, k in zip(*np.unravel_index(np.argsort(-np.abs(slope), axis=None)[:5], slope.shape)):
        up, down = table.copy(), table.copy()
        up[row, k] += 0.05
        down[row, k] -= 0.05
        assert (likelihood(up) - likelihood(down)) / 0.1 == pytest.approx(slope[row, k], rel=0.02)

"""Stages of the pipeline on rows with nulls, repeated ids and copies, against plain versions."""

import random

import corpus_pipeline
from textgraph.llm.queries import tokenizer
from textgraph.llm.wordmemo import encoder

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
random.seed(12)
WORDS = [f"{a}{b}" for a in "bdfgklmnprst" for b in ("ab", "en", "ir", "os", "ul")]


def prose(n):
    return " ".join(random.choice(WORDS) for _ in range(n))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], SCHEMA)


def texts(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def one_of_each(rows):
    """Groups by links of 0.8 between different rows; of each the row of the smallest id stays."""
    distinct = list(dict.fromkeys(r for r in rows if r[0] is not None and shingles(r[1])))
    up = list(range(len(distinct)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    sets = [shingles(t) for _, t in distinct]
    for i in range(len(distinct)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= 80 * len(sets[i] | sets[j]):
                up[top(i)] = top(j)
    groups = {}
    for i, r in enumerate(distinct):
        groups.setdefault(top(i), []).append(r)
    return [r for r in rows if r[0] is None or not shingles(r[1])], list(groups.values())


def test_copies_of_repeated_ids(spark):
    a, b, c = prose(40), prose(40), prose(40)
    near = a.split()
    near[20] = "other"
    rows = [(1, a), (2, a), (2, b), (3, c), (3, c), (3, c), (4, " ".join(near)), (4, prose(30)), (5, None), (5, None), (6, ""), (None, a), (None, a), (7, "two words"), (8, "TWO words"), (9, b), (2, prose(20))]
    got = texts(corpus_pipeline.keep_one_of_each_group(spark, frame(spark, rows), ""))
    every, groups = one_of_each(rows)
    left = list(got)
    for r in every:
        left.remove(r)
    assert len(left) == len(groups)  # one of each, whatever its id
    for g in groups:
        (kept,) = [r for r in left if r in g]
        assert kept[0] == min(i for i, _ in g)
    assert (2, b) in left and (3, c) in left and (1, a) in left and (2, a) not in left


def test_near_duplicates_equal_brute_force(spark):
    base = [prose(60).split() for _ in range(6)]
    rows = []
    for i in range(80):
        w = list(random.choice(base))
        for _ in range(random.choice([0, 1, 1, 2, 3, 6])):
            w[random.randrange(60)] = random.choice(WORDS)
        rows.append((random.randrange(1, 60), " ".join(w)))
    got = texts(corpus_pipeline.keep_one_of_each_group(spark, frame(spark, rows), ""))
    every, groups = one_of_each(rows)
    assert not every and len(got) == len(groups)
    assert sorted(i for i, _ in got) == sorted(min(i for i, _ in g) for g in groups)
    assert all(any(r in g for g in groups) for r in got)


def test_stages_on_odd_rows(spark, tmp_path):
    passage = prose(60)
    rows = [(1, f"{prose(20)}\n{passage}\n{prose(20)}"), (2, f"{prose(20)}\n{passage}\n{prose(20)}"), (3, passage), (4, None), (5, ""), (None, passage), (6, prose(15)), (6, prose(15)), (7, "x " * 20000)]
    frame(spark, [(1, "x")]).select("doc_id", "text").withColumnRenamed("text", "toxic").selectExpr("doc_id", "0 AS quality", "0 AS toxic").write.parquet(f"{tmp_path}/labels.parquet")
    docs = frame(spark, rows)
    same = corpus_pipeline.drop_toxic(spark, docs, str(tmp_path))
    assert same.columns == docs.columns and texts(same) == texts(docs)
    cut = corpus_pipeline.cut_shared_passages(spark, docs, str(tmp_path))
    kept = texts(cut)
    assert cut.columns == docs.columns and len(kept) == len(rows) - 1 and all(passage not in (t or "") for i, t in kept if i in (2, 3))
    assert {(i, t) for i, t in rows if i in (1, 4, 5, 6, 7, None)} <= set(kept)
    assert all(r["n_chars"] == len(r["text"]) for r in cut.collect() if r["text"] is not None)
    packed = corpus_pipeline.pack(spark, docs, str(tmp_path)).collect()
    encode = encoder(tokenizer("word_bpe_49k.json"), "word")
    assert sum(r["length"] for r in packed) == sum(len(x) + 1 for x in encode([t for _, t in rows]))
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, frame(spark, []), str(tmp_path)).count() == 0

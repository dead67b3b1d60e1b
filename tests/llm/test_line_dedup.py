"""Shared passages: planted ones go from later documents, all else stays."""

import random

import numpy as np

from textgraph.llm import line_dedup
from textgraph.llm.line_dedup import Lines, dedup_lines, likely, line_dedup_digest, patience, shared_blocks, shared_passages, without

random.seed(6)
WORDS = [f"{a}{b}" for a in "bcdfghklm" for b in ("a", "en", "or", "ist", "ule")]


def prose(n):
    out = [random.choice(WORDS) for _ in range(n)]
    for i in range(8, n, 9):
        out[i] += "."
    out[-1] += "."
    return " ".join(out)


def corpus():
    passage, lines = prose(70), "\n".join(prose(12) for _ in range(7))
    short = prose(20)
    rows = [(i, "\n".join(prose(14) for _ in range(4))) for i in range(1, 21)]
    rows += [(30, prose(25) + "\n" + lines + "\n" + prose(25)), (31, prose(9) + "\n" + lines.upper() + "\nEnd here."), (32, lines)]
    rows += [(40, "start of " + passage + " and the end " + prose(9)), (41, prose(30) + " of it " + passage + " with more " + prose(9))]
    rows += [(50 + i, short + "\n" + prose(30)) for i in range(6)]
    rows += [(60, rows[0][1]), (61, None), (62, ""), (None, lines), (63, prose(60) + " x " * 20000)]
    return rows, passage, lines


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", "q", "w") for i, t in rows], "doc_id long, text string, first string, h string, doc string, of string")


def test_planted_passages(spark):
    rows, passage, lines = corpus()
    texts = dict(rows)
    cut = {r["doc_id"]: r for r in shared_passages(frame(spark, rows)).collect()}
    assert set(cut) == {31, 32, 41, 60}
    assert list(cut[31]["sources"]) == [30] and cut[31]["removed_words"] == len(lines.split())
    assert cut[41]["removed_words"] >= 70 and passage not in cut[41]["text"] and cut[41]["text"].startswith(texts[41].split(" of it ")[0])
    kept = {r["doc_id"]: r["text"] for r in dedup_lines(frame(spark, rows)).collect()}
    assert set(kept) == set(texts) - {32, 60} and dedup_lines(frame(spark, rows)).columns == frame(spark, rows).columns
    assert all(kept[i] == texts[i] for i in kept if i not in cut)
    digest = {r["doc_id"]: r for r in line_dedup_digest(frame(spark, rows)).collect()}
    assert len(digest) == len(rows) and not digest[32]["kept"] and digest[1]["removed_words"] == 0 and list(digest[1]["sources"]) == []


def test_empty_table_and_repeated_ids(spark):
    assert dedup_lines(frame(spark, [])).count() == 0
    rows, _, lines = corpus()
    twice = [(1, lines), (1, lines), (2, "a b c. " + lines), (2, "d e f. " + lines)]
    assert sorted((r["doc_id"], r["text"]) for r in dedup_lines(frame(spark, twice)).collect()) == [(1, lines), (1, lines), (2, "a b c."), (2, "d e f.")]


def test_patience_is_a_common_subsequence():
    for _ in range(300):
        a, b = ([random.choice("abcdefgh") for _ in range(random.randint(0, 12))] for _ in range(2))
        pairs = patience(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
        if a == b:
            assert len(pairs) == len(a)


def test_passages_in_another_order():
    p, q = prose(60), prose(60)
    a, b = Lines([f"{q}\nmiddle words here now.\n{p}"]), Lines([f"{p}\nother words stand here.\n{q}"])
    spans = sorted(shared_blocks(a, 0, b, 0, 50))
    assert [e - s for s, e in spans] == [60, 60]


def test_without_keeps_breaks():
    assert without("a b\nc d\ne f", [(2, 4)]) == "a b\ne f"
    assert without("a b c d", [(1, 3)]) == "a d" and without("é b c", [(0, 1)]) == "b c" and without("a b", [(0, 2)]) == ""


def texts_of(spark, rows):
    return {r["doc_id"]: r["text"] for r in dedup_lines(frame(spark, rows)).collect()}


def numbered(n, ends="!!"):
    return " ".join(f"{random.choice(WORDS)}{i}{ends}" for i in range(n))


def test_passages_of_short_lines(spark):
    shout, verse = numbered(70), "\n".join(f"{numbered(2, '')} {numbered(1, '.')}" for _ in range(30))
    plain = numbered(55, "")
    rows = [(1, shout), (2, shout), (3, "start here\n" + verse), (4, verse + "\nand the end"), (5, "a " + plain + " b"), (6, "c " + plain + " d")]
    assert texts_of(spark, rows) == {1: shout, 3: rows[2][1], 4: "and the end", 5: rows[4][1], 6: "c d"}


def test_the_first_document_of_a_whole_block_is_found(spark):
    lines = [prose(6) for _ in range(10)]
    whole = "\n".join(lines)
    rows = [(i, "\n".join([prose(9), lines[2 * i - 2], prose(9), lines[2 * i - 1]])) for i in range(1, 6)] + [(6, whole), (7, whole)]
    assert texts_of(spark, rows) == dict(rows[:6])
    halves = [numbered(30, "") for _ in range(2)]
    rows = [(1, halves[0] + "\n" + prose(9)), (2, prose(9) + "\n" + halves[1]), (3, " ".join(halves)), (4, "x. " + " ".join(halves) + " y.")]
    assert texts_of(spark, rows) == dict(rows[:3]) | {4: "x. y."}
    parts = [numbered(12, "") for _ in range(5)]
    rows = [(i + 1, " ".join(parts[i : i + 3])) for i in range(3)] + [(8, "u " + " ".join(parts)), (9, "v " + " ".join(parts) + " w")]
    assert texts_of(spark, rows) == dict(rows[:4]) | {9: "v w"}


def test_a_passage_twice_in_the_later_document(spark):
    passage = "\n".join(prose(12) for _ in range(5))
    rows = [(1, "one.\n" + passage), (2, "\n".join(["two.", passage, "three.", passage, "four."])), (3, passage + "\n" + passage)]
    assert texts_of(spark, rows) == {1: rows[0][1], 2: "two.\nthree.\nfour."}


def test_every_stretch_of_min_words_is_cut(spark):
    """Against brute force: what goes is each min_words words that an earlier document has, and nothing else."""
    parts = [" ".join(random.choice(WORDS) + random.choice(("", "", ".", "\n")) for _ in range(random.randint(3, 14))) for _ in range(6)]
    rows = [(i, " ".join(random.choice(parts) for _ in range(random.randint(1, 9)))) for i in range(60)]
    words = {i: t.split() for i, t in rows}
    held: dict[tuple, int] = {}
    for i in sorted(words):
        for p in range(len(words[i]) - 19):
            held.setdefault(tuple(words[i][p : p + 20]), i)
    want = {}
    for i, w in words.items():
        gone = {q for p in range(len(w) - 19) if held[tuple(w[p : p + 20])] < i for q in range(p, p + 20)}
        if gone:
            want[i] = [x for q, x in enumerate(w) if q not in gone]
    got = {r["doc_id"]: (r["text"].split(), r["removed_words"]) for r in shared_passages(frame(spark, rows), 20).collect()}
    assert len(want) > 20 and got == {i: (left, len(words[i]) - len(left)) for i, left in want.items()}


def test_filters_hold_all_their_values(spark):
    values = [random.randrange(-(1 << 63), 1 << 63) for _ in range(3000)] + [-1, 0, 1]
    found = likely(spark.createDataFrame([(x,) for x in values], "x long"))
    assert found.may_hold(np.array(values, np.int64).view(np.uint64)).all()
    assert found.may_hold(np.arange(1000, 21000, dtype=np.uint64)).mean() < 0.05
    assert not likely(spark.createDataFrame([], "x long")).may_hold(np.arange(9, dtype=np.uint64)).any()


def test_full_filters_change_nothing(spark, monkeypatch):
    """A filter that lets everything pass costs time only."""
    rows, _, _ = corpus()
    want = sorted(tuple(r) for r in line_dedup_digest(frame(spark, rows)).collect() if r["doc_id"] is not None)
    monkeypatch.setattr(line_dedup.Likely, "may_hold", lambda self, x: np.ones(len(x), bool))
    assert sorted(tuple(r) for r in line_dedup_digest(frame(spark, rows)).collect() if r["doc_id"] is not None) == want


def test_texts_are_shuffled_for_no_lookup(spark, tmp_path):
    """Whichever documents have a shared mark or a pair is found without a join of all texts."""
    rows, _, _ = corpus()
    seen = []
    keep = line_dedup.saved
    line_dedup.saved = lambda df, path: seen.append((path.rsplit("/", 1)[1], df._jdf.queryExecution().executedPlan().toString())) or keep(df, path)
    try:
        shared_passages(frame(spark, rows)).count()
    finally:
        line_dedup.saved = keep
    plans = dict(seen)
    assert "Join" not in plans["stretches"] and "Join" not in plans["texts"]


def exchanges_of_texts(df):
    """How many exchanges of a plan carry texts."""
    found, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
            continue
        names = [node.output().apply(i).name() for i in range(node.output().size())]
        found += node.nodeName() == "Exchange" and "text" in names
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return found


def test_texts_are_shuffled_once_for_each_join(spark, monkeypatch):
    """Texts of pairs go to their ids and on to their tasks, those that lose words to their ids again; rows that are repeated count once."""
    rows, _, lines = corpus()
    rows += [(31, rows[21][1]), (70, "other words of " + lines), (70, lines + " and more"), (70, "other words of " + lines)]
    rows = [x for x in rows if x[0] is not None]
    seen, keep, least = {}, line_dedup.saved, spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    monkeypatch.setattr(line_dedup, "saved", lambda df, path: seen.update({path.rsplit("/", 1)[1]: exchanges_of_texts(df)}) or keep(df, path))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        cut = [(r["doc_id"], r["text"], list(r["sources"])) for r in shared_passages(frame(spark, rows)).collect()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", least)
    assert (seen["texts"], seen["spans"], seen["cut"]) == (0, 2, 1)
    assert sorted(x[0] for x in cut) == [31, 32, 41, 60, 70, 70] and {x[1] for x in cut if x[0] == 70} == {"other words of", "and more"}
    assert all(30 in sources for i, _, sources in cut if i in (31, 32, 70))

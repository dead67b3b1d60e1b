"""Lexicon matching against plain edit distances; scores on a fixture with quotations and misspellings."""

import random
import zlib

from textgraph.llm import toxicity
from textgraph.llm.toxicity import Lexicon, Terms, build_trie, context, edits_allowed, match, toxicity_query


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def test_match_equals_edit_distance():
    random.seed(3)
    terms = sorted({"".join(random.choice("abcd") for _ in range(random.randint(3, 15))) for _ in range(60)})
    tries = build_trie(terms, []), build_trie([t[::-1] for t in terms], []), build_trie([t for t in terms if edits_allowed(t) > 1], [])
    for _ in range(2000):
        w = list(random.choice(terms))
        for _ in range(random.randint(0, 3)):
            at, what = random.randrange(len(w) + 1), random.random()
            w[at : at + (what > 0.4)] = [random.choice("abcd")] if what < 0.7 else []
        word = "".join(w) or "a"
        near = [(d, t) for t in terms if (d := distance(word, t)) <= edits_allowed(t)]
        want = (word, 0) if word in terms else min(near)[::-1] if near else None
        assert match(word, *tries) == want


def test_openings_match_all_that_begin_so():
    trie = build_trie(["scum"], ["vequ"])
    assert match("vequisse", trie, {}, {}) == ("vequ", 0) and match("scums", trie, build_trie(["mucs"], []), {}) is None


def test_words_that_may_match_reach_the_automata():
    """Every word within the allowed edits of a term, wherever these are, passes the tests before the automata."""
    random.seed(6)
    terms = ["".join(random.choice("abcdefgh") for _ in range(random.randint(5, 18))) for _ in range(40)]
    words = set()
    for _ in range(1500):
        t = random.choice(terms)
        w = list(t)
        for _ in range(edits_allowed(t)):
            at, what = random.choice([0, len(w) - 1, random.randrange(len(w))]), random.random()
            w[at : at + (what > 0.4)] = [random.choice("abcdefghé")] if what < 0.7 else []
        words.add("".join(w))
    lexicon = Lexicon(terms, [])
    lexicon.learn(Terms([" ".join(sorted(words))]))
    hits = {h for h in lexicon.hits}
    t = Terms([" ".join(sorted(words))])
    assert all(int(h) in hits for h in t.hashes)


def test_punctuation_of_any_length_is_no_part_of_a_term():
    lexicon = Lexicon(["worthless"], [])
    edge = "!" * 300
    assert lexicon.features([f"so ((((((worthless{edge} now", "worthless", "!!!!!!!! ......", "", None])[:, 0].tolist()[1] > 0
    x = lexicon.features([f"((((((worthless{edge}", "worthless", "!!!!!!!! ...... ?"])
    assert x[0].tolist() == x[1].tolist() and not x[2].any()


def test_sample_is_bounded_and_does_not_depend_on_the_order(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE", 200)
    docs, labels = corpus(spark)
    one = {r["doc_id"]: r["score"] for r in toxicity_query(docs.repartition(1), labels).collect()}
    many = {r["doc_id"]: r["score"] for r in toxicity_query(docs.repartition(9), labels.repartition(5)).collect()}
    assert one == many and len(set(one.values())) > 2


def test_context_tells_quotation_from_abuse():
    def weight(text):
        t = Terms([text])
        i = next(i for i in range(len(t.hashes)) if t.word(i) == b"idiot")
        return context(t, i, 0, len(t.hashes))[0]

    assert weight('the word "idiot" is old') < weight("what an idiot here") < weight("you are an idiot today")


def corpus(spark):
    random.seed(4)
    plain = "river stone cloud winter garden paper music window yellow basket".split()
    rows, labels = [], []
    for i in range(600):
        words = [random.choice(plain) for _ in range(30)]
        toxic = i % 8 == 0
        if toxic:
            for _ in range(3):
                words[random.randrange(30)] = random.choice(["moronic", "worthless", "pathetic"])
        rows.append((i, " ".join(words), "en", "s"))
        labels.append((i, int(toxic), "x"))
    rows += [(600, "you are worthles and pathetik and moronnic today", "en", "s"), (601, 'the word "worthless" is an old word', "en", "s"), (602, None, "en", "s"), (603, "", "en", "s"), (None, "pathetic worthless moronic", "en", "s"), (604, "river stone worthless cloud paper pathetic garden moronic " * 8000, "en", "s")]
    return spark.createDataFrame(rows, "doc_id long, text string, score string, predicted string"), spark.createDataFrame(labels + [(None, 1, "x"), (5, None, "x")], "doc_id long, toxic int, text string")


def test_scores(spark):
    docs, labels = corpus(spark)
    got = {r["doc_id"]: r for r in toxicity_query(docs, labels).collect()}
    assert len(got) == 606
    for i in range(600):
        assert got[i]["predicted"] == int(i % 8 == 0)
    assert got[600]["score"] > got[602]["score"] == got[603]["score"] and got[601]["score"] < got[None]["score"]
    assert got[604]["predicted"] == 1 and got[602]["predicted"] == 0 and got[None]["held_out"] is False
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i in range(605))


def test_without_labels(spark):
    docs, labels = corpus(spark)
    got = toxicity_query(docs.limit(5), labels.limit(0)).collect()
    assert len(got) == 5 and all(r["score"] == 0 and r["predicted"] == 0 for r in got)
    assert toxicity_query(docs.limit(0), labels).count() == 0


def test_lexicon_is_small_when_pickled():
    import pickle

    lexicon = Lexicon(["worthless"], [])
    lexicon.features(["many words here worthless"] * 10)
    assert pickle.loads(pickle.dumps(lexicon)).features(["worthless"])[0][0] > 0
    assert not pickle.loads(pickle.dumps(lexicon)).hits
    assert toxicity.FEATURES == 7

"""Toxicity scores: a learned lexicon, matched through Levenshtein automata, weighed by the context of each match.

The lexicon (terms, and openings that stand for all words that begin so) is learned from labelled documents.  It is
held in a trie.  Every distinct word is read as a Levenshtein automaton that walks the trie, so misspelled terms are
found, too.  A window of words around a match tells quotation from abuse, and a logistic model over the weighed
matches gives the score.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textgraph.llm.common import Words, arrow_limits, crc_of_id, lean, saved, span_hashes, work_dir

#: Labelled documents that the classifier is fitted on, at most (those of the least hashes of their ids).
SAMPLE = 20_000
#: Sizes of the classifier: terms and openings each, those of the most toxic documents; and clean words that look like a
#: misspelled term, the most frequent ones.
ENTRIES, CLEAN = 1 << 16, 1 << 18
#: Words on either side of a match that its context is read from.
WINDOW = 6
#: Lengths of learned openings, and of the shortest terms that may be misspelled by one and two edits.
OPENINGS, ONE_EDIT, TWO_EDITS = (4, 5, 6, 7, 8), 5, 12
_EDGE = np.zeros(256, bool)
_EDGE[list(b".,;:!?\"'()[]{}<>*_-~`#$%&@^+=|/\\")] = True
_QUOTES = "\"'“”‘’«»„`"
#: Words that report speech, and words that address someone.
REPORTING = frozenset("said says wrote called quote quoted quoting term word called shouted insult insults dit appelle mot sagte nennt wort dijo llama palabra".split())
ADDRESSING = frozenset("you your youre u ur tu toi vous du dich dein ihr usted eres".split())
FEATURES = 7


class Terms(Words):
    """Words without the punctuation at their edges; hashes are of what remains."""

    def __init__(self, texts: list[str | None]):
        super().__init__(texts)
        self.outer = self.starts, self.ends
        inner, at = ~_EDGE[self.data], np.arange(len(self.data), dtype=np.int32)
        # the next byte, from each on, that is no punctuation, and the last one up to each; one byte stays in any case
        after = np.minimum.accumulate(np.where(inner, at, len(at))[::-1])[::-1]
        before = np.maximum.accumulate(np.where(inner, at, -1))
        self.starts = np.minimum(after[self.starts], self.outer[1] - 1).astype(np.int64)
        self.ends = np.maximum(before[self.outer[1] - 1] + 1, self.starts + 1).astype(np.int64)
        self.hashes = span_hashes(self.data, self.starts, self.ends)


def edits_allowed(term: str) -> int:
    return 2 if len(term) >= TWO_EDITS else 1 if len(term) >= ONE_EDIT else 0


def build_trie(terms: list[str], openings: list[str]) -> dict:
    """Nested dicts by character; key "" holds (term, True if it is an opening)."""
    root: dict = {}
    for words, opening in ((terms, False), (openings, True)):
        for w in words:
            node = root
            for ch in w:
                node = node.setdefault(ch, {})
            node[""] = (w, opening)
    return root


def _walk(word: str, trie: dict, most: int, same: int = 0) -> Iterator[tuple[int, str]]:
    """Terms within ``most`` edits (and those allowed for them) that have the word's first ``same`` letters, and their distances.

    The automaton of the word has a bit for each of its positions and a set of bits for each number of edits; a
    character of the trie moves all of them at once, and a branch without bits is left.
    """
    node = trie
    for ch in word[:same]:
        node = node.get(ch)
        if node is None:
            return
    end, places = 1 << len(word), {}
    for i, ch in enumerate(word):
        places[ch] = places.get(ch, 0) | 1 << i
    reach, at = end + end - 1, 1 << same
    two = most > 1
    stack = [(node, at, at | at << 1, at | at << 1 | at << 2)]
    while stack:
        node, r0, r1, r2 = stack.pop()
        for ch, below in node.items():
            if ch == "":
                continue
            m = places.get(ch, 0)
            a0 = (r0 & m) << 1
            a1 = (r1 & m) << 1 | r0 | r0 << 1 | a0 << 1
            a2 = (r2 & m) << 1 | r1 | r1 << 1 | a1 << 1 if two else 0
            if "" in below and not below[""][1] and (a0 | a1 | a2) & end:
                term = below[""][0]
                d = 0 if a0 & end else 1 if a1 & end else 2
                if d <= edits_allowed(term):
                    yield d, term
            if (a0 | a1 | a2) & reach:
                stack.append((below, a0, a1, a2))


def match(word: str, trie: dict, reverse: dict, long: dict) -> tuple[str, int] | None:
    """The nearest entry and its distance: an opening of the word (0), a term (0), or a misspelled term.

    reverse: the trie of the reversed terms.  One edit leaves the first two or the last two letters of a term as they
    are, so walks from both ends find all terms one edit away.  long: the trie of terms that may have two edits, which
    may be anywhere.
    """
    node = trie
    for ch in word:
        node = node.get(ch)
        if node is None:
            break
        if "" in node and node[""][1]:
            return node[""][0], 0
    else:
        if "" in node:
            return node[""][0], 0
    if not ONE_EDIT - 1 <= len(word) <= 64:
        return None
    found = list(_walk(word, trie, 1, 2))
    found += [(d, term[::-1]) for d, term in _walk(word[::-1], reverse, 1, 2)]
    if not found and len(word) >= TWO_EDITS - 2:
        found = list(_walk(word, long, 2))
    if not found:
        return None
    d, term = min(found)
    return term, d


def stretches_of(term: str) -> list[bytes]:
    """The first four bytes of each third of a term: two edits leave one third as it is."""
    n = len(term)
    return [term[a:b].encode()[:4] for a, b in ((0, n // 3), (n // 3, 2 * n // 3), (2 * n // 3, n))]


def _fours(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 16-bit hash of the four bytes from each place on."""
    x = data[at].astype(np.uint32) | data[at + 1].astype(np.uint32) << 8 | data[at + 2].astype(np.uint32) << 16 | data[at + 3].astype(np.uint32) << 24
    return (x * np.uint32(0x9E3779B1)) >> np.uint32(16)


@dataclass
class Lexicon:
    terms: list[str]
    openings: list[str]
    clean: frozenset[str] = frozenset()  # words of clean documents that look like misspelled terms
    weights: np.ndarray = field(default_factory=lambda: np.zeros(FEATURES + 1))
    prior: float = 0.0

    def __post_init__(self) -> None:
        self.start()

    def __getstate__(self) -> dict:
        return {k: self.__dict__[k] for k in ("terms", "openings", "clean", "weights", "prior")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.start()

    def start(self) -> None:
        self.trie = build_trie(self.terms, self.openings)
        self.reverse = build_trie([w[::-1] for w in self.terms], [])
        long = [w for w in self.terms if edits_allowed(w) > 1]
        self.long = build_trie(long, [])
        self.parts = np.zeros(1 << 16, bool)  # of the thirds of long terms
        for w in long:
            for part in stretches_of(w):
                self.parts[_fours(np.frombuffer(part, np.uint8), np.zeros(1, np.int64))] = True
        self.hits: dict[int, tuple[str, int]] = {}
        self.hit_hashes = np.empty(0, np.uint64)
        self.seen = np.empty(0, np.uint64)
        self.first, self.last = np.zeros(65536, bool), np.zeros(65536, bool)
        for w in [*self.terms, *self.openings]:
            raw = w.encode()
            self.first[raw[0] << 8 | raw[1]] = True
        for w in self.terms:
            raw = w.encode()
            self.last[raw[-2] << 8 | raw[-1]] = True
        self.longest = max([len(w.encode()) for w in self.terms], default=0) + 8  # two inserted characters

    def learn(self, t: Terms) -> None:
        """Matches the words that weren't seen before.

        A word can only match if it opens or ends like an entry (one edit leaves the first or the last two letters of a
        term), or if a third of a long term is in it.
        """
        fresh, at = np.unique(t.hashes, return_index=True)
        if len(self.seen):
            where = np.minimum(np.searchsorted(self.seen, fresh), len(self.seen) - 1)
            new = self.seen[where] != fresh
            fresh, at = fresh[new], at[new]
        if len(self.seen) > 4_000_000:
            self.seen, new = np.empty(0, np.uint64), None
        self.seen = np.union1d(self.seen, fresh)
        size = t.ends[at] - t.starts[at]
        d, s, e = t.data, t.starts[at], t.ends[at]
        two = size >= 2
        head = (d[s].astype(np.int64) << 8) | d[np.minimum(s + 1, len(d) - 1)]
        tail = (d[np.maximum(e - 2, 0)].astype(np.int64) << 8) | d[e - 1]
        able = two & (self.first[head] | (self.last[tail] & (size <= self.longest)))
        left = np.flatnonzero(~able & (size >= TWO_EDITS - 2) & (size <= self.longest))
        if len(left) and self.parts.any():
            n = size[left] - 3
            inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            hit = self.parts[_fours(d, np.repeat(s[left], n) + inside)]
            able[left] = np.logical_or.reduceat(hit, np.cumsum(n) - n)
        for i in np.flatnonzero(able):
            word = d[s[i] : e[i]].tobytes().decode("utf-8", "replace")
            found = match(word, self.trie, self.reverse, self.long)
            if found and not (found[1] and word in self.clean):
                self.hits[int(fresh[i])] = found
        self.hit_hashes = np.sort(np.fromiter(self.hits, np.uint64, len(self.hits)))

    def features(self, texts: list[str | None]) -> np.ndarray:
        """[text, FEATURES]: exact, misspelled, quoted and addressed matches, distinct terms, rate, and their presence."""
        t = Terms(texts)
        self.learn(t)
        out = np.zeros((len(texts), FEATURES))
        if not len(self.hit_hashes) or not len(t.hashes):
            return out
        where = np.minimum(np.searchsorted(self.hit_hashes, t.hashes), len(self.hit_hashes) - 1)
        found = np.flatnonzero(self.hit_hashes[where] == t.hashes)
        doc = np.searchsorted(t.first, found, side="right") - 1
        sums: dict[int, list] = {}
        for i, j in zip(found.tolist(), doc.tolist()):
            term, d = self.hits[int(t.hashes[i])]
            s = sums.setdefault(j, [0.0, 0.0, 0.0, 0.0, set()])
            weight, quoted, addressed = context(t, i, int(t.first[j]), int(t.first[j + 1]))
            s[0 if d == 0 else 1] += weight / (1 + d)
            s[2] += quoted
            s[3] += addressed
            s[4].add(term)
        for j, (exact, near, quoted, addressed, terms) in sums.items():
            n = int(t.first[j + 1] - t.first[j])
            out[j] = (math.log1p(exact), math.log1p(near), math.log1p(quoted), math.log1p(addressed), math.log1p(len(terms)), math.log1p(100 * (exact + near / 4) / n), min(1.0, exact))
        return out

    def score(self, texts: list[str | None]) -> np.ndarray:
        if not self.terms and not self.openings:
            return np.full(len(texts), self.prior)
        x = self.features(texts)
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -30, 30)))


def context(t: Terms, i: int, first: int, last: int) -> tuple[float, int, int]:
    """Weight of the match at word i of its document's words first to last, and whether it is quoted or addressed.

    A match between quotation marks, or after words that report speech, counts a quarter; one with words that address
    someone nearby counts once and a half.
    """
    a, b = max(first, i - WINDOW), min(last, i + WINDOW + 1)
    before = t.data[t.outer[0][a] : t.starts[i]].tobytes().decode("utf-8", "replace")
    after = t.data[t.ends[i] : t.outer[1][b - 1]].tobytes().decode("utf-8", "replace")
    opened = sum(before.count(q) for q in _QUOTES) - sum(before.count(q + s) for q in "'’" for s in ("s ", "t ", "re ", "ll "))
    quoted = opened % 2 == 1 and any(q in after for q in _QUOTES)
    near = {t.word(k).decode("utf-8", "replace") for k in range(a, b) if k != i}
    reported = bool(near & REPORTING)
    addressed = bool(near & ADDRESSING) and not quoted
    return (0.25 if quoted or reported else 1.0) * (1.5 if addressed else 1.0), int(quoted or reported), int(addressed)


def fit_logistic(x: np.ndarray, y: np.ndarray, rounds: int = 40, ridge: float = 0.05) -> np.ndarray:
    """Weights and bias by Newton steps on the penalised log likelihood."""
    x = np.concatenate((x, np.ones((len(x), 1))), axis=1)
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + penalty * w
        hess = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(hess, grad)
        w -= step * min(1.0, 4 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    return w


def learn(docs: DataFrame, labels: DataFrame, folder: str) -> Lexicon:
    """Lexicon and model from labelled documents: docs (doc_id, text), labels (doc_id, toxic 0 or 1, others are ignored).

    At most SAMPLE labelled ids are used, those of the smallest hashes (of equal ones those of the smaller ids); all rows
    of such an id count.  Of labels that contradict each other for one id, toxic holds.  Lists are cut by how often a word
    occurs, of equal ones by the word.
    """
    spark = docs.sparkSession
    marked = labels.filter("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    order = F.xxhash64("doc_id")
    share = 1.2 * SAMPLE / max(marked.count(), 1)
    chosen = marked if share >= 1 else marked.filter(F.pmod(order, F.lit(1 << 20)) < math.ceil(share * (1 << 20)))
    chosen = chosen.orderBy(F.pmod(order, F.lit(1 << 20)), "doc_id").limit(SAMPLE)  # so it may be broadcast
    sample = saved(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic"), f"{folder}/sample")

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = batch.column(1).to_numpy()
            t = Terms(batch.column(0).to_pylist())
            if not len(t.hashes):
                continue
            doc = np.repeat(np.arange(batch.num_rows), np.diff(t.first)).astype(np.uint64)
            names, at, inv = np.unique(t.hashes, return_index=True, return_inverse=True)
            pairs = np.unique(inv.astype(np.uint64) << np.uint64(32) | doc)
            word, of = (pairs >> np.uint64(32)).astype(np.int64), (pairs & np.uint64(0xFFFFFFFF)).astype(np.int64)
            bad = np.bincount(word, toxic[of], len(names)).astype(np.int64)
            all_ = np.bincount(word, minlength=len(names))
            text = [t.word(i).decode("utf-8", "replace") for i in at]
            yield pa.RecordBatch.from_arrays([pa.array(text, pa.string()), pa.array(bad), pa.array(all_)], names=["word", "bad", "n"])

    counts = saved(sample.mapInArrow(lean(words), "word string, bad long, n long").groupBy("word").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n")), f"{folder}/words")
    total = sample.agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("bad")).head()
    if not total["bad"] or total["bad"] == total["n"]:
        return Lexicon([], [], prior=(total["bad"] or 0) / max(total["n"], 1))
    rate = total["bad"] / total["n"]
    distinct = counts.count()
    # toxic documents of a word that can't be chance, among so many words
    least = max(3, math.ceil(math.log(max(distinct, 2)) / math.log(1 / rate)))
    size = F.length("word")
    pure = (F.col("bad") >= least) & (F.col("bad") >= 0.9 * F.col("n"))
    terms = counts.filter(pure & (size >= 3) & (size <= 64)).orderBy(F.desc("bad"), "word").limit(ENTRIES)
    heads = counts.select("word", "bad", "n", F.explode(F.array(*[F.lit(k) for k in OPENINGS])).alias("k")).filter(size > F.col("k"))
    heads = heads.groupBy(F.expr("left(word, k)").alias("word")).agg(F.sum("bad").alias("bad"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("kinds"))
    heads = heads.filter((F.col("bad") >= least) & (F.col("bad") >= 0.98 * F.col("n")) & (F.col("kinds") >= 3)).orderBy(F.desc("bad"), "word").limit(ENTRIES)
    term_list, opening_list = [r["word"] for r in terms.collect()], [r["word"] for r in heads.collect()]
    lexicon = Lexicon(term_list, opening_list)
    shared = spark.sparkContext.broadcast(lexicon)

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            keep = [bool((m := match(w, own.trie, own.reverse, own.long)) and m[1]) for w in batch.column(0).to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    # words of clean documents that are a misspelling of a term by their letters only
    ordinary = counts.filter((F.col("bad") < 0.5 * F.col("n")) & (size >= 4) & (size <= 64)).select("word", "n").mapInArrow(alike, "word string, n long")
    spared = ordinary.orderBy(F.desc("n"), "word").limit(CLEAN)
    lexicon = Lexicon(term_list, opening_list, frozenset(r["word"] for r in spared.collect()))
    shared = spark.sparkContext.broadcast(lexicon)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = shared.value.features(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(1).cast(pa.int32()), pa.array(x.tolist(), pa.list_(pa.float64()))], names=["toxic", "x"])

    rows = sample.mapInArrow(lean(measure), "toxic int, x array<double>").groupBy("x").agg(F.sum("toxic").alias("bad"), F.count(F.lit(1)).alias("n")).collect()  # a row for each different document of the sample at most
    rows.sort(key=lambda r: r["x"])  # sums don't depend on the tasks
    x = np.array([r["x"] for r in rows for _ in range(r["n"])]).reshape(-1, FEATURES)
    y = np.array([b for r in rows for b in [1.0] * r["bad"] + [0.0] * (r["n"] - r["bad"])])
    lexicon.weights, lexicon.prior = fit_logistic(x, y), rate
    return lexicon


def score_documents(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.7) -> DataFrame:
    """docs with score (0 to 1, higher: rather toxic) and predicted (1 from the threshold on).

    docs needs text; all of its columns are kept, whatever their names, but for score and predicted, which are
    replaced.  Null and empty texts have no matches and get the score of a document without any; very long texts are
    scored whole, and repeated rows alike.
    """
    spark = docs.sparkSession
    arrow_limits(spark)
    kept = [c for c in docs.columns if c not in ("score", "predicted")]
    shared = spark.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = shared.value.score(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(score)], names=[*kept, "score"])

    schema = docs.select(*kept).schema.add("score", "double")
    return docs.select(*kept).mapInArrow(lean(run), schema).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def train(docs: DataFrame, labels: DataFrame) -> Lexicon:
    return learn(docs, labels, work_dir(docs.sparkSession, "toxicity"))


def toxicity_query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document; labels of held-out ids (crc32 mod 3 is 1) aren't read.

    A null doc_id isn't held out.
    """
    held_out = F.coalesce(crc_of_id("doc_id") % 3 == 1, F.lit(False))
    lexicon = train(docs, labels.filter(~held_out))
    return score_documents(docs.select("doc_id", "text"), lexicon).select("doc_id", held_out.alias("held_out"), "score", "predicted")

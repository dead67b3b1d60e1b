"""Language-model scores: a hashed maximum-entropy model with a class-factored softmax.

P(word | history) = P(class | history) * P(word | class, history).  The class is predicted by a softmax over hashed features
of the history: the last word, the word before it (a skip), the last two words, and the classes of the last word and of
the last three.  Within a class the softmax has the word's own feature and that of the pair with the last word, for pairs
of words that occur often; as few words of a class make a pair with the last word, its sum is that of the class but for
these.  A class also holds one unknown word.

Classes, counts and weights come from all training documents, whatever their length.  Tasks count words, then the pairs
of frequent words and the company (of anchors, the most frequent words) that each frequent word keeps, and other words
of each ending; all are summed as whole numbers.  Frequent words are grouped by their company; other words have the
class next to that of their ending.  Class weights are learnt in synchronous rounds: tasks sum gradients over their share of the round's
documents with the same weights, and each round moves the weights once.  Pair weights are learnt by gradient steps on
the pairs' counts, spread by the first word, for every pair of frequent words that was seen twice.  So scores don't depend on how the documents are dealt to tasks.  Counts lie in
hash-ordered shards in the shared folder, of which a scoring task keeps a bounded number.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textgraph.llm import files
from textgraph.llm.common import BATCH_BYTES, Words, arrow_limits, crc_of_id, lean, mix64, saved, shuffle_parts, work_dir

#: Words with a class of their own, and anchors among them; pairs of last bytes.
FREQUENT, ANCHORS, ENDINGS = 16_384, 24, 1 << 16
#: A document's shares of anchors are counted in parts of this size, so sums don't depend on their order.
UNIT = 1 << 10
CLASSES = 24
#: Rows of the weight table of hashed features; weights of pairs that every task holds (those of the most frequent pairs;
#: where there are more, the others' are joined to the documents that have these pairs).
ROWS, PAIRS = 1 << 15, 1 << 21
#: Documents are dealt to so many rounds of gradient steps by a hash; how far a round moves, and the least weight of evidence.
ROUNDS, RATE, FAITH = 6, 0.45, 4.0
#: Steps of pair weights, and the precision of their prior.
PAIR_STEPS, PAIR_PRIOR = 12, 0.7
#: Tokens whose features are held at a time, and whose probabilities are.
STRETCH, STEP = 1 << 16, 4096
#: Words of a shard, about, and shards that a process keeps.
SHARD_WORDS, KEPT_SHARDS = 1 << 20, 24
END = np.uint64(0xE0D0E0D0E0D0E0D1)
ALPHA = 0.1
LOG10_E = float(np.log10(np.e))
#: Parts of a pair's weight that sums of weights are counted in.
FINE = 1 << 32
#: Histories of classes: each of the last three is a class, the end, or nothing.
_C = CLASSES + 2
COMBINATIONS = _C**3


class Tokens(Words):
    """Words, each text closed by END: tokens (hashes), doc (text of each), last (two last bytes of each)."""

    def __init__(self, texts: list[str | None]):
        super().__init__(texts)
        n, docs = len(self.hashes), len(texts)
        self.sizes = np.diff(self.first) + 1
        self.begin = np.cumsum(self.sizes) - self.sizes
        self.doc = np.repeat(np.arange(docs), self.sizes)
        ends = self.begin + self.sizes - 1
        self.tokens = np.full(n + docs, END, np.uint64)
        self.last = np.zeros(n + docs, np.int64)
        at = np.ones(n + docs, bool)
        at[ends] = False
        self.tokens[at] = self.hashes
        if n:
            tail = self.data[self.ends - 1].astype(np.int64)
            tail += np.where(self.ends - self.starts > 1, self.data[np.maximum(self.ends - 2, 0)].astype(np.int64) << 8, 0)
            self.last[at] = tail


@dataclass
class Classes:
    """Bounded: FREQUENT words and one entry per pair of last bytes."""

    words: np.ndarray  # sorted hashes
    of_word: np.ndarray
    of_ending: np.ndarray

    def __call__(self, tokens: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The class of each token, and which frequent word it is (or FREQUENT)."""
        out, number = self.of_ending[last], np.full(len(tokens), FREQUENT, np.int64)
        if len(self.words):
            number = _numbers(tokens, self.words)
            out = np.where(number < FREQUENT, self.of_word[np.minimum(number, len(self.words) - 1)], out)
        return np.where(tokens == END, CLASSES, out).astype(np.int64), number  # the end is a class of its own


def _numbers(tokens: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Places of tokens among sorted words; FREQUENT for others."""
    if not len(words):
        return np.full(len(tokens), FREQUENT, np.int64)
    at = np.minimum(np.searchsorted(words, tokens), len(words) - 1)
    return np.where(words[at] == tokens, at, FREQUENT)


def count_words(docs: DataFrame) -> DataFrame:
    """h, c, last: partial counts of the documents' tokens, and the last bytes of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def counts() -> pa.RecordBatch:
            h, c, last = (np.concatenate(x) for x in zip(*held))
            held.clear()
            names, first, inv = np.unique(h, return_index=True, return_inverse=True)
            total = np.bincount(inv, c, len(names)).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(total), pa.array(last[first].astype(np.int32))], names=["h", "c", "last"])

        for batch in batches:
            t = Tokens(batch.column(0).to_pylist())
            if not len(t.tokens):
                continue
            names, first, n = np.unique(t.tokens, return_index=True, return_counts=True)
            held.append((names, n, t.last[first]))
            size += len(names)
            if size > 1_000_000:
                yield counts()
                size = 0
        if held:
            yield counts()

    return docs.select("text").mapInArrow(lean(run), "h long, c long, last int")


_KEY, _N = 17, (1 << 17) - 1  # a pair's key: the first word's number, then the second's, or FREQUENT + its ending


def gather_pairs(docs: DataFrame, names: np.ndarray, anchors: np.ndarray, folder: str) -> tuple[DataFrame, DataFrame]:
    """Counts of pairs (key, n) whose first word is one of ``names`` (sorted hashes), and sums (i, sums) of company.

    Company has rows for names, then for endings of other words: shares of anchors in the documents of their tokens, in
    parts of UNIT, and how many tokens there are.
    """
    size = FREQUENT + ENDINGS
    shared = docs.sparkSession.sparkContext.broadcast((names, anchors))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, anchors = shared.value
        sums = np.zeros((size, ANCHORS + 1), np.int64)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        room = 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            keys, counts = (np.concatenate(x) for x in zip(*held))
            held.clear()
            order = np.argsort(keys, kind="stable")
            first = np.flatnonzero(np.append(True, keys[order][1:] != keys[order][:-1])) if len(keys) else np.empty(0, np.int64)
            return keys[order][first], np.add.reduceat(counts[order], first) if len(first) else counts

        for batch in batches:
            t = Tokens(batch.column(0).to_pylist())
            if not len(t.tokens):
                continue
            inner = t.tokens != END
            number = _numbers(t.tokens, names)
            second = np.where(number < FREQUENT, number, FREQUENT + t.last)
            pair = np.flatnonzero((number[:-1] < FREQUENT) & inner[1:] & (t.doc[1:] == t.doc[:-1]))
            keys, counts = np.unique((number[pair] << _KEY | second[pair + 1]).astype(np.int32), return_counts=True)
            held.append((keys, counts.astype(np.int32)))
            room += len(keys)
            if room > 1_500_000:
                held.append(merged())
                room = len(held[0][0])
                if room > 750_000:
                    yield _pair_rows(*held.pop())
                    room = 0
            doc, row = t.doc[inner], second[inner]
            anchor = _numbers(t.tokens[inner], anchors)
            hit = anchor < FREQUENT
            share = np.bincount(doc[hit] * ANCHORS + anchor[hit], minlength=batch.num_rows * ANCHORS).reshape(-1, ANCHORS)
            share = np.append(share * UNIT // np.maximum(share.sum(axis=1, keepdims=True), 1), np.ones((len(share), 1), np.int64), axis=1).astype(np.int32)
            for at in range(0, len(row), STRETCH):
                r = row[at : at + STRETCH]
                order = np.argsort(r, kind="stable")
                first = np.flatnonzero(np.append(True, r[order][1:] != r[order][:-1]))
                sums[r[order][first]] += np.add.reduceat(share[doc[at : at + STRETCH][order]], first, axis=0)
        if held:
            yield _pair_rows(*merged())
        yield from _sum_rows(sums)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((size, ANCHORS + 1), np.int64)
        for batch in batches:
            if batch.num_rows:
                x = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int64).reshape(-1, ANCHORS + 1)
                np.add.at(sums, batch.column(0).to_numpy(), x)
        yield from (b.select(["i", "sums"]) for b in _sum_rows(sums))

    gathered = saved(docs.select("text").mapInArrow(lean(add), "key int, n int, i int, sums binary"), f"{folder}/gathered")
    pairs = saved(gathered.filter("key is not null").groupBy("key").agg(F.sum("n").alias("n")), f"{folder}/pairs")
    company = gathered.filter("i is not null").select("i", "sums").repartition(shuffle_parts(docs.sparkSession), "i").mapInArrow(lean(total), "i int, sums binary")
    return pairs, company


_GATHERED = pa.schema([("key", pa.int32()), ("n", pa.int32()), ("i", pa.int32()), ("sums", pa.binary())])


def _pair_rows(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    n = len(keys)
    return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts.astype(np.int32)), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], schema=_GATHERED)


def _sum_rows(sums: np.ndarray) -> Iterator[pa.RecordBatch]:
    used = np.flatnonzero(sums[:, -1])
    for at in range(0, len(used), 4096):
        i = used[at : at + 4096]
        yield pa.RecordBatch.from_arrays([pa.nulls(len(i), pa.int32()), pa.nulls(len(i), pa.int32()), pa.array(i.astype(np.int32)), pa.array([x.tobytes() for x in sums[i]], pa.binary())], schema=_GATHERED)


def frequent_words(vocabulary: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and counts of the FREQUENT words of the greatest counts (h, c), the most frequent first."""
    end = int(np.array([END]).view(np.int64)[0])
    found = vocabulary.filter(F.col("h") != end).orderBy(F.desc("c"), "h").select("h", "c").limit(FREQUENT).collect()
    return np.array([r["h"] for r in found], np.int64).view(np.uint64), np.array([r["c"] for r in found], np.int64)


def form_classes(order: np.ndarray, company: DataFrame) -> Classes:
    """Groups of frequent words (the most frequent first), and classes of endings, by their company (i, sums)."""
    ending, names = np.zeros(ENDINGS, np.uint8), np.sort(order)
    out = np.zeros((FREQUENT + ENDINGS, ANCHORS + 1), np.int64)
    for r in company.collect():  # a row a word or ending
        out[r["i"]] = np.frombuffer(r["sums"], np.int64)
    if not len(order):
        return Classes(order, np.empty(0, np.uint8), ending)
    count = out[:, -1]
    company = out[:, :-1] / (float(UNIT) * np.maximum(count, 1)[:, None])
    frequent = np.searchsorted(names, order)
    x, weight = np.sqrt(company[frequent]), np.sqrt(count[frequent])
    centre = x[np.linspace(0, len(x) - 1, CLASSES).astype(int)].copy()
    for _ in range(15):
        d = (centre * centre).sum(1) - 2 * x @ centre.T
        near = d.argmin(axis=1)
        for k in range(CLASSES):
            m = near == k
            if m.any():
                centre[k] = np.average(x[m], axis=0, weights=weight[m])
    y = np.sqrt(company[FREQUENT:])
    ending[:] = np.where(count[FREQUENT:] > 0, ((centre * centre).sum(1) - 2 * y @ centre.T).argmin(axis=1), 0)
    of_word = np.empty(len(names), np.uint8)
    of_word[frequent] = near
    return Classes(names, of_word, ending)


@dataclass
class Pairs:
    """Weights of pairs within a class: sorted keys, their weights; and by first word and class the sum's change."""

    keys: np.ndarray
    weights: np.ndarray
    change: np.ndarray  # [FREQUENT, CLASSES + 1], a share of the class's sum

    def log_share(self, first: np.ndarray, second: np.ndarray, cls: np.ndarray) -> np.ndarray:
        """What the pair adds to the natural logarithm of a word's probability within its class."""
        out = np.zeros(len(first))
        some = np.flatnonzero(first < FREQUENT)
        if len(self.keys) and len(some):
            key = first[some] << _KEY | second[some]
            at = np.minimum(np.searchsorted(self.keys, key.astype(np.int32)), len(self.keys) - 1)
            out[some] = np.where(self.keys[at] == key, self.weights[at], 0)
        out[some] -= np.log1p(self.change[first[some], cls[some]])
        return out

    def others(self, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and keys of the pairs of frequent words that aren't held here."""
        some = np.flatnonzero((first < FREQUENT) & (second < FREQUENT))
        key = (first[some] << _KEY | second[some]).astype(np.int32)
        if len(self.keys):
            other = self.keys[np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)] != key
            some, key = some[other], key[other]
        return some, key


def learn_pairs(pairs: DataFrame, classes: Classes, count_of: np.ndarray, in_class: np.ndarray, folder: str) -> tuple[Pairs, DataFrame | None]:
    """From counts of pairs (key, n); count_of: those of the frequent words; in_class: the sum of each class.

    Returns the weights of the PAIRS most frequent pairs with the changes that all pairs make, and the weights of all
    other pairs as a table (key, x), or None if there are no others.

    The pairs of a first word and a class are learnt together.  Their objective is n log P(second | class, first) with a normal prior on weights;
    each step is the gradient over a bound of its curvature, for all pairs of a task's first words at once.
    """
    spark = pairs.sparkSession
    shared = spark.sparkContext.broadcast((classes, np.log(count_of + ALPHA), np.log(in_class)))
    # sixteen bins to each doubling of n; the best bins that hold PAIRS pairs
    level = F.floor(F.log2("n") * 16).cast("int")
    bins = pairs.filter((F.col("key").bitwiseAND(_N) < FREQUENT) & (F.col("n") > 1)).groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect()  # at most 1,024
    least, room = 0, 0
    for r in bins:
        room += r["count"]
        if room > PAIRS:
            least = r["level"] + 1
            break

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, own, sums = shared.value
        held = [(b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy(zero_copy_only=False)) for b in batches if b.num_rows]
        if not held:
            return
        key, n, often = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(key)
        key, n, often = key[order], n[order].astype(np.float64), often[order]
        first, second = key >> _KEY, key & _N
        frequent = second < FREQUENT
        of = np.where(frequent, classes.of_word[np.where(frequent, second, 0)], classes.of_ending[np.where(frequent, 0, second - FREQUENT)])
        group = first.astype(np.int64) * (CLASSES + 1) + of
        names, inv = np.unique(group, return_inverse=True)
        total = np.bincount(inv, n)
        chosen = np.flatnonzero(frequent & (n > 1))
        at, seen, word = inv[chosen], n[chosen], second[chosen]
        base = np.exp(own[word] - sums[of[chosen]])  # the word's share of its class
        theta = np.zeros(len(chosen))
        change = np.zeros(len(names))
        for _ in range(PAIR_STEPS):
            p = base * np.exp(theta) / (1 + change[at])
            mean = total[at] * p
            theta += (seen - mean - PAIR_PRIOR * theta) / (np.maximum(mean, np.minimum(seen, 2 * mean + 1)) + PAIR_PRIOR)
            np.clip(theta, -12, 12, out=theta)
            change = np.bincount(at, base * np.expm1(theta), len(names))
        yield _weight_rows(key[chosen], theta, np.where(often[chosen], _HELD, _OTHER))
        used = np.flatnonzero(np.bincount(at, minlength=len(names)))
        yield _weight_rows(names[used], change[used], np.full(len(used), _CHANGE))

    spread = pairs.repartition(shuffle_parts(spark), F.shiftright("key", _KEY)).select("key", "n", (level >= least).alias("often"))
    learnt = spread.mapInArrow(lean(learn), "key int, x float, kind int")
    if least:
        learnt = saved(learnt, f"{folder}/pair-weights")
    got = learnt.filter(F.col("kind") != _OTHER).toArrow()  # PAIRS + FREQUENT x CLASSES rows at most
    key, x, kind = (got.column(i).to_numpy() for i in range(3))
    change = np.zeros(FREQUENT * (CLASSES + 1), np.float32)
    change[key[kind == _CHANGE]] = x[kind == _CHANGE]
    key, x = key[kind == _HELD], x[kind == _HELD]
    order = np.argsort(key)
    held = Pairs(key[order], x[order], change.reshape(FREQUENT, CLASSES + 1))
    return held, learnt.filter(F.col("kind") == _OTHER).select("key", "x") if least else None


#: What a row of weights is: a pair's that all tasks hold, the change of a first word and a class, another pair's.
_HELD, _CHANGE, _OTHER = 0, 1, 2


def _weight_rows(key: np.ndarray, x: np.ndarray, kind: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(key.astype(np.int32)), pa.array(x.astype(np.float32)), pa.array(kind.astype(np.int32))], names=["key", "x", "kind"])


def feature_rows(tokens: np.ndarray, cls: np.ndarray, doc: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Of each token the combination of the last three classes, and [token, 3] rows of hashed features, by stretches."""
    for at in range(0, len(tokens), STRETCH):
        a, b = max(0, at - 3), min(at + STRETCH, len(tokens))
        combination, rows = _feature_rows(tokens[a:b], cls[a:b], doc[a:b])
        yield slice(at, b), combination[at - a :], rows[at - a :]


def _back(x: np.ndarray, doc: np.ndarray, k: int, none: int) -> np.ndarray:
    out = np.full_like(x, none)
    out[k:] = np.where(doc[k:] == doc[:-k], x[:-k], none)
    return out


def _feature_rows(tokens: np.ndarray, cls: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    w1, w2 = _back(tokens, doc, 1, 0), _back(tokens, doc, 2, 0)
    c1, c2, c3 = (_back(cls, doc, k, _C - 1) for k in (1, 2, 3))
    keys = [w1, w2, w1 * np.uint64(0x9E3779B97F4A7C15) + w2]
    rows = np.stack([(mix64(k + np.uint64(0xA24BAED4963EE407 * (i + 1) % (1 << 64))) & np.uint64(ROWS - 1)).astype(np.uint16) for i, k in enumerate(keys)], axis=1)
    return ((c1 * _C + c2) * _C + c3).astype(np.uint16), rows


@dataclass
class ClassWeights:
    """Weights of the class softmax: [1 + _C + COMBINATIONS] rows of class features, then ROWS of hashed ones."""

    table: np.ndarray

    def __post_init__(self) -> None:
        self.start()

    def start(self) -> None:
        first = np.arange(COMBINATIONS) // (_C * _C)
        own = self.table[: 1 + _C + COMBINATIONS]
        self.history = own[0] + own[1 : 1 + _C][first] + own[1 + _C :]  # a combination stands for all three
        self.hashed = self.table[1 + _C + COMBINATIONS :]

    def __getstate__(self) -> np.ndarray:
        return self.table

    def __setstate__(self, table: np.ndarray) -> None:
        self.table = table
        self.start()

    def probabilities(self, combination: np.ndarray, rows: np.ndarray) -> np.ndarray:
        out = np.empty((len(rows), CLASSES + 1), np.float32)
        for at in range(0, len(rows), STEP):
            z = self.history[combination[at : at + STEP]]
            for f in range(rows.shape[1]):
                z += self.hashed[rows[at : at + STEP, f]]
            z -= z.max(axis=1, keepdims=True)
            np.exp(z, out=z)
            z /= z.sum(axis=1, keepdims=True)
            out[at : at + STEP] = z
        return out


class Evidence:
    """What tokens say of weights: how often each class came with each feature, and how often it was expected to."""

    def __init__(self) -> None:
        k = CLASSES + 1
        self.came, self.expected = np.zeros((COMBINATIONS + ROWS) * k), np.zeros((COMBINATIONS + ROWS, k))

    def add(self, p: np.ndarray, combination: np.ndarray, rows: np.ndarray, cls: np.ndarray) -> None:
        for key, at in ((combination, 0), *((rows[:, f], COMBINATIONS) for f in range(rows.shape[1]))):
            order = np.argsort(key, kind="stable")
            sorted_ = key[order]
            first = np.flatnonzero(np.append(True, sorted_[1:] != sorted_[:-1]))
            self.expected[at + sorted_[first].astype(np.int64)] += np.add.reduceat(p[order], first, axis=0)
            np.add.at(self.came, (key.astype(np.int64) + at) * (CLASSES + 1) + cls, 1.0)

    def rows(self) -> tuple[np.ndarray, np.ndarray]:
        """[row, class] of both, by rows of ClassWeights.table."""
        out = []
        for x in (self.came.reshape(-1, CLASSES + 1), self.expected):
            own = x[:COMBINATIONS]
            by_class = own.reshape(_C, -1, CLASSES + 1).sum(axis=1)
            out.append(np.concatenate((by_class.sum(axis=0, keepdims=True), by_class, own, x[COMBINATIONS:])))
        return out[0], out[1]


PARTS = 16
_EVIDENCE = pa.schema([("part", pa.int32()), ("came", pa.binary()), ("expected", pa.binary())])


def _evidence_of(docs: DataFrame, classes, weights) -> tuple[np.ndarray, np.ndarray]:
    """The evidence of documents for weights (both are broadcast), summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, seen = Evidence(), False
        for batch in batches:
            t = Tokens(batch.column(0).to_pylist())
            if not len(t.tokens):
                continue
            cls, _ = classes.value(t.tokens, t.last)
            for part, combination, rows in feature_rows(t.tokens, cls, t.doc):
                found.add(weights.value.probabilities(combination, rows), combination, rows, cls[part])
            seen = True
        if seen:
            parts = [np.array_split(x.astype(np.float32), PARTS) for x in found.rows()]
            for i, (came, expected) in enumerate(zip(*parts)):
                yield pa.RecordBatch.from_pylist([{"part": i, "came": came.tobytes(), "expected": expected.tobytes()}], schema=_EVIDENCE)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for part, *blobs in zip(*(c.to_pylist() for c in batch.columns)):
                x = [np.frombuffer(b, np.float32) for b in blobs]
                sums[part] = [a + b for a, b in zip(sums[part], x)] if part in sums else [a.astype(np.float64) for a in x]
        for part, x in sums.items():
            yield pa.RecordBatch.from_pylist([{"part": part, "came": x[0].astype(np.float32).tobytes(), "expected": x[1].astype(np.float32).tobytes()}], schema=_EVIDENCE)

    kind = "part int, came binary, expected binary"
    parts = {r["part"]: r for r in docs.select("text").mapInArrow(lean(run), kind).repartition(PARTS, "part").mapInArrow(add, kind).collect()}  # PARTS rows
    if not parts:
        return np.zeros((0, CLASSES + 1)), np.zeros((0, CLASSES + 1))
    return tuple(np.concatenate([np.frombuffer(parts[i][c], np.float32) for i in range(PARTS)]).reshape(-1, CLASSES + 1) for c in ("came", "expected"))


def train_weights(docs: DataFrame, classes: Classes, in_class: np.ndarray) -> ClassWeights:
    """ROUNDS synchronous steps, each by the documents of a share of all texts' hashes; in_class: tokens of each class.

    A step is the gradient (how often a class came with a feature, less how often it was expected to) over a bound of
    its curvature.
    """
    spark = docs.sparkSession
    table = np.zeros((1 + _C + COMBINATIONS + ROWS, CLASSES + 1), np.float32)
    table[0] = np.log(np.maximum(in_class, ALPHA) / np.maximum(in_class, ALPHA).sum())
    known = spark.sparkContext.broadcast(classes)
    tasks = spark.sparkContext.defaultParallelism  # what a round sends back doesn't grow with the documents
    for r in range(ROUNDS):
        weights = spark.sparkContext.broadcast(ClassWeights(table))
        share = docs.filter(F.pmod(F.xxhash64(F.coalesce("text", F.lit("")), F.lit(1)), F.lit(ROUNDS)) == r)
        came, expected = _evidence_of(share.coalesce(tasks), known, weights)
        weights.unpersist()
        if len(came):
            step = RATE * (came - expected) / (np.maximum(expected, 0.5 * came) + FAITH)
            table = (table + np.clip(step, -1.5, 1.5)).astype(np.float32)
    return ClassWeights(table)


def _with_class(vocabulary: DataFrame, classes: Classes) -> DataFrame:
    shared = vocabulary.sparkSession.sparkContext.broadcast(classes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, c, last = batch.columns
            cls, _ = shared.value(h.to_numpy().view(np.uint64), last.to_numpy())
            yield pa.RecordBatch.from_arrays([h, c, pa.array(cls.astype(np.int32))], names=["h", "c", "class"])

    return vocabulary.select("h", "c", "last").mapInArrow(run, "h long, c long, class int")


def write_shards(vocabulary: DataFrame, folder: str, words: int) -> int:
    """Shards of (hash, count), by the upper bits of the hash; returns the number of those bits."""
    bits = max(1, (max(words, 1) // SHARD_WORDS).bit_length())

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        now = None

        def put() -> None:
            h, c = (np.concatenate(x) for x in zip(*held))
            files.put(f"{folder}/{now}", np.array([len(h)], "<i8").tobytes() + h.astype("<i8").tobytes() + c.astype("<i8").tobytes())
            held.clear()

        names = []
        for batch in batches:
            shard, h, c = (x.to_numpy() for x in batch.columns)
            for s in np.unique(shard):
                if held and s != now:
                    put()
                now = int(s)
                names.append(now)
                held.append((h[shard == s], c[shard == s]))
        if held:
            put()
        yield pa.RecordBatch.from_arrays([pa.array(sorted(set(names)), pa.int32())], names=["shard"])

    shard = F.shiftrightunsigned("h", 64 - bits).cast("int").alias("shard")
    rows = vocabulary.select(shard, "h", "c").repartition(min(1 << bits, 4096), "shard").sortWithinPartitions("shard", "h")
    rows.mapInArrow(write, "shard int").write.mode("overwrite").parquet(f"{folder}-written")
    return bits


_SHARDS: OrderedDict[str, tuple[np.ndarray, np.ndarray]] = OrderedDict()


def _shard(path: str) -> tuple[np.ndarray, np.ndarray]:
    if path not in _SHARDS:
        while len(_SHARDS) >= KEPT_SHARDS:
            _SHARDS.popitem(last=False)
        try:
            raw = files.get(path)
        except FileNotFoundError:  # no word has these upper bits
            raw = np.array([0], "<i8").tobytes()
        n = int(np.frombuffer(raw[:8], "<i8")[0])
        _SHARDS[path] = np.frombuffer(raw[8 : 8 + 8 * n], "<i8"), np.frombuffer(raw[8 + 8 * n :], "<i8")
    _SHARDS.move_to_end(path)
    return _SHARDS[path]


def counts_of(names: np.ndarray, folder: str, bits: int) -> np.ndarray:
    """Training counts of sorted distinct hashes."""
    out = np.zeros(len(names), np.int64)
    edge = np.searchsorted(names, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits))
    for s, (a, b) in enumerate(zip(edge, np.append(edge[1:], len(names)))):
        if a < b:
            h, c = _shard(f"{folder}/{s}")
            if len(h):
                mine = names[a:b].view(np.int64)
                at = np.minimum(np.searchsorted(h, mine), len(h) - 1)
                out[a:b] = np.where(h[at] == mine, c[at], 0)
    return out


def language_model_scores(docs: DataFrame, is_training: F.Column) -> DataFrame:
    """n_tokens, n_known, train_tokens, base_score and score of every row, learnt from rows where is_training holds.

    docs needs doc_id and text; other columns are ignored.  Null and empty texts are one token, the end.  Repeated
    rows count and are scored each.  Without training rows every word is unknown.  base_score is the sum over tokens of
    log10((c + 0.1) / (N + 0.1 * (V + 1))); score the model's log10 probability of the text and its end.
    """
    spark = docs.sparkSession
    arrow_limits(spark, BATCH_BYTES // 2)
    folder = work_dir(spark, "language-model")
    train = docs.filter(is_training)
    counted = saved(count_words(train).groupBy("h").agg(F.sum("c").alias("c"), F.min("last").alias("last")), f"{folder}/counted")
    order, often = frequent_words(counted)
    by_name = np.argsort(order)
    names = order[by_name]
    pairs, company = gather_pairs(train, names, np.sort(order[:ANCHORS]), folder)
    classes = form_classes(order, company)
    vocabulary = _with_class(counted, classes)
    per_class = {r["class"]: r for r in vocabulary.groupBy("class").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect()}
    words = sum(r["v"] for r in per_class.values())
    total = sum(r["n"] for r in per_class.values())
    tokens = np.array([per_class[k]["n"] if k in per_class else 0.0 for k in range(CLASSES + 1)])
    in_class = np.array([per_class[k]["n"] + ALPHA * (per_class[k]["v"] + 1) if k in per_class else ALPHA for k in range(CLASSES + 1)])
    bits = write_shards(vocabulary, f"{folder}/shards", words)
    shards = f"{folder}/shards"
    pair_weights, others = learn_pairs(pairs, classes, often[by_name], in_class, folder)
    is_whole = others is None
    shared = spark.sparkContext.broadcast((classes, train_weights(train, classes, tokens), pair_weights, in_class))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, weights, pair_weights, in_class = shared.value
        for batch in batches:
            t = Tokens(batch.column(2).to_pylist())
            if not batch.num_rows:
                continue
            names, first, inv = np.unique(t.tokens, return_index=True, return_inverse=True)
            c = counts_of(names, shards, bits)
            of_name, number = classes(names, t.last[first])
            cls, number = of_name[inv], number[inv]
            base = (np.log10(c + ALPHA) - np.log10(total + ALPHA * (words + 1)))[inv]
            own = (np.log10(c + ALPHA) - np.log10(in_class[of_name]))[inv]
            before = _back(number, t.doc, 1, FREQUENT)
            inner = np.flatnonzero(cls < CLASSES)
            own[inner] += pair_weights.log_share(before[inner], np.where(number < FREQUENT, number, _N)[inner], cls[inner]) * LOG10_E
            more = []
            if not is_whole:
                at, keys = pair_weights.others(before[inner], number[inner])
                ends = np.searchsorted(t.doc[inner][at], np.arange(batch.num_rows + 1)).astype(np.int32)
                more = [batch.column(3), pa.ListArray.from_arrays(pa.array(ends), pa.array(keys))]
            for part, combination, rows in feature_rows(t.tokens, cls, t.doc):
                p = weights.probabilities(combination, rows)
                own[part] += np.log10(np.maximum(p[np.arange(len(p)), cls[part]], 1e-30))
            known = np.add.reduceat((c > 0)[inv].astype(np.int64), t.begin)
            cols = [batch.column(0), batch.column(1), pa.array(t.sizes.astype(np.int64)), pa.array(known), pa.array(np.full(batch.num_rows, total, np.int64)), pa.array(np.add.reduceat(base, t.begin)), pa.array(np.add.reduceat(own, t.begin)), *more]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "row", "keys"][: len(cols)])

    rows = docs.select("doc_id", (~is_training).alias("held_out"), "text")
    result = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    if is_whole:
        return rows.mapInArrow(lean(run), result)
    # pairs that tasks don't hold: their weights are joined; whole numbers, so sums don't depend on their order
    scored = saved(rows.withColumn("row", F.monotonically_increasing_id()).mapInArrow(lean(run), f"{result}, row long, keys array<int>"), f"{folder}/scored")
    weight = others.select("key", F.round(F.col("x").cast("double") * F.lit(float(FINE))).cast("long").alias("w"))
    sums = scored.select("row", F.explode("keys").alias("key")).join(weight, "key").groupBy("row").agg(F.sum("w").alias("w"))
    score = F.col("score") + F.coalesce("w", F.lit(0)) * F.lit(LOG10_E / FINE)
    return scored.drop("keys").join(sums, "row", "left").select(*[score.alias("score") if c == "score" else F.col(c) for c in scored.columns if c not in ("row", "keys")])


def lm_query(docs: DataFrame) -> DataFrame:
    """Scores of all documents; those whose crc32(doc_id) mod 10 is 0 are held out.  A null doc_id isn't."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return language_model_scores(docs, F.coalesce(crc_of_id("doc_id") % 10 != 0, F.lit(True)))

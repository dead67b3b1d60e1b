"""Passages that documents share, found by marks of their words, aligned with patience diff, and cut from the later document.

Every stretch of ``min_words`` words has a mark, which depends on these words only (A-Z as lower case).  Marks that
several documents have name pairs of documents: each later document and the first that has the whole stretch.  The
lines of a pair (a line ends at a line break or behind a sentence's last word) are aligned; an aligned block is extended
word by word at both ends, and blocks that no whole line leads to are found by their words.  A block of ``min_words``
words is deleted from the later document.  The first document that has a stretch keeps it.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textgraph.llm.common import Words, arrow_limits, lean, mix64, powers, remove, saved, shuffle_parts, work_dir

#: Words of a block that is deleted, at least.
MIN_WORDS = 50
#: Odd factors of hashes of stretches.
_ODD = mix64(np.arange(1, 129, dtype=np.uint64)) | np.uint64(1)
_STOP = np.zeros(256, bool)
_STOP[list(b".!?")] = True


class Lines(Words):
    """line[i]: its first word; of text t, lines first_line[t] to first_line[t + 1]; line_hashes by line."""

    def __init__(self, texts: list[str | None]):
        super().__init__(texts)
        n = len(self.hashes)
        ends = np.zeros(n, bool)
        if n:
            ends = _STOP[self.data[self.ends - 1]]
            breaks = np.cumsum(self.data == 10)
            ends[:-1] |= breaks[self.starts[1:]] != breaks[self.ends[:-1]]  # a line break (or a text's end) in between
            ends[-1] = True
        opens = np.concatenate((np.ones(1, bool), ends))[:n]
        self.line = np.flatnonzero(opens)
        self.sizes = np.diff(np.append(self.line, n))
        if len(self.line):
            inside = np.arange(n) - np.repeat(self.line, self.sizes)
            self.line_hashes = mix64(np.add.reduceat(self.hashes * powers(int(self.sizes.max()))[inside], self.line) + self.sizes.astype(np.uint64))
        else:
            self.line_hashes = np.empty(0, np.uint64)
        self.first_line = np.searchsorted(self.line, self.first)


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Pairs (i, j), both ascending, with a[i] == b[j]: lines unique in both are aligned by a longest increasing
    subsequence, and the stretches between (and around) them in the same way; equal ends of a stretch match first."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        ca, cb = Counter(a[a0:a1]), Counter(b[b0:b1])
        where = {x: j for j, x in enumerate(b[b0:b1], b0) if cb[x] == 1 and ca.get(x) == 1}
        if not where:
            continue
        unique = [(i, where[x]) for i, x in enumerate(a[a0:a1], a0) if x in where]
        tops: list[int] = []  # patience piles: least last j of an increasing run of each length
        at: list[int] = []
        back: list[int] = []
        for k, (_, j) in enumerate(unique):
            p = bisect_left(tops, j)
            if p == len(tops):
                tops.append(j)
                at.append(k)
            else:
                tops[p], at[p] = j, k
            back.append(at[p - 1] if p else -1)
        chain, k = [], at[-1]
        while k >= 0:
            chain.append(unique[k])
            k = back[k]
        last = (a0, b0)
        for i, j in reversed(chain):
            out.append((i, j))
            todo.append((last[0], i, last[1], j))
            last = (i + 1, j + 1)
        todo.append((last[0], a1, last[1], b1))
    return sorted(out)


def shared_blocks(a: Lines, s: int, b: Lines, t: int, min_words: int) -> list[tuple[int, int]]:
    """Word spans of text s of a that are blocks of min_words words or more of text t of b.

    After an alignment, lines of a that are still unmatched are aligned again with all of b, so passages in another
    order and passages that a repeats are found, too.  Blocks that no whole line leads to are found by their words.
    """
    ha, hb = a.hashes[a.first[s] : a.first[s + 1]], b.hashes[b.first[t] : b.first[t + 1]]
    open_at = np.isin(_spans(ha, min_words), _spans(hb, min_words))  # where a block's words aren't in a span yet
    if not open_at.any():
        return []
    la, lb = slice(a.first_line[s], a.first_line[s + 1]), slice(b.first_line[t], b.first_line[t + 1])
    wa, wb = (a.line[la] - a.first[s]).tolist() + [len(ha)], (b.line[lb] - b.first[t]).tolist() + [len(hb)]
    xa, xb = a.line_hashes[la].tolist(), b.line_hashes[lb].tolist()
    both = set(xa) & set(xb)
    ia, ib = [i for i, x in enumerate(xa) if x in both], [j for j, x in enumerate(xb) if x in both]
    spans: list[tuple[int, int]] = []
    while ia and open_at.any():
        pairs = [(ia[p], ib[q]) for p, q in patience([xa[i] for i in ia], [xb[j] for j in ib])]
        k, new = 0, []
        while k < len(pairs):
            m = k + 1
            while m < len(pairs) and pairs[m][0] - pairs[m - 1][0] == 1 and pairs[m][1] - pairs[m - 1][1] == 1:
                m += 1
            (i0, j0), (i1, j1) = pairs[k], pairs[m - 1]
            p, q, e, f = wa[i0], wb[j0], wa[i1 + 1], wb[j1 + 1]
            while p and q and ha[p - 1] == hb[q - 1]:
                p, q = p - 1, q - 1
            while e < len(ha) and f < len(hb) and ha[e] == hb[f]:
                e, f = e + 1, f + 1
            if e - p >= min_words:
                new.append((p, e))
                open_at[p : e - min_words + 1] = False
            k = m
        if not new:
            break
        spans += new
        used = {i for i, _ in pairs}
        ia = [i for i in ia if i not in used]
    return spans + merged([(p, p + min_words) for p in np.flatnonzero(open_at).tolist()])


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without these spans of words; a line break or a space stays where words remain on both sides."""
    raw = text.encode("utf-8", "surrogatepass")
    w = Words([text])
    n, parts, at = len(w.starts), [], 0
    for a, b in spans:
        left, right = int(w.ends[a - 1]) if a else 0, int(w.starts[b]) if b < n else len(raw)
        parts.append(raw[at:left])
        if a and b < n:
            gap = raw[left : int(w.starts[a])] + raw[int(w.ends[b - 1]) : right]
            parts.append(b"\n" if b"\n" in gap else b" ")
        at = right
    parts.append(raw[at:])
    return b"".join(parts).decode("utf-8", "surrogatepass")


def _spans(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of h[i : i + k], for each i that has k values."""
    if len(h) < k:
        return np.empty(0, np.uint64)
    out, size = h, 1
    for level, bit in enumerate(bin(k)[3:]):
        out, size = out[: len(out) - size] * _ODD[2 * level] + out[size:], 2 * size
        if bit == "1":
            out, size = out[:-1] * _ODD[2 * level + 1] + h[size:], size + 1
    return mix64(out)


def _least(x: np.ndarray, k: int) -> np.ndarray:
    """The least of x[i : i + k], for each i that has k values."""
    size = 1
    while 2 * size <= k:
        x, size = np.minimum(x[: len(x) - size], x[size:]), 2 * size
    return np.minimum(x[: len(x) - (k - size)], x[k - size :])


def window_marks(w: Words, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, mark) of each stretch of min_words words: of the stretches of just over half as many words in
    it, the least hash.  Equal stretches have equal marks, wherever they stand."""
    k = min_words // 2 + 1
    n = len(w.hashes) - min_words + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    marks = _least(_spans(w.hashes, k), min_words - k + 1)
    doc = np.repeat(np.arange(len(w.first) - 1), np.diff(w.first))[:n]
    at = np.flatnonzero(w.first[doc + 1] - np.arange(n) >= min_words)
    return doc[at], at, marks[at]


def _distinct(doc: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((x, doc))
    doc, x = doc[order], x[order]
    new = np.ones(len(x), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (x[1:] != x[:-1])
    return doc[new], x[new]


def _hash_rows(ids: pa.Array, doc: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), ids.take(pa.array(doc))], names=["h", "doc"])


def document_pairs(docs: DataFrame, min_words: int, folder: str) -> DataFrame:
    """(doc, first): later documents and, for each min_words words that an earlier one has, the first that has them.

    Marks (see window_marks) that one document has can't lie in shared words.  Where two have a mark, they are a pair.
    Where more have it, the first of them needn't have all min_words words, so each stretch of that mark names its own
    first document.
    """
    rows = docs.filter("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc"), "text")

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, _, x = window_marks(Words(batch.column(1).to_pylist()), min_words)
            change = np.ones(len(x), bool)
            change[1:] = (doc[1:] != doc[:-1]) | (x[1:] != x[:-1])
            yield _hash_rows(batch.column(0), *_distinct(doc[change], x[change]))

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = Words(batch.column(1).to_pylist())
            doc, at, x = window_marks(w, min_words)
            hit = crowded.value.may_hold(x)
            yield _hash_rows(batch.column(0), *_distinct(doc[hit], _spans(w.hashes, min_words)[at[hit]]))

    held = saved(rows.mapInArrow(lean(marks), "h long, doc long"), f"{folder}/marks")
    shared = held.groupBy("h").agg(F.min("doc").alias("first"), F.max("doc").alias("last"), F.count("*").alias("n")).filter("first < last")
    shared = saved(shared, f"{folder}/shared")
    two = shared.filter("n = 2").select(F.col("last").alias("doc"), "first").distinct()
    # a mark that the filter lets pass by chance adds stretches, of which those of one document go below
    crowded = docs.sparkSession.sparkContext.broadcast(likely(shared.filter("n > 2").select("h")))
    wanted = saved(rows.mapInArrow(lean(stretches), "h long, doc long"), f"{folder}/stretches")
    firsts = wanted.groupBy("h").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).filter("first < last").select("h", "first")
    more = wanted.join(firsts, "h").filter("first < doc").select("doc", "first").distinct()
    return two.unionByName(more).distinct()


#: Bits of a filter, at most (16 MB), bits for each of its values if there is room, and tasks that make it.
FILTER_BITS, BITS_EACH, FILTER_PARTS = 1 << 27, 12, 16


class Likely:
    """A Bloom filter of 64-bit integers: holds all its values, and a few others by chance (the more, the fuller it is)."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits
        self.mask = np.uint64(8 * len(bits) - 1)

    @staticmethod
    def places(x: np.ndarray, mask: np.uint64) -> Iterator[np.ndarray]:
        h = mix64(x.astype(np.uint64) ^ _ODD[7])
        step = (h >> np.uint64(32)) | np.uint64(1)
        for i in range(4):
            yield ((h + np.uint64(i) * step) & mask).astype(np.int64)

    def may_hold(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for at in self.places(x, self.mask):
            out &= (self.bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
        return out


def likely(values: DataFrame) -> Likely:
    """The filter of a table of one column of longs, made by FILTER_PARTS tasks; the driver gets it whole (see FILTER_BITS)."""
    size = min(FILTER_BITS, max(1 << 12, 1 << int(values.count() * BITS_EACH).bit_length()))
    share = size // FILTER_PARTS

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(0).to_numpy().view(np.uint64)
            at = np.unique(np.concatenate(list(Likely.places(x, np.uint64(size - 1)))))
            yield pa.RecordBatch.from_arrays([pa.array((at // share).astype(np.int32)), pa.array((at % share).astype(np.int32))], names=["part", "at"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits: dict[int, np.ndarray] = {}
        for batch in batches:
            part, at = (c.to_numpy() for c in batch.columns)
            for i in np.unique(part).tolist():
                mine = bits.setdefault(i, np.zeros(share // 8, np.uint8))
                np.bitwise_or.at(mine, at[part == i] >> 3, np.uint8(1) << (at[part == i] & 7).astype(np.uint8))
        for i, mine in bits.items():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([mine.tobytes()], pa.binary())], names=["part", "bits"])

    found = {r["part"]: r["bits"] for r in values.mapInArrow(spread, "part int, at int").repartition(FILTER_PARTS, "part").mapInArrow(gather, "part int, bits binary").collect()}
    return Likely(np.concatenate([np.frombuffer(found.get(i, bytes(share // 8)), np.uint8) for i in range(FILTER_PARTS)]))


def shared_passages(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Documents that lose words: doc_id, of (hash of the row's text), removed_words, sources (earlier ids), text.

    docs needs doc_id and text; other columns are ignored.  Rows without an id or a text take no part.  Rows of equal
    doc_id aren't compared with each other; each is aligned with all rows of an earlier id.  Whole copies lose all
    their words.  Common short lines alone change nothing, and an empty table gives an empty result.
    """
    spark = docs.sparkSession
    arrow_limits(spark)
    folder = work_dir(spark, "line-dedup")
    pairs = saved(document_pairs(docs, min_words, folder), f"{folder}/pairs").filter("first < doc")
    remove(spark, *(f"{folder}/{x}" for x in ("marks", "shared", "stretches")))
    rows = docs.filter("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # texts of no pair (but a few that the filter lets pass) are shuffled by no step
    some = _of_ids(rows, pairs.select(F.explode(F.array("doc", "first")).alias("doc_id"))).withColumn("of", F.xxhash64("text"))
    few = saved(some.select("doc_id", "of", "text"), f"{folder}/texts")
    found = saved(_aligned(pairs, _once(few), min_words), f"{folder}/spans")
    spans = found.groupBy("doc_id").agg(F.collect_list(F.struct("of", "source", "spans")).alias("found"))
    cut = _once(_of_ids(few, found.select("doc_id"))).join(spans, "doc_id").select("doc_id", "of", "found", "text")

    def delete(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                mine = [x for x in row["found"] if x["of"] == row["of"]]
                if mine:
                    gone = merged([(y["a"], y["b"]) for x in mine for y in x["spans"]])
                    out.append({"doc_id": row["doc_id"], "of": row["of"], "removed_words": sum(b - a for a, b in gone), "sources": sorted({x["source"] for x in mine}), "text": without(row["text"], gone)})
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=_CUT)

    return saved(cut.mapInArrow(lean(delete), "doc_id long, of long, removed_words long, sources array<long>, text string"), f"{folder}/cut")


def _of_ids(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose doc_id is one of ids (a column doc_id), and a few others; nothing is shuffled for it."""
    wanted = rows.sparkSession.sparkContext.broadcast(likely(ids.distinct()))
    at = rows.columns.index("doc_id")

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(wanted.value.may_hold(batch.column(at).to_numpy().view(np.uint64))))

    return rows.mapInArrow(lean(pick), rows.schema)


def _once(texts: DataFrame) -> DataFrame:
    """Each doc_id, of and text once, dealt by doc_id: a join by doc_id alone shuffles no text again."""
    return texts.repartition(shuffle_parts(texts.sparkSession), "doc_id").dropDuplicates(["doc_id", "of"])


_CUT = pa.schema([("doc_id", pa.int64()), ("of", pa.int64()), ("removed_words", pa.int64()), ("sources", pa.list_(pa.int64())), ("text", pa.string())])
_SPANS = pa.schema([("doc_id", pa.int64()), ("of", pa.int64()), ("source", pa.int64()), ("spans", pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))])
#: Pairs of a document that one task aligns, about.
GROUP_PAIRS = 4096


def _aligned(pairs: DataFrame, texts: DataFrame, min_words: int) -> DataFrame:
    """doc_id, of, source, spans: what the alignment of each pair (doc, first) finds in the later document.

    texts: doc_id, of, text of all documents of pairs, each once, dealt by doc_id.  They are joined once, with the tasks
    that each is wanted in, and then shuffled to these.

    Of each pair, the document that is in more pairs is sent once, to the tasks of its pairs, and the other to it.  So a
    passage that many documents share doesn't copy its first document for each, nor a compilation itself for each source.
    """
    spark = pairs.sparkSession
    in_first = pairs.groupBy("first").agg(F.count(F.lit(1)).alias("n"))
    in_doc = pairs.groupBy("doc").agg(F.count(F.lit(1)).alias("m"))
    by_first = F.col("n") >= F.col("m")
    met = pairs.join(in_first, "first").join(in_doc, "doc")
    met = met.select(F.when(by_first, F.col("first")).otherwise(F.col("doc")).alias("own"), F.when(by_first, F.col("doc")).otherwise(F.col("first")).alias("other"), F.ceil(F.greatest("n", "m") / GROUP_PAIRS).cast("int").alias("parts"))
    owners = met.groupBy("own").agg(F.max("parts").alias("parts"))
    held = owners.select(F.col("own").alias("doc_id"), "own", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("other"))
    # at most one owner for GROUP_PAIRS pairs has more than one task
    many = F.broadcast(owners.filter("parts > 1").select("own", F.col("parts").alias("all")))
    sent = met.join(many, "own", "left").select(F.col("other").alias("doc_id"), "own", F.pmod(F.xxhash64("other"), F.coalesce("all", F.lit(1))).cast("int").alias("part"), "other")
    both = texts.join(held.unionByName(sent), "doc_id").select("own", "part", "other", "of", "text").repartition(shuffle_parts(spark), "own", "part").sortWithinPartitions("own", "part", F.col("other").asc_nulls_first(), "of")

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, mine = None, []
        for batch in batches:
            out = []
            for own, part, other, of, text in zip(*(c.to_pylist() for c in batch.columns)):
                if (own, part) != key:
                    key, mine = (own, part), []
                if other is None:
                    mine.append((of, Lines([text])))
                    continue
                lines = Lines([text])
                for own_of, own_lines in mine:
                    (doc, doc_of, later), (first, _, earlier) = sorted(((own, own_of, own_lines), (other, of, lines)), key=lambda x: -x[0])
                    spans = shared_blocks(later, 0, earlier, 0, min_words)
                    if spans:
                        out.append({"doc_id": doc, "of": doc_of, "source": first, "spans": [{"a": int(a), "b": int(b)} for a, b in spans]})
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=_SPANS)

    return both.mapInArrow(lean(align), "doc_id long, of long, source long, spans array<struct<a: int, b: int>>")


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with the shared passages cut from their texts; rows that lose all their words go.  All columns stay."""
    cut = shared_passages(docs, min_words).select(F.col("doc_id").alias("_id"), F.col("of").alias("_of"), F.col("text").alias("_text"))
    joined = docs.join(cut, (F.col("doc_id") == F.col("_id")) & (F.xxhash64("text") == F.col("_of")), "left")
    kept = joined.filter(F.col("_text").isNull() | F.col("_text").rlike(r"[^\x20\x09-\x0D]"))
    return kept.select(*[F.coalesce("_text", "text").alias("text") if c == "text" else F.col(c) for c in docs.columns])


def line_dedup_digest(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """One row per row of docs: doc_id, removed_words, sources, text_crc32 (of the text that stays), kept."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    every = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("of"), F.crc32(text).alias("old"))
    cut = shared_passages(docs, min_words).select("doc_id", "of", "removed_words", "sources", F.crc32(F.col("text").cast("binary")).alias("new"), F.col("text").rlike(r"[^\x20\x09-\x0D]").alias("left"))
    joined = every.join(cut, ["doc_id", "of"], "left")
    return joined.select("doc_id", F.coalesce("removed_words", F.lit(0)).alias("removed_words"), F.coalesce("sources", F.array().cast("array<long>")).alias("sources"), F.coalesce("new", "old").alias("text_crc32"), F.coalesce("left", F.lit(True)).alias("kept"))

"""SentencePiece encoding by suffix-array matching: all occurrences of all pieces in a batch, then relaxation.

The distinct words of a batch are joined to one text, whose suffixes are sorted (up to the longest piece).  Every
piece is binary-searched for its range of suffixes, so each of its occurrences is an edge between two positions.  The
edges, sorted by position, are relaxed word by word.  The public model is of the BPE kind, where the result isn't the
path of the best sum but that of merges in order of rank: relaxation joins, again and again, the two neighbouring
symbols whose edge has the best rank (leftmost first), in all words at once.  Characters without a piece become the
byte pieces of their UTF-8.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textgraph.llm.common import arrow_limits, lean
from textgraph.llm.wordmemo import Memo

SPACE = "▁"
#: Bytes of joined words that are indexed at a time, and distinct words that are remembered.
INDEX_BYTES, MEMO_WORDS = 1 << 20, 1_500_000
#: Bytes of text taken at a time.
TEXT_BYTES = 2 << 20
#: Bytes up to which suffixes are sorted; the rest of longer pieces is compared where their openings occur.
DEPTH = 16
#: Words of more symbols than this are relaxed one by one with a heap.
LONG_WORD = 256
#: Bits of an edge's key that hold its length; pieces must be shorter than all ones.
SIZE_BITS = 10
MOST_BYTES = (1 << SIZE_BITS) - 1
_NONE = np.int64(1) << 40


class Pieces(Memo):
    """A model's pieces, as bytes, with ranks and ids."""

    room = MEMO_WORDS

    def __init__(self, path: str):
        super().__init__()
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.normalizer = sentencepiece.SentencePieceNormalizer(model_file=path)
        n = self.sp.get_piece_size()
        usable = [i for i in range(n) if not (self.sp.is_control(i) or self.sp.is_unknown(i) or self.sp.is_byte(i) or self.sp.is_unused(i))]
        text = [self.sp.id_to_piece(i) for i in usable]
        if any(SPACE in p.lstrip(SPACE) for p in text):
            raise ValueError("a piece holds a space behind other characters: words can't be encoded on their own")
        self.raw = [p.encode() for p in text]
        if max(map(len, self.raw), default=0) >= MOST_BYTES:
            raise ValueError(f"a piece of {MOST_BYTES} bytes or more")
        self.ids = np.array(usable, np.int64)
        # the best score first; of equal scores the smaller id
        order = np.lexsort((self.ids, -np.array([self.sp.get_score(i) for i in usable])))
        self.rank = np.empty(len(usable), np.int64)
        self.rank[order] = np.arange(len(usable))
        self.by_rank = self.ids[order]
        self.sizes = np.array([len(r) for r in self.raw], np.int64)
        # what each id says when it is decoded
        said = [b"" if self.sp.is_control(i) else " \u2047 ".encode() if self.sp.is_unknown(i) else bytes([int(self.sp.id_to_piece(i)[3:5], 16)]) if self.sp.is_byte(i) else self.sp.id_to_piece(i).replace(SPACE, " ").encode() for i in range(n)]
        self.said, self.said_size = np.frombuffer(b"".join(said), np.uint8), np.array([len(x) for x in said], np.int64)
        self.said_start = np.cumsum(self.said_size) - self.said_size
        self.bytes = {b: self.sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)}
        joined, begin = np.frombuffer(b"".join(self.raw), np.uint8), np.cumsum(self.sizes) - self.sizes
        self.keys, self.top = (self._keys(joined, begin, self.sizes, fill) for fill in (0, 255))

    @staticmethod
    def _keys(data: np.ndarray, at: np.ndarray, sizes: np.ndarray, fill: int = 0) -> list[np.ndarray]:
        """The next DEPTH bytes from each position as big-endian words, with ``fill`` behind the given sizes."""
        out = []
        for w in range(0, DEPTH, 8):
            key = np.zeros(len(at), np.uint64)
            for j in range(w, w + 8):
                inside = j < sizes
                byte = np.where(inside, data[np.minimum(at + j, len(data) - 1)], fill).astype(np.uint64)
                key = (key << np.uint64(8)) | byte
            out.append(key)
        return out

    def edges(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sorted keys position * 64 + length of all occurrences of all pieces in data, and their ranks."""
        at = np.arange(len(data), dtype=np.int64)
        suffix = self._keys(data, at, len(data) - at)
        order = np.lexsort(suffix[::-1])
        suffix = [k[order] for k in suffix]

        def search(keys: list[np.ndarray], right: bool) -> np.ndarray:
            lo, hi = np.zeros(len(keys[0]), np.int64), np.full(len(keys[0]), len(order), np.int64)
            while (open_ := lo < hi).any():
                mid = np.minimum((lo + hi) >> 1, len(order) - 1)
                less, same = np.zeros(len(mid), bool), np.ones(len(mid), bool)
                for s, k in zip(suffix, keys):
                    here = s[mid]
                    less |= same & (here < k)
                    same &= here == k
                if right:
                    less |= same
                lo, hi = np.where(open_ & less, mid + 1, lo), np.where(open_ & ~less, mid, hi)
            return lo

        first, last = search(self.keys, False), search(self.top, True)
        count = last - first
        piece = np.repeat(np.arange(len(count)), count)
        inside = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        start = order[np.repeat(first, count) + inside]
        for i in np.flatnonzero(self.sizes[piece] > DEPTH):  # few pieces are longer
            if data[start[i] : start[i] + self.sizes[piece[i]]].tobytes() != self.raw[piece[i]]:
                piece[i] = -1
        start, piece = start[piece >= 0], piece[piece >= 0]
        key = (start << SIZE_BITS) | self.sizes[piece]
        by = np.argsort(key, kind="stable")
        return key[by], self.rank[piece][by]

    def _relax(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words (with spaces as their mark), none empty, and the numbers of them by word."""
        raw = [w.encode("utf-8", "replace") for w in words]
        data = np.frombuffer(b"\x00".join(raw) + b"\x00", np.uint8)  # no piece holds a NUL
        keys, ranks = self.edges(data)
        ends = np.cumsum([len(r) + 1 for r in raw]) - 1
        char = ((data & 0xC0) != 0x80) & (data != 0)
        char[np.flatnonzero(data == 0)] = False
        left = np.flatnonzero(char)
        # a NUL within a word counts as a character, those between words don't
        inner = np.flatnonzero(data == 0)
        inner = inner[~np.isin(inner, ends)]
        left = np.sort(np.concatenate((left, inner)))
        word = np.searchsorted(ends, left, side="right")
        final = np.append(left[1:], 0)
        last = np.append(word[1:] != word[:-1], True)
        right = np.where(last, ends[word], final)

        def rank_of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            size = b - a
            k = (a << SIZE_BITS) | np.minimum(size, MOST_BYTES)
            p = np.minimum(np.searchsorted(keys, k), len(keys) - 1) if len(keys) else np.zeros(len(k), np.int64)
            if not len(keys):
                return np.full(len(k), _NONE)
            return np.where((keys[p] == k) & (size < MOST_BYTES), ranks[p], _NONE)

        done_left, done_right, done_word = [], [], []
        while len(left):
            joined = np.full(len(left), _NONE)
            pair = np.flatnonzero(~last)
            joined[pair] = rank_of(left[pair], right[pair + 1])
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            best = np.minimum.reduceat(joined, first)
            sizes = np.diff(first, append=len(left))
            each = np.repeat(best, sizes)
            still = each < _NONE
            if not still.all():
                done_left.append(left[~still])
                done_right.append(right[~still])
                done_word.append(word[~still])
                left, right, word, last, joined, each = (x[still] for x in (left, right, word, last, joined, each))
                if not len(left):
                    break
            hit = joined == each
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            # of equal ranks the leftmost merges; the next equal one may overlap it, and waits for the next round
            order = np.cumsum(hit) - np.repeat(np.cumsum(hit)[first] - hit[first], np.diff(first, append=len(left)))
            merge = np.flatnonzero(hit & (order == 1))
            right[merge] = right[merge + 1]
            last[merge] = last[merge + 1]
            keep = np.ones(len(left), bool)
            keep[merge + 1] = False
            left, right, word, last = left[keep], right[keep], word[keep], last[keep]
        a, b, of = (np.concatenate([*x, np.empty(0, np.int64)]).astype(np.int64) for x in (done_left, done_right, done_word))
        by = np.argsort(a, kind="stable")
        a, b, of = a[by], b[by], of[by]
        r = rank_of(a, b)
        ids = np.where(r < _NONE, self.by_rank[np.minimum(r, len(self.by_rank) - 1)], -1)
        width = np.where(ids >= 0, 1, b - a)
        at = np.cumsum(width) - width
        flat = np.empty(int(width.sum()), np.int64)
        flat[at[ids >= 0]] = ids[ids >= 0]
        for j in np.flatnonzero(ids < 0):
            flat[at[j] : at[j] + width[j]] = [self.bytes[c] for c in data[a[j] : b[j]].tolist()]
        return flat, np.bincount(of, width, len(words)).astype(np.int64)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text (null: none), as the model's own library gives them."""
        raw = [self.normalizer.normalize(t).encode() if t else b"" for t in texts]
        out, at = [], 0
        while at < len(raw):
            upto, size = at, 0
            while upto < len(raw) and (size < TEXT_BYTES or upto == at):
                size += len(raw[upto])
                upto += 1
            out += [x.astype(np.int32) for x in self.ids_of(raw[at:upto])]
            at = upto
        return out

    def cuts(self, data: np.ndarray, texts: np.ndarray) -> np.ndarray:
        """A word begins at each mark of a space that doesn't follow another."""
        mark = np.zeros(len(data) + 3, bool)
        a, b, c = SPACE.encode()
        mark[3 : len(data) + 1] = (data[:-2] == a) & (data[1:-1] == b) & (data[2:] == c) if len(data) > 2 else False
        cut = mark[3:] & ~mark[:-3]
        cut[texts[texts < len(data)]] = True
        return np.flatnonzero(cut)

    def learn(self, fresh: list[str], hashes: np.ndarray) -> None:
        at = 0
        while at < len(fresh):
            upto, size = at, 0
            while upto < len(fresh) and (size < INDEX_BYTES or upto == at):
                size += len(fresh[upto]) + 1
                upto += 1
            short = [i for i in range(at, upto) if len(fresh[i]) <= LONG_WORD]
            if short:
                self.remember(hashes[short], *self._relax([fresh[i] for i in short]))
            for i in range(at, upto):
                if len(fresh[i]) > LONG_WORD:
                    ids = self._long(fresh[i])
                    self.remember(hashes[i : i + 1], ids, np.array([len(ids)]))
            at = upto

    def _long(self, word: str) -> np.ndarray:
        """One word of many symbols: the same merges, from a heap."""
        import heapq

        raw = word.encode("utf-8", "replace")
        data = np.frombuffer(raw, np.uint8)
        keys, ranks = self.edges(data)
        rank = dict(zip(keys.tolist(), ranks.tolist()))
        start = np.flatnonzero((data & 0xC0) != 0x80).tolist()
        n = len(start)
        end = start[1:] + [len(raw)]
        nxt, prev, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap: list[tuple[int, int, int]] = []

        def push(i: int) -> None:
            j = nxt[i]
            if j < n and end[j] - start[i] < MOST_BYTES and (r := rank.get(start[i] << SIZE_BITS | end[j] - start[i])) is not None:
                heapq.heappush(heap, (r, i, end[j]))

        for i in range(n - 1):
            push(i)
        while heap:
            _, i, e = heapq.heappop(heap)
            j = nxt[i]
            if not alive[i] or j >= n or end[j] != e or start[j] != end[i]:
                continue
            end[i], alive[j], nxt[i] = e, False, nxt[j]
            if nxt[j] < n:
                prev[nxt[j]] = i
            push(i)
            if prev[i] >= 0:
                push(prev[i])
        out: list[int] = []
        for i in range(n):
            if alive[i]:
                r = rank.get(start[i] << SIZE_BITS | end[i] - start[i])
                out += [int(self.by_rank[r])] if r is not None else [self.bytes[c] for c in raw[start[i] : end[i]]]
        return np.array(out, np.int32)

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        """The texts of lists of ids: pieces joined, byte pieces as UTF-8, marks as spaces, the added first space gone.

        Control pieces are nothing; bytes that aren't UTF-8 become replacement characters.
        """
        flat = np.concatenate([*ids, np.empty(0, np.int32)]).astype(np.int64)
        size = self.said_size[flat]
        ends = np.cumsum(size)
        data = self.said[np.arange(int(size.sum())) + np.repeat(self.said_start[flat] - ends + size, size)].tobytes()
        cut = np.concatenate(([0], ends))[np.cumsum([0] + [len(x) for x in ids])].tolist()
        return [data[a + (data[a : a + 1] == b" ") : b].decode("utf-8", "replace") for a, b in zip(cut[:-1], cut[1:])]


_PIECES: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    if path not in _PIECES:
        _PIECES[path] = Pieces(path)
    return _PIECES[path]


def encode_pieces(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, ids (array of int) and decoded (the text those ids give) of every row.

    docs needs doc_id and text; other columns are ignored.  Null and empty texts have no ids and decode to an empty
    text; repeated rows and rows without an id are encoded each.
    """
    arrow_limits(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(model)
        for batch in batches:
            ids = p.encode(batch.column(1).to_pylist())
            sizes = np.cumsum([0] + [len(x) for x in ids])
            flat = pa.array(np.concatenate([*ids, np.empty(0, np.int32)]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), flat), pa.array(p.decode(ids), pa.string())], names=["doc_id", "ids", "decoded"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(run), "doc_id long, ids array<int>, decoded string")


def pieces_digest(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_pieces, ids_hash (xxhash64 of the ids), text_crc32 (of the decoded text)."""
    return encode_pieces(docs, model).select("doc_id", F.size("ids").cast("long").alias("n_pieces"), F.xxhash64("ids").alias("ids_hash"), F.crc32(F.col("decoded").cast("binary")).alias("text_crc32"))

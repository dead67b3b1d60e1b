"""Whole-text encoding with a tokenizers file, where each distinct stretch of text is encoded once.

Both supported files cut a text before a space or line break that follows a non-space, and before a comma or full stop
that follows a letter or digit: no pre-token reaches over such a place, and none looks beyond it.  So the ids of a text
are those of the stretches between these places, one after another, and the library is asked for a stretch only when
it is new.  Places and stretches are found in numpy over the texts' bytes; stretches are told apart by 64-bit hashes.
Texts that may hold a special token go to the library as a whole.
"""

from __future__ import annotations

import os
from itertools import chain

import numpy as np

from textgraph.llm.common import span_hashes

#: Stretches remembered at most; beyond that the memory starts anew.
MEMO_WORDS = 1_000_000
#: Characters of text taken at a time, stretches encoded at a time, and joined to one call of the library.
CHARS, LEARN, JOINED = 1_500_000, 16_384, 64
MARK = "\ue000"

#: What a byte may be a cut behind, and what it may be a cut before: bit 0 (blanks behind ASCII that is no white space)
#: and bit 1 (points behind ASCII letters and digits).
_BEHIND, _BEFORE = np.zeros(256, np.uint8), np.zeros(256, np.uint8)
_BEHIND[0x21:0x7F] |= 1
_BEHIND[[*range(48, 58), *range(65, 91), *range(97, 123)]] |= 2
_BEFORE[[0x20, 0x0A]] = 1
_BEFORE[[0x2C, 0x2E]] = 2


def stretches(data: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Where stretches begin, given the bytes of joined texts and where these begin.

    After bytes of other characters a cut needs proof: no Unicode white space before a blank, and a letter of the
    Latin-1 block before a point.
    """
    cut = np.zeros(len(data), bool)
    may, before = _BEFORE[data[1:]], data[:-1]
    np.not_equal(_BEHIND[before] & may, 0, out=cut[1:])
    high = np.flatnonzero((before >= 0x80) & (may != 0)) + 1
    if len(high):
        b1, b2, b3 = (data[np.maximum(high - k, 0)] for k in (1, 2, 3))
        white = (b2 == 0xC2) & ((b1 == 0x85) | (b1 == 0xA0))
        white |= (b3 == 0xE1) & (b2 == 0x9A) | (b3 == 0xE2) & ((b2 == 0x80) | (b2 == 0x81)) | (b3 == 0xE3) & (b2 == 0x80)
        letter = (b2 == 0xC3) & (b1 != 0x97) & (b1 != 0xB7)
        cut[high] = np.where(_BEFORE[data[high]] == 1, ~white, letter)
    cut[texts[texts < len(data)]] = True
    return np.flatnonzero(cut)


class HashIndex:
    """Numbers of 64-bit hashes in an open table; many are looked up at once."""

    def __init__(self, room: int):
        self.mask = (1 << (2 * room - 1).bit_length()) - 1
        self.keys, self.values, self.used = np.zeros(self.mask + 1, np.uint64), np.zeros(self.mask + 1, np.int32), 0

    def find(self, h: np.ndarray) -> np.ndarray:
        """-1 for those that aren't there."""
        out = np.full(len(h), -1, np.int32)
        at, left = (h & np.uint64(self.mask)).astype(np.int64), np.arange(len(h))
        while len(left):
            k = self.keys[at]
            hit = k == h[left]
            out[left[hit]] = self.values[at[hit]]
            on = np.flatnonzero(~hit & (k != 0))
            left, at = left[on], (at[on] + 1) & self.mask
        return out

    def add(self, h: np.ndarray, values: np.ndarray) -> None:
        """Distinct hashes that aren't there."""
        at, left = (h & np.uint64(self.mask)).astype(np.int64), np.arange(len(h))
        self.used += len(h)
        while len(left):
            free = np.flatnonzero(self.keys[at] == 0)
            slot, first = np.unique(at[free], return_index=True)
            put = free[first]
            self.keys[slot], self.values[slot] = h[left[put]], values[left[put]]
            rest = np.ones(len(left), bool)
            rest[put] = False
            left, at = left[rest], (at[rest] + 1) & self.mask


class WordStore:
    """Ids of words, each word's in one stretch of a flat array."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.flat, self.used, self.words = np.zeros(1 << 16, np.uint32), 0, 0
        self.start, self.size = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32)

    def put(self, flat: np.ndarray, sizes: np.ndarray) -> range:
        """Adds words of these ids and sizes; returns their numbers."""
        n, k, total = len(sizes), self.words, len(flat)
        while self.used + total > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
        while k + n > len(self.start):
            self.start, self.size = (np.concatenate((a, np.zeros_like(a))) for a in (self.start, self.size))
        self.flat[self.used : self.used + total] = flat
        self.start[k : k + n], self.size[k : k + n] = self.used + np.cumsum(sizes) - sizes, sizes
        self.used += total
        self.words += n
        return range(k, k + n)

    def gather(self, k: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
        """The ids of texts of counts[i] words each, whose words have the numbers k."""
        sizes = self.size[k].astype(np.int64)
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.flat[np.arange(total, dtype=np.int64) + np.repeat(self.start[k] - ends + sizes, sizes)]
        cut = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(counts)))]
        return [ids[a:b] for a, b in zip(cut[:-1], cut[1:])]


class Memo:
    """Ids of stretches of text by their hashes; subclasses say where stretches begin and learn new ones."""

    room = MEMO_WORDS

    def __init__(self) -> None:
        self.store, self.index = WordStore(), HashIndex(self.room)

    def cuts(self, data: np.ndarray, texts: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def learn(self, keys: list[str], hashes: np.ndarray) -> None:
        raise NotImplementedError

    def remember(self, hashes: np.ndarray, flat: np.ndarray, sizes: np.ndarray) -> None:
        self.index.add(hashes, np.array(self.store.put(flat, sizes)))

    def ids_of(self, raw: list[bytes]) -> list[np.ndarray]:
        """The ids of each text, given as bytes."""
        data = np.frombuffer(b"".join(raw), np.uint8)
        if not len(data):
            return [np.empty(0, np.uint32)] * len(raw)
        begin = np.cumsum([0] + [len(r) for r in raw])
        starts = self.cuts(data, begin[:-1])
        ends = np.append(starts[1:], len(data))
        h = span_hashes(data, starts, ends)
        h[h == 0] = 1
        k = self.index.find(h)
        new = np.flatnonzero(k < 0)
        if len(new):
            if self.index.used + len(new) > self.room:
                self.store.clear()
                self.index = HashIndex(max(self.room, 2 * len(h)))
                new = np.arange(len(h))
            fresh, first = np.unique(h[new], return_index=True)
            at = new[first]
            self.learn([data[s:e].tobytes().decode() for s, e in zip(starts[at], ends[at])], fresh)
            k[new] = self.index.find(h[new])
        return self.store.gather(k, np.diff(np.searchsorted(starts, begin)))


class Encoder(Memo):
    """kind: "byte" (spaces belong to the following word) or "word" (white space is dropped)."""

    def __init__(self, path: str, kind: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__()
        self.tok, self.kind = Tokenizer.from_file(path), kind
        if kind == "byte":
            vocab = self.tok.get_vocab()
            self.opens = np.zeros(max(vocab.values()) + 1, bool)
            self.opens[[i for w, i in vocab.items() if w[:1] == "Ġ"]] = True
        else:
            self.mark = self.tok.encode(MARK, add_special_tokens=False).ids

    def _one_by_one(self, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for e in self.tok.encode_batch(keys, add_special_tokens=False)]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), np.uint32, int(sizes.sum())), sizes

    def _joined(self, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and sizes of many words from few calls, each over words that are joined and told apart afterwards.

        "byte": one space opens each word, and only first tokens hold one.  "word": a private-use character stands
        between words, as a word of its own.  Where they can't be told apart, they are encoded one by one.
        """
        step = range(0, len(keys), JOINED)
        if self.kind == "byte":
            runs = ["".join(keys[i : i + JOINED]) for i in step]
        else:
            runs = [f" {MARK} ".join([*keys[i : i + JOINED], ""]) for i in step]
        flat = np.fromiter(chain.from_iterable(e.ids for e in self.tok.encode_batch(runs, add_special_tokens=False)), np.uint32)
        if self.kind == "byte":
            first = np.flatnonzero(self.opens[flat])
            if len(first) == len(keys) and first[0] == 0:
                return flat, np.diff(first, append=len(flat))
            return self._one_by_one(keys)
        m = self.mark
        at = np.flatnonzero(flat == m[-1])
        at = at[at >= len(m) - 1] - (len(m) - 1)
        for j, x in enumerate(m):
            at = at[flat[at + j] == x]
        if len(at) != len(keys):
            return self._one_by_one(keys)
        keep = np.ones(len(flat), bool)
        for j in range(len(m)):
            keep[at + j] = False
        return flat[keep], np.diff(at, prepend=-len(m)) - len(m)

    def cuts(self, data: np.ndarray, texts: np.ndarray) -> np.ndarray:
        return stretches(data, texts)

    def learn(self, keys: list[str], hashes: np.ndarray) -> None:
        if self.kind == "byte":
            able = np.array([len(k) > 1 and k[0] == " " and not k[1].isspace() and not k[-1].isspace() for k in keys])
        else:
            able = np.array([MARK not in k for k in keys])
        for which, how in ((np.flatnonzero(able), self._joined), (np.flatnonzero(~able), self._one_by_one)):
            for i in range(0, len(which), LEARN):
                some = which[i : i + LEARN]
                self.remember(hashes[some], *how([keys[j] for j in some]))

    def __call__(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text, as uint32; null is an empty text."""
        texts = [t or "" for t in texts]
        out: list[np.ndarray] = [np.empty(0, np.uint32)] * len(texts)
        whole = [i for i, t in enumerate(texts) if "<|" in t]
        for i, e in zip(whole, self.tok.encode_batch([texts[i] for i in whole], add_special_tokens=False)):
            out[i] = np.array(e.ids, np.uint32)
        odd = set(whole)
        plain = [i for i, t in enumerate(texts) if t and i not in odd]
        at = 0
        while at < len(plain):
            upto, chars = at, 0
            while upto < len(plain) and (chars < CHARS or upto == at):
                chars += len(texts[plain[upto]])
                upto += 1
            for i, ids in zip(plain[at:upto], self.ids_of([texts[i].encode() for i in plain[at:upto]])):
                out[i] = ids
            at = upto
        return out


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, kind: str) -> Encoder:
    """One encoder a process, so that later tasks of a worker find the words of earlier ones."""
    if (path, kind) not in _ENCODERS:
        _ENCODERS[path, kind] = Encoder(path, kind)
    return _ENCODERS[path, kind]

"""Token files and packing against the library and exact round trips."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from textgraph.llm import jvm, token_files
from textgraph.llm.packing import first_fit_decreasing, pack_documents, packing_digest
from textgraph.llm.queries import tokenizer
from textgraph.llm.token_files import token_ids_digest
from textgraph.llm.wordmemo import Encoder, HashIndex, encoder

EDGES = [(3, "one two, three."), (1, None), (2, ""), (5, "  odd   spaces \n\t x"), (4, "<|endoftext|> y"), (None, "no id"), (3, "one two, three."), (9, "long " * 30000), (7, "é世 'll a.b ,c")]
SCHEMA = "doc_id long, text string, ids string, start string, length string"


def docs(spark, rows=EDGES):
    return spark.createDataFrame([(i, t, "x", "y", "z") for i, t in rows], SCHEMA)


def library(name, text):
    return encoder(tokenizer(name), "byte" if "byte" in name else "word").tok.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("name,kind", [("byte_bpe_50k.json", "byte"), ("word_bpe_49k.json", "word")])
def test_encoder_equals_library(name, kind):
    random.seed(5)
    bits = ["a", "the", " ", " ", ".", ",", "\n", "'s", "!", "é", " ", "23", "\t", "_", "日", "́", ")", " x", " y,", "", "\x01"]
    texts = ["".join(random.choice(bits) for _ in range(random.randint(0, 30))) for _ in range(2000)] + [t for _, t in EDGES]
    e = encoder(tokenizer(name), kind)
    assert all(list(got) == library(name, t) for got, t in zip(e(texts), texts))


def test_full_memory_starts_anew(monkeypatch):
    monkeypatch.setattr(Encoder, "room", 40)
    e = Encoder(tokenizer("byte_bpe_50k.json"), "byte")
    random.seed(2)
    for _ in range(30):
        texts = [" ".join(f"w{random.randrange(200)}" for _ in range(25)) for _ in range(3)]
        assert all(list(got) == library("byte_bpe_50k.json", t) for got, t in zip(e(texts), texts))


def test_hash_index():
    index, rng = HashIndex(1000), np.random.default_rng(3)
    h = np.unique(rng.integers(1, 1 << 60, 900).astype(np.uint64))
    h[:300] = np.arange(1, 301, dtype=np.uint64) << np.uint64(20)  # all in one place of the table
    h = np.unique(h)
    index.add(h[::2], np.arange(len(h))[::2])
    found = index.find(h)
    assert (found[::2] == np.arange(len(h))[::2]).all() and (found[1::2] == -1).all()


def through(spark, docs):
    """Each document's ids as coded blocks."""
    df = spark.createDataFrame([(bytearray(d.astype("<u4").tobytes()),) for d in docs], "raw binary")
    return df.select("raw", token_files.coded(spark, F.col("raw")).alias("blocks"))


def test_coder_round_trip(spark):
    rng = np.random.default_rng(1)
    sizes = [0, 1, 3, 5000, (1 << 16) - 1, 1 << 16, (1 << 16) + 1, 200_000]
    docs = [(rng.zipf(1.4, n) % 50000).astype(np.uint32) for n in sizes] + [rng.integers(0, 1 << 20, 3000).astype(np.uint32), np.full(999, (1 << 20) - 1, np.uint32)]
    rows = through(spark, docs).select("raw", token_files.decoded(spark, F.col("blocks")).alias("back")).collect()
    assert len(rows) == len(docs) and all(r["raw"] == r["back"] for r in rows)


def test_coder_learns(spark):
    first, second = np.tile(np.arange(40, dtype=np.uint32) * 7, 3000), np.random.default_rng(2).integers(0, 4, 60_000).astype(np.uint32) * 9000
    a, b = (len(r["blocks"]) for r in through(spark, [first, second]).collect())
    assert a < len(first) / 50  # known from the last two ids
    assert b < len(second) * 2.5 / 8  # noise of two bits an id


def test_blocks_start_anew_seldom(spark):
    """What a block learns lasts for 2^17 ids; bits below an id's length are learnt as well without other orders."""
    ids = (np.random.default_rng(5).zipf(1.3, (1 << 17) + 1) % 50000).astype(np.uint32)
    one, two = (bytes(r["blocks"]) for r in through(spark, [ids[:-1], ids]).collect())
    assert int.from_bytes(one[:4], "little") == 1 and int.from_bytes(two[:4], "little") == 2
    _, n = np.unique(ids, return_counts=True)
    assert 8 * len(one) < 1.1 * -(n * np.log2(n / len(ids))).sum()


def test_coder_refuses_what_it_cannot_hold(spark):
    with pytest.raises(Exception, match="20 bits at most"):
        through(spark, [np.array([1 << 20], np.uint32)]).collect()


@pytest.mark.parametrize("where", [-1, 30, 9, 0])
def test_damage_is_found(spark, where):
    blocks = bytearray(through(spark, [np.arange(70_000, dtype=np.uint32)]).head()["blocks"])
    blocks[where] ^= 85
    df = spark.createDataFrame([(blocks,)], "blocks binary")
    with pytest.raises(Exception, match="token file"):
        df.select(token_files.decoded(spark, F.col("blocks"))).collect()


def test_segments(spark):
    ids = [5, None, -3]
    data = token_files.segment(token_files.pack_heads(ids, [1, 7, 0]), b"blocks")
    heads, blocks = token_files.parse_segment(data)
    df = spark.createDataFrame([(bytearray(heads),)], "heads binary")
    (docs,) = df.select(jvm.function(spark, "TokenCoder", "Documents", token_files._DOCUMENTS, F.col("heads"))).head()
    assert [tuple(d) for d in docs] == [(5, 0, 1), (None, 1, 7), (-3, 8, 0)] and blocks == b"blocks"
    for bad in (data[:-1], data[:25] + b"x" + data[26:], b""):
        with pytest.raises(ValueError):
            token_files.parse_segment(bad)


def test_token_files(spark):
    got = sorted(token_ids_digest(docs(spark), tokenizer("byte_bpe_50k.json")).collect(), key=lambda r: r["start"])
    order = sorted(EDGES, key=lambda x: (x[0] is not None, x[0] or 0))  # the rows of id 3 are equal
    start = 0
    for row, (i, t) in zip(got, order, strict=True):
        ids = library("byte_bpe_50k.json", t) + [0]
        assert (row["doc_id"], row["start"], row["n_tokens"]) == (i, start, len(ids))
        assert row["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    assert token_ids_digest(docs(spark, []), tokenizer("byte_bpe_50k.json")).count() == 0


def test_many_segments_and_files(spark, monkeypatch):
    monkeypatch.setattr(token_files, "SEGMENT_IDS", 50)
    monkeypatch.setattr(token_files, "FILE_BYTES", 200)
    rows = [(i % 60, f"text {i} " * (i % 9)) for i in range(200)]
    got = sorted(token_ids_digest(docs(spark, rows).repartition(7), tokenizer("byte_bpe_50k.json")).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == sorted(i for i, _ in rows)
    starts = np.cumsum([0] + [r["n_tokens"] for r in got])
    assert [r["start"] for r in got] == list(starts[:-1])
    want = {zlib.crc32(np.array(library("byte_bpe_50k.json", t) + [0], "<u4").tobytes()) for _, t in rows}
    assert {r["ids_crc32"] for r in got} == want


def test_first_fit_decreasing_equals_plain():
    random.seed(3)
    for _ in range(50):
        cap = random.choice([10, 64, 2048])
        sizes = np.array([random.choice([cap, random.randint(1, cap), 1]) for _ in range(random.randint(1, 200))])
        bins, offsets = first_fit_decreasing(sizes, cap)
        room, want = [], {}
        for i in np.argsort(-sizes, kind="stable"):
            b = next((b for b, r in enumerate(room) if r >= sizes[i]), None)
            if b is None:
                room.append(cap)
                b = len(room) - 1
            want[i] = (b, cap - room[b])
            room[b] -= sizes[i]
        assert [want[i] for i in range(len(sizes))] == list(zip(bins, offsets))


def test_packing(spark):
    rows = packing_digest(docs(spark), tokenizer("word_bpe_49k.json")).collect()
    ids = {}
    for r in pack_documents(docs(spark), tokenizer("word_bpe_49k.json"), "word").collect():
        ids.setdefault((r["doc_id"], r["start"]), []).append(np.frombuffer(r["ids"], "<u4"))
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():  # gapless, at most 2048
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 2048
    for i, t in dict(EDGES).items():
        whole = library("word_bpe_49k.json", t) + [1]
        starts = sorted({r["start"] for r in rows if r["doc_id"] == i})
        assert [x for s in starts for x in ids[i, s][0]] == whole
        assert all(r["doc_tokens"] == len(whole) for r in rows if r["doc_id"] == i)
    assert sum(r["length"] for r in rows) == sum(len(library("word_bpe_49k.json", t)) + 1 for _, t in EDGES)
    assert packing_digest(docs(spark, []), tokenizer("word_bpe_49k.json")).count() == 0

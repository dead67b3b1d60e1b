"""Pieces against the public library."""

import random
import zlib

from textgraph.llm.queries import tokenizer
from textgraph.llm.sentence_pieces import encode_pieces, pieces, pieces_digest

ODD = ["", None, " ", "  Hello   world\n\t ab ﬁ é́  ", "a\x00b \x00", "日本語テキスト 🤗🤗 x", "a" * 700 + " b" * 3, "▁▁ x▁y ▁", "aaaa aaaaaa   ", " " * 80, "........!!!!!! ==========", "é" * 300, "word " * 20000]


def test_encode_equals_library():
    p = pieces(tokenizer("piece_bpe_32k.model"))
    random.seed(1)
    texts = ODD + ["".join(random.choice("abcdeghinorst   .,é\n0124▁世") for _ in range(random.randint(1, 80))) for _ in range(1500)]
    assert [list(x) for x in p.encode(texts)] == [p.sp.encode(t or "") for t in texts]


def test_frame(spark):
    df = spark.createDataFrame([(i if i else None, t, 1, 2) for i, t in enumerate(ODD)], "doc_id long, text string, ids int, decoded int")
    p = pieces(tokenizer("piece_bpe_32k.model"))
    got = encode_pieces(df, tokenizer("piece_bpe_32k.model")).collect()
    assert sorted((r["doc_id"] or 0, list(r["ids"]), r["decoded"]) for r in got) == sorted((i, p.sp.encode(t or ""), p.sp.decode(p.sp.encode(t or ""))) for i, t in enumerate(ODD))
    digest = {r["doc_id"]: r for r in pieces_digest(df, tokenizer("piece_bpe_32k.model")).collect()}
    assert digest[3]["text_crc32"] == zlib.crc32(ODD[3].encode()) and digest[3]["n_pieces"] == len(p.sp.encode(ODD[3]))
    assert pieces_digest(df.limit(0), tokenizer("piece_bpe_32k.model")).count() == 0

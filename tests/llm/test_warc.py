"""Archives against the table they were written from."""

import hashlib

from textgraph.llm import warc
from textgraph.llm.common import work_dir

LONG = "<html>" + "x" * 200
ROWS = [(5, "http://a/1", LONG), (2, "http://a/2", LONG), (9, None, LONG), (3, "http://b/ü x\n", "short"), (4, "u", "short"), (6, "u", None), (7, "u", ""), (None, "u", LONG), (8, "u", "é" * 5000), (2, "http://a/2", LONG)]


def pages(spark, rows=ROWS):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], "page_id long, url string, html string, digest string, path string")


def test_round_trip(spark):
    got = sorted((tuple(r) for r in warc.warc_digest(spark, pages(spark)).collect()), key=str)
    want = []
    for i, _, html in ROWS:
        raw = (html or "").encode()
        first = min([j for j, _, h in ROWS if h == html and j is not None], default=None)
        refers = first if len(raw) >= 100 and i is not None and i != first else None
        want.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if refers is not None else "response", refers))
    assert got == sorted(want, key=str)
    assert warc.warc_digest(spark, pages(spark, [])).count() == 0


def test_selected_records_and_payloads(spark):
    index = warc.write_archives(pages(spark), work_dir(spark, "warc-test"))
    assert index.count() == len(ROWS)
    some = warc.read_records(index.filter("page_id in (3, 8, 9)")).collect()
    assert {(r["page_id"], r["record_type"], r["refers_to"]) for r in some} == {(3, "response", None), (8, "response", None), (9, "revisit", 2)}
    assert {r["page_id"]: r["payload"] and bytes(r["payload"]).decode() for r in some} == {3: "short", 8: "é" * 5000, 9: None}


def test_coalesce():
    gap = warc.GAP
    assert warc.coalesce([(0, 10), (10, 5), (15 + gap, 5), (30 + 3 * gap, 1)]) == [(0, 20 + gap, [0, 1, 2]), (30 + 3 * gap, 1, [3])]
    big = warc.RANGE
    assert warc.coalesce([(0, big), (big, big + 5)]) == [(0, big, [0]), (big, big + 5, [1])]
    assert warc.coalesce([]) == []

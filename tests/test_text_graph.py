"""Cases of links, regions, front matter, paths and directives, one by one."""

import pytest
from pyspark.sql import functions as F

from textgraph.functions import paths, text
from textgraph.operators import bookmark, frontmatter, graph, links, regions, registry, store, weave

HOME = "/home/u"


def files(spark, *rows):
    return spark.createDataFrame(list(rows), "path string, content string")


def found(spark, path, content):
    rows = links.links(files(spark, (path, content))).orderBy("line_no", "place").collect()
    return [(r["line_no"], r["link"], r["fragment"]) for r in rows]


@pytest.mark.parametrize(
    "content,want",
    [
        ("[[/a/b.md]]", [(1, "/a/b.md", None)]),
        ("[[/a.md#frag]]", [(1, "/a.md", "frag")]),
        ("[[/a]] and [[/b]]", [(1, "/a", None), (1, "/b", None)]),
        ("[[/a]]\n\n[[/b]] [[/c#frag]]", [(1, "/a", None), (3, "/b", None), (3, "/c", "frag")]),
        ("[[]] [[  ]] [[#x]]", []),
        ("[[/open", []),
        ("[[/a\n/b]]", []),
        ("[[ ~/notes/fix.md ]]", [(1, "~/notes/fix.md", None)]),
        ("[[ /a # part one ]]", [(1, "/a", "part one")]),
        ("[[/x#]]", [(1, "/x", None)]),
        ("```\n[[/in/fence.md]]\n```", [(2, "/in/fence.md", None)]),
        ("array[1][2] and [[~/real-link.md]]", [(1, "~/real-link.md", None)]),
        ("[[/a]]\r\n", [(1, "/a", None)]),
        ("[[ foo [[/z]]", [(1, "foo [[/z", None)]),
        ("[[ /nbsp ]]", [(1, "/nbsp", None)]),
        ("", []),
        (None, []),
    ],
)
def test_markdown_links(spark, content, want):
    assert found(spark, "/f.md", content) == want


@pytest.mark.parametrize(
    "path,content,want",
    [
        ("/f.cpp", "// see [[/a]]\nint x = 5; // [[/b#r]]\nchar *s = \"[[/no]]\";\n/* [[/c]] */", [(1, "/a", None), (2, "/b", "r"), (4, "/c", None)]),
        ("/f.py", "# [[/a]]\nx = 1  # [[/b#f]]\ny = '[[/no]]'", [(1, "/a", None), (2, "/b", "f")]),
        ("/f.rs", "/*\n [[/a]]\n more [[/b#x]] */ [[/no]]", [(2, "/a", None), (3, "/b", "x")]),
        ("/f.rs", "/* [[/a]] */ /* [[/b]] */", [(1, "/a", None)]),
        ("/f.rs", "/* [[/never]]\nclosed", []),
        ("/f.lua", "--[[/a/b]]", [(1, "/a/b", None)]),
        ("/f.py", "# [[/a]] [[/a]] [[/b]] [[/a]]", [(1, "/a", None), (1, "/b", None), (1, "/a", None)]),
        ("/f.jpg", "[[/a]]", []),
    ],
)
def test_code_links(spark, path, content, want):
    assert found(spark, path, content) == want


def test_edges_keep_absolute_and_home_paths(spark):
    df = links.edges(links.links(files(spark, ("/s.md", "[[rel/x.md]] [[~/n.md#f]] [[/a/../b.md]] [[~bob/x]] [[/k]] [[/k]] [[/k#f]] [[/k#f]]"))), HOME)
    assert sorted(map(tuple, df.collect()), key=str) == sorted([("/s.md", f"{HOME}/n.md", "f"), ("/s.md", "/b.md", None), ("/s.md", "/k", None), ("/s.md", "/k", None), ("/s.md", "/k", "f"), ("/s.md", "/k", "f")], key=str)
    assert links.insert_edges(df).filter("target = '/k'").count() == 3


def all_regions(spark, content, path="/f.cpp"):
    marked = regions.marked_lines(files(spark, (path, content)))
    return [tuple(r)[1:] for r in regions.regions(marked).orderBy("start_line").collect()], [tuple(r)[1:] for r in regions.violations(marked).orderBy("line_no").collect()]


@pytest.mark.parametrize(
    "content,want,bad",
    [
        ("x\n// @region a\ny\n// @end a", [("a", 2, 4, None)], []),
        ("// @region a\n//| one\n//|   two\nint x;\n//| three\n// @end a", [("a", 1, 6, "one\ntwo\n\nthree")], []),
        ("// @region a\n//| one\n// plain\n// | two\n// @end a", [("a", 1, 5, "one\n\ntwo")], []),
        ("// @region a\n// @end a\n// @region b\n// @end b\n", [("a", 1, 2, None), ("b", 3, 4, None)], []),
        ("// @region a\nx\ny\nz", [("a", 1, 4, None)], []),
        ("// @region a\nx\n// @end b", [("a", 1, 3, None)], []),
        ("// @end z", [], []),
        ("// @regionfoo\n// @endpoint x", [("foo", 1, 2, None)], []),
        ("/// @region x", [], []),
        ("// @region a\n// @region b\n// @end b", None, [("nested", "b", 2)]),
        ("// @region a\n// @end a\n// @region a\n// @end a", None, [("duplicate", "a", 3)]),
        ("//| outside\r\n// @region a\r\n//| in\r\n// @end a\r\n", [("a", 2, 4, "in")], []),
    ],
)
def test_regions(spark, content, want, bad):
    got, violations = all_regions(spark, content)
    assert violations == bad and (want is None or got == want)


def test_regions_of_other_languages(spark):
    assert all_regions(spark, "# @region a\n#| p\n# @end a", "/f.py")[0] == [("a", 1, 3, "p")]
    assert all_regions(spark, "// @region a\n// @end a", "/f.md")[0] == []


@pytest.mark.parametrize(
    "content,want",
    [
        ("---\ntitle: A Tale\ndate: 2026-03-18\n---\nx", {"title": "A Tale", "date": "2026-03-18"}),
        ("---\ntags: [rust, supercollider, music]\n---\n", {"tags": "[rust, supercollider, music]"}),
        ("---\na: 0\nb: 5\nc: true\nd: false\ne: null\nf: 1.5\ng: yes\n---\n", {"a": "0", "b": "5", "c": "true", "d": "false", "e": "null", "f": "1.5", "g": "yes"}),
        ("no block", {}),
        ("---\na: [\n---\n", {}),
        ("---\na: 1\na: 2\n---\n", {}),
        ("---\ntitle: First\n---\n---\ntitle: Second\n---\n", {"title": "First"}),
        ("---\na: 1\n----\n", {"a": "1"}),
        ("---\n---\nx", {}),
        ("---\n1: x\nb: y\n---\n", {"b": "y"}),
        ("---\nk: [a, [b, c]]\n---\n", {"k": "[a, [b, c]]"}),
        ("  \n---\ntitle: Łódź\n---\n", {"title": "Łódź"}),
        ("---\n- a\n- b\n---\n", {}),
    ],
)
def test_frontmatter(spark, content, want):
    pytest.importorskip("yaml")
    rows = frontmatter.yaml_attributes(files(spark, ("/f.md", content), ("/f.py", content))).collect()
    assert {r["key"]: r["value"] for r in rows} == want and {r["file"] for r in rows} <= {"/f.md"}


def test_flat_frontmatter_agrees(spark):
    df = files(spark, ("/a.md", "---\ntitle: Plain words\nx-y: more\n---\n"), ("/b.md", "---\nt: [a]\n---\n"), ("/c.md", "---\na: b\na: c\n---\n"))
    assert sorted(map(tuple, frontmatter.flat_attributes(df).collect())) == [("/a.md", "title", "Plain words"), ("/a.md", "x-y", "more")]


def test_paths(spark):
    cases = {"relative/path": None, "/absolute/path": "/absolute/path", "~/something": HOME + "/something", "/a/b/../c": "/a/c", "/a/./b/./c": "/a/b/c", "/../a": "/a", "~bob/x": None, "//a//": "/a", "/": "/"}
    df = spark.createDataFrame([(k,) for k in cases], "p string").select("p", paths.node_path(F.col("p"), HOME).alias("q"))
    assert {r["p"]: r["q"] for r in df.collect()} == cases
    one = spark.range(1).select(paths.below(F.lit("/a/b"), F.lit("/a")), paths.below(F.lit("/ab"), F.lit("/a")), paths.join(F.lit("/home/m"), F.lit("n/f.md")), paths.short_tail(F.lit("/a/b/c/d")), paths.short_source(F.lit("/x/src/y/z.rs")), paths.short_source(F.lit("/x/z.rs"))).head()
    assert tuple(one) == (True, False, "/home/m/n/f.md", "…/b/c/d", "y/z.rs", "z.rs")


@pytest.mark.parametrize("path,name", [("/a.md", "markdown"), ("/a.CPP", "c_family"), ("/a.py", "python"), ("/a.scd", "supercollider"), ("/a.abc", "abc"), ("/a.jpg", None), ("/a.parquet", None), ("/a.tsx", "javascript"), ("/a.zsh", "shell")])
def test_extractors(spark, path, name):
    e = registry.find(path)
    assert (e.name if e else None) == name
    assert spark.range(1).select(registry.extractor_name(F.lit(path))).head()[0] == name


def test_like_is_ascii_and_has_wildcards(spark):
    df = spark.createDataFrame([("/a/FIX.md",), ("/axb",), ("/Ä",), ("/a\\b",)], "path string").withColumn("modified", F.lit(1.0))
    hit = lambda q: sorted(r["path"] for r in graph.find(df, q).collect())
    assert hit("fix") == ["/a/FIX.md"] and hit("a_b") == ["/a\\b", "/axb"] and hit("ä") == [] and hit("\\") == ["/a\\b"]


def test_globs():
    import re

    for glob, name, hit in (("*.bin", ".x.bin", True), ("build", "build", True), ("build", "builds", False), ("[a-c]?", "b1", True), ("[!a]x", "ax", False), ("*.BIN", "a.bin", False)):
        assert bool(re.match(text.glob_regex(glob), name)) == hit
    assert text.glob_regex("[abc") is None


def test_store_functions(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    assert sorted(map(tuple, store.upsert(old, spark.createDataFrame([("b", 3), ("c", 4), ("c", 5)], "k string, v int"), ["k"]).collect())) == [("a", 1), ("b", 3), ("c", 5)]
    none = spark.createDataFrame([], "source string, target string, fragment string")
    twice = spark.createDataFrame([("s", "t", None), ("s", "t", None), ("s", "t", "x"), ("s", "t", "x")], "source string, target string, fragment string")
    assert store.insert_edges(none, twice).count() == 3


def test_weave(spark):
    lines = links.file_lines(files(spark, ("/x/src/f.rs", "// @region a\n//| Why.\n\nfn f() {}  \n\n  g()\n\n// @end a\n// @region b\n// @end b")))
    r = spark.createDataFrame([("/x/src/f.rs", "a", 1, 8, "Why."), ("/x/src/f.rs", "b", 9, 10, None), ("/gone.py", "c", 1, 2, "")], "file string, name string, start_line int, end_line int, prose string")
    stats = spark.createDataFrame([(1, 2, 3, 1)], "nodes long, edges long, regions long, with_prose long")
    template = [
        ("# T", "# T"),
        ("  {{prose:a}}", "  Why.\n  "),
        ("{{code:a}}", "```rust\nfn f() {}\n\n  g()\n```"),
        (" {{region:a}}", " Why.\n \n ```rust\n fn f() {}\n \n   g()\n ```"),
        ("{{region:zz}}", "*[region not found: zz]*"),
        ("{{code:b}}", "*[source file not found: /x/src/f.rs]*"),
        ("{{code:c}}", "*[source file not found: /gone.py]*"),
        ("{{region:c}}", ""),
        ("{{prose:b}}", ""),
        ("{{stats}}", "**1** files · **2** edges · **3** regions · **1** with prose"),
        ("{{what:x}}", "*[unknown directive: what:x]*"),
        ("{{what}}", "*[unknown directive: what:]*"),
        ("{{prose}}", "*[missing region name in {{prose}}]*"),
        ("{{file}}", "*[missing path in {{file:}}]*"),
        ("```abc", "```abc"),
        ("{{stats}}", "% [region not found: None]"),
        ("\t{{prose:a}}", "\tfn f() {}\n\t\n\t  g()"),
        ("{{code:b}}", "% [source not found: b]"),
        ("{{code:q}}", "% [region not found: q]"),
        ("```", "```"),
        ("keep {{stats}} inline", "keep {{stats}} inline"),
        ("{{index}}", "| File | Region | Lines | Prose |\n|------|--------|-------|-------|\n| `gone.py` | `c` | 1–2 | — |\n| `f.rs` | `a` | 1–8 | 4 ch |\n| `f.rs` | `b` | 9–10 | — |"),
        ("{{file:/x/src/f.rs}}", "//| Why.\n\nfn f() {}\n\n  g()\n"),
        ("{{file:/none}}", "*[file not found: /none]*"),
        ("", ""),
    ]
    t = weave.template_lines(files(spark, ("t", "\n".join(x for x, _ in template)), ("u", "no directive\n")))
    docs = {d["path"]: d["document"] for d in weave.expand(t, lines, r, stats).collect()}
    assert docs["t"] == "\n".join(x for _, x in template) and docs["u"] == "no directive\n"
    none = weave.expand(weave.template_lines(files(spark, ("t", "{{index}}"))), lines, r.limit(0), stats).head()["document"]
    assert none == "| File | Region | Lines | Prose |\n|------|--------|-------|-------|"


def test_literate(spark):
    lines = links.file_lines(files(spark, ("/r/sub/f.py", "# @region a\n#| Why.\nx = 1  \n\n# @end a\n# @region b\n# @end b")))
    r = spark.createDataFrame([("/r/sub/f.py", "a", 1, 5, " Why. "), ("/r/sub/f.py", "b", 6, 7, None)], "file string, name string, start_line int, end_line int, prose string")
    e = spark.createDataFrame([("/r/sub/f.py", "/r/z.md", "x"), ("/r/sub/f.py", "/far/away/in/a.md", None), ("/r/sub/f.py", "/far/away/in/a.md", None)], "source string, target string, fragment string")
    page = weave.literate(r, weave.region_code(r, lines, loose=True), e, ["/q", "/r"]).head()["document"]
    assert page == "# sub/f.py\n\n*Connects to:* `…/away/in/a.md`, `…/away/in/a.md`, `z.md#x`\n\n---\n\n## a\n\nWhy.\n\n```python\nx = 1\n```\n\n## b\n\n"
    assert weave.literate(r, weave.region_code(r, lines, loose=True), e.limit(0), []).head()["document"].startswith("# …/r/sub/f.py\n\n---\n\n## a")


def test_fence_languages(spark):
    names = {"/a.RS": "rust", "/a.abc": "abc", "/a.sc": "", "/a.md": "", "/.py": "", "/d.py/x": "", "/a.b.yml": "yaml"}
    df = spark.createDataFrame([(k,) for k in names], "p string").select("p", registry.fence(F.col("p"), registry.WEAVE_FENCES).alias("f"))
    assert {r["p"]: r["f"] for r in df.collect()} == names
    assert spark.range(1).select(registry.fence(F.lit("/a.abc"), registry.LITERATE_FENCES)).head()[0] == ""


@pytest.mark.parametrize(
    "rest,want",
    [
        ('news "two words" ~hidden !x #note last', ["news", "two words", "last"]),
        ('~"Name" x', ["Name", "x"]),
        ('#"x" "#y"', ["x", "#y"]),
        ('"~x" "!y" a', ["a"]),
        ('a "open end', ["a"]),
        ('ab"c d"e f', ["c d", "e", "f"]),
        ('"" a', ["", "a"]),
        ("a\tb  c ", ["a", "b", "c"]),
        ("", []),
        ('"', []),
    ],
)
def test_tags(spark, rest, want):
    assert list(spark.range(1).select(bookmark.tags(F.lit(rest))).head()[0]) == want


def test_bookmark_columns(spark):
    row = spark.range(1).select(
        bookmark.slug(F.lit("  Héllo, World! " + "x" * 100)).alias("slug"),
        bookmark.title_text(F.lit('say "hi"')).alias("title"),
        bookmark.title_text(F.lit("")).alias("none"),
        bookmark.tags_yaml(F.array(F.lit("a"), F.lit("b"))).alias("yaml"),
        bookmark.page_text(F.lit("<p>a <b>b</b></p><script>x</script>")).alias("text"),
    ).head()
    assert row["slug"].startswith("h-llo-world-x") and len(row["slug"]) == 80
    assert (row["title"], row["none"], row["yaml"], row["text"]) == ('say \\"hi\\"', "Untitled bookmark", '["a", "b"]', "a b")


def test_bookmark_files(spark, tmp_path):
    df = spark.createDataFrame([("2024/01/02/a.md", "one"), ("2024/01/02/b.md", "två")], "path string, document string")
    written = sorted(r["path"] for r in bookmark.write_files(df, str(tmp_path)).collect())
    assert [open(p, encoding="utf-8").read() for p in written] == ["one", "två"] and len(list(tmp_path.rglob("*.*"))) == 2


def test_markup(spark):
    one = spark.range(1).select(weave.inline_markup(F.lit("a <b> `c` **d** *e* ** f"))).head()[0]
    assert one == 'a &lt;b&gt; <font face="Courier" size="9">c</font> <b>d</b> <i>e</i> ** f'


def test_blocks(spark):
    content = "# h \n## h\n### h3\n---\n  ***\n```rust\n# no\n\n  x\n```\none\n  two\n{{stats}}\n{{code: a b}}\n\n----\n#### four\n#tag\nthree\n```\nopen\n"
    got = [tuple(r)[2:] for r in weave.blocks(weave.template_lines(files(spark, ("t", content)))).orderBy("block_no").collect()]
    assert got == [
        (1, "h1", None, "h"),
        (2, "h2", None, "h"),
        (3, "h3", None, "h3"),
        (4, "hr", None, None),
        (5, "hr", None, None),
        (6, "code", "rust", "# no\n\n  x"),
        (11, "para", None, "one two"),
        (13, "directive", "stats", None),
        (14, "directive", "code", " a b"),
        (16, "para", None, "----"),
        (17, "para", None, "#### four"),
        (18, "para", None, "#tag"),
        (19, "para", None, "three"),
        (20, "code", "", "open\n"),
    ]

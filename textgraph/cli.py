"""Command line: collect, find, init, stop, unstop, roots, project, weave."""

from __future__ import annotations

import argparse
import os
import re
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textgraph.collect import collect
from textgraph.operators import graph, weave
from textgraph.operators.links import file_lines
from textgraph.operators.store import Store
from textgraph.sources import discover


def init(directory: str, name: str | None = None, names: discover.Names = discover.Names()) -> int:
    """Writes a definition; 1 if there is one."""
    path = os.path.join(directory, names.definition)
    if os.path.exists(path):
        return 1
    name = name or os.path.basename(os.path.abspath(directory)) or "unnamed"
    with open(path, "w", encoding="utf-8") as f:
        f.write(f"name: {name}\nrefs: []\n")
    return 0


def stop(directory: str, names: discover.Names = discover.Names()) -> int:
    open(os.path.join(directory, names.stop), "a").close()
    return 0


def unstop(directory: str, names: discover.Names = discover.Names()) -> int:
    path = os.path.join(directory, names.stop)
    if os.path.exists(path):
        os.remove(path)
    return 0


def _rows(title: str, df: DataFrame) -> str:
    return "\n".join([f"## {title}", *("- " + " | ".join("" if v is None else str(v) for v in r) for r in df.toLocalIterator()), ""])


def overview(db: Store) -> str:
    """The graph in brief: a line per root and per file with regions, other sections are bounded."""
    t = db.tables()
    sections = [
        ("Counts", graph.table_counts(t["nodes"], t["edges"], t["regions"], t["roots"])),
        ("Roots", graph.files_per_root(t["nodes"], t["roots"]).orderBy("path")),
        ("References", graph.refs_per_root(t["roots"], t["refs"]).orderBy("path")),
        ("Hubs", graph.hubs(t["edges"])),
        ("Orphans", graph.orphans(t["nodes"], t["edges"])),
        ("Regions", graph.region_summary(t["regions"]).orderBy("file")),
        ("Recent", graph.recent(t["changelog"])),
    ]
    return "\n".join(_rows(n, df) for n, df in sections)


def node_page(db: Store, query: str) -> str | None:
    """All that is known of a file; None if the query names none or several."""
    t = db.tables()
    hits = [r["path"] for r in graph.resolve(t["nodes"], query).orderBy("rank").collect()]
    if len(hits) != 1:
        return None
    p = hits[0]
    sections = [
        ("File", graph.node_header(t["nodes"], t["roots"], p)),
        ("Links to", graph.outgoing(t["edges"], p)),
        ("Linked from", graph.incoming(t["edges"], p)),
        ("Regions", graph.node_regions(t["regions"], p).select("name", "start_line", "end_line")),
        ("Attributes", graph.node_attributes(t["attributes"], p)),
    ]
    return "\n".join(_rows(n, df) for n, df in sections)


def _sources(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Lines of these files, as they are now; those that can't be read are left out."""
    rows = []
    for p in paths:
        try:
            with open(p, encoding="utf-8") as f:
                rows.append((p, f.read()))
        except (OSError, UnicodeDecodeError):
            continue
    return file_lines(spark.createDataFrame(rows, "path string, content string"))


def woven(spark: SparkSession, db: Store, template: str) -> str:
    t = db.tables()
    with open(template, encoding="utf-8") as f:
        content = f.read()
    lines = weave.template_lines(spark.createDataFrame([(template, content)], "path string, content string"))
    # only what the template names is read
    asked = {m.group(3) for line in content.split("\n") if (m := re.match(weave.DIRECTIVE, line)) and m.group(3)}
    named = {r["file"] for r in t["regions"].filter(F.col("name").isin(*asked)).select("file").distinct().collect()} if asked else set()
    out = weave.expand(lines, _sources(spark, sorted(named | asked)), t["regions"], graph.weave_stats(t["nodes"], t["edges"], t["regions"])).head(1)
    return out[0]["document"] if out else ""


def literate(spark: SparkSession, db: Store, path: str) -> str | None:
    """The literate page of a file, by its path or a part that one file has; None if it isn't there."""
    t = db.tables()
    hits = [r["path"] for r in graph.resolve(t["nodes"], path).orderBy("rank").collect()]
    if len(hits) != 1:
        return None
    roots = [r["path"] for r in t["roots"].orderBy("path").collect()]
    mine = t["regions"].filter(F.col("file") == hits[0])
    out = weave.literate(mine, weave.region_code(mine, _sources(spark, hits), loose=True), t["edges"].filter(F.col("source") == hits[0]), roots).head(1)
    if out:
        return out[0]["document"]
    return spark.range(1).select(weave.page_head(F.lit(hits[0]), roots)).head()[0] + "*No regions found in this file.*\n"


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="textgraph")
    p.add_argument("--db", default="textgraph.db")
    sub = p.add_subparsers(dest="command", required=True)
    for name, args in {"collect": ["seed"], "find": ["query"], "init": ["directory", "?name"], "stop": ["directory"], "unstop": ["directory"], "roots": [], "project": ["kind", "?query"], "weave": ["template"]}.items():
        s = sub.add_parser(name)
        for a in args:
            s.add_argument(a.lstrip("?"), nargs="?" if a[0] == "?" else None)
    a = p.parse_args(argv)
    if a.command in ("init", "stop", "unstop"):
        return init(a.directory, a.name) if a.command == "init" else {"stop": stop, "unstop": unstop}[a.command](a.directory)
    spark = SparkSession.builder.appName("textgraph").getOrCreate()
    if a.command == "collect":
        print(collect(spark, a.seed, a.db))
        return 0
    db = Store(spark, a.db, must_exist=a.command in ("project", "weave"))
    if a.command == "find":
        text: str | None = "\n".join(r["path"] for r in graph.find(db.table("nodes"), a.query).collect())
    elif a.command == "roots":
        text = _rows("Roots", db.table("roots").orderBy("path"))
    elif a.command == "weave":
        text = woven(spark, db, a.template)
    elif a.kind == "graph":
        text = overview(db)
    elif a.kind == "node":
        text = node_page(db, a.query)
    elif a.kind == "literate":
        text = literate(spark, db, a.query)
    else:
        text = _rows("Regions", db.table("regions").select("file", "name", "prose").orderBy("file", "name"))
    if text is None:
        return 1
    print(text)
    return 0


if __name__ == "__main__":
    sys.exit(main())

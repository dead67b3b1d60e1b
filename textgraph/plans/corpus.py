"""A corpus of files made from the documents table, the same in Spark SQL and DuckDB."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from textgraph.functions.storage import work_folder
from textgraph.operators import bookmark

HOME = "/home/user"

#: doc_id % 4 decides the kind of file: markdown, Rust-like code, Python-like code, no extractor.
_CONTENT = """
CASE doc_id % 4
WHEN 0 THEN '---' || chr(10) || 'title: Doc ' || doc_id || chr(10) || 'lang: ' || lang || chr(10) || '---' || chr(10) || text || chr(10)
  || 'See [[/src' || ((doc_id + 1) % 20) || '/' || (doc_id + 1) || '.rs#alpha]] and [[relative/path.md]].' || chr(10)
  || '[[/missing/' || doc_id || '.md]] [[ /src' || ((doc_id + 1) % 20) || '/' || (doc_id + 1) || '.rs # none ]]' || chr(10)
  || '## Links of ' || doc_id || chr(10) || '```rust' || chr(10) || '# no heading' || chr(10) || '```' || chr(10) || '{{prose:alpha}}' || chr(10) || '***' || chr(10)
  || '[[/hub/index.md]] [[/hub/index.md]]' || chr(10)
WHEN 1 THEN '// @region alpha' || chr(10) || '//| About ' || doc_id || '.' || chr(10) || '//|   Indented line.' || chr(10)
  || 'fn f' || doc_id || '() {} // see [[/src' || ((doc_id - 1) % 20) || '/' || (doc_id - 1) || '.md]] [[/again.md]] [[/again.md]]' || chr(10) || '// | Second block.' || chr(10)
  || 'let x = 1;' || chr(10) || 'let y = 2; // @end maybe' || chr(10) || '// @end other' || chr(10) || '/* [[/src' || ((doc_id + 1) % 20) || '/' || (doc_id + 1) || '.py#body]]' || chr(10)
  || ' * and [[/hub/index.md#block]] [[no/root.md]]' || chr(10) || ' [[~/notes/block.md]] */ [[/behind/the/block.md]]' || chr(10)
  || '// @region tail' || chr(10) || 'unclosed ' || lang || chr(10) || text
WHEN 2 THEN '# @region body' || chr(10) || text || chr(10) || '# [[~/notes/' || (doc_id % 7) || '.md#top]]' || chr(10) || '#| Prose of ' || lang || chr(10) || '# @end body' || chr(10)
ELSE text END
"""
_EXT = "CASE doc_id % 4 WHEN 0 THEN '.md' WHEN 1 THEN '.rs' WHEN 2 THEN '.py' ELSE '.jpg' END"
_COLUMNS = ["doc_id", "lang", f"'/' || source || '/' || doc_id || {_EXT} AS path", "'/' || source AS root", f"{_EXT} AS ext", f"{_CONTENT} AS content", "CAST(1700000000 + doc_id AS DOUBLE) AS modified"]

#: For DuckDB: files with their hash and size.
FILES = f"files AS (SELECT *, sha256(content) AS hash, CAST(strlen(content) AS BIGINT) AS size FROM (SELECT {', '.join(_COLUMNS)} FROM documents))"


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, lang, path, root, ext, content, modified, hash, size."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "source", "text")
    return docs.selectExpr(*_COLUMNS).selectExpr("*", "sha2(content, 256) AS hash", "CAST(octet_length(content) AS BIGINT) AS size")


_WAS = "CASE WHEN doc_id % 7 = 0 THEN path || '.old' ELSE path END AS path"
_IS = "CASE WHEN doc_id % 5 = 0 THEN '/moved' || path ELSE path END AS path"
_HAD = "CASE WHEN doc_id % 11 = 0 THEN 'old' || hash ELSE hash END AS hash"


#: The definition of a root, in both languages.
DEFINED = "'name: root ' || substring(root, 2) || chr(10) || CASE WHEN root = '/src0' THEN 'exclude: [\"*.jpg\"]' || chr(10) ELSE '' END"


def tree(spark: SparkSession, sf_dir: str) -> str:
    """Writes all files as a tree of roots and a hub that refers to them, and returns the hub's directory.

    The root src0 excludes .jpg; a directory that a stop file closes and a reference to nowhere are there, too.
    """
    base = work_folder(spark, "tree")
    every = files(spark, sf_dir)
    defined = every.select("root").distinct().selectExpr("root || '/textgraph.yaml' AS path", f"{DEFINED} AS document")
    bookmark.write_files(every.filter("content is not null").selectExpr("substring(path, 2) AS path", "content AS document").unionByName(defined.selectExpr("substring(path, 2) AS path", "document")), base).write.format("noop").mode("overwrite").save()
    targets = [r["root"] for r in every.select("root").distinct().orderBy("root").collect()]  # listed by hand
    os.makedirs(f"{base}/hub")
    with open(f"{base}/hub/textgraph.yaml", "w", encoding="utf-8") as f:
        f.write("name: hub\nwalk: false\nrefs:\n" + "".join(f"- path: {base}{t}\n" for t in [*targets, "/nowhere"]))
    if targets:
        os.makedirs(f"{base}{targets[0]}/closed")
        for name in (".textgraph-stop", "unseen.md"):
            open(f"{base}{targets[0]}/closed/{name}", "w").close()
    return f"{base}/hub"


def previous(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An earlier snapshot of all files: some had another path, some another hash."""
    return files(spark, sf_dir).selectExpr(_WAS, "root", "modified", "size", _HAD)


def current(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A later snapshot of all files, some of which have moved."""
    return files(spark, sf_dir).selectExpr(_IS, "root", "modified", "size", "hash")


SNAPSHOTS = f"prev AS (SELECT {_WAS}, root, modified, size, {_HAD} FROM files),\ncur AS (SELECT {_IS}, root, modified, size, hash FROM files)"


def roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A root per source, and a hub without files."""
    own = files(spark, sf_dir).selectExpr("root AS path", "concat('root ', substring(root, 2)) AS name").distinct()
    return own.unionByName(spark.createDataFrame([("/hub", "hub")], "path string, name string"))


def refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hub refers to every root; root n to root n + 1 and to a directory that is no root."""
    own = files(spark, sf_dir).select("root").distinct()
    hub = own.selectExpr("'/hub' AS source", "root AS target")
    ring = own.selectExpr("root AS source", "concat('/src', cast((cast(substring(root, 5) AS int) + 1) % 20 AS string)) AS target")
    return hub.unionByName(ring).unionByName(own.selectExpr("root AS source", "'/elsewhere/notes' AS target"))


ROOTS = """roots AS (SELECT DISTINCT root AS path, 'root ' || substr(root, 2) AS name FROM files UNION ALL SELECT '/hub', 'hub'),
refs AS (SELECT '/hub' AS source, root AS target FROM (SELECT DISTINCT root FROM files) UNION ALL
 SELECT root, '/src' || ((CAST(substr(root, 5) AS INT) + 1) % 20) FROM (SELECT DISTINCT root FROM files) UNION ALL
 SELECT root, '/elsewhere/notes' FROM (SELECT DISTINCT root FROM files))"""

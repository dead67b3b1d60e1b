"""Named queries over the corpus, and the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textgraph import collect, schema
from textgraph.functions import paths, text
from textgraph.operators import bookmark, diff, frontmatter, graph, links, regions, registry, store, weave
from textgraph.plans import corpus
from textgraph.sources import discover, tree

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL if it has any."""

    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


files, HOME = corpus.files, corpus.HOME

# --- parts of the SQL -------------------------------------------------------------------------------------------

_LINES = """lines AS (SELECT path, ext, CAST(i AS INT) AS line_no, regexp_replace(parts[i], '\\r$', '') AS line FROM (
 SELECT path, ext, parts, unnest(generate_series(1, len(parts) - CASE WHEN parts[len(parts)] = '' THEN 1 ELSE 0 END)) AS i
 FROM (SELECT path, ext, string_split(content, chr(10)) AS parts FROM files)))"""
_PARSED = """SELECT path, line_no, place, trim(CASE WHEN instr(inner_, '#') > 0 THEN substr(inner_, 1, instr(inner_, '#') - 1) ELSE inner_ END, '  ') AS link,
 nullif(trim(CASE WHEN instr(inner_, '#') > 0 THEN substr(inner_, instr(inner_, '#') + 1) END, '  '), '') AS fragment
 FROM (SELECT path, line_no, CAST(generate_subscripts(found, 1) AS INT) AS place, unnest(found) AS inner_ FROM (
  SELECT path, line_no, regexp_extract_all(body, '\\[\\[(.*?)\\]\\]', 1) AS found FROM {source}))"""
_MD = "md AS (" + _PARSED.format(source="(SELECT path, line_no, line AS body FROM lines WHERE ext = '.md')") + ")"
_COMMENT = "com AS (" + _PARSED.format(source="(SELECT path, line_no, CASE WHEN instr(line, pfx) > 0 THEN substr(line, instr(line, pfx) + length(pfx)) END AS body FROM (SELECT *, CASE ext WHEN '.rs' THEN '//' ELSE '#' END AS pfx FROM lines WHERE ext IN ('.rs', '.py')))") + ")"
_IN_BLOCK = """(SELECT path, line_no, CASE WHEN line_no = b THEN substr(body, 1, instr(body, '*/') - 1) ELSE body END AS body FROM (
 SELECT path, line_no, b, CASE WHEN line_no = a THEN substr(line, instr(line, '/*') + 2) ELSE line END AS body FROM lines
 JOIN (SELECT path AS p, min(line_no) FILTER (line LIKE '%/*%') AS a, min(line_no) FILTER (line LIKE '%*/%') AS b FROM lines WHERE ext = '.rs' GROUP BY path) ON p = path AND line_no BETWEEN a AND b))"""
_BLOCK = "blk AS (" + _PARSED.format(source=_IN_BLOCK) + ")"
#: Of links of code that follow each other with an equal line, link and fragment, the first.
_LINKS = """links AS (SELECT * FROM md UNION ALL SELECT path, line_no, place, link, fragment FROM (
 SELECT *, lag(struct_pack(l := line_no, k := link, f := coalesce('#' || fragment, ''))) OVER (PARTITION BY path ORDER BY line_no, place, link, pass, fragment) AS before FROM (SELECT *, 0 AS pass FROM com UNION ALL SELECT *, 1 FROM blk))
 WHERE before IS DISTINCT FROM struct_pack(l := line_no, k := link, f := coalesce('#' || fragment, '')))"""
_EDGES = f"""edges AS (SELECT path AS source, CASE WHEN link LIKE '~/%' THEN '{HOME}' || substr(link, 2) ELSE link END AS target, fragment FROM links WHERE link LIKE '/%' OR link LIKE '~/%')"""
_KEPT = """kept AS (SELECT DISTINCT source, target, fragment FROM edges WHERE fragment IS NOT NULL UNION ALL SELECT * FROM edges WHERE fragment IS NULL)"""
_TO_EDGES = [corpus.FILES, _LINES, _MD, _COMMENT, _BLOCK, _LINKS, _EDGES]
_MARKED = """marked AS (SELECT path, line_no, line, CASE WHEN body LIKE '@region%' AND trim(substr(body, 8)) <> '' THEN 'region' WHEN body LIKE '@end%' AND trim(substr(body, 5)) <> '' THEN 'end' WHEN body LIKE '|%' THEN 'prose' END AS kind,
 CASE WHEN body LIKE '@region%' THEN trim(substr(body, 8)) WHEN body LIKE '@end%' THEN trim(substr(body, 5)) END AS name, CASE WHEN body LIKE '|%' THEN ltrim(substr(body, 2), ' ') END AS prose
 FROM (SELECT path, line_no, line, CASE WHEN starts_with(trim(line), pfx) THEN trim(substr(trim(line), length(pfx) + 1)) END AS body FROM (SELECT *, CASE ext WHEN '.rs' THEN '//' ELSE '#' END AS pfx FROM lines WHERE ext IN ('.rs', '.py'))))"""
_SPANS = """spans AS (SELECT path AS file, name, line_no AS start_line, coalesce(next_line, last_line) AS end_line, next_line IS NOT NULL AS closed FROM (
 SELECT path, name, kind, line_no, lead(line_no) OVER (PARTITION BY path ORDER BY line_no) AS next_line FROM marked WHERE kind IN ('region', 'end')) m
 JOIN (SELECT path AS p, max(line_no) AS last_line FROM lines GROUP BY path) l ON l.p = m.path WHERE kind = 'region')"""
_PROSE = """blocks AS (SELECT file, name, region_start, min(line_no) AS start_line, string_agg(prose, chr(10) ORDER BY line_no) AS content FROM (
 SELECT s.file, s.name, s.start_line AS region_start, m.line_no, m.prose, m.line_no - row_number() OVER (PARTITION BY s.file, s.name, s.start_line ORDER BY m.line_no) AS island
 FROM spans s JOIN marked m ON m.path = s.file AND m.kind = 'prose' AND m.line_no BETWEEN s.start_line AND s.end_line) GROUP BY file, name, region_start, island)"""
_REGIONS = """regions AS (SELECT s.file, s.name, CAST(s.start_line AS INT) AS start_line, CAST(s.end_line AS INT) AS end_line, nullif(p.prose, '') AS prose FROM spans s LEFT JOIN (
 SELECT file, name, region_start, string_agg(content, chr(10) || chr(10) ORDER BY start_line) AS prose FROM blocks GROUP BY ALL) p ON p.file = s.file AND p.name = s.name AND p.region_start = s.start_line)"""
_TO_REGIONS = [corpus.FILES, _LINES, _MARKED, _SPANS, _PROSE, _REGIONS]
_ATTRS = """attrs AS (SELECT path AS file, 'title' AS key, 'Doc ' || doc_id AS value FROM files WHERE ext = '.md' UNION ALL SELECT path, 'lang', lang FROM files WHERE ext = '.md')"""
_ALL = [*_TO_EDGES, _MARKED, _SPANS, _PROSE, _REGIONS, corpus.ROOTS, _ATTRS]


def _with(parts: list[str], select: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n" + select


_STATUS = "status AS (SELECT coalesce(p.path, c.path) AS path, CASE WHEN p.path IS NULL THEN 'added' WHEN c.path IS NULL THEN 'removed' WHEN p.hash = c.hash THEN 'unchanged' ELSE 'changed' END AS status FROM prev p FULL OUTER JOIN cur c ON p.path = c.path)"
_DIFF = [corpus.FILES, corpus.SNAPSHOTS, _STATUS]


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.edges(links.links(files(spark, sf_dir)), HOME)


def _regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.regions(regions.marked_lines(files(spark, sf_dir)))


def _diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.snapshot_diff(corpus.previous(spark, sf_dir), corpus.current(spark, sf_dir))


# --- scans, filters ---------------------------------------------------------------------------------------------


@query(_with([corpus.FILES], "SELECT path, hash, size, modified, root FROM files"))
def nodes_hash(spark, sf_dir):
    return files(spark, sf_dir).select("path", "hash", "size", "modified", "root")


@query(_with([corpus.FILES], "SELECT path, CASE ext WHEN '.md' THEN 'markdown' WHEN '.rs' THEN 'rust' WHEN '.py' THEN 'python' END AS extractor FROM files"))
def extractor_match(spark, sf_dir):
    return files(spark, sf_dir).select("path", registry.extractor_name(F.col("path")).alias("extractor"))


@query(_with([corpus.FILES], "SELECT path FROM files WHERE ext = '.jpg'"))
def no_extractor_files(spark, sf_dir):
    return files(spark, sf_dir).filter(registry.extractor_name(F.col("path")).isNull()).select("path")


@query(_with([corpus.FILES], "SELECT path, hash FROM files WHERE path = '/src4/4.md'"))
def path_equality(spark, sf_dir):
    return files(spark, sf_dir).filter("path = '/src4/4.md'").select("path", "hash")


# --- links ------------------------------------------------------------------------------------------------------


def _relative(spark, sf_dir):
    """Where the tree lies, and an expression that takes this from a path."""
    seed = corpus.tree(spark, sf_dir)
    base = seed.removesuffix("/hub")
    return seed, lambda c: F.substring(F.col(c), len(base) + 1, 1 << 30)


_DEFINITIONS = f"defined AS (SELECT root || '/textgraph.yaml' AS path, root, {corpus.DEFINED} AS content FROM (SELECT DISTINCT root FROM files))"
_FOUND = "found AS (SELECT path, root, hash, size FROM files WHERE content IS NOT NULL AND NOT (root = '/src0' AND ext = '.jpg') UNION ALL SELECT path, root, sha256(content), CAST(strlen(content) AS BIGINT) FROM defined)"


@query(_with([corpus.FILES, _DEFINITIONS, _FOUND], "SELECT path, root, hash, size FROM found"))
def discovered_files(spark, sf_dir):
    """The files of a tree on disk, as the data source finds them."""
    seed, relative = _relative(spark, sf_dir)
    return tree.read_tree(spark, seed).select(relative("path").alias("path"), relative("root").alias("root"), "hash", "size")


@query(_with([corpus.FILES], "SELECT '/hub' AS path, 'hub' AS name, count(DISTINCT root) + 1 AS refs, 'dangling_ref /nowhere' AS warnings FROM files UNION ALL SELECT DISTINCT root, 'root ' || substr(root, 2), 0, NULL FROM files"))
def discovered_roots(spark, sf_dir):
    """Roots in the plan, the number of their references, and warnings about them."""
    seed = corpus.tree(spark, sf_dir)
    base, plan = seed.removesuffix("/hub"), discover.plan(seed)
    said = {w["path_a"]: f"{w['kind']} {w['path_b'].removeprefix(base)}" for w in plan.warnings}
    return spark.createDataFrame([(r.path.removeprefix(base), r.name, len(r.refs), said.get(r.path)) for r in plan.roots], "path string, name string, refs long, warnings string")


@query(_with([*_ALL, _KEPT, _DEFINITIONS, _FOUND], """SELECT 'nodes' AS name, count(*) AS n FROM found UNION ALL SELECT 'edges', count(*) FROM kept UNION ALL SELECT 'regions', count(*) FROM regions UNION ALL SELECT 'attributes', count(*) FROM attrs
 UNION ALL SELECT 'roots', count(DISTINCT root) + 1 FROM files UNION ALL SELECT 'refs', count(DISTINCT root) + 1 FROM files UNION ALL SELECT 'changelog', count(*) FROM found"""))
def collected_tables(spark, sf_dir):
    """Rows of each table of a new store, after the tree was collected into it twice."""
    seed = corpus.tree(spark, sf_dir)
    path = f"{seed}-store"
    for now in (1.0, 2.0):
        collect.collect(spark, seed, path, home=HOME, now=now)
    t = store.Store(spark, path).tables()
    counts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("name"), "n") for n, df in t.items()]
    return reduce(DataFrame.unionByName, counts)


@query(_with([corpus.FILES, _LINES], "SELECT path, line_no, line FROM lines"))
def file_lines(spark, sf_dir):
    return links.file_lines(files(spark, sf_dir))


@query(_with([corpus.FILES, _LINES, _MD], "SELECT * FROM md"))
def links_raw(spark, sf_dir):
    return links.raw_links(links.file_lines(files(spark, sf_dir).filter("ext = '.md'")))


@query(_with([corpus.FILES, _LINES, _COMMENT], "SELECT * FROM com"))
def comment_links(spark, sf_dir):
    return links.comment_links(files(spark, sf_dir))


@query(_with([corpus.FILES, _LINES, _BLOCK], "SELECT * FROM blk"))
def block_comment_links(spark, sf_dir):
    return links.block_links(files(spark, sf_dir))


@query(_with([*_TO_EDGES], "SELECT path, line_no, place, link, fragment FROM links"))
def links_deduplicated(spark, sf_dir):
    return links.links(files(spark, sf_dir))


@query(_with(_TO_EDGES, "SELECT * FROM edges"))
def edges_all(spark, sf_dir):
    return _edges(spark, sf_dir)


@query(_with([*_TO_EDGES, _KEPT], "SELECT * FROM kept"))
def edges_dedup_nullaware(spark, sf_dir):
    return links.insert_edges(_edges(spark, sf_dir))


@query(_with(_TO_EDGES, "SELECT DISTINCT * FROM edges"))
def edges_distinct(spark, sf_dir):
    return _edges(spark, sf_dir).distinct()


@query(_with(_TO_EDGES, "SELECT e.* FROM edges e WHERE EXISTS (SELECT 1 FROM files f WHERE f.path = e.target)"))
def edges_resolved(spark, sf_dir):
    return diff.resolved(_edges(spark, sf_dir), files(spark, sf_dir))


@query(_with(_TO_EDGES, "SELECT e.* FROM edges e WHERE NOT EXISTS (SELECT 1 FROM files f WHERE f.path = e.target)"))
def edges_dangling(spark, sf_dir):
    return diff.dangling(_edges(spark, sf_dir), files(spark, sf_dir))


@query(_with(_TO_EDGES, "SELECT DISTINCT e.target AS path FROM edges e JOIN files f ON f.path = e.target"))
def resolved_targets(spark, sf_dir):
    return diff.resolved_targets(_edges(spark, sf_dir), files(spark, sf_dir))


@query(_with(_ALL, "SELECT e.source, e.target, e.fragment, EXISTS (SELECT 1 FROM regions r WHERE r.file = e.target AND r.name = e.fragment) AS found FROM edges e WHERE fragment IS NOT NULL"))
def fragment_check(spark, sf_dir):
    return diff.fragment_check(_edges(spark, sf_dir), _regions(spark, sf_dir))


# --- regions ----------------------------------------------------------------------------------------------------


@query(_with(_TO_REGIONS, "SELECT * FROM regions"))
def regions_all(spark, sf_dir):
    return _regions(spark, sf_dir)


@query(_with(_TO_REGIONS, "SELECT file, name, CAST(start_line AS INT) AS start_line, CAST(end_line AS INT) AS end_line FROM spans WHERE NOT closed"))
def regions_unclosed(spark, sf_dir):
    return regions.spans(regions.marked_lines(files(spark, sf_dir))).filter("not closed").select("file", "name", F.col("start_line").cast("int"), F.col("end_line").cast("int"))


@query(_with(_TO_REGIONS, "SELECT file, name, CAST(region_start AS INT) AS region_start, CAST(start_line AS INT) AS start_line, content FROM blocks"))
def prose_blocks(spark, sf_dir):
    return regions.prose_blocks(regions.marked_lines(files(spark, sf_dir))).withColumn("region_start", F.col("region_start").cast("int")).withColumn("start_line", F.col("start_line").cast("int"))


@query(_with(_TO_REGIONS, "SELECT file, name, prose FROM regions WHERE prose IS NOT NULL AND prose <> ''"))
def regions_with_prose(spark, sf_dir):
    return _regions(spark, sf_dir).filter("prose is not null and prose <> ''").select("file", "name", "prose")


_BAD = "replace(concat('// @region a\n// @region b\n// @end\n// @end b\n// @region a\n// @end a ', lang), '//', CASE ext WHEN '.py' THEN '#' ELSE '//' END)"


@query(_with([corpus.FILES], "SELECT path AS file, kind, name, line_no FROM files, (VALUES ('nested', 'b', 2), ('duplicate', 'a', 5)) v(kind, name, line_no) WHERE ext IN ('.rs', '.py')"))
def region_violations(spark, sf_dir):
    broken = files(spark, sf_dir).withColumn("content", F.expr(_BAD))
    return regions.violations(regions.marked_lines(broken))


# --- frontmatter ------------------------------------------------------------------------------------------------


@query(_with([corpus.FILES, _ATTRS], "SELECT * FROM attrs"))
def frontmatter_attrs(spark, sf_dir):
    return frontmatter.flat_attributes(files(spark, sf_dir))


@query(_with([corpus.FILES, _ATTRS], "SELECT * FROM attrs"))
def frontmatter_yaml(spark, sf_dir):
    return frontmatter.yaml_attributes(files(spark, sf_dir))


_NESTED = "concat('\n---\ntags: [x, [', lang, ', 1.50], true]\nn: ', doc_id, '\nnone: null\nwords: \"a: ', lang, '\"\n---\nname: no\n')"


@query("SELECT '/' || doc_id || '.md' AS file, key, value FROM documents, LATERAL (VALUES ('tags', '[x, [' || lang || ', 1.5], true]'), ('n', CAST(doc_id AS VARCHAR)), ('none', 'null'), ('words', 'a: ' || lang)) v(key, value)")
def frontmatter_nested(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select(F.concat(F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.expr(_NESTED).alias("content"))
    return frontmatter.yaml_attributes(docs)


@query(_with([corpus.FILES], "SELECT path AS file, 'Doc ' || doc_id AS title, lang FROM files WHERE ext = '.md'"))
def attrs_wide(spark, sf_dir):
    return frontmatter.wide(frontmatter.flat_attributes(files(spark, sf_dir)), ["title", "lang"])


# --- paths ------------------------------------------------------------------------------------------------------

_PATHS = {"/a/b/../c": "/a/c", "/a/./b//c/": "/a/b/c", "/../a": "/a", "~/x": f"{HOME}/x", "~": HOME, "~bob/x": None, "rel/x": None, "/": "/"}


@query("SELECT raw, path FROM (VALUES " + ", ".join(f"('{k}', {'NULL' if v is None else repr(v)})" for k, v in _PATHS.items()) + ") t(raw, path)")
def path_clean(spark, sf_dir):
    return spark.createDataFrame([(k,) for k in _PATHS], "raw string").select("raw", paths.node_path(F.col("raw"), HOME).alias("path"))


@query(_with([corpus.FILES, corpus.ROOTS], "SELECT f.path, coalesce((SELECT r.name || substr(f.path, length(r.path) + 1) FROM roots r WHERE starts_with(f.path, r.path) ORDER BY r.path LIMIT 1), f.path) AS short FROM files f"))
def short_path(spark, sf_dir):
    return graph.short_paths(files(spark, sf_dir), corpus.roots(spark, sf_dir))


@query("SELECT page_id, CASE WHEN url LIKE '%/src/%' THEN string_split(url, '/src/')[-1] ELSE string_split(url, '/')[-1] END AS short FROM pages")
def short_path_weave(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", paths.short_source(F.col("url")).alias("short"))


# --- diff and store ---------------------------------------------------------------------------------------------


@query(_with(_DIFF, "SELECT * FROM status"))
def snapshot_diff(spark, sf_dir):
    return _diff(spark, sf_dir)


@query(_with(_DIFF, "SELECT status, count(*) AS files FROM status GROUP BY status"))
def diff_counts(spark, sf_dir):
    return _diff(spark, sf_dir).groupBy("status").agg(F.count(F.lit(1)).alias("files"))


@query(_with(_DIFF, "SELECT path FROM status WHERE status IN ('added', 'changed')"))
def work_set(spark, sf_dir):
    return diff.work_set(_diff(spark, sf_dir))


@query(_with([*_TO_EDGES, corpus.SNAPSHOTS, _STATUS], "SELECT path FROM status WHERE status = 'removed' AND path IN (SELECT target FROM edges WHERE target IN (SELECT path FROM files))"))
def broken_targets(spark, sf_dir):
    return diff.broken_targets(_diff(spark, sf_dir), diff.resolved_targets(_edges(spark, sf_dir), files(spark, sf_dir)))


@query(_with([corpus.FILES, corpus.ROOTS], "SELECT path, name FROM roots WHERE path NOT IN (SELECT root FROM files WHERE doc_id % 20 < 15)"))
def stale_roots(spark, sf_dir):
    return diff.stale_roots(corpus.roots(spark, sf_dir), files(spark, sf_dir).filter("doc_id % 20 < 15").select(F.col("root").alias("path")).distinct())


@query(_with(_DIFF, "SELECT path, hash, size, modified, root FROM prev WHERE path NOT IN (SELECT path FROM cur) UNION ALL SELECT path, hash, size, modified, root FROM cur"))
def merge_nodes(spark, sf_dir):
    cols = ["path", "hash", "size", "modified", "root"]
    return store.upsert(corpus.previous(spark, sf_dir).select(*cols), corpus.current(spark, sf_dir).select(*cols), ["path"]).select(*cols)


@query(_with([*_TO_EDGES, corpus.SNAPSHOTS, _STATUS], "SELECT * FROM edges WHERE source NOT IN (SELECT path FROM status WHERE status = 'removed')"))
def cascade_delete(spark, sf_dir):
    gone = _diff(spark, sf_dir).filter("status = 'removed'").select("path")
    return store.remove_files({"edges": _edges(spark, sf_dir)}, gone)["edges"]


@query(_with(_DIFF, "SELECT CAST(5 AS DOUBLE) AS timestamp, status AS action, 'node' AS kind, path AS path_a, CAST(NULL AS VARCHAR) AS path_b FROM status WHERE status IN ('added', 'removed')"))
def changelog_append(spark, sf_dir):
    return store.changes(_diff(spark, sf_dir), 5.0)


_SPLIT = _with(_TO_EDGES, "SELECT 'removed' AS action, * FROM (SELECT * FROM edges WHERE source NOT LIKE '/src1/%' EXCEPT ALL SELECT * FROM edges WHERE source NOT LIKE '/src2/%') UNION ALL SELECT 'added', * FROM (SELECT * FROM edges WHERE source NOT LIKE '/src2/%' EXCEPT ALL SELECT * FROM edges WHERE source NOT LIKE '/src1/%')")


@query(_SPLIT)
def edge_diff(spark, sf_dir):
    e = _edges(spark, sf_dir)
    return diff.edge_diff(e.filter("source not like '/src1/%'"), e.filter("source not like '/src2/%'"))


@query(_with([corpus.FILES, corpus.ROOTS], "SELECT source, target FROM refs WHERE source <> '/src3'"))
def remove_root(spark, sf_dir):
    t = {"roots": corpus.roots(spark, sf_dir), "refs": corpus.refs(spark, sf_dir)}
    gone = t["roots"].filter("path = '/src3'")
    return store.replace_roots(t, schema.empty(spark, "roots"), schema.empty(spark, "refs"), gone)["refs"]


# --- reads ------------------------------------------------------------------------------------------------------


@query(_with([corpus.FILES], "SELECT path, modified FROM files WHERE path LIKE '%/src1_/%' ORDER BY modified DESC, path LIMIT 50"))
def find_wildcard(spark, sf_dir):
    return graph.find(files(spark, sf_dir), "/SRC1_/")


@query("SELECT p_partkey, p_name FROM part WHERE lower(p_name) LIKE '%ar%' ORDER BY p_partkey DESC LIMIT 50")
def find_like(spark, sf_dir):
    p = _table(spark, sf_dir, "part")
    return p.filter(text.like_anywhere(F.col("p_name"), "AR")).orderBy(F.desc("p_partkey")).limit(50).select("p_partkey", "p_name")


@query(_with([corpus.FILES, corpus.ROOTS], "SELECT path, name FROM roots"))
def roots_list(spark, sf_dir):
    return corpus.roots(spark, sf_dir).orderBy("path")


@query(_with(_ALL, "SELECT (SELECT count(*) FROM files) AS nodes, (SELECT count(*) FROM edges) AS edges, (SELECT count(*) FROM regions) AS regions, (SELECT count(*) FROM roots) AS roots"))
def table_counts(spark, sf_dir):
    return graph.table_counts(files(spark, sf_dir), _edges(spark, sf_dir), _regions(spark, sf_dir), corpus.roots(spark, sf_dir))


@query(_with([corpus.FILES, corpus.ROOTS], "SELECT r.path, r.name, count(f.path) AS files FROM roots r LEFT JOIN files f ON f.root = r.path GROUP BY r.path, r.name"))
def files_per_root(spark, sf_dir):
    return graph.files_per_root(files(spark, sf_dir), corpus.roots(spark, sf_dir))


@query(_with([corpus.FILES, corpus.ROOTS], "SELECT f.source AS path, string_agg(coalesce(r.name, string_split(f.target, '/')[-1]), ', ' ORDER BY f.target) AS refs FROM refs f LEFT JOIN roots r ON r.path = f.target GROUP BY f.source"))
def refs_per_root(spark, sf_dir):
    return graph.refs_per_root(corpus.roots(spark, sf_dir), corpus.refs(spark, sf_dir))


@query(_with([*_TO_EDGES, _KEPT], "SELECT target, count(*) AS links FROM kept GROUP BY target ORDER BY links DESC, target LIMIT 10"))
def hubs_topk(spark, sf_dir):
    return graph.hubs(links.insert_edges(_edges(spark, sf_dir)))


@query(_with(_TO_EDGES, "SELECT path, modified FROM files WHERE path NOT IN (SELECT source FROM edges) AND path NOT IN (SELECT target FROM edges) ORDER BY modified DESC, path LIMIT 15"))
def orphans(spark, sf_dir):
    return graph.orphans(files(spark, sf_dir), _edges(spark, sf_dir))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def orders_without_items(spark, sf_dir):
    items = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return _table(spark, sf_dir, "orders").join(items, "o_orderkey", "left_anti").select("o_orderkey")


@query(_with(_TO_EDGES, "SELECT target AS path, count(*) AS links FROM edges GROUP BY target"))
def in_degree(spark, sf_dir):
    return graph.degrees(_edges(spark, sf_dir), "target")


@query(_with(_TO_EDGES, "SELECT source AS path, count(*) AS links FROM edges GROUP BY source"))
def out_degree(spark, sf_dir):
    return graph.degrees(_edges(spark, sf_dir), "source")


@query(_with(_TO_REGIONS, "SELECT file, name, start_line, end_line, CAST(length(prose) AS BIGINT) AS prose_chars FROM regions"))
def region_index(spark, sf_dir):
    return graph.region_index(_regions(spark, sf_dir))


@query(_with(_TO_REGIONS, "SELECT file, count(*) AS regions, string_agg(name || CASE WHEN prose IS NOT NULL THEN ' *' ELSE '' END, ', ' ORDER BY start_line) AS names FROM regions GROUP BY file"))
def region_summary(spark, sf_dir):
    return graph.region_summary(_regions(spark, sf_dir))


@query(_with(_TO_REGIONS, "SELECT * FROM regions WHERE name = 'alpha' ORDER BY file LIMIT 1"))
def region_by_name(spark, sf_dir):
    return graph.region_by_name(_regions(spark, sf_dir), "alpha")


@query(_with(_ALL, "SELECT (SELECT count(*) FROM files) AS nodes, (SELECT count(*) FROM edges) AS edges, count(*) AS regions, count(*) FILTER (prose IS NOT NULL AND prose <> '') AS with_prose FROM regions"))
def weave_stats(spark, sf_dir):
    return graph.weave_stats(files(spark, sf_dir), _edges(spark, sf_dir), _regions(spark, sf_dir))


@query("SELECT strftime(ts, '%Y-%m-%d %H:%M') AS time, 'added' AS action, event_type AS kind, CAST(event_id AS VARCHAR) AS path_a, CAST(NULL AS VARCHAR) AS path_b FROM events ORDER BY ts DESC LIMIT 10")
def recent_activity(spark, sf_dir):
    log = _table(spark, sf_dir, "events").select((F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("timestamp"), F.lit("added").alias("action"), F.col("event_type").alias("kind"), F.col("event_id").cast("string").alias("path_a"), F.lit(None).cast("string").alias("path_b"))
    return graph.recent(log)


_NODE = "/src4/4.md"


@query(_with([corpus.FILES, corpus.ROOTS], f"SELECT f.path, r.name AS root_name, strftime(to_timestamp(f.modified) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M') AS modified, format('{{:,}}', f.size) AS size, left(f.hash, 12) AS hash FROM files f JOIN roots r ON r.path = f.root WHERE f.path = '{_NODE}'"))
def node_header(spark, sf_dir):
    return graph.node_header(files(spark, sf_dir), corpus.roots(spark, sf_dir), _NODE)


@query(_with(_TO_EDGES, f"SELECT target, fragment FROM edges WHERE source = '{_NODE}'"))
def node_outgoing(spark, sf_dir):
    return graph.outgoing(_edges(spark, sf_dir), _NODE)


@query(_with(_TO_EDGES, f"SELECT source, fragment FROM edges WHERE target = '{_NODE}'"))
def node_incoming(spark, sf_dir):
    return graph.incoming(_edges(spark, sf_dir), _NODE)


@query(_with(_TO_REGIONS, "SELECT * FROM regions WHERE file = '/src5/5.rs'"))
def node_regions(spark, sf_dir):
    return graph.node_regions(_regions(spark, sf_dir), "/src5/5.rs")


@query(_with([corpus.FILES, _ATTRS], f"SELECT key, value FROM attrs WHERE file = '{_NODE}'"))
def node_attributes(spark, sf_dir):
    return graph.node_attributes(frontmatter.yaml_attributes(files(spark, sf_dir)), _NODE)


@query(_with([corpus.FILES], "SELECT path, CAST(row_number() OVER (ORDER BY modified DESC, path) AS INT) AS rank FROM (SELECT path, modified FROM files WHERE path LIKE '%/src7/%' ORDER BY modified DESC, path LIMIT 5)"))
def node_resolve(spark, sf_dir):
    return graph.resolve(files(spark, sf_dir), "/src7/")


@query(_with([corpus.FILES, corpus.ROOTS], "SELECT path, min(hops) AS hops FROM (WITH RECURSIVE w(path, hops) AS (SELECT '/src0', 0 UNION SELECT r.target, w.hops + 1 FROM w JOIN refs r ON r.source = w.path WHERE w.hops < 3) SELECT * FROM w) GROUP BY path"))
def reachable_three_hops(spark, sf_dir):
    return graph.reachable(corpus.refs(spark, sf_dir), spark.createDataFrame([("/src0",)], "path string"), 3)


# --- documents --------------------------------------------------------------------------------------------------

_SLICE = """{name} AS (SELECT file, name, string_agg(regexp_replace(line, '\\s+$', ''), chr(10) ORDER BY line_no) AS code FROM (
 SELECT *, min(CASE WHEN NOT blank THEN line_no END) OVER (PARTITION BY file, name) AS a, max(CASE WHEN NOT blank THEN line_no END) OVER (PARTITION BY file, name) AS b FROM (
 SELECT r.file, r.name, l.line_no, l.line, regexp_matches(l.line, '^\\s*$') AS blank FROM regions r JOIN lines l ON l.path = r.file AND l.line_no BETWEEN r.start_line AND r.end_line
 WHERE NOT regexp_matches(trim(l.line), '{mark}') AND NOT regexp_matches(l.line, '^\\s*(//|#)\\|'))) WHERE line_no BETWEEN a AND b GROUP BY file, name)"""
_CODE = _SLICE.format(name="code", mark="^[%#/]*\\s*@(region|end)\\s")
_LOOSE = _SLICE.format(name="loose", mark="@(region|end) ")
_LANGUAGE = "CASE WHEN {0} LIKE '%.rs' THEN 'rust' WHEN {0} LIKE '%.py' THEN 'python' ELSE '' END"
#: What follows the first root that begins a path; else its last three components.
_SHORT = """short AS (SELECT path, coalesce((SELECT arg_min(ltrim(substr(n.path, length(r.path) + 1), '/'), r.path) FROM roots r WHERE starts_with(n.path, r.path)),
 CASE WHEN len(string_split(path, '/')) > 3 THEN '…/' || array_to_string(string_split(path, '/')[-3:], '/') ELSE path END) AS short FROM (SELECT file AS path FROM regions UNION SELECT target FROM edges) n)"""


@query(_with([*_TO_REGIONS, _CODE], "SELECT * FROM code"))
def region_code(spark, sf_dir):
    f = files(spark, sf_dir)
    return weave.region_code(regions.regions(regions.marked_lines(f)), links.file_lines(f))


@query(_with([*_TO_REGIONS, _LOOSE], "SELECT * FROM loose"))
def region_code_loose(spark, sf_dir):
    f = files(spark, sf_dir)
    return weave.region_code(regions.regions(regions.marked_lines(f)), links.file_lines(f), loose=True)


def _root_paths(spark, sf_dir) -> list[str]:
    return [r["path"] for r in corpus.roots(spark, sf_dir).orderBy("path").collect()]  # listed by hand


@query(_with([*_ALL, _LOOSE, _SHORT], f"""SELECT p.file, '# ' || s.short || chr(10) || chr(10) || coalesce('*Connects to:* ' || l.links || chr(10) || chr(10), '') || '---' || chr(10) || chr(10) || p.body AS document FROM (
 SELECT r.file, string_agg('## ' || r.name || chr(10) || chr(10) || coalesce(r.prose || chr(10) || chr(10), '') || coalesce('```' || {_LANGUAGE.format('r.file')} || chr(10) || c.code || chr(10) || '```' || chr(10) || chr(10), ''), '' ORDER BY r.start_line) AS body
 FROM regions r LEFT JOIN loose c ON c.file = r.file AND c.name = r.name GROUP BY r.file) p JOIN short s ON s.path = p.file
 LEFT JOIN (SELECT e.source, string_agg('`' || t.short || coalesce('#' || e.fragment, '') || '`', ', ' ORDER BY e.target, e.fragment NULLS FIRST) AS links FROM edges e JOIN short t ON t.path = e.target GROUP BY e.source) l ON l.source = p.file"""))
def literate_document(spark, sf_dir):
    f = files(spark, sf_dir)
    r = regions.regions(regions.marked_lines(f))
    return weave.literate(r, weave.region_code(r, links.file_lines(f), loose=True), _edges(spark, sf_dir), _root_paths(spark, sf_dir))


_INCLUDED = "included AS (SELECT path, coalesce(string_agg(CASE WHEN NOT regexp_matches(trim(line), '^[%#/]*\\s*@(region|end)\\s') THEN regexp_replace(line, '\\s+$', '') END, chr(10) ORDER BY line_no), '') AS code FROM lines GROUP BY path)"
_INDEX = """idx AS (SELECT '| File | Region | Lines | Prose |' || chr(10) || '|------|--------|-------|-------|' || coalesce(chr(10) || string_agg('| `' || CASE WHEN file LIKE '%/src/%' THEN string_split(file, '/src/')[-1] ELSE string_split(file, '/')[-1] END || '` | `' || name || '` | ' || start_line || '–' || end_line || ' | ' || CASE WHEN length(prose) > 0 THEN length(prose) || ' ch' ELSE '—' END || ' |', chr(10) ORDER BY file, start_line), '') AS text FROM regions)"""
_FIRST = "one AS (SELECT r.name, r.file, r.prose, c.code FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY file) AS n FROM regions) r LEFT JOIN code c ON c.file = r.file AND c.name = r.name WHERE r.n = 1)"
_TEMPLATE = "# Title\n{{stats}}\n  {{prose:alpha}}\n{{code:body}}\n```\n  {{code:tail}}\n  {{file:nope}}\n```\n{{region:nope}}\n{{prose}}\n{{odd:x}}\nkeep {{stats}} here\n {{region:alpha}}\n{{index}}\n{{file:/src1/1.rs}}\n{{file:/none}}\n{{file}}\n"


def _of(kind: str, name: str) -> str:
    return f"(SELECT {kind} FROM one WHERE name = '{name}')"


def _in_fence(name: str) -> str:
    return f"(SELECT '```' || {_LANGUAGE.format('file')} || chr(10) || code || chr(10) || '```' FROM one WHERE name = '{name}')"


_WOVEN = " || chr(10) || ".join(
    [
        "'# Title'",
        "(SELECT '**' || (SELECT count(*) FROM files) || '** files · **' || (SELECT count(*) FROM edges) || '** edges · **' || count(*) || '** regions · **' || count(prose) || '** with prose' FROM regions)",
        f"'  ' || replace({_of('prose', 'alpha')} || chr(10), chr(10), chr(10) || '  ')",
        _in_fence("body"),
        "'```'",
        f"'  ' || replace({_of('code', 'tail')}, chr(10), chr(10) || '  ')",
        "'  % [region not found: nope]'",
        "'```'",
        "'*[region not found: nope]*'",
        "'*[missing region name in {{prose}}]*'",
        "'*[unknown directive: odd:x]*'",
        "'keep {{stats}} here'",
        f"' ' || replace({_of('prose', 'alpha')} || chr(10) || chr(10) || {_in_fence('alpha')}, chr(10), chr(10) || ' ')",
        "(SELECT text FROM idx)",
        "(SELECT code FROM included WHERE path = '/src1/1.rs')",
        "'*[file not found: /none]*'",
        "'*[missing path in {{file:}}]*'",
        "''",
    ]
)


@query(_with([*_ALL, _CODE, _INCLUDED, _INDEX, _FIRST], f"SELECT 'doc' AS path, {_WOVEN} AS document"))
def weave_expand(spark, sf_dir):
    f = files(spark, sf_dir)
    lines, r = links.file_lines(f), regions.regions(regions.marked_lines(f))
    t = spark.createDataFrame([("doc", _TEMPLATE)], "path string, content string")
    return weave.expand(weave.template_lines(t), lines, r, graph.weave_stats(f, _edges(spark, sf_dir), r))


@query(_with([corpus.FILES, _LINES, _INCLUDED], "SELECT path, code FROM included"))
def file_include(spark, sf_dir):
    return weave.file_include(links.file_lines(files(spark, sf_dir)))


_TEMPLATE_LINES = "tl AS (SELECT path, CAST(i AS INT) AS line_no, parts[i] AS line, regexp_replace(parts[i], '^\\s+|\\s+$', '', 'g') AS bare FROM (SELECT path, parts, unnest(generate_series(1, len(parts))) AS i FROM (SELECT path, string_split(content, chr(10)) AS parts FROM files WHERE ext = '.md')))"
_KINDS = r"""kinds AS (SELECT *, CASE WHEN fence AND open THEN 'code' WHEN fence THEN 'close' WHEN open THEN 'inside' WHEN bare = '' THEN 'blank' WHEN bare IN ('---', '***', '___') THEN 'hr' WHEN bare LIKE '# %' THEN 'h1' WHEN bare LIKE '## %' THEN 'h2'
 WHEN bare LIKE '### %' THEN 'h3' WHEN regexp_matches(bare, '^\{\{\w+(:[^}]+)?\}\}$') THEN 'directive' ELSE 'para' END AS kind
 FROM (SELECT *, sum(CASE WHEN fence THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY line_no) % 2 = 1 AS open FROM (SELECT *, starts_with(bare, '```') AS fence FROM tl)))"""
_BLOCKS = r"""numbered AS (SELECT *, sum(CASE WHEN starts THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY line_no) AS block_no FROM (
 SELECT *, kind NOT IN ('blank', 'close') AND NOT (kind = 'inside' OR kind = 'para' AND NOT starts_with(bare, '#') AND coalesce(lag(kind) OVER w = 'para' AND NOT starts_with(lag(bare) OVER w, '#'), false)) AS starts FROM kinds WINDOW w AS (PARTITION BY path ORDER BY line_no)))"""


@query(_with([corpus.FILES, _TEMPLATE_LINES, _KINDS, _BLOCKS], r"""SELECT path, CAST(block_no AS INT) AS block_no, min(line_no) AS line_no, arg_min(kind, line_no) AS block,
 CASE arg_min(kind, line_no) WHEN 'code' THEN trim(substr(arg_min(bare, line_no), 4)) WHEN 'directive' THEN regexp_extract(arg_min(bare, line_no), '\w+') END AS label,
 CASE arg_min(kind, line_no) WHEN 'code' THEN coalesce(string_agg(CASE WHEN kind = 'inside' THEN line END, chr(10) ORDER BY line_no), '') WHEN 'para' THEN string_agg(bare, ' ' ORDER BY line_no)
  WHEN 'directive' THEN nullif(regexp_extract(arg_min(bare, line_no), ':([^}]+)', 1), '') WHEN 'hr' THEN NULL ELSE trim(regexp_replace(arg_min(bare, line_no), '^#+ ', '')) END AS text
 FROM numbered WHERE kind NOT IN ('blank', 'close') GROUP BY path, block_no"""))
def markdown_blocks(spark, sf_dir):
    return weave.blocks(weave.template_lines(files(spark, sf_dir).filter("ext = '.md'")))


@query("""SELECT item_id, regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '`([^`]+)`', '<font face="Courier" size="9">\\1</font>', 'g'), '\\*\\*([^*]+)\\*\\*', '<b>\\1</b>', 'g'), '\\*([^*]+)\\*', '<i>\\1</i>', 'g') AS markup
 FROM (SELECT item_id, replace(replace('`a` **b** *c* & ' || text, ' the ', ' *the* '), '.', '** **x**<') AS text FROM benchmark)""")
def inline_markup(spark, sf_dir):
    marked = F.replace(F.replace(F.concat(F.lit("`a` **b** *c* & "), "text"), F.lit(" the "), F.lit(" *the* ")), F.lit("."), F.lit("** **x**<"))
    return _table(spark, sf_dir, "benchmark").select("item_id", weave.inline_markup(marked).alias("markup"))


# --- pages and bookmarks ----------------------------------------------------------------------------------------

_HREFS = "hrefs AS (SELECT page_id, CAST(generate_subscripts(found, 1) - 1 AS INT) AS at, unnest(found) AS href FROM (SELECT page_id, regexp_extract_all(html, 'href=\"([^\"]*)\"', 1) AS found FROM pages))"


@query(_with([_HREFS], "SELECT * FROM hrefs"))
def page_links(spark, sf_dir):
    return bookmark.page_links(_table(spark, sf_dir, "pages"))


@query(_with([_HREFS], "SELECT href AS target, count(*) AS links FROM hrefs GROUP BY href ORDER BY links DESC, target LIMIT 10"))
def page_hubs(spark, sf_dir):
    return graph.hubs(bookmark.page_links(_table(spark, sf_dir, "pages")).select(F.col("href").alias("target")))


_SLUG = "left(regexp_replace(regexp_replace(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 80)"


@query("SELECT conv_id, turn, " + _SLUG.format("text") + " AS slug FROM conversations")
def slugify(spark, sf_dir):
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", bookmark.slug(F.col("text")).alias("slug"))


@query("SELECT p_partkey, '[\"' || replace(p_name, ' ', '\", \"') || '\"]' AS tags FROM part")
def tags_yaml(spark, sf_dir):
    return _table(spark, sf_dir, "part").select("p_partkey", bookmark.tags_yaml(bookmark.tags(F.col("p_name"))).alias("tags"))


_PAGE_TEXT = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script>', ' ', 'g'), '(?is)<style\b.*?</style>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))"


@query("SELECT page_id, '---' || chr(10) || 'title: \"Page ' || page_id || '\"' || chr(10) || 'url: \"' || url || '\"' || chr(10) || 'date: \"2023-11-14T22:13:20+00:00\"' || chr(10) || 'tags: [\"page\", \"web\"]' || chr(10) || '---' || chr(10) || chr(10) || " + _PAGE_TEXT + " || chr(10) AS document, '2023/11/14' AS folder FROM pages")
def bookmark_document(spark, sf_dir):
    when = F.lit(1700000000)
    title, found = F.concat(F.lit("Page "), F.col("page_id").cast("string")), F.array(F.lit("page"), F.lit("web"))
    return _table(spark, sf_dir, "pages").select("page_id", bookmark.document(title, F.col("url"), when, found, bookmark.page_text(F.col("html"))).alias("document"), bookmark.date_path(when).alias("folder"))


@query(f"SELECT page_id, {_PAGE_TEXT} AS text FROM pages")
def page_text(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", bookmark.page_text(F.col("html")).alias("text"))


@query("SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title FROM pages")
def page_titles(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", bookmark.page_title(F.col("html")).alias("title"))


@query("SELECT n_name AS title, 'tag' || (n_nationkey % 5) || ',two words,Name,last' AS tags FROM nation")
def tag_lookup(spark, sf_dir):
    n = _table(spark, sf_dir, "nation")
    url = F.concat(F.lit("http://feed/"), F.col("n_name"), F.lit("/rss"))
    feeds = n.select(F.col("n_name").alias("title"), url.alias("url"))
    tail = F.concat(F.lit('"tag'), (F.col("n_nationkey") % 5).cast("string"), F.lit('"  "two words" ~"Name" !hidden\t#note "~no" last "open'))
    urls = n.select(F.col("n_nationkey").alias("line_no"), F.concat(url, F.lit(" "), tail).alias("line"))
    return bookmark.tag_lookup(feeds.select("title"), feeds, urls).select("title", F.array_join("tags", ",").alias("tags"))

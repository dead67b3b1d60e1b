"""Read queries over the store's tables.  Every top-k has a full order, so results are the same each time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textgraph.functions import paths, text

FIND, HUBS, ORPHANS, RECENT, CANDIDATES = 50, 10, 15, 10, 5


def find(nodes: DataFrame, query: str, limit: int = FIND) -> DataFrame:
    """Paths that contain the query, the most recent first."""
    return nodes.filter(text.like_anywhere(F.col("path"), query)).orderBy(F.desc("modified"), "path").limit(limit).select("path", "modified")


def table_counts(nodes: DataFrame, edges: DataFrame, regions: DataFrame, roots: DataFrame) -> DataFrame:
    out = None
    for name, df in (("nodes", nodes), ("edges", edges), ("regions", regions), ("roots", roots)):
        one = df.agg(F.count(F.lit(1)).alias(name))
        out = one if out is None else out.crossJoin(one)  # one row each
    return out


def files_per_root(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """path, name, files of all roots; a hub has none."""
    counts = nodes.groupBy("root").agg(F.count(F.lit(1)).alias("files"))
    return roots.join(counts, roots.path == counts.root, "left").select("path", "name", F.coalesce("files", F.lit(0)).alias("files"))


def refs_per_root(roots: DataFrame, refs: DataFrame) -> DataFrame:
    """path, names of the roots it refers to (or the last component of what isn't a root)."""
    named = refs.join(roots.select(F.col("path").alias("target"), "name"), "target", "left")
    label = F.coalesce("name", paths.base_name(F.col("target")))
    return named.select(F.col("source").alias("path"), label.alias("label"), "target").groupBy("path").agg(F.expr("listagg(label, ', ') WITHIN GROUP (ORDER BY target)").alias("refs"))


def hubs(edges: DataFrame, limit: int = HUBS) -> DataFrame:
    return edges.groupBy("target").agg(F.count(F.lit(1)).alias("links")).orderBy(F.desc("links"), "target").limit(limit)


def orphans(nodes: DataFrame, edges: DataFrame, definition: str = "textgraph.yaml", limit: int = ORPHANS) -> DataFrame:
    """Files that no link touches, definition files apart, the most recent first."""
    alone = nodes.join(edges.select(F.col("source").alias("path")), "path", "left_anti").join(edges.select(F.col("target").alias("path")), "path", "left_anti")
    return alone.filter(~text.ascii_lower(F.col("path")).endswith(definition.lower())).orderBy(F.desc("modified"), "path").limit(limit).select("path", "modified")


def degrees(edges: DataFrame, end: str) -> DataFrame:
    """path and its number of links, by their source (out) or target (in)."""
    return edges.groupBy(F.col(end).alias("path")).agg(F.count(F.lit(1)).alias("links"))


def region_index(regions: DataFrame) -> DataFrame:
    return regions.select("file", "name", "start_line", "end_line", F.char_length("prose").cast("long").alias("prose_chars"))


def region_summary(regions: DataFrame) -> DataFrame:
    """file and its regions in order, each marked if it has prose."""
    mark = F.concat("name", F.when(F.col("prose").isNotNull(), " *").otherwise(""))
    return regions.withColumn("mark", mark).groupBy("file").agg(F.count(F.lit(1)).alias("regions"), F.expr("listagg(mark, ', ') WITHIN GROUP (ORDER BY start_line)").alias("names"))


def region_by_name(regions: DataFrame, name: str) -> DataFrame:
    """The region of this name; of several files, that of the first path."""
    return regions.filter(F.col("name") == name).orderBy("file").limit(1)


def weave_stats(nodes: DataFrame, edges: DataFrame, regions: DataFrame) -> DataFrame:
    prose = regions.agg(F.count(F.lit(1)).alias("regions"), F.count_if(F.col("prose").isNotNull() & (F.col("prose") != "")).alias("with_prose"))
    return nodes.agg(F.count(F.lit(1)).alias("nodes")).crossJoin(edges.agg(F.count(F.lit(1)).alias("edges"))).crossJoin(prose)


def recent(changelog: DataFrame, limit: int = RECENT) -> DataFrame:
    """The latest changes, with their time as text in the session's time zone."""
    top = changelog.orderBy(F.desc("timestamp"), "path_a").limit(limit)
    return top.select(F.date_format(F.timestamp_seconds("timestamp"), "yyyy-MM-dd HH:mm").alias("time"), "action", "kind", "path_a", "path_b")


def resolve(nodes: DataFrame, query: str) -> DataFrame:
    """The exact path (rank 0) or else up to CANDIDATES paths that contain the query, the most recent first."""
    exact = nodes.filter(F.col("path") == query).select("path", F.lit(0).alias("rank"))
    like = find(nodes, query, CANDIDATES).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("modified"), "path")))
    return exact.unionByName(like.select("path", "rank")).withColumn("least", F.min("rank").over(Window.partitionBy(F.lit(1)))).filter("rank = 0 or least > 0").select("path", "rank")


def node_header(nodes: DataFrame, roots: DataFrame, path: str) -> DataFrame:
    one = nodes.filter(F.col("path") == path).join(roots.select(F.col("path").alias("root"), "name"), "root", "left")
    return one.select("path", F.coalesce("name", "root").alias("root_name"), F.date_format(F.timestamp_seconds("modified"), "yyyy-MM-dd HH:mm").alias("modified"), F.format_number("size", 0).alias("size"), F.left("hash", F.lit(12)).alias("hash"))


def outgoing(edges: DataFrame, path: str) -> DataFrame:
    return edges.filter(F.col("source") == path).select("target", "fragment").orderBy("target", "fragment")


def incoming(edges: DataFrame, path: str) -> DataFrame:
    return edges.filter(F.col("target") == path).select("source", "fragment").orderBy("source", "fragment")


def node_regions(regions: DataFrame, path: str) -> DataFrame:
    return regions.filter(F.col("file") == path).orderBy("start_line")


def node_attributes(attributes: DataFrame, path: str) -> DataFrame:
    return attributes.filter(F.col("file") == path).select("key", "value").orderBy("key")


def short_paths(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """path and what is shown for it: below the first root (by path) that its text starts with, else its last parts."""
    lengths = sorted(r["n"] for r in roots.select(F.length("path").alias("n")).distinct().collect())  # lengths of paths: few
    named = roots.select(F.col("path").alias("r"), "name")
    # the beginnings that may be roots, so that the join has a key
    begins = nodes.select("path", F.explode(F.array(*[F.lit(n) for n in lengths]).cast("array<int>")).alias("n")).select("path", F.left("path", F.col("n")).alias("r"))
    first = begins.join(named, "r").groupBy("path").agg(F.min(F.struct("r", "name")).alias("f"))
    below = F.concat("f.name", F.substring(F.col("path"), F.length("f.r") + 1, F.lit(1 << 30)))
    return nodes.select("path").distinct().join(first, "path", "left").select("path", F.coalesce(below, paths.short_tail(F.col("path"))).alias("short"))


def reachable(edges: DataFrame, start: DataFrame, hops: int) -> DataFrame:
    """path and the least number of steps from the start paths, up to ``hops``."""
    seen = start.select("path", F.lit(0).alias("hops"))
    links = edges.select("source", "target").distinct()
    front = seen
    for step in range(1, hops + 1):
        front = front.join(links, front.path == links.source).select(F.col("target").alias("path"), F.lit(step).alias("hops")).distinct().join(seen.select("path"), "path", "left_anti")
        seen = seen.unionByName(front)
    return seen

"""[[path#fragment]] links of prose and of comments."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textgraph.functions import paths, text
from textgraph.operators import registry

_LINK = r"(?s)\[\[(.*?)\]\]"


def file_lines(files: DataFrame) -> DataFrame:
    """path, line_no (from 1), line of files (path, content); null content has none."""
    return files.select("path", F.posexplode(text.lines(F.col("content"))).alias("at", "line")).select("path", (F.col("at") + 1).alias("line_no"), "line")


def raw_links(lines: DataFrame, body: str = "line") -> DataFrame:
    """Links of each line's body: path, line_no, place (from 1 within the line), link, fragment; empty links go."""
    found = lines.select("path", "line_no", F.posexplode(F.regexp_extract_all(F.col(body), F.lit(_LINK), F.lit(1))).alias("at", "inner"))
    mark = F.instr("inner", "#")
    link = F.when(mark > 0, F.substring_index("inner", "#", 1)).otherwise(F.col("inner"))
    rest = F.when(mark > 0, F.expr("substring(inner, instr(inner, '#') + 1)"))
    out = found.select("path", "line_no", (F.col("at") + 1).alias("place"), text.trim(link).alias("link"), F.nullif(text.trim(rest), F.lit("")).alias("fragment"))
    return out.filter("link <> ''")


def comment_body(line: Column, prefix: Column) -> Column:
    """What follows the first line-comment mark anywhere in the line; null without one."""
    at = F.instr(line, prefix)
    return F.when(at > 0, F.substring(line, at + F.length(prefix), F.lit(1 << 30)))


def comment_links(files: DataFrame) -> DataFrame:
    """Links behind line-comment marks of code files."""
    lines = file_lines(files).withColumn("prefix", registry.line_comment(F.col("path"))).filter("prefix is not null")
    return raw_links(lines.withColumn("body", comment_body(F.col("line"), F.col("prefix"))), "body")


def _block_bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines inside closed block comments.  A line opens one block at most; what follows its end is code."""
    for batch in batches:
        out: list[tuple[str, int, str]] = []
        for path, content, opening, closing in zip(*(c.to_pylist() for c in batch.columns)):
            inside: list[tuple[str, int, str]] | None = None
            for no, line in enumerate(content.split("\n"), 1):
                if inside is None:
                    _, found, body = line.partition(opening)
                    if not found:
                        continue
                    inside = []
                else:
                    body = line
                part, closed, _ = body.partition(closing)
                inside.append((path, no, part))
                if closed:
                    out += inside
                    inside = None
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int32(), pa.string()))], names=["path", "line_no", "line"])


def block_links(files: DataFrame) -> DataFrame:
    """Links of block comments; links of a block that never closes go.  (Only this needs Python: a state over lines.)"""
    opening, closing = registry.block_marks(F.col("path"))
    blocks = files.select("path", "content", opening.alias("o"), closing.alias("c")).filter("o is not null and content is not null and instr(content, o) > 0")
    return raw_links(blocks.mapInArrow(_block_bodies, "path string, line_no int, line string"))


def adjacent_distinct(links: DataFrame) -> DataFrame:
    """Without links that equal their predecessor of the same file, line, path and fragment; others may repeat."""
    order = Window.partitionBy("path").orderBy("line_no", "place", "link", "pass", "fragment")
    key = F.struct("line_no", "link", "fragment")
    return links.withColumn("before", F.lag(key).over(order)).filter(~F.coalesce(F.col("before").eqNullSafe(key), F.lit(False))).drop("before", "pass")


def links(files: DataFrame) -> DataFrame:
    """All raw links: whole text of freetext files, comments of code files (those without adjacent repeats)."""
    free = raw_links(file_lines(files.filter(registry.is_freetext(F.col("path")))))
    code = comment_links(files).withColumn("pass", F.lit(0)).unionByName(block_links(files).withColumn("pass", F.lit(1)))
    return free.unionByName(adjacent_distinct(code))


def edges(found: DataFrame, home: str) -> DataFrame:
    """source, target, fragment of links with absolute or home paths; others are dropped."""
    return found.select(F.col("path").alias("source"), paths.node_path(F.col("link"), home).alias("target"), "fragment").filter("target is not null")


def insert_edges(found: DataFrame) -> DataFrame:
    """Edges as a table keeps them: one per source, target and fragment, but all of those without a fragment."""
    times = F.when(F.col("fragment").isNull(), F.col("n")).otherwise(F.lit(1))
    counted = found.groupBy("source", "target", "fragment").agg(F.count(F.lit(1)).cast("int").alias("n"))
    return counted.select("source", "target", "fragment", F.explode(F.sequence(F.lit(1), times)).alias("n")).drop("n")

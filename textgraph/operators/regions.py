"""Named regions of code files and the prose in their comments, with windows over lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textgraph.functions import text
from textgraph.operators import registry
from textgraph.operators.links import file_lines

_REST = 1 << 30


def marked_lines(files: DataFrame) -> DataFrame:
    """path, line_no, line, kind (region, end, prose or null), name, prose of files with line comments."""
    lines = file_lines(files).withColumn("prefix", registry.line_comment(F.col("path"))).filter("prefix is not null")
    bare = text.trim(F.col("line"))
    lines = lines.withColumn("bare", bare).withColumn("body", F.when(F.startswith("bare", F.col("prefix")), text.trim(F.substring(F.col("bare"), F.length("prefix") + 1, F.lit(_REST)))))
    name = F.when(F.col("body").startswith("@region"), text.trim(F.substring("body", 8, _REST))).when(F.col("body").startswith("@end"), text.trim(F.substring("body", 5, _REST)))
    kind = F.when((name != "") & F.col("body").startswith("@region"), "region").when((name != "") & F.col("body").startswith("@end"), "end").when(F.col("body").startswith("|"), "prose")
    prose = F.when(kind == "prose", F.regexp_replace(F.substring("body", 2, _REST), "^ +", ""))
    return lines.select("path", "line_no", "line", kind.alias("kind"), F.when(kind.isin("region", "end"), name).alias("name"), prose.alias("prose"))


def spans(marked: DataFrame) -> DataFrame:
    """file, name, start_line, end_line, closed, next_kind of every region mark.

    An end closes the open region whatever its name; a region that no end follows reaches the last line.
    """
    last = marked.groupBy("path").agg(F.max("line_no").alias("last_line"))
    order = Window.partitionBy("path").orderBy("line_no")
    marks = marked.filter("kind in ('region', 'end')").withColumn("next_kind", F.lead("kind").over(order)).withColumn("next_line", F.lead("line_no").over(order))
    starts = marks.filter("kind = 'region'").join(last, "path")
    return starts.select(F.col("path").alias("file"), "name", F.col("line_no").alias("start_line"), F.coalesce("next_line", "last_line").alias("end_line"), F.col("next_line").isNotNull().alias("closed"), "next_kind")


def violations(marked: DataFrame) -> DataFrame:
    """file, kind (nested or duplicate), name, line_no: a region opened inside another, or a name used again."""
    found = spans(marked)
    order = Window.partitionBy("file").orderBy("start_line")
    prior = found.withColumn("outer_kind", F.lag("next_kind").over(order)).withColumn("again", F.row_number().over(Window.partitionBy("file", "name").orderBy("start_line")))
    nested = F.coalesce(F.col("outer_kind") == "region", F.lit(False))
    return prior.filter(nested | (F.col("again") > 1)).select("file", F.when(nested, "nested").otherwise("duplicate").alias("kind"), "name", F.col("start_line").alias("line_no"))


def prose_blocks(marked: DataFrame) -> DataFrame:
    """file, name, start_line (of the block), content: prose lines that follow each other within a region."""
    inside = spans(marked).select(F.col("file").alias("path"), "name", "start_line", "end_line").join(marked.filter("kind = 'prose'").select("path", "line_no", "prose"), "path").filter("line_no between start_line and end_line")
    islands = inside.withColumn("island", F.col("line_no") - F.row_number().over(Window.partitionBy("path", "name", "start_line").orderBy("line_no")))
    return islands.groupBy(F.col("path").alias("file"), "name", F.col("start_line").alias("region_start"), "island").agg(F.min("line_no").alias("start_line"), F.expr("listagg(prose, '\n') WITHIN GROUP (ORDER BY line_no)").alias("content")).select("file", "name", "region_start", "start_line", "content")


def regions(marked: DataFrame) -> DataFrame:
    """file, name, start_line, end_line, prose (blocks with an empty line between them, null without any).

    One shuffle by file: lines carry the start of the region they are in, and each prose line what stands before it.
    """
    so_far = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = marked.withColumn("start_line", F.last(F.when(F.col("kind") == "region", F.col("line_no")), ignorenulls=True).over(so_far)).filter("start_line is not null")
    here = Window.partitionBy("path", "start_line").orderBy("line_no")
    ended = F.count(F.when(F.col("kind") == "end", 1)).over(here.rowsBetween(Window.unboundedPreceding, 0)) > 0
    rows = rows.withColumn("said", F.when((F.col("kind") == "prose") & ~ended, F.col("line_no")))
    before = F.last("said", ignorenulls=True).over(here.rowsBetween(Window.unboundedPreceding, -1))
    gap = F.when(before.isNull(), "").when(before == F.col("line_no") - 1, "\n").otherwise("\n\n")
    rows = rows.withColumn("part", F.when(F.col("said").isNotNull(), F.concat(gap, "prose")))
    found = rows.groupBy(F.col("path").alias("file"), "start_line").agg(
        F.max(F.when(F.col("line_no") == F.col("start_line"), F.col("name"))).alias("name"),
        F.coalesce(F.min(F.when(F.col("kind") == "end", F.col("line_no"))), F.max("line_no")).alias("end_line"),
        F.expr("listagg(part, '') WITHIN GROUP (ORDER BY line_no)").alias("prose"),
    )
    return found.select("file", "name", F.col("start_line").cast("int"), F.col("end_line").cast("int"), F.nullif("prose", F.lit("")).alias("prose"))

"""Documents woven from the graph: code slices of regions, directives, literate pages, markdown blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textgraph.functions import paths, text
from textgraph.operators import registry

#: A directive alone on its line, {{kind}} or {{kind:argument}}; a mark, in a stripped line, and its loose form.
DIRECTIVE = r"^(\s*)\{\{(\w+)(?::([^}]+))?\}\}\s*$"
_MARK = r"^[%#/]*\s*@(region|end)\s"
_LOOSE_MARK = r"@(region|end) "
#: What opens a line of prose, a rule, and the head of the index.
_PROSE = r"^(//|#)\|"
RULES = ("---", "***", "___")
_INDEX_HEAD = "| File | Region | Lines | Prose |\n|------|--------|-------|-------|\n"


def _right_stripped(line: Column) -> Column:
    return F.regexp_replace(line, r"(?U)\s+$", "")


def _joined(lines: DataFrame, keys: list[str]) -> DataFrame:
    """code: lines as one text by key, without white space at their ends and without blank lines at the text's."""
    blank = text.trim(F.col("line")) == ""
    w = Window.partitionBy(*keys)
    kept = lines.withColumn("a", F.min(F.when(~blank, F.col("line_no"))).over(w)).withColumn("b", F.max(F.when(~blank, F.col("line_no"))).over(w))
    kept = kept.filter("line_no between a and b").withColumn("line", _right_stripped(F.col("line")))
    return kept.groupBy(*keys).agg(F.expr("listagg(line, '\n') WITHIN GROUP (ORDER BY line_no)").alias("code"))


def region_code(regions: DataFrame, lines: DataFrame, loose: bool = False) -> DataFrame:
    """file, name, code: the lines of each region without marks and prose; regions without such lines have no row.

    loose drops lines that hold a mark anywhere.  The line range is a condition on an equal file, not a range join.
    """
    inside = regions.select(F.col("file").alias("path"), "name", "start_line", "end_line").join(lines, "path").filter("line_no between start_line and end_line")
    bare = text.trim(F.col("line"))
    code = inside.filter(~bare.rlike(_LOOSE_MARK if loose else _MARK) & ~bare.rlike(_PROSE))
    return _joined(code.select(F.col("path").alias("file"), "name", "line_no", "line"), ["file", "name"])


def file_include(lines: DataFrame) -> DataFrame:
    """path, code: whole files without marks (prose and blank lines stay), and without white space at the ends of lines."""
    kept = F.when(~text.trim(F.col("line")).rlike(_MARK), _right_stripped(F.col("line")))
    return lines.withColumn("kept", kept).groupBy("path").agg(F.expr("coalesce(listagg(kept, '\n') WITHIN GROUP (ORDER BY line_no), '')").alias("code"))


def fenced(code: Column, language: Column) -> Column:
    return F.concat(F.lit("```"), language, F.lit("\n"), code, F.lit("\n```"))


def literate(regions: DataFrame, code: DataFrame, edges: DataFrame, roots: list[str]) -> DataFrame:
    """file, document: the short path, what the file links to, and per region its prose and its code in a fence.

    For files with regions; code is that of region_code(loose=True).  Links stand in the order of their targets and
    fragments, each as often as there are edges.  Paths are short below the first of ``roots`` that begins them.
    """
    prose = text.trim(F.col("prose"))
    parts = regions.join(code, ["file", "name"], "left")
    own = F.concat(fenced(F.col("code"), registry.fence(F.col("file"), registry.LITERATE_FENCES)), F.lit("\n\n"))
    body = F.concat(F.lit("## "), F.col("name"), F.lit("\n\n"), F.when(F.col("prose") != "", F.concat(prose, F.lit("\n\n"))).otherwise(""), F.coalesce(own, F.lit("")))
    pages = parts.withColumn("body", body).groupBy("file").agg(F.expr("listagg(body, '') WITHIN GROUP (ORDER BY start_line)").alias("body"))
    link = F.concat(F.lit("`"), paths.short_path(F.col("target"), roots), F.coalesce(F.concat(F.lit("#"), "fragment"), F.lit("")), F.lit("`"))
    to = edges.select(F.col("source").alias("file"), "target", "fragment", link.alias("link")).groupBy("file").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("target", "fragment", "link"))), lambda x: x["link"]), ", ").alias("links"))
    joined = pages.join(to, "file", "left")
    return joined.select("file", F.concat(page_head(F.col("file"), roots), F.coalesce(F.concat(F.lit("*Connects to:* "), "links", F.lit("\n\n")), F.lit("")), F.lit("---\n\n"), "body").alias("document"))


def page_head(path: Column, roots: list[str]) -> Column:
    return F.concat(F.lit("# "), paths.short_path(path, roots), F.lit("\n\n"))


def index_table(regions: DataFrame) -> DataFrame:
    """One row: the region index as a markdown table, by file and first line."""
    size = F.when(F.char_length("prose") > 0, F.concat(F.char_length("prose").cast("string"), F.lit(" ch"))).otherwise("—")
    row = F.format_string("| `%s` | `%s` | %d–%d | %s |", paths.short_source(F.col("file")), F.col("name"), F.col("start_line"), F.col("end_line"), size)
    rows = regions.select("file", "start_line", row.alias("row")).agg(F.expr("listagg(row, '\n') WITHIN GROUP (ORDER BY file, start_line)").alias("rows"))
    return rows.select(F.concat(F.lit(_INDEX_HEAD), "rows").alias("text")).select(F.coalesce("text", F.lit(_INDEX_HEAD.rstrip())).alias("text"))


def stats_line(stats: DataFrame) -> DataFrame:
    return stats.select(F.format_string("**%d** files · **%d** edges · **%d** regions · **%d** with prose", F.col("nodes"), F.col("edges"), F.col("regions"), F.col("with_prose")).alias("text"))


def template_lines(files: DataFrame) -> DataFrame:
    """path, line_no, line of files (path, content): what stands between line feeds, the empty last line included."""
    return files.select("path", F.posexplode(F.split("content", "\n")).alias("at", "line")).select("path", (F.col("at") + 1).alias("line_no"), "line")


def expand(templates: DataFrame, lines: DataFrame, regions: DataFrame, stats: DataFrame) -> DataFrame:
    """path, document: templates (see template_lines) with each directive line replaced by what it names.

    Kinds are prose, code, region (both), file, stats and index.  Inside a fence any directive gives a region's bare
    code.  Every line of what replaces a directive has its indentation.  Unknown kinds, missing arguments and names that
    aren't there leave a note.  Of regions of one name that of the smallest file is taken; lines are those of the files
    that can be read.
    """
    order = Window.partitionBy("path").orderBy("line_no")
    mark = text.trim(F.col("line")).startswith("```")
    fence = F.sum(mark.cast("int")).over(order)
    part = lambda i: F.regexp_extract("line", DIRECTIVE, i)
    found = templates.withColumn("in_fence", fence % 2 == 1).withColumns({"kind": F.nullif(part(2), F.lit("")), "indent": part(1), "arg": F.nullif(part(3), F.lit(""))})
    first = regions.withColumn("n", F.row_number().over(Window.partitionBy("name").orderBy("file"))).filter("n = 1").select("file", "name", "start_line", "end_line", F.nullif(text.trim(F.col("prose")), F.lit("")).alias("prose"))
    asked = found.filter("kind is not null").select(F.col("arg").alias("name")).distinct()
    first = first.join(asked, "name", "left_semi")
    named = first.join(region_code(first, lines), ["file", "name"], "left").select(F.col("name").alias("arg"), F.col("file").alias("region_file"), "prose", "code")
    whole = lines.join(found.filter("kind = 'file'").select(F.col("arg").alias("path")).distinct(), "path", "left_semi")
    wanted = file_include(whole).select(F.lit("file").alias("kind"), F.col("path").alias("arg"), F.col("code").alias("content"))
    # one row each, for lines of that kind alone
    single = stats_line(stats).select(F.lit("stats").alias("kind"), F.col("text").alias("single")).unionByName(index_table(regions).select(F.lit("index").alias("kind"), F.col("text").alias("single")))
    both = found.join(named, "arg", "left").join(wanted, ["kind", "arg"], "left").join(single, "kind", "left")
    arg = F.coalesce("arg", F.lit(""))
    code = fenced(F.col("code"), registry.fence(F.col("region_file"), registry.WEAVE_FENCES))
    lost = F.concat(F.lit("*[source file not found: "), "region_file", F.lit("]*"))
    prose = F.when(F.col("prose").isNotNull(), F.concat("prose", F.lit("\n")))
    replaced = (
        F.when(F.col("in_fence") & F.col("region_file").isNull(), F.concat(F.lit("% [region not found: "), F.coalesce("arg", F.lit("None")), F.lit("]")))
        .when(F.col("in_fence"), F.coalesce("code", F.concat(F.lit("% [source not found: "), "arg", F.lit("]"))))
        .when(F.col("kind").isin("stats", "index"), F.col("single"))
        .when((F.col("kind") == "file") & F.col("arg").isNull(), F.lit("*[missing path in {{file:}}]*"))
        .when(F.col("kind") == "file", F.coalesce("content", F.concat(F.lit("*[file not found: "), "arg", F.lit("]*"))))
        .when(~F.col("kind").isin("prose", "code", "region"), F.concat(F.lit("*[unknown directive: "), "kind", F.lit(":"), arg, F.lit("]*")))
        .when(F.col("arg").isNull(), F.concat(F.lit("*[missing region name in {{"), "kind", F.lit("}}]*")))
        .when(F.col("region_file").isNull(), F.concat(F.lit("*[region not found: "), "arg", F.lit("]*")))
        .when(F.col("kind") == "prose", F.coalesce(prose, F.lit("")))
        .when(F.col("kind") == "code", F.coalesce(code, lost))
        .otherwise(F.concat_ws("\n", prose, code))
    )
    indented = F.concat("indent", F.replace(replaced, F.lit("\n"), F.concat(F.lit("\n"), "indent")))
    out = both.withColumn("text", F.when(F.col("kind").isNull() | mark, F.col("line")).otherwise(indented))
    return out.groupBy("path").agg(F.expr("listagg(text, '\n') WITHIN GROUP (ORDER BY line_no)").alias("document"))


def escaped(x: Column) -> Column:
    """Text for XML."""
    return F.replace(F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def inline_markup(x: Column) -> Column:
    """Escaped text with code, bold and italic marks as tags (fixed values: the marks and the tags)."""
    out = F.regexp_replace(escaped(x), r"`([^`]+)`", '<font face="Courier" size="9">$1</font>')
    out = F.regexp_replace(out, r"\*\*([^*]+)\*\*", "<b>$1</b>")
    return F.regexp_replace(out, r"\*([^*]+)\*", "<i>$1</i>")


def blocks(templates: DataFrame) -> DataFrame:
    """path, block_no (from 1), line_no (its first), block, label, text: the blocks of markdown lines.

    Kinds are hr, h1 to h3, code (label: its language), directive (label: its kind, text: its argument) and para (lines
    joined by spaces).  Blank lines end paragraphs; a line that begins with # and is no heading is one of its own.  A fence that
    isn't closed reaches to the end.
    """
    order = Window.partitionBy("path").orderBy("line_no")
    bare = text.trim(F.col("line"))
    mark = F.col("bare").startswith("```")
    count = F.sum(mark.cast("int")).over(order)
    kind = F.when(mark & F.col("open"), "code").when(mark, "close").when(F.col("open"), "inside").when(F.col("bare") == "", "blank").when(F.col("bare").isin(*RULES), "hr")
    for n in (1, 2, 3):
        kind = kind.when(F.col("bare").startswith("#" * n + " "), f"h{n}")
    kind = kind.when(F.col("bare").rlike(DIRECTIVE), "directive").otherwise("para")
    lines = templates.withColumn("bare", bare).withColumn("open", count % 2 == 1).withColumn("kind", kind)
    before = lambda c: F.lag(c).over(order)
    alone = F.col("bare").startswith("#")
    joins = (F.col("kind") == "inside") | (F.col("kind") == "para") & ~alone & F.coalesce((before("kind") == "para") & ~before("bare").startswith("#"), F.lit(False))
    parts = lines.withColumn("starts", ~joins & ~F.col("kind").isin("blank", "close"))
    parts = parts.withColumn("block_no", F.sum(F.col("starts").cast("int")).over(order)).filter(~F.col("kind").isin("blank", "close"))
    argument = F.nullif(F.regexp_extract("bare", DIRECTIVE, 3), F.lit(""))
    said = F.when(F.col("kind") == "inside", F.col("line")).when(F.col("kind") == "para", F.col("bare")).when(F.col("kind") == "directive", argument).when(F.col("kind").isin("h1", "h2", "h3"), text.trim(F.substring(F.col("bare"), F.right("kind", F.lit(1)).cast("int") + 2, F.lit(1 << 30))))
    label = F.when(F.col("kind") == "code", text.trim(F.substring("bare", 4, 1 << 30))).when(F.col("kind") == "directive", F.regexp_extract("bare", DIRECTIVE, 2))
    rows = parts.select("path", "block_no", "line_no", "kind", label.alias("label"), said.alias("said"))
    whole = rows.groupBy("path", "block_no").agg(F.min("line_no").alias("line_no"), F.min_by("kind", "line_no").alias("block"), F.min_by("label", "line_no").alias("label"), F.sort_array(F.collect_list(F.when(F.col("said").isNotNull(), F.struct("line_no", "said")))).alias("all"))
    said = F.transform("all", lambda x: x["said"])
    joined = F.when(F.col("block") == "code", F.array_join(said, "\n")).otherwise(F.array_join(said, " "))
    return whole.select("path", F.col("block_no").cast("int").alias("block_no"), "line_no", "block", "label", F.when((F.size("all") > 0) | (F.col("block") == "code"), joined).alias("text"))

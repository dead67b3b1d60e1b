"""Path algebra as column expressions: no file system is consulted."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean(path: Column) -> Column:
    """Resolves "." and ".." and repeated or trailing slashes of an absolute path; ".." at the top stays there."""
    parts = F.filter(F.split(path, "/"), lambda x: ~x.isin("", "."))
    kept = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, x: F.when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x))),
    )
    return F.concat(F.lit("/"), F.array_join(kept, "/"))


def node_path(raw: Column, home: str) -> Column:
    """The path a link names: absolute, or below ``home`` if its first component is "~"; else null."""
    expanded = F.when((raw == "~") | raw.startswith("~/"), F.concat(F.lit(home), F.substring(raw, 2, 1 << 30))).when(raw.startswith("/"), raw)
    return clean(expanded)


def below(path: Column, root: Column) -> Column:
    """Whether path is root or lies below it, by whole components."""
    return (path == root) | path.startswith(F.concat(root, F.lit("/")))


def join(path: Column, rest: Column) -> Column:
    return F.concat_ws("/", path, rest)


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def short_tail(path: Column) -> Column:
    """The last three components behind an ellipsis; shorter paths as they are."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 3, F.concat(F.lit("…/"), F.array_join(F.slice(parts, -3, 3), "/"))).otherwise(path)


def short_path(path: Column, roots: list[str]) -> Column:
    """What follows the first root that begins the path as a text, without slashes at its front; else its short tail."""
    if not roots:
        return short_tail(path)
    first = F.get(F.filter(F.array(*[F.lit(r) for r in roots]), lambda r: path.startswith(r)), F.lit(0))
    return F.coalesce(F.regexp_replace(F.substring(path, F.length(first) + 1, F.lit(1 << 30)), "^/+", ""), short_tail(path))


def short_source(path: Column) -> Column:
    """What follows the last "/src/", else the file's name."""
    return F.when(path.contains("/src/"), F.substring_index(path, "/src/", -1)).otherwise(base_name(path))

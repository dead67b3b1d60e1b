"""Which files are read how, by the ends of their names; the first entry that fits holds."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Extractor:
    name: str
    patterns: tuple[str, ...]
    line: str | None = None
    block: tuple[str, str] | None = None
    freetext: bool = False


#: Names, endings and comment marks of the supported languages, in order.
EXTRACTORS = (
    Extractor("markdown", (".md",), freetext=True),
    Extractor("c_family", (".c", ".h", ".cpp", ".hpp", ".cc", ".hh"), "//", ("/*", "*/")),
    Extractor("rust", (".rs",), "//", ("/*", "*/")),
    Extractor("python", (".py",), "#"),
    Extractor("supercollider", (".scd", ".sc"), "//", ("/*", "*/")),
    Extractor("shell", (".sh", ".bash", ".zsh"), "#"),
    Extractor("yaml", (".yaml", ".yml"), "#"),
    Extractor("lua", (".lua",), "--", ("--[[", "]]")),
    Extractor("javascript", (".js", ".ts", ".jsx", ".tsx"), "//", ("/*", "*/")),
    Extractor("abc", (".abc",), "%"),
)
#: Names of fenced code languages by ending, on literate pages and in woven documents.
LITERATE_FENCES = {".rs": "rust", ".py": "python", ".cpp": "cpp", ".c": "c", ".h": "c", ".hpp": "cpp", ".scd": "supercollider", ".js": "javascript", ".ts": "typescript", ".sh": "bash", ".lua": "lua", ".yaml": "yaml", ".yml": "yaml"}
WEAVE_FENCES = LITERATE_FENCES | {".abc": "abc"}


def find(path: str, extractors: tuple[Extractor, ...] = EXTRACTORS) -> Extractor | None:
    low = path.lower()
    return next((e for e in extractors if any(low.endswith(p) for p in e.patterns)), None)


def _case(path: Column, value, extractors: tuple[Extractor, ...]) -> Column:
    out = None
    for e in extractors:
        fits = F.lit(False)
        for p in e.patterns:
            fits = fits | F.lower(path).endswith(p)
        out = F.when(fits, value(e)) if out is None else out.when(fits, value(e))
    return out


def extractor_name(path: Column, extractors: tuple[Extractor, ...] = EXTRACTORS) -> Column:
    """Null where no extractor fits."""
    return _case(path, lambda e: F.lit(e.name), extractors)


def line_comment(path: Column, extractors: tuple[Extractor, ...] = EXTRACTORS) -> Column:
    return _case(path, lambda e: F.lit(e.line).cast("string"), extractors)


def block_marks(path: Column, extractors: tuple[Extractor, ...] = EXTRACTORS) -> tuple[Column, Column]:
    return tuple(_case(path, lambda e, i=i: F.lit(e.block[i] if e.block else None).cast("string"), extractors) for i in (0, 1))


def is_freetext(path: Column, extractors: tuple[Extractor, ...] = EXTRACTORS) -> Column:
    return F.coalesce(_case(path, lambda e: F.lit(e.freetext), extractors), F.lit(False))


def fence(path: Column, names: dict[str, str]) -> Column:
    """The language of a file by the last ending of its name, or an empty text."""
    ending = F.lower(F.regexp_extract(path, r"[^/.][^/]*(\.[^./]*)$", 1))
    return F.coalesce(F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[ending], F.lit(""))

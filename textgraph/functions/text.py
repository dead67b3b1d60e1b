"""Text expressions whose meaning must not depend on the engine's defaults."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def trim(x: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def ascii_lower(x: Column) -> Column:
    return F.translate(x, UPPER, LOWER)


def like_anywhere(x: Column, query: str) -> Column:
    """SQL LIKE '%query%' with ASCII letters of either case; % and _ of the query are wildcards, there is no escape."""
    pattern = query.translate(str.maketrans(UPPER, LOWER)).replace("\\", "\\\\")
    return ascii_lower(x).like(f"%{pattern}%")


def lines(content: Column) -> Column:
    """Array of lines: split at line feeds, no empty line after the last one, one carriage return stripped from each."""
    parts = F.split(content, "\n")
    kept = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    return F.transform(kept, lambda x: F.regexp_replace(x, r"\r\z", ""))


def valid_text(content: Column) -> Column:
    """Bytes as text, or null where they aren't UTF-8."""
    return F.try_validate_utf8(content.cast("string"))


def glob_regex(glob: str) -> str | None:
    """A whole-name regular expression for a glob (* ? [..] [!..]), or None if it isn't valid."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[":
            end = glob.find("]", i + (3 if glob[i + 1 : i + 2] == "!" else 2))
            if end < 0:
                return None
            inner = glob[i + 1 : end]
            out += "[" + ("^" + re.escape(inner[1:]).replace(r"\-", "-") if inner[:1] == "!" else re.escape(inner).replace(r"\-", "-")) + "]"
            i = end
        else:
            out += re.escape(c)
        i += 1
    return rf"(?s:{out})\Z"

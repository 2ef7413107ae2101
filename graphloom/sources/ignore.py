"""Ignore patterns as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def load_patterns(text: str) -> list[str]:
    """Patterns of an ignore file: trimmed, without blank lines and comments."""
    lines = [x.strip() for x in text.splitlines()]
    return [x for x in lines if x and not x.startswith("#")]


def glob_regex(pattern: str) -> str:
    """A glob as a regular expression: `**/` is any depth, `*` and `?` stay within a segment, {a,b} and [..] are kept."""
    out, i, braces = "", 0, 0
    while i < len(pattern):
        if pattern.startswith("**/", i) and (i == 0 or pattern[i - 1] == "/"):
            out, i = out + "(?:[^/]+/)*", i + 3
        elif pattern[i:] == "**" and (i == 0 or pattern[i - 1] == "/"):
            out, i = out + ".*", i + 2
        elif pattern[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif pattern[i] == "?":
            out, i = out + "[^/]", i + 1
        elif pattern[i] == "[" and "]" in pattern[i + 2 :]:
            end = pattern.index("]", i + 2)
            body = pattern[i + 1 : end]
            out += "[" + ("^" + body[1:] if body[0] in "!^" else body).replace("\\", "\\\\") + "]"
            i = end + 1
        elif pattern[i] == "{":
            out, i, braces = out + "(?:", i + 1, braces + 1
        elif pattern[i] == "}" and braces:
            out, i, braces = out + ")", i + 1, braces - 1
        elif pattern[i] == "," and braces:
            out, i = out + "|", i + 1
        else:
            out, i = out + re.escape(pattern[i]), i + 1
    return f"^{out}$"


def _matches(path: Column, patterns: list[str]) -> Column:
    hit = F.lit(False)
    base = F.regexp_extract(path, r"([^/]*)$", 1)
    for p in patterns:
        hit = hit | path.rlike(glob_regex(p))
        if p.endswith("/"):
            hit = hit | path.startswith(p)
        elif "/" not in p:
            hit = hit | (~path.contains(":") & base.rlike(glob_regex(p)))
    return hit


def ignored(path: Column, patterns: list[str]) -> Column:
    """True if a pattern matches the path or any directory above it (a matching directory hides all below)."""
    if not patterns:
        return F.lit(False)
    parts = F.split(path, "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    return F.exists(above, lambda p: _matches(p, patterns))


def is_ignored(path: str, patterns: list[str]) -> bool:
    """The same of one path, for what lists directories itself."""
    parts = path.split("/")
    for above in ("/".join(parts[: i + 1]) for i in range(len(parts))):
        for p in patterns:
            if re.search(glob_regex(p), above):
                return True
            if above.startswith(p) if p.endswith("/") else "/" not in p and ":" not in above and re.search(glob_regex(p), above.rsplit("/", 1)[-1]):
                return True
    return False

"""Identifiers and dotted names as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def file_id(key: Column) -> Column:
    return F.concat(F.lit("f:"), key)


def node_id(lang: Column, kind: Column, fqn: Column, key: Column, start_line: Column) -> Column:
    mark = F.when(kind == "object", "o").otherwise("m")
    return F.concat_ws(":", F.lit("n"), lang, mark, fqn, key, start_line.cast("string"))


def short_id(kind: Column, number: Column) -> Column:
    mark = F.when(kind == "file", "f").when(kind == "object", "o").otherwise("m")
    return F.concat(mark, number.cast("string"))


def parse_short_id(text: Column) -> tuple[Column, Column]:
    """(kind, number); nulls where the text is no short id."""
    ok = text.rlike(r"^[mof][+-]?[0-9]{1,18}$")
    mark = F.substring(text, 1, 1)
    kind = F.when(mark == "m", "method").when(mark == "o", "object").otherwise("file")
    return F.when(ok, kind), F.when(ok, F.substring(text, F.lit(2), F.length(text)).cast("long"))


def parse_short(text: str) -> tuple[str, int] | None:
    """The same for one id on the driver."""
    m = re.fullmatch(r"([mof])([+-]?[0-9]{1,18})", text)
    return ({"m": "method", "o": "object", "f": "file"}[m[1]], int(m[2])) if m else None


def lang_from_path(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))
    return F.when(ext == ".py", "python").when(ext == ".java", "java").otherwise(F.regexp_replace(ext, r"^\.", ""))


def module_name(path: Column) -> Column:
    """A Python path as a dotted module; a package's __init__ is the package itself."""
    bare = F.regexp_replace(path, r"\.[^./]*$", "")
    return F.translate(F.regexp_replace(bare, r"(^|/)__init__$", ""), "/", ".")


def prefixed(prefix: Column, name: Column) -> Column:
    return F.when((prefix == "") | (name == ""), name).otherwise(F.concat(prefix, F.lit("."), name))


def strip_last(name: Column) -> Column:
    """A dotted name without its last segment; "" if it has but one."""
    return F.regexp_extract(name, r"(?s)^(.*)\.[^.]*$", 1)


def last_segment(name: Column) -> Column:
    return F.substring_index(name, ".", -1)


def relative_import(raw: Column, module: Column) -> Column:
    """Resolves leading dots against the module; raw stays where there are too many dots or nothing is left."""
    dots = F.length(F.regexp_extract(raw, r"^(\.+)", 1))
    rest = F.substring(raw, dots + 1, F.length(raw))
    package = F.slice(F.split(module, r"\."), F.lit(1), F.size(F.split(module, r"\.")) - 1)
    up = dots - 1
    keep = F.size(package) - up
    base = F.array_join(F.slice(package, F.lit(1), F.greatest(keep, F.lit(0))), ".")
    made = F.when(rest == "", base).when(base == "", rest).otherwise(F.concat(base, F.lit("."), rest))
    return F.when((dots == 0) | (keep < 0) | (made == ""), raw).otherwise(made)

"""The identifier analyzer as column expressions: no Python runs on the rows."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Delimiters, stop words, and suffix rules in the order in which they are tried.
DELIMITERS = r"/._\-: \t"
STOP_WORDS = (
    "a an the and or not in is it of to as at be by do for if on up we self this super true false null nil none new "
    "return import from def class func var let const type struct interface public private protected static final void "
    "int str bool list map set get err error"
).split()
SUFFIXES = [
    ("iers", "ier"), ("ies", "y"), ("ing", ""), ("ations", "ate"), ("ation", "ate"), ("ness", ""), ("ment", ""),
    ("ers", "er"), ("ed", ""), ("ly", ""), ("s", ""),
]

_CAMEL = r"(?<=\p{Ll})(?=\p{Lu})|(?<=[^%s])(?=\p{Lu}\p{Ll})" % DELIMITERS


def split_delimiters(text: Column) -> Column:
    return F.array_remove(F.split(text, f"[{DELIMITERS}]"), "")


def split_camel(text: Column) -> Column:
    """Parts of an identifier: a cut before a capital that follows a small letter or precedes one."""
    return F.filter(F.split(text, _CAMEL), lambda x: x != "")


def stem(word: Column) -> Column:
    out = None
    for suffix, to in SUFFIXES:
        cut = F.concat(F.substring(word, F.lit(1), F.length(word) - len(suffix)), F.lit(to))
        fits = F.endswith(word, F.lit(suffix)) & (F.octet_length(cut) > 2)
        out = F.when(fits, cut) if out is None else out.when(fits, cut)
    return F.when(F.octet_length(word) <= 3, word).otherwise(out.otherwise(word))


def normalize(text: Column, stop_words: list[str] | None = None) -> Column:
    """Normalized distinct terms in order of first appearance; a given stop list replaces the default one."""
    stops = stop_words or STOP_WORDS
    parts = F.split(text, f"[{DELIMITERS}]+|{_CAMEL}")
    low = F.transform(parts, lambda x: F.lower(F.regexp_replace(x, r"(?U)^\s+|\s+$", "")))
    kept = F.filter(low, lambda x: (F.octet_length(x) >= 2) & ~x.isin(stops))
    return F.array_distinct(F.filter(F.transform(kept, stem), lambda x: F.octet_length(x) >= 2))


def pre_tokenize(text: Column, stop_words: list[str] | None = None) -> Column:
    return F.array_join(normalize(text, stop_words), " ")


def _folds() -> tuple[str, str]:
    """Latin letters with marks and the letters that they fold to, by canonical decomposition."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for c in range(0xC0, 0x250)]
    pairs = [(a, b) for a, b in pairs if a != b and b.isascii()]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def _split_terms(lowered: Column) -> Column:
    return F.filter(F.split(lowered, r"[^\p{L}\p{N}\p{Co}]+"), lambda x: x != "")


def index_terms(text: Column) -> Column:
    """The index's own word splitter: runs of letters, digits and private characters, folded in case and marks."""
    marked, plain = _folds()
    return _split_terms(F.translate(F.lower(text), marked, plain))


def n_index_terms(text: Column) -> Column:
    """The number of index_terms. Letters fold to letters, so marks make no difference to it."""
    return F.size(_split_terms(F.lower(text)))

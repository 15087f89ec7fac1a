"""String primitives with the exact semantics the operators need; all of them are JVM expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def texts(values: list[str]) -> Column:
    """A literal array of strings (typed, also when empty)."""
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def trim_ws(c: Column) -> Column:
    """Strip all Unicode white space from both ends (``trim`` strips blanks only)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def clean_text(c: Column) -> Column:
    """No-break blanks to blanks, carriage returns to line feeds, at most one empty line, single blanks, stripped."""
    c = F.translate(c, " \r", " \n")
    c = F.regexp_replace(c, "\n{3,}", "\n\n")
    c = F.regexp_replace(c, "[ \t]{2,}", " ")
    return trim_ws(c)


def count_of(text: Column, word: Column | str) -> Column:
    """Non-overlapping occurrences of a non-empty substring."""
    w = F.lit(word) if isinstance(word, str) else word
    counted = F.floor((F.length(text) - F.length(F.replace(text, w, F.lit("")))) / F.length(w)).cast("int")
    # most words aren't there: a search costs a part of what a replacement does
    return F.when(text.isNull(), F.lit(None).cast("int")).when(F.contains(text, w), counted).otherwise(F.lit(0))


def count_all(text: Column, words: list[str]) -> Column:
    """Occurrences of all words together; a place counts for every word that stands there."""
    return reduce(lambda a, b: a + b, [count_of(text, w) for w in words], F.lit(0))


def has_any(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words], F.lit(False))


def sentences(text: Column) -> Column:
    """Pieces that end with ``.``, ``!`` or ``?`` before white space, stripped, none empty."""
    return F.filter(F.transform(F.split(text, r"(?U)(?<=[.!?])\s+"), trim_ws), lambda s: s != "")


def blocks(text: Column) -> Column:
    """Pieces between empty lines, stripped, none empty."""
    return F.filter(F.transform(F.split(text, "\n\n"), trim_ws), lambda b: b != "")


def words(text: Column) -> Column:
    """White-space separated words."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.coalesce(F.size(words(text)), F.lit(0))


def tokens(text: Column) -> Column:
    """Lower-case words of two or more letters, hyphens and apostrophes included; letters are matched before lower-casing."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"([A-Za-z][A-Za-z\-']+)"), 1), F.lower)


def slug(name: Column) -> Column:
    """Lower case, runs of other characters than a-z and 0-9 to one underscore, none at the ends."""
    s = F.btrim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "_"), F.lit("_"))
    return F.when(s == "", "unknown_speaker").otherwise(s)


def content_key(prefix: str, *parts: Column) -> Column:
    """A key derived from content: ``prefix_`` and 12 hexadecimal digits."""
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha1(F.concat_ws("\u0001", *parts)), 1, 12))

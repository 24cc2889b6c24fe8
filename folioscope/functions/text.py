"""Scalar text functions as Column expressions.

White space, dashes and marks are the ones the manuals use. Patterns are written once, with `\\b`
for an ASCII word boundary: `rx` turns it into look-arounds, since Java's own is Unicode-aware.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_BOUNDARY = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"

#: Words that queries and passages are not matched by.
STOP_WORDS = ("a an and are as at be by can for from how i if in into is it me of on or please the this to use using what when where which with write read get set find").split()

DASHES = "‐‑‒–—―"
PUNCTUATION = r"[_\-./()\[\]{}:;,=+*<>|]+"


def rx(pattern: str) -> str:
    """The pattern in Java's dialect, with ASCII word boundaries."""
    return pattern.replace(r"\b", _BOUNDARY)


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that is worked out once a row: Spark would write out its expression at each use."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def has(text: Column, pattern: str) -> Column:
    return text.rlike(rx(pattern))


@F.pandas_udf(StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda x: x if x is None else unicodedata.normalize("NFKC", x))


def nfkc(text: Column, gated: bool = True) -> Column:
    """Compatibility normal form. Spark has none built in; ASCII rows skip the Arrow call's work."""
    return F.when(text.rlike(r"[^\x00-\x7F]"), _nfkc(text)).otherwise(text) if gated else _nfkc(text)


def normalize_text(text: Column) -> Column:
    """One kind of line end, single spaces, no line indents, at most two blank lines in a row."""
    out = F.regexp_replace(F.coalesce(text, F.lit("")), "\r", "\n")
    out = F.regexp_replace(out, "[\t ]+", " ")
    out = F.regexp_replace(out, " {2,}", " ")
    out = F.regexp_replace(out, "\n +", "\n")
    return F.regexp_replace(F.regexp_replace(out, "\n{4,}", "\n\n\n"), r"^[ \n]+|[ \n]+$", "")


def normalize_for_search(text: Column, compatibility: bool = False) -> Column:
    """Lower case, dashes and punctuation as single spaces; with compatibility also NFKC."""
    out = F.lower(F.coalesce(text, F.lit("")))
    out = nfkc(out) if compatibility else out
    out = F.translate(out, DASHES, "-" * len(DASHES))
    out = F.regexp_replace(out, PUNCTUATION, " ")
    return F.trim(F.regexp_replace(out, "[\\s ]+", " "))


def canonical_symbol(text: Column) -> Column:
    """Upper case, letters, digits and underscores alone: for search, registers and validation."""
    return F.regexp_replace(F.upper(F.coalesce(text, F.lit(""))), "[^A-Z0-9_]", "")


def canonical_hardware_symbol(text: Column) -> Column:
    """As canonical_symbol, without underscores: for bit fields and golden facts."""
    return F.regexp_replace(F.upper(F.coalesce(text, F.lit(""))), "[^A-Z0-9]", "")


def comparable(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[\s\[\]{}()_,\-]+", "")


def compact(text: Column, most: int = 240) -> Column:
    """One line, cut with an ellipsis beyond `most` characters."""
    flat = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.when(F.length(flat) > most, F.concat(F.substring(flat, 1, most - 3), F.lit("..."))).otherwise(flat)


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(normalize_for_search(text), r"\s+", "-"), "[^a-z0-9-]", "")


def tokens(text: Column, stop: bool = True) -> Column:
    """Search tokens of more than one character, in order, without stop words."""
    words = F.split(normalize_for_search(text), " ")
    keep = lambda t: (F.length(t) > 1) & ~t.isin(*STOP_WORDS) if stop else F.length(t) > 1
    return F.filter(words, keep)


def count_word(text: Column, term: str) -> Column:
    """How often the term stands as a whole word."""
    return F.regexp_count(text, F.lit(rx(r"\b" + re.escape(term) + r"\b"))) if term else F.lit(0)


def count_loose(text: Column, term: str) -> Column:
    """How often the term stands anywhere, without overlaps."""
    if not term:
        return F.lit(0)
    return ((F.length(text) - F.length(F.replace(text, F.lit(term), F.lit("")))) / len(term)).cast("int")


def fuzzy_similarity(a: Column, b: Column) -> Column:
    """1 for equal texts, 0 for empty or very short ones, else one less the edit distance's share."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when((F.length(a) == 0) | (F.length(b) == 0), 0.0).when(a == b, 1.0).when(longest <= 2, 0.0).otherwise(1 - F.levenshtein(a, b) / longest)


def half_up(x: Column) -> Column:
    """Rounds halves towards plus infinity."""
    return F.floor(x + 0.5)


def stable_hash(text: Column, digits: int = 12) -> Column:
    return F.substring(F.sha1(text), 1, digits)

"""Lines, sections, chunks and their types."""

from __future__ import annotations

import functools
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscope.functions import rules
from folioscope.functions.text import half_up, has, normalize_for_search, once, rx

CHUNK_CHARS, CHUNK_OVERLAP, BREAK_FROM = 2600, 450, 0.55
BREAKS = ("\n\n", "\n", ". ", "; ", ": ")


def lines_of(pages: DataFrame, text: str = "text") -> DataFrame:
    """One row per line that is not blank: pages' other columns, pos (from 1) and line."""
    others = [c for c in pages.columns if c != text]
    kept = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")  # F.trim itself would take the index as what to trim
    return pages.select(*others, F.posexplode(kept).alias("pos", "line")).withColumn("pos", F.col("pos") + 1)


# --- sections -----------------------------------------------------------------------------------


def section_type(line: Column) -> Column:
    """struct(type, level, confidence) of a heading, null for other lines."""
    return _type_of(_title(line))


def _title(line: Column) -> Column:
    return F.substring(F.trim(F.regexp_replace(F.regexp_replace(line, r"\s+", " "), r"[.·•]+$", "")), 1, 240)


def _type_of(title: Column) -> Column:
    noise = (F.length(title) < 4) | title.rlike(rx(rules.SECTION_NOISE))
    depth = F.size(F.split(F.regexp_extract(title, r"^\d+(?:\.\d+)*", 0), r"\."))
    cases = [F.when(has(title, p), F.struct(F.regexp_replace(F.lit(t), "^register_topic$", "topic").alias("type"), (depth if level < 0 else F.lit(level)).alias("level"), F.lit(c).alias("confidence"))) for t, level, c, p in rules.SECTION_TYPES]
    return F.when(noise, None).otherwise(F.coalesce(*cases))


def headings(lines: DataFrame) -> DataFrame:
    """Headings, not numbered: per (filename, page, title) the surest, the first on ties."""
    found = once(once(lines, "__title", _title(F.col("line"))), "s", _type_of(F.col("__title"))).where("s is not null")
    rows = found.select("filename", "page", "pos", F.col("line").alias("title"), "s.type", "s.level", "s.confidence")
    best = W.partitionBy("filename", "page", F.lower("title")).orderBy(F.desc("confidence"), "pos")
    return rows.withColumn("n", F.row_number().over(best)).where("n = 1").drop("n")


def sections(lines: DataFrame) -> DataFrame:
    """Headings as sections: per (filename, page, title) the surest, numbered in page order."""
    one = headings(lines)
    # Numbered within pages; what comes before a page is a sum over pages, which are few to a file.
    counts = one.groupBy("filename", "page").agg(F.count("*").alias("sections"))
    before = F.coalesce(F.sum("sections").over(W.partitionBy("filename").orderBy("page").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    number = F.row_number().over(W.partitionBy("filename", "page").orderBy("pos")) + F.col("before")
    met = one.join(counts.select("filename", "page", before.alias("before")), ["filename", "page"])
    return met.withColumn("section_id", F.concat("filename", F.lit(":s"), number)).select(*one.columns, "section_id")


def score_section(title: Column, kind: Column, query: str, terms: list[str], text: Column | None = None) -> Column:
    """Points of a section for a query; text is the title normalized for search, where that is at hand."""
    text, phrase = normalize_for_search(title) if text is None else text, " ".join(terms)
    score = F.when(text == phrase, 140).otherwise(0) + F.when(F.contains(text, F.lit(phrase)), 95).otherwise(0)
    for t in terms:
        score = score + F.when(has(text, rf"\b{t}\b"), 18).otherwise(0) + F.when(F.contains(text, F.lit(t)), 8).otherwise(0)
    for t in query.split():
        score = score + F.when(_in_symbol(title, t.upper()), 18).otherwise(0)
    return score + F.when(kind == "numbered", 12).when(kind == "appendix", 8).otherwise(0) + F.when(has(title, rules.SECTION_WORDS), 10).otherwise(0)


def _in_symbol(title: Column, name: str) -> Column:
    """Whether the title's canonical symbol contains a name. The symbol itself, costly to write out, is not."""
    if re.search("[^A-Z0-9_]", name):
        return F.lit(False)
    upper = F.upper(F.coalesce(title, F.lit("")))
    return F.contains(upper, F.lit(name)) | upper.rlike("[^A-Z0-9_]*".join(name))


def search_sections(lines: DataFrame, query: str, terms: list[str], k: int) -> DataFrame:
    """The k best sections by score_section, ties by page, level, filename and title; pos may be of any type that sorts.

    Lines of one section are alike but for case, so all of them have a term or none. Sections without any term have
    18 points for each word of the query, 12 for their type and 10 for their words at most: they are typed and compared
    only where fewer than k sections have more.
    """
    order = [F.desc("score"), "page", "level", "filename", "title"]

    def best(rows: DataFrame) -> DataFrame:
        found = once(headings(rows), "__text", normalize_for_search(F.col("title")))
        scored = once(found, "score", score_section(F.col("title"), F.col("type"), query, terms, F.col("__text"))).drop("__text")
        return scored.where("score > 0").orderBy(*order).limit(k)

    if not terms or not all(re.fullmatch(r"\w+", t) for t in terms):
        return best(lines)
    has_term = functools.reduce(Column.__or__, (F.contains("__lower", F.lit(t)) for t in terms))
    lower = lambda rows: once(rows, "__lower", F.lower("line"))
    named = best(lower(lines).where(has_term))
    surer = named.where(F.col("score") > 18 * len(query.split()) + 12 + 10).agg(F.count("*")).scalar()
    return named.unionByName(best(lower(lines.where(surer < k)).where(~has_term))).orderBy(*order).limit(k)


def nearest_section(rows: DataFrame, section: DataFrame) -> DataFrame:
    """As-of join: to each row (filename, page) the last section at or before its page.

    One sorted pass over both sides together; the deepest section of a page counts, the first on ties.
    """
    per_page = section.groupBy("filename", "page").agg(F.max_by("section_id", F.struct("level", -F.col("pos"))).alias("section_id"))
    keys = rows.select("filename", "page").distinct()
    both = per_page.unionByName(keys.withColumn("section_id", F.lit(None).cast("string")))
    last = F.last_value("section_id", True).over(W.partitionBy("filename").orderBy("page").rangeBetween(W.unboundedPreceding, 0))
    found = both.select("filename", "page", last.alias("section_id")).distinct()
    return rows.join(found, ["filename", "page"], "left")


# --- chunks -------------------------------------------------------------------------------------


def _chunks(text: str, size: int, overlap: int) -> list[str]:
    if len(text) <= size:
        return [text] if text else []
    out, start = [], 0
    while True:
        end = min(start + size, len(text))
        piece = text[start:end]
        if end < len(text):
            at = max(piece.rfind(b) for b in BREAKS)
            if at > size * BREAK_FROM:
                end = start + at + 1
                piece = text[start:end]
        if piece.strip():
            out.append(piece.strip())
        if end >= len(text):
            return out
        start = max(0, end - overlap)


def chunks(pages: DataFrame, size: int = CHUNK_CHARS, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """Overlapping chunks that end at a sentence or line where one is near: pages' keys, chunk_index, text.

    Where a chunk starts depends on the one before, so each text is cut in one Arrow call.
    """

    @F.pandas_udf("array<string>")
    def cut(text: pd.Series) -> pd.Series:
        return text.map(lambda t: _chunks(t or "", size, overlap))

    others = [c for c in pages.columns if c != "text"]
    return pages.select(*others, F.posexplode(cut("text")).alias("chunk_index", "text"))


def chunk_type_stats(typed: DataFrame) -> DataFrame:
    """Per chunk type: how many, mean scores (rounded half up) and first page."""
    return typed.groupBy("chunk_type").agg(F.count("*").alias("chunks"), half_up(F.avg("noise")).alias("noise"), half_up(F.avg("content")).alias("content"), F.min("page").alias("first_page"))

"""Figures and tables by their captions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscope.functions import rules
from folioscope.functions.text import has, normalize_for_search, stable_hash

BEFORE, AFTER = 4, 5


def captions(lines: DataFrame) -> DataFrame:
    """Captions: keys, type, number, title, caption_id, and context_lines, the number of lines around."""
    part = lambda i: F.trim(F.regexp_extract("line", rules.CAPTION, i))
    around = F.count("*").over(W.partitionBy("filename", "page").orderBy("pos").rowsBetween(-BEFORE, AFTER))
    found = lines.withColumn("context_lines", around).where(F.col("line").rlike(rules.CAPTION))
    rows = found.select("filename", "page", "pos", F.when(F.lower(part(1)).startswith("fig"), "Figure").otherwise("Table").alias("type"), part(2).alias("number"), part(4).alias("title"), "context_lines")
    return rows.withColumn("caption_id", F.concat(F.lit("cap-p"), "page", F.lit("-"), "number", F.lit("-"), stable_hash(F.col("title"))))


def figure_kind(caption: Column) -> Column:
    return rules.first_label(normalize_for_search(caption), rules.FIGURE_KINDS, "unknown")


def manifest(found: DataFrame) -> DataFrame:
    """Figures of a page in order, with an id, a kind and a confidence."""
    n = F.row_number().over(W.partitionBy("filename", "page").orderBy("pos"))
    kind = figure_kind(F.col("title"))
    rows = found.withColumn("kind", F.when(kind != "unknown", kind).otherwise(F.lower("type")))
    sure = 50 + F.when(F.col("number") != "", 25).otherwise(8) + F.when(F.col("kind").isin("figure", "table"), 0).otherwise(15) + F.when(F.length("title") > 8, 6).otherwise(0)
    return rows.withColumn("figure_id", F.format_string("p%d_f%03d", "page", n)).withColumn("confidence", F.least(F.lit(100), sure))


def visual_tables(found: DataFrame) -> DataFrame:
    """Table captions that announce a drawn table: the kind with most signals, and a confidence."""
    hits = {k: F.when(has(F.col("title"), p), 1).otherwise(0) for k, p in rules.VISUAL_TABLES}
    total = sum(hits.values(), F.lit(0))
    most = F.greatest(*hits.values())
    kind = F.coalesce(*(F.when(h == most, F.lit(k)) for k, h in hits.items()))
    rows = found.withColumn("hits", total).where("hits > 0").withColumn("visual_kind", kind)
    return rows.withColumn("visual_confidence", F.least(F.lit(95), 45 + F.col("hits") * 10 + F.when(F.col("hits") > 1, 10).otherwise(0)))


def kind_counts(figures: DataFrame) -> DataFrame:
    return figures.groupBy("kind").agg(F.count("*").alias("figures"), F.min("page").alias("first_page"))

"""Cautions and operation sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscope.functions import rules
from folioscope.functions.text import normalize_for_search, rx

PER_TOPIC, CLUSTER_GAP, MAX_STEPS = 10, 2, 16


def caution_lines(lines: DataFrame) -> DataFrame:
    """Lines with a caution label: keys, labels (joined by `,`), type, register."""
    found = lines.withColumn("found", rules.caution_labels(F.col("line"))).where(F.size("found") > 0)
    text = F.concat_ws(" ", F.array_join("found", " "), "line")
    return found.select("filename", "page", "pos", F.array_join("found", ",").alias("labels"), rules.first_of_all(text, rules.CAUTION_TYPES, "general").alias("type"), F.regexp_extract("line", rx(rules.REGISTER_SYMBOL), 0).alias("register"), "line")


def caution_score(line: Column, topic: Column, labels: Column) -> Column:
    """Points for a line on a topic: its words, and each label."""
    hit = F.when(F.contains(normalize_for_search(line), normalize_for_search(topic)), 80).otherwise(0)
    return (hit + 20 * F.size(F.split(labels, ","))).cast("int")


def caution_index(cautions: DataFrame, topics: DataFrame) -> DataFrame:
    """Per (filename, topic) its PER_TOPIC best lines: pages, the commonest type, the best score, a confidence.

    topics (filename, topic) is a short list, so lines meet topics of their own file alone.
    """
    met = cautions.join(F.broadcast(topics), "filename").withColumn("score", caution_score(F.col("line"), F.col("topic"), F.col("labels"))).where("score >= 80")
    rank = F.row_number().over(W.partitionBy("filename", "topic").orderBy(F.desc("score"), "page", "pos"))
    best = met.withColumn("n", rank).where(F.col("n") <= PER_TOPIC)
    kinds = best.groupBy("filename", "topic", "type").agg(F.count("*").alias("c"), F.min("n").alias("first"))
    common = kinds.groupBy("filename", "topic").agg(F.max_by("type", F.struct("c", -F.col("first"))).alias("type"))
    sums = best.groupBy("filename", "topic").agg(F.count("*").alias("lines"), F.countDistinct("page").alias("pages"), F.max("score").alias("score"))
    return sums.join(common, ["filename", "topic"]).withColumn("confidence", F.when(F.col("score") >= 220, "high").when(F.col("score") >= 120, "medium").otherwise("low"))


def write_pairs(lines: DataFrame) -> DataFrame:
    """Ordered writes: keys, first_value, second_value, register."""
    part = lambda i: F.regexp_extract("line", rules.WRITE_PAIR, i)
    return lines.where(F.col("line").rlike(rules.WRITE_PAIR)).select("filename", "page", "pos", part(1).alias("first_value"), part(2).alias("second_value"), part(3).alias("register"))


def steps(lines: DataFrame) -> DataFrame:
    """Numbered steps of a page in order: keys, step, number, operation, register, next_step."""
    number = F.regexp_extract("line", r"^(\d{1,2})[.)]\s", 1).try_cast("int")
    found = lines.withColumn("number", number).where("number is not null").withColumn("operation", rules.first_label(F.col("line"), rules.STEP_OPERATIONS, "other"))
    w = W.partitionBy("filename", "page").orderBy("pos")
    rows = found.withColumn("step", F.row_number().over(w)).where(F.col("step") <= MAX_STEPS)
    return rows.select("filename", "page", "step", "number", "operation", F.regexp_extract("line", rx(rules.REGISTER_SYMBOL), 0).alias("register"), F.lead("step").over(w).alias("next_step"))


def structure(step_rows: DataFrame) -> DataFrame:
    """Per page: steps, how many have a known operation and a register, and complete, partial or unstructured."""
    known = F.count_if((F.col("operation") != "other") & (F.col("register") != ""))
    out = step_rows.groupBy("filename", "page").agg(F.count("*").alias("steps"), known.alias("known"))
    return out.withColumn("status", F.when(F.col("known") == F.col("steps"), "complete").when(F.col("known") > 0, "partial").otherwise("unstructured"))


def page_clusters(hits: DataFrame, gap: int = CLUSTER_GAP) -> DataFrame:
    """Gaps and islands: runs of pages (filename, topic, page, score) at most `gap` apart, with their weight."""
    w = W.partitionBy("filename", "topic").orderBy("page")
    new = F.when(F.col("page") - F.lag("page").over(w) > gap, 1).otherwise(0)
    island = hits.withColumn("new", new).withColumn("cluster", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    out = island.groupBy("filename", "topic", "cluster").agg(F.min("page").alias("page_start"), F.max("page").alias("page_end"), F.count("*").alias("pages"), F.sum("score").alias("score"))
    return out.withColumn("weight", F.col("score") + 25 * F.col("pages"))


def best_cluster(clusters: DataFrame) -> DataFrame:
    """The weightiest cluster of each topic, the first on ties."""
    rank = F.row_number().over(W.partitionBy("filename", "topic").orderBy(F.desc("weight"), "page_start"))
    return clusters.withColumn("n", rank).where("n = 1").drop("n")

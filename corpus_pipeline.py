"""The corpus pipeline: toxicity, line dedup, near duplicates, decontamination, encoding.

Each stage takes (spark, docs, sf_dir), where docs has the columns of documents, and returns a
DataFrame; run() writes each one's result as Parquet into the shared folder and gives it, read
back, to the next. All but the last return the columns of documents.

Odd input, in every stage: a null text is an empty one; rows without a doc_id pass all filters;
repeated rows are each kept or dropped together, but for near duplicates, which keep one row of
each document (its id and text); an empty table stays empty; further columns pass through all but the last stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm import bpe, decontaminate, line_dedup, near_duplicates, toxicity
from folioscope.llm.common import cut, table, whole_text

#: Score from which a document is rejected as toxic.
TOXIC = 0.7


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose toxicity score reaches TOXIC; the model learns from the labelled ones."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, out="__score").where(F.col("__score") < TOXIC).select(*docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes lines that an earlier line is like; a document that loses all it had goes, others get a new n_chars."""
    done = line_dedup.dedup_lines(docs)
    left = done.where((F.col("n_removed") == 0) | (F.trim(F.col("text")) != ""))
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return left.select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that of least doc_id, of each class of alike documents; documents without shingles stay.

    Different texts under one doc_id are different documents: of a class with two of them one stays.
    """
    text = F.xxhash64(whole_text())
    known = docs.where("doc_id is not null")
    classes = cut(near_duplicates.classes(known, by_text=True), "classes")
    first = classes.where("class is not null").groupBy("class").agg(F.min(F.struct("doc_id", "t")).alias("f")).select("f.doc_id", "f.t")
    kept = cut(first.unionByName(classes.where("class is null").select("doc_id", "t")).distinct(), "kept")
    kept = kept.select(F.col("doc_id").alias("__id"), F.col("t").alias("__t"))
    one = known.withColumn("__h", text).join(kept, (F.col("doc_id").cast("long") == F.col("__id")) & (F.col("__h") == F.col("__t")), "left_semi").dropDuplicates(["doc_id", "__h"])
    return one.select(*docs.columns).unionByName(docs.where("doc_id is null")).select(*docs.columns)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    leaks = cut(decontaminate.leaks(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct(), "leaks")
    return docs.join(leaks, "doc_id", "left_anti").select(*docs.columns)


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows (doc_id, n_tokens, ids): the byte-level BPE ids of every text, checked by decoding them."""
    vocab = bpe.vocabulary(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    encoded = bpe.encode(docs.select("doc_id", "text"), vocab, keep=["doc_id"], checked=True)
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontaminate_stage),
    ("byte_bpe", encode_stage),
]

#: SQL can express neither the first stage's model nor the last one's encoding; tests hold each against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs

"""The training-data queries: opN_<name> over whole tables, and the pipeline."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm import bpe, chat, ctw, decontaminate, id_files, licenses, line_dedup, near_duplicates, oracles, pivot_search, toxicity
from folioscope.llm.common import remainder, scratch, table


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocab = bpe.vocabulary(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    encoded = bpe.encode(table(spark, sf_dir, "documents"), vocab, keep=["doc_id"])
    both = bpe.decode(encoded, vocab)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "ids")
    id_files.write(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return id_files.read(spark, path, crc32=True)


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")), keep=["doc_id"])
    return scored.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op5_ctw(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = ctw.score(table(spark, sf_dir, "documents"), remainder("doc_id", 7) != 2)
    return scored.select("doc_id", (remainder("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


def op6_pivot_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_search.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256)


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", odd), (-1, 1, "assistant", odd)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.read_back(chat.format_conversations(turns))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.classes(table(spark, sf_dir, "documents"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return licenses.scan(docs, licenses.fit(licenses.sample_negatives(docs)))


def queries() -> dict:
    return {"op1_byte_bpe": op1_byte_bpe, "op2_id_files": op2_id_files, "op3_decontaminate": op3_decontaminate, "op4_toxicity": op4_toxicity, "op5_ctw": op5_ctw, "op6_pivot_top_k": op6_pivot_top_k, "op7_chat": op7_chat, "op8_line_dedup": op8_line_dedup, "op9_near_duplicates": op9_near_duplicates, "op10_licenses": op10_licenses}


def oracle_sql() -> dict[str, str]:
    return dict(oracles.ORACLES)

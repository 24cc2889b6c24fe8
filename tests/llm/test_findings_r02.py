"""Cases of the second round's findings on the training-data operators."""

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from folioscope.llm import ctw, toxicity, words
from folioscope.llm.common import remainder


def test_toxicity_learns_from_all_labelled_texts(spark):
    ids = [i for i in range(13_000) if zlib.crc32(str(i).encode()) % 3 != 1]
    docs = spark.createDataFrame([(i, f"quartz {i}" if i % 2 else f"quartz {i - 1}") for i in ids], "doc_id long, text string")
    labels = docs.select("doc_id", F.lit(0).alias("toxic"))
    texts = docs.select("text").distinct().where(F.pmod(F.xxhash64("text"), F.lit(5)) != 0).count()
    for most in (toxicity.LABELS_BYTES, 0):
        model = toxicity.fit(docs, labels, broadcast_bytes=most)
        assert model.grams["quar"] == texts and model.evidence == {}
        assert model.base < 1 / 1500  # calibrated with every copy of the texts held back


def test_toxicity_calibration_counts_copies():
    import numpy as np

    once = toxicity.calibrated(np.array([0.0, 2.0, 0.0, 2.0]), np.array([0, 1, 0, 0]), np.ones(4, int))
    assert once == toxicity.calibrated(np.array([0.0, 2.0, 2.0]), np.array([0, 0, 1]), np.array([2, 1, 1]))


def _shuffled(spark) -> int:
    """Rows that all stages so far have written for shuffles."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_ctw_beyond_broadcast_shuffles_no_row_for_each_step(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").limit(300)
    wrote, scores = [_shuffled(spark)], []
    for most in (1 << 26, 0):
        rows = ctw.score(docs, remainder("doc_id", 7) != 2, broadcast_bytes=most).collect()
        scores.append({r.doc_id: round(r.score, 6) for r in rows})
        wrote.append(_shuffled(spark))
    assert scores[0] == scores[1] and len(scores[0]) == 300
    assert (wrote[2] - wrote[1]) - (wrote[1] - wrote[0]) < 5 * 300


def test_ctw_beyond_broadcast_in_many_chunks_and_buckets(spark, monkeypatch):
    docs = spark.range(300).select(F.when(F.col("id") % 50 != 0, F.col("id")).alias("doc_id"), F.expr("concat(id % 97, ' w', id % 13, ' ', hex(id))").alias("text")).repartition(3)
    want = sorted((r.doc_id or -1, r.n_tokens, round(r.score, 6)) for r in ctw.score(docs, F.col("doc_id") < 200).collect())
    monkeypatch.setattr(ctw, "BUCKET_STEPS", 50)
    monkeypatch.setattr(ctw, "CHUNK_BYTES", 500)
    monkeypatch.setattr(ctw, "PACKED_TEXTS", 7)
    got = sorted((r.doc_id or -1, r.n_tokens, round(r.score, 6)) for r in ctw.score(docs, F.col("doc_id") < 200, broadcast_bytes=0).collect())
    assert got == want and len(got) == 300


def test_hash_windows_stay_below_mapped_memory(monkeypatch):
    """Arrays of 1 MB or more are mapped, and cleared, anew each time (common.release); hashes do not depend on the window."""
    assert 8 * (words.WINDOW + 1) < 1 << 20
    texts = pa.array([" ".join(f"Word{i * j % 101}" for i in range(700)) + "\nx" * j for j in range(40)])
    want = words.of_texts(texts)[0]
    for window in (1 << 8, 1 << 18):
        monkeypatch.setattr(words, "WINDOW", window)
        monkeypatch.setattr(words, "_POWERS", [np.zeros(0, np.uint64), np.zeros(0, np.uint64)])
        assert (words.of_texts(texts)[0] == want).all()

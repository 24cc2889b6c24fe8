"""Page ingest: each page once, over restarts."""

from datetime import datetime

from folioscope.streaming import pages


def test_ingest_once(spark, tmp_path):
    folder, out, mark = (f"file://{tmp_path}/{x}" for x in ("in", "out", "mark"))
    now = datetime(2024, 1, 1)
    spark.createDataFrame([("m", 1, "a", now), ("m", 1, "a", now), ("m", 2, "b", now)], pages.SCHEMA).write.parquet(folder)
    pages.ingest(pages.arriving(spark, folder), out, mark).awaitTermination(60)
    spark.createDataFrame([("m", 2, "again", now), ("n", 1, "c", now)], pages.SCHEMA).write.mode("append").parquet(folder)
    pages.ingest(pages.arriving(spark, folder), out, mark).awaitTermination(60)
    got = sorted((r.filename, r.page, r.text) for r in spark.read.parquet(out).collect())
    assert got == [("m", 1, "a"), ("m", 2, "b"), ("n", 1, "c")]


def test_arrivals(spark, tmp_path):
    now = datetime(2024, 1, 1)
    df = spark.createDataFrame([("m", 1, "ab", now), ("m", 2, "c", now)], pages.SCHEMA)
    assert [(r.pages, r.chars) for r in pages.arrivals(df).collect()] == [(2, 3)]

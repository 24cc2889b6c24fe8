"""The pipeline's stages on planted cases and on odd input."""

import random

import pytest

import corpus_pipeline

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_odd_rows(spark, odd):
    docs = odd
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        got = {r.doc_id for r in out.collect()}
        assert {2, 3, 4, 7, 8, 9, None} <= got, name
    last = corpus_pipeline.encode_stage(spark, docs, SF)
    assert last.columns == ["doc_id", "n_tokens", "ids"] and last.count() == 11


@pytest.mark.parametrize("n", range(5))
def test_empty(spark, none, n):
    assert corpus_pipeline.STAGES[n][1](spark, none, SF).collect() == []


def test_planted(spark):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(3000)]
    line = lambda n: " ".join(rng.choices(words, k=n))
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first().text
    passage = line(60)
    rows = [(i, "\n".join(line(30) for _ in range(4))) for i in range(20)]
    rows += [(100, rows[0][1]), (101, f"{line(30)}\n{passage}"), (102, f"{passage}\n{line(30)}"), (103, f"{line(20)}\n{item}\n{line(20)}")]
    base = " ".join(line(12) for _ in range(10))
    near = base.split()
    near[60] = "changed"
    rows += [(104, base), (105, " ".join(near))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    lines = {r.doc_id: r.text for r in corpus_pipeline.line_stage(spark, docs, SF).collect()}
    assert 100 not in lines and passage in lines[101] and passage not in lines[102] and all(lines[i] == t for i, t in rows[:20])
    kept = {r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, docs, SF).collect()}
    assert kept == {d for d, _ in rows} - {100, 105}
    clean = {r.doc_id for r in corpus_pipeline.decontaminate_stage(spark, docs, SF).collect()}
    assert clean == {d for d, _ in rows} - {103}


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "n_tokens", "ids"] and 0 < out.count() <= 200
    assert out.select("doc_id").distinct().count() == out.count()

def test_texts_under_one_id(spark):
    """Different texts under one id are different documents: alike ones go by class, others stay."""
    long_ = [" ".join(f"{c}{i}" for i in range(40)) for c in "abc"]
    rows = [(1, long_[0], "x"), (1, long_[1], "y"), (1, long_[1], "y"), (2, long_[0], "z"), (3, long_[2], "z"), (4, None, "n"), (4, "", "m")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = sorted((r.doc_id, r.text or "") for r in corpus_pipeline.near_duplicate_stage(spark, docs, SF).collect())
    assert kept == sorted([(1, long_[0]), (1, long_[1]), (3, long_[2]), (4, "")])

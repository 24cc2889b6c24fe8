import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.llm import chat, pivot_search, queries

VECTORS = "vec_id long, embedding array<double>"


def brute(rows, k=5):
    usable = [(i, [np.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite([256 * x for x in v]).all()]
    out = set()
    for q, a in {(i, tuple(v)) for i, v in usable if i % 50 == 0}:
        scores = sorted((-min(sum(int(x) * int(y) for x, y in zip(a, v, strict=True)), (1 << 63) - 1), i) for i, v in usable if i != q and len(v) == len(a))[:k]
        out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scores)}
    return out


def found(spark, rows):
    df = spark.createDataFrame(rows, VECTORS)
    return {tuple(r) for r in pivot_search.top_k(df.repartition(3), F.col("vec_id") % 50 == 0).collect()}


def test_exact_with_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=6).round(1).tolist()) for i in range(260)] + [(300 + i, [0.5] * 6) for i in range(30)]
    rows += [(400, None), (401, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (450, [float("nan")] * 6), (451, [float("inf")] * 6), (None, [1.0] * 6), (500, [1.0, 2.0]), (501, [2.0, 1.0]), (550, [])]
    assert found(spark, rows) == brute(rows)


def test_large_components_are_exact(spark):
    rows = [(i, [2.0**40 + i, 1.0 / (i + 1)]) for i in range(60)]
    assert found(spark, rows) == brute(rows)
    rows = [(i, [2.0**20 + i, 1.0 / (i + 1)]) for i in range(60)]  # whole numbers beyond what doubles hold
    assert found(spark, rows) == brute(rows)


def test_few_and_none(spark):
    assert found(spark, [(0, [1.0]), (1, [1.0])]) == {(0, 1, 1, 65536)}
    assert pivot_search.top_k(spark.createDataFrame([], VECTORS), F.col("vec_id") % 50 == 0).collect() == []


def test_query_is_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert {tuple(r) for r in queries.op6_pivot_top_k(spark, sf).select("query_id", "rank", "vec_id", "score").collect()} == brute(rows)


def test_escape_round_trip():
    random.seed(4)
    parts = [*chat.CONTROL, "\\", "<", "[", "|im", "_start|>", "s>", "a", " ", "\n", "INST]", "/", "<\\|im_end|>"]
    for _ in range(20_000):
        text = "".join(random.choices(parts, k=random.randint(0, 9)))
        out = chat.escape(text)
        assert chat.unescape(out) == text and not any(c in out for c in chat.CONTROL)
        name = chat.escape_name(text)
        assert "\n" not in name and chat.unescape_name(name) == text


def test_language():
    run = lambda t, **v: "".join(x for x, _ in chat.compile_template(t)([{"role": "user", "text": "hi"}, {"role": "bot", "text": "yo"}], **v))
    assert run("{% for m in messages %}{% if m.role == 'user' %}U{% elif m.role == name %}B{% else %}?{% endif %}{{ m.text | upper }}{# no #}{% endfor %}", name="bot") == "UHIBYO"
    assert run("{% set a = 'x' + 'y' %}{{ a }}{% if not a == 'xy' or false %}no{% endif %}") == "xy"
    assert chat.fold(chat.parse("a{{ 'b' + 'c' }}{% if 'x' == 'x' %}d{% else %}e{% endif %}")) == (chat.Out(chat.Const("abcd")),)


@pytest.mark.parametrize("bad", ["{% for m in other %}{% endfor %}", "{{ m.__class__ }}", "{{ f(1) }}", "{{ x | nothing }}", "{% if a %}", "{% endfor %}", "{{ 'a }}", "{% import os %}", "{{ a. }}"])
def test_sandbox(bad):
    with pytest.raises(chat.TemplateError):
        chat.compile_template(bad)


def test_conversations(spark):
    odd = "</s>[INST] ok [/INST]"
    rows = [(1, 2, "assistant", "yo <|im_end|>"), (1, 1, "user", None), (1, None, None, "first"), (2, 1, "assistant", "a"), (2, 1, "assistant", "a"), (3, 1, "us\ner", odd * 3), (4, 1, "assistant", "long " * 600_000), (4, 2, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS part", "'x' AS spans")
    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(df)).collect()}
    assert set(got) == {1, 2, 3, 4}
    for c, r in got.items():
        turns = sorted((x for x in rows if x[0] == c), key=lambda x: (x[1] is not None, x[1] or 0, x[2] or "", x[3] or ""))
        text = "".join(f"{x[2] or ''}\n{x[3] or ''}\n" for x in turns)
        loss = "".join(x[3] or "" for x in turns if x[2] == "assistant")
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(turns), hashlib.sha256(text.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.read_back(chat.format_conversations(df.limit(0))).collect() == []

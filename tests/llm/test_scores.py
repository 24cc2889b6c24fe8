import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folioscope.llm import ctw, licenses, queries, toxicity
from folioscope.llm.common import remainder

SMALL = "/root/testdata/sf0.01"


def test_base_scores_and_odd_input(spark, odd, none):
    rows = odd.select("doc_id", "text").collect()
    train = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 7 != 2
    counts: Counter = Counter()
    words = lambda t: [*(t or "").encode().lower().split(), b""]
    for r in rows:
        if train(r.doc_id):
            counts.update(words(r.text))
    n, v = sum(counts.values()), len(counts)
    want = sorted(((r.doc_id or -1), len(words(r.text)), sum(w in counts for w in words(r.text)), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words(r.text)), 6)) for r in rows)
    for head, most in ((1_000_000, 1 << 26), (1, 0)):  # by broadcast, and by joins alone
        got = ctw.score(odd, remainder("doc_id", 7) != 2, head=head, broadcast_bytes=most).collect()
        assert sorted(((r.doc_id or -1), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
        assert all(r.score < 0 for r in got)
    assert ctw.score(none, remainder("doc_id", 7) != 2).collect() == []


def test_tree_is_context_tree_weighting():
    """Against a direct recursion over the tree."""
    texts = ["The then", "than", "at the"]
    key, coded = ctw.steps(pa.array(texts), 2)
    assert coded.tolist() == [10, 6, 8]
    uniq, times = np.unique(key, return_counts=True)
    levels = ctw._subtree(uniq, times, 2, 0)

    def counts(context, node):
        out = [0, 0]
        for t in texts:
            raw = b"  " + b"".join(w + b" " for w in t.lower().encode().split()) + b"\n"
            for i in range(2, len(raw)):
                if raw[i - len(context) : i] == context:
                    for k in range(8):
                        if (1 << k | raw[i] >> 8 - k) == node:
                            out[raw[i] >> 7 - k & 1] += 1
        return out

    def pe(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)

    def pw(context, node):
        a, b = counts(context, node)
        if len(context) == 2 or not a + b:
            return pe(a, b)
        below = sum(pw(bytes([c]) + context, node) for c in set(b"  thean\n"))
        return math.log(0.5) + np.logaddexp(pe(a, b), below)

    for level, context in ((0, b""), (1, b"h"), (2, b"th")):
        for node in (1, 3, 6, 13):
            at = int.from_bytes(context, "big") << 8 | node
            i, there = levels[level].find(np.array([at]))
            if there[0]:
                assert levels[level].pw[i[0]] == pytest.approx(pw(context, node))
                assert [levels[level].n0[i[0]], levels[level].n1[i[0]]] == counts(context, node)


def test_model_is_a_distribution(spark):
    """Over one step, the probabilities of all bytes sum to 1."""
    docs = spark.createDataFrame([("the then an",), ("then the",), ("",)], "text string")
    counted = ctw.count(docs, F.lit(True), 3).where("kind = 1").select(F.col("key").alias("step"), "n")
    for context in (b"  t", b"he ", b"xyz"):
        at = int.from_bytes(context, "big") << 8
        wanted = counted.unionByName(spark.range(256).selectExpr(f"{at}L | id AS step", "0L AS n")).groupBy("step").agg(F.sum("n").alias("n"))
        rows = [r.lp for r in ctw.predict(wanted, 3).collect() if r.step & ~255 == at]
        assert len(rows) == 256 and sum(10**x for x in rows) == pytest.approx(1)


def test_score_is_the_sum_of_predictions(spark):
    """Against adding up what a plain tree gives each byte; by broadcast and by joins."""
    rows = [(i, " ".join(f"w{(i * j) % 7}" for j in range(1, 9))) for i in range(12)] + [(20, "New words here"), (21, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    train = F.col("doc_id") < 10
    key, coded = ctw.steps(pa.array([t for d, t in rows if d < 10]), ctw.DEPTH)
    every, _ = ctw.steps(pa.array([t or "" for _, t in rows]), ctw.DEPTH)
    table = {int(k): 0 for k in every}
    for k in key.tolist():
        table[k] += 1
    lp = {r.step: r.lp for r in ctw.predict(spark.createDataFrame(list(table.items()), "step long, n long"), ctw.DEPTH).collect()}
    want = {d: sum(lp[int(k)] for k in ctw.steps(pa.array([t or ""]), ctw.DEPTH)[0]) for d, t in rows}
    for most in (1 << 26, 0):
        got = {r.doc_id: r.score for r in ctw.score(docs, train, broadcast_bytes=most).collect()}
        assert got == pytest.approx(want)
    assert want[20] / 15 < want[11] / 25  # what was never seen costs more for each byte


def test_lattice():
    grams = Counter()
    for w, n in {"idiot": 50, "loser": 50, "worthless": 20, "stupid": 20, "the": 500, "thing": 90, "reader": 60}.items():
        padded = "^^^" + w + "\0"
        for i in range(len(w) + 1):
            grams[padded[i : i + 4]] += n
    chars = toxicity.CharModel(dict(grams))
    for token, word in {"1d10t": "idiot", "iiidiot": "idiot", "i-d-i-o-t": "idiot", "L0$ER!!!": "loser", "w0rthl3ss": "worthless", "the": "the", "thing%%%": "thing", "99": "", "***": ""}.items():
        assert toxicity.restore(token, chars) == word, token


def test_doubled_spaced_and_split_words_are_read():
    grams = Counter()
    words = {"idiot": 50, "moron": 50, "stupid": 50, "the": 500, "thing": 90, "reader": 60, "letter": 60}
    for w, n in words.items():
        padded = "^^^" + w + "\0"
        for i in range(len(w) + 1):
            grams[padded[i : i + 4]] += n
    toxic = {"idiot": 0.9, "moron": 0.9, "stupid": 0.9}
    scorer = toxicity.Model(dict(grams), toxic, 0.01, frozenset({"the", "thing", "reader", "letter", "on"})).scorer()
    for spelt, word in {"iddiot": "idiot", "morron": "moron", "sstupid": "stupid", "idi\u043et": "idiot", "$ t u p i d": "stupid", "m   o   r   o   n": "moron", "i / d / i / o / t": "idiot", "mo ron": "moron", "st upid": "stupid", "id i ot": "idiot"}.items():
        assert scorer.evidence(f"the {spelt} thing") == pytest.approx(-math.log(0.1)) and scorer.restored(f"the {spelt} thing") == f"the {word} thing", spelt
    for clean in ("the letter", "the reader on the thing", "a - b", "mo\nron"):
        assert scorer.score(clean) == pytest.approx(0.01), clean
    assert scorer.score("moron idiot") > scorer.score("idiot idiot") == scorer.score("idiot") > 0.01


def test_toxicity_holds_out_and_finds(spark):
    rows = queries.op4_toxicity(spark, SMALL).collect()
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    assert len(rows) == 1000 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    hits = sum(r.predicted and labels[r.doc_id] for r in held)
    assert hits >= 0.7 * sum(labels[r.doc_id] for r in held) and sum(r.predicted and not labels[r.doc_id] for r in held) <= 2


def test_toxicity_odd_input(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (6, 0), (None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.fit(odd, labels)
    got = toxicity.score(odd, model, restored="restored")
    assert got.columns.count("score") == 1 and got.count() == 11
    assert all(0 <= r.score <= 1 for r in got.collect())
    assert toxicity.score(none, toxicity.fit(none, labels.limit(0))).collect() == []


def test_licences(spark, odd, none):
    texts = ["Licensed under the Apache License, Version 2.0.", "The driver renewed a license at the office.", "", None, "intro\nReleased under the MIT License.\nThis work is licensed under the GNU General Public License, version 3.", "All rights reserved.", "Licensed under CC BY-NC 4.0."]
    df = spark.createDataFrame(list(enumerate(texts)) + [(0, texts[0])], "doc_id long, text string").selectExpr("*", "1 AS line", "2 AS family")
    model = licenses.fit(licenses.sample_negatives(odd))
    got = sorted((r.doc_id, r.line, r.family, r.confirmed) for r in licenses.scan(df, model).collect())
    assert got == [(0, 0, "apache", True), (4, 1, "mit", True), (4, 2, "gpl", True), (5, 0, "proprietary", True), (6, 0, "cc-by-nc", True)]
    assert licenses.scan(odd, model).collect() == [] and licenses.scan(none, model).collect() == []


def test_wrapped_and_unknown_licences(spark, odd):
    """Statements over several lines are read as one; below the threshold they are unknown."""
    wrapped = "Intro.\n\nLicensed\nunder the\nApache\nLicense,\nVersion 2.0.\n\nEnd."
    df = spark.createDataFrame([(1, wrapped)], "doc_id long, text string")
    model = licenses.fit(licenses.sample_negatives(odd))
    got = [(r.doc_id, r.line, r.family, r.confirmed) for r in licenses.scan(df, model).collect()]
    assert got == [(1, 2, "apache", True)]
    unknown = licenses.scan(df, model, threshold=1.01).collect()
    assert unknown and all(r.family == "unknown" and not r.confirmed and 0 < r.probability <= 1 for r in unknown)


def test_unlisted_licences_are_unknown(spark, odd):
    """Each in turn is held out of the fit as a whole, and still no family's."""
    negatives = licenses.sample_negatives(odd)
    for kind in ("eclipse", "artistic", "isc", "boost"):
        model = licenses.fit(negatives, unlisted={k: v for k, v in licenses.UNLISTED.items() if k != kind})
        df = spark.createDataFrame(list(enumerate(licenses.UNLISTED[kind])), "doc_id long, text string")
        got = [(r.doc_id, r.family, r.confirmed) for r in licenses.scan(df, model).collect()]
        assert (0, "unknown", False) in got and all(f == "unknown" and not c for _, f, c in got), (kind, got)


def test_toxic_evidence_is_not_chance_or_one_family(spark):
    """Words of many near copies of one toxic text, and rare words, are no evidence; those of many texts are."""
    rng = np.random.default_rng(1)
    vocabulary = [f"{a}{b}{c}" for a in "bdfgk" for b in ("en", "ar", "ol") for c in ("tis", "mon", "der", "lu")]
    line = lambda n: rng.choice(vocabulary, n).tolist()
    family = [*line(20), "harmless", *line(20)]
    docs, labels = [], []
    for i in range(400):
        words = line(40)
        if i % 4 == 0:
            words[rng.integers(0, 40)] = "zorgblat"
        if i % 4 == 2:
            words = list(family)
            words[rng.integers(0, 20)] = vocabulary[i % 60]
        docs.append((i, " ".join(words)))
        labels.append((i, int(i % 2 == 0)))
    model = toxicity.fit(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert "zorgblat" in model.evidence and "harmless" not in model.evidence and not any(w in model.evidence for w in vocabulary)
    scorer = toxicity.Scorer(model)
    assert scorer.score("a zorgblat b") > 0.7 > scorer.score("a harmless b")


def test_chance():
    from math import comb

    for a, n, p in ((3, 10, 0.2), (10, 10, 0.5), (5, 300, 0.01)):
        want = sum(comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(a, n + 1))
        assert toxicity.log_chance(a, n, p) == pytest.approx(math.log(want), abs=1e-6)


def test_telling_words_lose_nothing():
    """No paragraph without a telling word can pass the class of everything else."""
    model = licenses.fit(["some words of the text", "and others of the kind"] * 30)
    telling, other = set(model.telling()), model.classes.index(licenses.OTHER)
    for c in range(len(model.classes)):
        if c != other:
            gain = model.weights[c] - model.weights[other]
            rest = sum(w for g, w in zip(model.grams, gain, strict=True) if w > 0 and not telling & set(g.split(" ")))
            assert rest < model.bias[other] - model.bias[c]


def test_scores_do_not_depend_on_partitions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    scored = []
    for n in (1, 16):
        rows = ctw.score(docs.repartition(n, "doc_id"), remainder("doc_id", 7) != 2).collect()
        scored.append({r.doc_id: (r.n_tokens, r.n_known, r.base_score, r.score) for r in rows})
    assert scored[0].keys() == scored[1].keys()
    assert all(scored[0][d] == pytest.approx(scored[1][d], rel=1e-9) for d in scored[0])

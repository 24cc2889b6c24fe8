import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from folioscope.llm import bpe, queries

RANKS = bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))
OWN = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})


@pytest.fixture(scope="module")
def vocab():
    return bpe.Vocabulary.of(RANKS, P.PATTERN)


def test_perfect_hash_is_minimal_and_complete():
    keys = [f"k{i}".encode() for i in range(5000)]
    h = bpe.MinimalPerfectHash(keys, list(range(5000)))
    assert sorted(h.values) == list(range(5000)) and None not in h.keys
    assert all(h.get(k) == i for i, k in enumerate(keys)) and h.get(b"other") is None
    assert bpe.MinimalPerfectHash([], []).get(b"x") is None


def test_same_as_library(vocab):
    random.seed(3)
    parts = [" ", "  ", "\n", "\t", "a", "b", "the", "'s", "é", "1", "23", "!", "??", " ", "\U00032f53", "日本", "😀", "\x1c", "́", "word,", "end.\n", "<|endoftext|>"]
    encoder = bpe.Encoder(vocab)
    for _ in range(5000):
        text = "".join(random.choices(parts, k=random.randint(0, 14)))
        assert np.frombuffer(encoder.encode(text), "<i4").tolist() == OWN.encode_ordinary(text), text


def test_long_pretoken(vocab):
    text = "ab" * 20_000 + "é" * 3000
    assert np.frombuffer(bpe.Encoder(vocab).encode(text), "<i4").tolist() == OWN.encode_ordinary(text)


def test_small_memo_changes_nothing(vocab):
    encoder = bpe.Encoder(vocab)
    encoder.follows.limit = 2
    text = "one two three one two three four"
    for _ in range(3):
        assert np.frombuffer(encoder.encode(text), "<i4").tolist() == OWN.encode_ordinary(text)


def test_odd_input(spark, odd, none):
    held = bpe.vocabulary(spark, P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    both = bpe.decode(bpe.encode(odd, held), held)
    assert both.columns == ["doc_id", "text", "score", "key", "h", "n", "line", "sid", "ids", "decoded"]
    rows = both.collect()
    assert len(rows) == 11
    for r in rows:
        assert r.ids == OWN.encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode()
    assert bpe.encode(none, held).collect() == []
    assert bytes(bpe.decode(spark.sql("SELECT CAST(NULL AS array<int>) AS ids"), held).first().decoded) == b""


def test_query(spark):
    rows = queries.op1_byte_bpe(spark, "/root/testdata/sf0.001").collect()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        ids = OWN.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()

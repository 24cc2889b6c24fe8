import random
import zlib

import numpy as np
import public_tokenizers as P
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from folioscope.llm import id_files, queries
from folioscope.llm.common import scratch

FILE = P.path("word_bpe_49k.json")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**45), max_size=700))
def test_elias_fano(values):
    values = sorted(values)
    e, _ = id_files.EliasFano.read(memoryview(id_files.EliasFano.of(values).to_bytes()), 0)
    assert e.values().tolist() == values
    for i in range(0, len(values), 13):
        assert e.select(i) == values[i]


def test_elias_fano_is_small():
    ends = np.cumsum(np.random.default_rng(1).integers(0, 1000, 10_000))
    assert len(id_files.EliasFano.of(ends).to_bytes()) < 10_000 * 2  # 64-bit offsets would take 80,000


def test_chunked_is_whole():
    with open(FILE, encoding="utf-8") as f:
        spec = f.read()
    a, b = id_files.WordEncoder(spec, 2), id_files.WordEncoder(spec, 2, chunked=False)
    random.seed(5)
    parts = ["élan", "Straße", "THE", "thing.", "été,", " ", "\n", "\t", "'s", "Σ", "ς", "İx", "İ", "İ,", "TARİHİ.", ",", ".", "ǅ", "é", "12", "??", "<|endoftext|>", "<|ENDOFTEXT|>", "日本", "　"]
    texts = ["".join(random.choices(parts, k=random.randint(0, 12))) for _ in range(4000)]
    assert a.encode(texts) == b.encode(texts)


def test_far_ids(spark):
    """Hashed 64-bit ids: a block ends before its ids lie too far apart."""
    ids = [-(1 << 63), -5, 0, 1, (1 << 62) + 7, (1 << 63) - 1]
    path = scratch(spark, "far")
    id_files.write(spark.createDataFrame([(i, f"text {i}") for i in ids], "doc_id long, text string").coalesce(1), path, FILE)
    assert sorted(r.doc_id for r in id_files.read(spark, path).collect()) == ids


def test_blocks_and_odd_input(spark, odd, none):
    path = scratch(spark, "ids")
    id_files.write(odd, path, FILE)
    rows = id_files.read(spark, path).collect()
    own = Tokenizer.from_file(FILE)
    texts = {}
    for r in odd.select("doc_id", "text").collect():
        texts.setdefault(r.doc_id, []).append(r.text or "")
    assert sorted((r.doc_id is not None, r.doc_id) for r in rows) == sorted((d is not None, d) for d, t in texts.items() for _ in t)
    start = 0
    for r in sorted(rows, key=lambda r: r.start):
        assert r.start == start and r.n_tokens == len(r.ids)
        start += r.n_tokens
        assert any(r.ids == [*own.encode(t, add_special_tokens=False).ids, 2] for t in texts[r.doc_id])
    ids = [r.doc_id for r in sorted(rows, key=lambda r: r.start)]
    assert ids == sorted(ids, key=lambda d: (d is not None, d))
    empty = scratch(spark, "none")
    id_files.write(none, empty, FILE)
    assert id_files.read(spark, empty).collect() == []


def test_one_document_by_select():
    ids = [np.arange(n, dtype="<u4").tobytes() for n in (3, 0, 5)]
    block = id_files.Block(id_files.pack_block([None, -4, 9], ids, 7, True))
    assert len(block) == 3 and block.doc_ids() == [None, -4, 9]
    assert [block.document(i).tolist() for i in range(3)] == [[0, 1, 2], [], [0, 1, 2, 3, 4]]


def test_query(spark):
    rows = {r.doc_id: r for r in queries.op2_id_files(spark, "/root/testdata/sf0.001").collect()}
    own = Tokenizer.from_file(FILE)
    start = 0
    for d in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect():
        ids = [*own.encode(d.text or "", add_special_tokens=False).ids, 2]
        r = rows[d.doc_id]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)

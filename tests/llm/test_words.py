import random

import pyarrow as pa

from folioscope.llm import words

PARTS = ["a", "B", "ab", "Été", "東京", " ", "\n", "\t", "\r\n", "\x0b", " ", "", "A", "aB", "x" * 40, "\n\n"]


def test_words_and_lines(monkeypatch):
    """Against splitting each text by itself, with words longer than a window too."""
    rng = random.Random(3)
    for window in (1 << 18, 7):
        monkeypatch.setattr(words, "WINDOW", window)
        texts = ["".join(rng.choices(PARTS, k=rng.randint(0, 30))) for _ in range(300)] + ["", "\n", "x", ""]
        array = pa.array(["skipped", *texts, "skipped"])[1:-1]
        names: dict[int, bytes] = {}
        got, counts = words.of_texts(array)
        flat = [w for t in texts for w in t.encode().lower().split()]
        assert counts.tolist() == [len(t.encode().split()) for t in texts]
        for h, w in zip(got.tolist(), flat, strict=True):
            assert names.setdefault(h, w) == w
        assert len(names) == len(set(flat))
        of, number, many, again = words.of_lines(array)
        assert again.tolist() == got.tolist()
        want = [(i, n, len(x.split())) for i, t in enumerate(texts) for n, x in enumerate(t.encode().split(b"\n")) if x.split()]
        assert list(zip(of.tolist(), number.tolist(), many.tolist(), strict=True)) == want
    assert words.of_lines(pa.array(["", ""]))[0].tolist() == [] and words.of_texts(pa.array([], pa.string()))[1].tolist() == []


def test_no_collisions():
    many = [f"{a}{b}" for a in ("w", "Wort", "aaaa", "ab" * 40) for b in range(60_000)]
    got, _ = words.of_texts(pa.array([" ".join(many)]))
    assert len(set(got.tolist())) == len({w.lower() for w in many})
    assert len({h >> 20 for h in got.tolist()}) == len({w.lower() for w in many})


def test_slices():
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * 350_000, "y" * 350_000, "", "z"] * 2)], names=["text"])
    assert [s.num_rows for s in words.slices(batch, 0)] == [1, 3, 1, 3]
    assert [s.num_rows for s in words.slices(batch, 0, rows=2)] == [1, 2, 2, 2, 1]

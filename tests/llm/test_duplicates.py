import math
import random
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from folioscope.llm import decontaminate, line_dedup, near_duplicates, queries
from folioscope.llm.graph import components

WORDS = [f"w{i}" for i in range(400)]


def corpus(seed=1, families=25):
    """Families of near copies, exact copies, shared passages and short texts."""
    rng = random.Random(seed)
    line = lambda n: " ".join(rng.choices(WORDS, k=n))
    shared = [line(30) for _ in range(3)]
    docs = []
    for f in range(families):
        base = [line(rng.randint(5, 40)) for _ in range(rng.randint(1, 5))]
        for _ in range(rng.randint(1, 9)):
            copy = []
            for x in base:
                w = x.split()
                for _ in range(rng.choice((0, 0, 1, 2, 4))):
                    w[rng.randrange(len(w))] = rng.choice(WORDS)
                copy.append(" ".join(w))
            if rng.random() < 0.4:
                copy.insert(rng.randint(0, len(copy)), rng.choice(shared))
            docs.append("\n".join(copy))
        docs.append(docs[-1])
    docs += ["one two three", "One TWO  three", "a b c d", "", None, line(3000)]
    return list(enumerate(docs))


def sets_of(text, k=5):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def brute_classes(rows):
    parent = {d: d for d, _ in rows}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    sets = {d: sets_of(t) for d, t in rows}
    for i, (a, _) in enumerate(rows):
        for b, _ in rows[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {d: (len(sets[d]), find(d)) for d, _ in rows}


@pytest.mark.parametrize("weight", [400_000, 150])
def test_near_duplicates(spark, monkeypatch, weight):
    """In whole groups, and with groups split into many parts."""
    monkeypatch.setattr(near_duplicates, "UNIT_WEIGHT", weight)
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates.classes(df).collect()} == brute_classes(rows)


def test_near_duplicates_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(near_duplicates, "BROADCAST_BYTES", 0)
    rows = corpus(2, 6)
    got = near_duplicates.classes(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == brute_classes(rows)


def test_near_duplicates_odd_input(spark, odd, none):
    got = sorted(((r.doc_id or -1), r.n_shingles, r.component_id) for r in near_duplicates.classes(odd).collect())
    assert len(got) == 11 and got[0] == (-1, 8, None)
    assert (2, 0, 2) in got and (3, 0, 3) in got and (4, 0, 4) in got and (7, 1, 7) in got
    assert near_duplicates.classes(none).collect() == []


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 3), (5, 6), (7, 7), (6, 8), (8, 5), (None, 4)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 9: 1, 5: 5, 6: 5, 8: 5}
    chain = [(i, i + 1) for i in range(200)]
    assert {r.component for r in components(spark.createDataFrame(chain, "a long, b long")).collect()} == {0}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def brute_lines(rows, percent, least):
    gone, seen = defaultdict(set), []
    for d, t in rows:
        for i, x in enumerate((t or "").split("\n")):
            s = frozenset(x.encode().lower().split())
            if len(s) < least:
                continue
            if any(100 * len(s & y) >= percent * len(s | y) for y in seen):
                gone[d].add(i)
            seen.append(s)
    return {d: t if not gone[d] else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[d]) for d, t in rows}


@pytest.mark.parametrize(("percent", "kept", "small", "pairs"), [(90, 8, 1 << 25, 1 << 30), (75, 1, 1 << 25, 0), (60, 1, 0, 1 << 30)])
def test_line_dedup(spark, monkeypatch, percent, kept, small, pairs):
    """With few candidates kept, the last round decides; with no broadcasts, joins do; with no pairs in place, blocks are dealt."""
    monkeypatch.setattr(line_dedup, "KEPT", kept)
    monkeypatch.setattr(line_dedup, "FIRST", 1)
    monkeypatch.setattr(line_dedup, "BROADCAST_BYTES", small)
    monkeypatch.setattr(line_dedup, "MANY_PAIRS", pairs)
    monkeypatch.setattr(line_dedup, "PACKED_ROWS", 100)
    monkeypatch.setattr(line_dedup, "BUCKET_ROWS", 300)
    rows = corpus(3)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r.doc_id: r.text for r in line_dedup.dedup_lines(df, percent=percent, min_words=5).collect()} == brute_lines(rows, percent, 5)


def test_line_dedup_odd_input(spark, odd, none):
    got = line_dedup.dedup_lines(odd)
    assert got.columns == [*odd.columns, "n_lines", "n_removed"]
    texts = Counter((r.doc_id, r.text, r.n_removed) for r in got.collect())
    assert sum(texts.values()) == 11 and texts[(2, None, 0)] == 1 and texts[(3, "", 0)] == 1
    assert texts[(6, "Another second line in this one.", 1)] == 1
    assert line_dedup.dedup_lines(none).collect() == []


def test_short_lines_go_too(spark, tmp_path):
    """op8 and the pipeline's stage compare lines of any number of words."""
    rows = [(1, "And ornd.\n\nOf, edti oner."), (2, "of,  EDTI oner.\n\nAnd others."), (3, "And ornd.\nx"), (4, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id: (r.text, r.n_removed) for r in queries.op8_line_dedup(spark, str(tmp_path)).collect()} == {1: (rows[0][1], 0), 2: ("\nAnd others.", 1), 3: ("x", 1), 4: ("", 1)}
    assert {r.doc_id: r.text for r in corpus_pipeline.line_stage(spark, docs, str(tmp_path)).collect()} == {1: rows[0][1], 2: "\nAnd others.", 3: "x"}


def test_near_copied_lines_go(spark):
    """By default from three quarters on."""
    rows = [(1, "a b c d e f g h i j k l"), (2, "a b c d e f g h i j X l"), (3, "a b c d e f g h X Y Z l")]  # 11 of 13 and 9 of 15 words
    got = {r.doc_id: r.n_removed for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 0, 2: 1, 3: 0}


def test_lines_without_any_kept(spark, monkeypatch):
    """Where the nearest candidates fail, all earlier lines are looked through, by a scan or a join."""
    monkeypatch.setattr(line_dedup, "KEPT", 0)
    rows = corpus(6, 12)
    for bound in (1 << 25, 10):
        monkeypatch.setattr(line_dedup, "BROADCAST_BYTES", bound)
        got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
        assert {r.doc_id: r.text for r in got.collect()} == brute_lines(rows, 75, 1)


def test_default_lines_are_brute_force(spark):
    rows = corpus(5)
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert {r.doc_id: r.text for r in got.collect()} == brute_lines(rows, 75, 1)


def test_decontamination(spark, odd, none):
    rng = random.Random(7)
    line = lambda n: " ".join(rng.choices(WORDS, k=n))
    items = [(i, line(rng.randint(12, 60))) for i in range(20)] + [(90, "two words"), (91, ""), (92, None), (None, line(20))]
    edited = items[3][1].split()
    edited[len(edited) // 2] = "changed"
    docs = [(1, f"{line(40)}\n{items[0][1].upper()}, {line(10)}"), (2, items[1][1]), (3, line(200)), (4, f"{line(5)} {' '.join(edited)}"), (5, None), (6, ""), (7, f"{items[2][1]}. {items[0][1]}"), (7, line(30)), (None, items[0][1])]
    a, b = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS n", "2 AS h"), spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS g")
    for listed in (100_000, 0):
        got = {(r.doc_id, r.item_id): r for r in decontaminate.leaks(a, b, listed=listed).collect()}
        assert set(got) == {(1, 0), (2, 1), (4, 3), (7, 0), (7, 2)}
        assert got[1, 0].similarity == 1 and got[1, 0].start_word == 40 and got[1, 0].bits_apart == 0
        assert 0.5 <= got[4, 3].similarity < 1
    assert decontaminate.leaks(odd, b).collect() == [] and decontaminate.leaks(none, b).collect() == [] and decontaminate.leaks(a, b.limit(0)).collect() == []


def test_blocks_find_all_within_radius(spark):
    """Any two fingerprints at most `radius` bits apart share a block."""
    rng = random.Random(9)
    for radius in (0, 3, 23):
        pairs = []
        for i in range(60):
            x = rng.getrandbits(64)
            y = x
            for bit in rng.sample(range(64), radius):
                y ^= 1 << bit
            pairs += [(i, 0, x - (1 << 64) if x >> 63 else x), (i, 1, y - (1 << 64) if y >> 63 else y)]
        cells = spark.createDataFrame(pairs, "i int, side int, fingerprint long").select("i", "side", decontaminate._blocks(radius)).select("i", "side", "block.*")
        a, b = cells.where("side = 0"), cells.where("side = 1")
        assert a.join(b, ["i", "no", "bits"]).select("i").distinct().count() == 60


def test_decontamination_recall(spark):
    """Against every window of every document: nothing false, and at least 0.95 of the links; all without the radius."""
    rng = random.Random(11)
    line = lambda n: " ".join(rng.choices(WORDS, k=n))
    items = [(i, line(rng.randint(12, 50))) for i in range(24)]
    docs = []
    for d in range(160):
        w = items[d % 24][1].split()
        for _ in range(rng.randint(0, max(1, len(w) // 6))):
            w[rng.randrange(len(w))] = rng.choice(WORDS)
        docs.append((d, f"{line(rng.randint(0, 40))} {' '.join(w)} {line(rng.randint(0, 40))}"))
    grams = lambda w: [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    df = Counter(g for _, t in items for g in set(grams(t.split())))
    weight = lambda s: sum(1 + math.floor(math.log2(len(items) / df[g]) + 1e-9) if g in df else (len(items) + 1).bit_length() for g in s)
    want = {}
    for d, t in docs:
        w = t.split()
        for i, x in items:
            own, n = set(grams(x.split())), len(x.split())
            best = max((weight(own & s) / weight(own | s) for a in range(max(1, len(w) - n + 1)) if (s := set(grams(w[a : a + n])))), default=0)
            if best >= 0.5:
                want[d, i] = best
    a, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    exact = {(r.doc_id, r.item_id) for r in decontaminate.leaks(a, b, radius=63).collect()}
    found = {(r.doc_id, r.item_id) for r in decontaminate.leaks(a, b).collect()}
    print(len(want), len(exact & want.keys()), len(found & want.keys()), len(exact - want.keys()))
    assert exact == want.keys()
    assert found <= exact and len(found) >= 0.95 * len(want)

"""Benchmark decontamination with DataFrame operations alone.

Texts are compared as runs of words (lower case, what lies between letters and digits dropped),
by their sets of GRAM-word shingles. A shingle weighs more the fewer benchmark items have it.

1. Documents keep the positions at which they have a shingle of some item. A document can only
   hold an item if the weight of the item's shingles it has anywhere reaches the threshold; so
   nothing is lost by leaving all other (document, item) pairs.
2. Each remaining hit says where the item would start: there a window of the item's size is laid.
3. Windows and items get 64-bit SimHash fingerprints from their weighted shingles. With RADIUS + 1
   blocks of bits, any two fingerprints within RADIUS agree on one block, so an equi-join on
   (size, block, bits) finds all pairs within the radius.
4. Their similarity is then computed exactly: weight of common shingles over weight of all.

Results for odd input: null and empty texts and items of fewer than GRAM words match nothing;
rows without a doc_id or item_id take no part; a repeated item row counts once for its id; an item
id with two texts is looked for by both; ties between windows go to the first; repeated documents
give one row for each (doc_id, item_id); other columns are not read; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import cut, small, whole_text

GRAM, PERCENT, RADIUS = 3, 50, 23
#: Item shingles up to which documents are searched for them in place; beyond, by a join.
LISTED = 100_000
#: Bytes up to which a table is broadcast.
BROADCAST_BYTES = 32 << 20


def _small(df: DataFrame) -> DataFrame:
    return small(df, BROADCAST_BYTES)


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _grams(words: str, gram: int) -> Column:
    """Hashes of all shingles of a word array, in order."""
    parts = ", ".join(f"get({words}, i + {k})" for k in range(gram))
    return F.expr(f"CASE WHEN size({words}) >= {gram} THEN transform(sequence(0, size({words}) - {gram}), i -> xxhash64({parts})) ELSE array() END")


def _fingerprint(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (keys, fingerprint) from rows (keys, g, w): each bit goes with the heavier side.

    Two counters of 32 bits share a sum, so 32 sums count all 64 bits.
    """
    lanes = [F.sum(F.expr(f"(shiftright(g, {j}) & {1 << 32 | 1}L) * w")).alias(f"s{j}") for j in range(32)]
    sums = rows.groupBy(*keys).agg(F.sum("w").alias("total"), *lanes)
    low = " | ".join(f"shiftleft(CAST(2 * (s{j} & 4294967295L) > total AS long), {j})" for j in range(32))
    high = " | ".join(f"shiftleft(CAST(2 * shiftright(s{j}, 32) > total AS long), {j + 32})" for j in range(32))
    return sums.select(*keys, F.expr(f"({low}) | ({high})").alias("fingerprint"))


def _blocks(radius: int) -> Column:
    """The radius + 1 blocks of a fingerprint: (number, bits), between them all 64 bits."""
    many = radius + 1
    edges = [64 * i // many for i in range(many + 1)]
    cells = (f"named_struct('no', {i}, 'bits', shiftrightunsigned(fingerprint, {a}) & {(1 << b - a) - 1 if b - a < 64 else -1}L)" for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False)))
    return F.explode(F.expr(f"array({', '.join(cells)})")).alias("block")


def leaks(docs: DataFrame, items: DataFrame, gram: int = GRAM, percent: int = PERCENT, radius: int = RADIUS, listed: int = LISTED) -> DataFrame:
    """Rows (doc_id, item_id, start_word, n_words, similarity, bits_apart): each item a document holds, where it fits best."""
    if not 0 <= radius < 64:
        raise ValueError("a fingerprint has 64 bits")
    bench = items.select(F.col("item_id").cast("long").alias("item_id"), whole_text().alias("text")).where("item_id is not null").distinct()
    bench = bench.select("item_id", F.xxhash64("text").alias("variant"), _words(F.col("text")).alias("words"))
    bench = cut(bench.select("item_id", "variant", F.size("words").alias("n"), _grams("words", gram).alias("grams")), "items").where(F.size("grams") > 0)
    spread = bench.select("item_id", "variant", "n", F.posexplode("grams").alias("pos", "g"))
    many = bench.select("item_id").distinct().count()
    heaviest = 1 + max(0, (many + 1).bit_length() - 1)
    # The weight of a shingle: 1 where all items have it, one more for each time half as many have it.
    weights = spread.groupBy("g").agg(F.countDistinct("item_id").alias("df")).select("g", (1 + F.floor(F.log2(F.lit(many) / F.col("df")) + 1e-9)).cast("long").alias("w"))
    weights = cut(weights, "weights")
    of_item = cut(spread.join(weights, "g").select("item_id", "variant", "n", "pos", "g", "w"), "shingles")
    whole = of_item.dropDuplicates(["item_id", "variant", "g"]).groupBy("item_id", "variant", "n").agg(F.sum("w").alias("weight"), F.collect_list(F.struct("g", "w")).alias("gw"))
    whole = cut(whole, "whole")

    # 1. Where documents have shingles of items.
    work = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).where("doc_id is not null")
    worded = work.select("doc_id", F.xxhash64("text").alias("h"), _words(F.col("text")).alias("words"))
    shingled = worded.select("doc_id", "h", _grams("words", gram).alias("grams"))
    n_grams = weights.count()
    if not n_grams:
        found = shingled.select("doc_id", "h", F.lit(0).alias("at"), F.lit(0).cast("long").alias("g")).limit(0)
    elif n_grams <= listed:
        known = ", ".join(f"{r.g}L" if r.g > -(1 << 63) else "(-9223372036854775807L - 1L)" for r in weights.select("g").collect())
        hits = F.expr(f"filter(transform(grams, (g, i) -> CASE WHEN g IN ({known}) THEN struct(g AS g, i AS at) END), x -> x IS NOT NULL)")
        # explode_outer: a filter on the array's size would be pushed down, and words be split anew for each shingle
        found = shingled.select("doc_id", "h", hits.alias("hits")).select("doc_id", "h", F.explode_outer("hits").alias("x")).where("x.g is not null").select("doc_id", "h", "x.at", "x.g")
    else:
        found = shingled.select("doc_id", "h", F.posexplode_outer("grams").alias("at", "g")).where("g is not null").join(_small(weights.select("g")), "g", "left_semi")
    met = cut(found.join(_small(of_item), "g").select("doc_id", "h", "item_id", "variant", "n", (F.col("at") - F.col("pos")).alias("start"), "g", "w"), "hits")
    held = met.select("doc_id", "h", "item_id", "variant", "g", "w").distinct().groupBy("doc_id", "h", "item_id", "variant").agg(F.sum("w").alias("has"))
    enough = held.join(_small(whole.select("item_id", "variant", "weight")), ["item_id", "variant"]).where(F.col("has") * 100 >= F.col("weight") * percent)

    # 2. Windows of the items' sizes.
    spots = met.join(enough.select("doc_id", "h", "item_id", "variant"), ["doc_id", "h", "item_id", "variant"], "left_semi").select("doc_id", "h", "n", F.greatest("start", F.lit(0)).alias("start")).distinct()
    spots = cut(spots.groupBy("doc_id", "h").agg(F.collect_list(F.struct("n", "start")).alias("spots")), "spots")
    keyed = work.withColumn("h", F.xxhash64("text"))
    texts = keyed.join(_small(spots), ["doc_id", "h"]).dropDuplicates(["doc_id", "h"]).select("doc_id", "h", "spots", _words(F.col("text")).alias("words"))
    laid = texts.select("doc_id", "h", "spots", F.size("words").alias("size"), _grams("words", gram).alias("grams")).select("doc_id", "h", "size", "grams", F.explode("spots").alias("s"))
    start = F.greatest(F.lit(0), F.least(F.col("s.start"), F.col("size") - F.col("s.n")))
    windows = laid.select("doc_id", "h", "grams", F.col("s.n").alias("n"), start.alias("start")).withColumn("set", F.array_distinct(F.slice("grams", F.col("start") + 1, F.col("n") - gram + 1)))
    windows = cut(windows.select("doc_id", "h", "n", "start", "set").distinct(), "windows")

    # 3. Fingerprints and blocks.
    w = F.coalesce("w", F.lit(heaviest).cast("long")).alias("w")
    of_window = windows.select("doc_id", "h", "n", "start", F.explode("set").alias("g")).join(_small(weights), "g", "left").select("doc_id", "h", "n", "start", "g", w)
    marks = cut(_fingerprint(of_window, ["doc_id", "h", "n", "start"]).join(of_window.groupBy("doc_id", "h", "n", "start").agg(F.sum("w").alias("weight")), ["doc_id", "h", "n", "start"]), "fingerprints")
    prints = _fingerprint(whole.select("item_id", "variant", "n", F.explode("gw").alias("x")).select("item_id", "variant", "n", "x.g", "x.w"), ["item_id", "variant", "n"])
    left = marks.select("doc_id", "h", "n", "start", "fingerprint", _blocks(radius)).select("*", "block.*")
    right = prints.select("item_id", "variant", "n", "fingerprint", _blocks(radius)).select("item_id", "variant", "n", F.col("fingerprint").alias("of_item"), "block.no", "block.bits")
    apart = F.bit_count(F.col("fingerprint").bitwiseXOR(F.col("of_item")))
    near = left.join(_small(right), ["n", "no", "bits"]).where(apart <= radius).select("doc_id", "h", "n", "start", "item_id", "variant", apart.alias("bits_apart")).distinct()

    # 4. Exact similarity.
    pairs = near.join(marks.select("doc_id", "h", "n", "start", "weight"), ["doc_id", "h", "n", "start"]).join(windows, ["doc_id", "h", "n", "start"])
    pairs = pairs.join(_small(whole.select("item_id", "variant", F.col("weight").alias("item_weight"), "gw")), ["item_id", "variant"])
    both = F.expr("aggregate(gw, 0L, (a, x) -> a + IF(array_contains(`set`, x.g), x.w, 0L))")
    scored = pairs.withColumn("both", both).withColumn("either", F.col("weight") + F.col("item_weight") - F.col("both")).where(F.col("both") * 100 >= F.col("either") * percent)
    best = scored.groupBy("doc_id", "item_id").agg(F.max(F.struct((F.col("both") / F.col("either")).alias("similarity"), (-F.col("start")).alias("back"), F.col("n").alias("n_words"), "bits_apart")).alias("b"))
    return best.select("doc_id", "item_id", (-F.col("b.back")).alias("start_word"), "b.n_words", "b.similarity", "b.bits_apart")

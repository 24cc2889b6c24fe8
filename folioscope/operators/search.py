"""Ranking: lexical score, BM25 over candidates, proximity, fuzzy terms, and their sum.

A query is a short text known when the plan is made: its terms become literals, so the passages are
read once, with no joins but those on their own tokens.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscope.functions import rules
from folioscope.functions.text import STOP_WORDS, canonical_symbol, count_loose, count_word, fuzzy_similarity, half_up, has, normalize_for_search, tokens

K1, B, BM25_WEIGHT = 1.35, 0.72, 24
WINDOW, WINDOW_WEIGHT, POSITIONS = 18, 28, 12
MIN_SCORE = 20

#: Points for the vocabulary of register tables.
VOCABULARY = [(r"(?i)\bAddress\b", 8), (r"(?i)\bOffset\b", 5), (r"(?i)\bAccess\s+Size\b", 8), (r"(?i)\bInitial\s+Value\b", 8), (r"(?i)\bBit\s+Name\b", 10), (r"(?i)\bDescription\b", 3)]
#: Other words for a term.
SYNONYMS = {"irq": ["interrupt", "isr"], "interrupt": ["irq", "isr"], "clk": ["clock"], "clock": ["clk"], "reset": ["rst"], "dma": ["descriptor"], "start": ["enable"], "stop": ["disable"]}


class Query:
    """A query's terms: plain, important (without stop words), and with synonyms."""

    def __init__(self, text: str):
        flat = re.sub(r"\s+", " ", re.sub(r"[_\-./()\[\]{}:;,=+*<>|]+", " ", text.lower())).strip()
        self.text, self.phrase = text, flat
        self.terms = list(dict.fromkeys(t for t in flat.split(" ") if len(t) > 1))
        self.important = [t for t in self.terms if t not in STOP_WORDS]
        self.expanded = list(dict.fromkeys(x for t in self.important for x in SYNONYMS.get(t, ()) if x not in self.terms))
        self.symbols = list(dict.fromkeys(s for s in (re.sub(r"[^A-Z0-9_]", "", w.upper()) for w in re.split(r"[\s,;:/()\[\]{}]+", text)) if len(s) > 1))

    def weight(self, term: str) -> float:
        return 2.4 if term in self.terms else 0.9

    def intents(self) -> list[str]:
        return [label for label, p in rules.INTENTS if re.search(p, self.text)] or ["generic"]


def _flattened(passages: DataFrame) -> DataFrame:
    """Adds flat and symbol, the text normalized both ways: once for all that looks into them."""
    return passages.withColumn("flat", normalize_for_search(F.col("text"))).withColumn("symbol", canonical_symbol(F.col("text")))


def lexical_score(query: Query) -> Column:
    """Phrase, words, parts of words, symbols and table vocabulary, over text, flat and symbol.

    A regular expression is tried only where its words stand somewhere in the text.
    """
    text, flat = F.col("text"), F.col("flat")
    score = F.when(F.contains(flat, F.lit(query.phrase)), 70).otherwise(0)
    for s in query.symbols:
        score = score + F.when(F.contains("symbol", F.lit(s)), 25).otherwise(0)
    for t in query.terms:
        score = score + F.when(F.contains(flat, F.lit(t)), 10 * count_word(flat, t) + 2 * count_loose(flat, t)).otherwise(0)
    for pattern, points in VOCABULARY:
        word = re.search(r"[A-Z][a-z]+", pattern)[0].lower()
        score = score + F.when(F.contains(flat, F.lit(word)) & has(text, pattern), points).otherwise(0)
    return score


def search(passages: DataFrame, query: str, k: int, keys: list[str]) -> DataFrame:
    """The k best passages by lexical score, ties by their keys."""
    scored = _flattened(passages).withColumn("score", lexical_score(Query(query)).cast("int")).drop("flat", "symbol")
    # Filtered last: below the sort, the filter would make Spark normalize each text anew for every term.
    return scored.orderBy(F.desc("score"), *keys).limit(k).where("score > 0")


def bm25(passages: DataFrame, query: str, keys: list[str]) -> DataFrame:
    """Rows (keys, bm25, hits) for passages with a query term; statistics are those of the passages given.

    Only tokens that are terms leave the scan, so what is shuffled follows the hits, not the text.
    """
    q = Query(query)
    terms = q.terms + q.expanded
    toks = tokens(F.col("text"))
    base = passages.select(*keys, F.size(toks).alias("dl"), F.filter(toks, lambda t: t.isin(*terms)).alias("found"))
    stats = base.agg(F.greatest(F.count("*"), F.lit(1)).alias("n"), F.greatest(F.avg("dl"), F.lit(1.0)).alias("avgdl"))
    tf = base.select(*keys, "dl", F.explode("found").alias("term")).groupBy(*keys, "dl", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    weight = F.coalesce(*(F.when(F.col("term") == t, F.lit(q.weight(t))) for t in terms))
    joined = tf.join(F.broadcast(df), "term").crossJoin(F.broadcast(stats))  # one row per term, one row
    idf = F.ln(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * (F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))) * weight
    return joined.groupBy(*keys).agg(half_up(F.sum(part) * BM25_WEIGHT).cast("int").alias("bm25"), F.count("*").cast("int").alias("hits"))


def proximity(passages: DataFrame, query: str, keys: list[str]) -> DataFrame:
    """Rows (keys, pairs, proximity): important terms close to each other, over their first POSITIONS places."""
    important = Query(query).important
    where = F.posexplode(F.filter(F.transform(tokens(F.col("text")), lambda t, i: F.struct(t.alias("term"), i.alias("at"))), lambda x: x["term"].isin(*important)))
    hits = passages.select(*keys, where.alias("n", "x")).select(*keys, "x.term", "x.at")
    first = hits.withColumn("n", F.row_number().over(W.partitionBy(*keys, "term").orderBy("at"))).where(F.col("n") <= POSITIONS)
    by_doc = first.groupBy(*keys).agg(F.collect_list(F.struct("term", "at")).alias("all"))  # at most POSITIONS for each term
    close = F.expr(f"flatten(transform(`all`, x -> transform(filter(`all`, y -> y.term > x.term AND abs(y.at - x.at) <= {WINDOW}), y -> abs(y.at - x.at))))")
    found = by_doc.select(*keys, close.alias("close")).where(F.size("close") > 0)
    near = WINDOW - F.array_min("close")
    return found.select(*keys, F.size("close").alias("pairs"), half_up(F.least(F.lit(120.0), F.size("close") * 8 + near * WINDOW_WEIGHT / WINDOW)).cast("int").alias("proximity"))


def coverage(query: Query) -> Column:
    """Points for the share of important terms the passage has, over flat."""
    flat = F.col("flat")
    hits = sum((F.when(F.contains(flat, F.lit(t)) & has(flat, rf"\b{re.escape(t)}\b"), 1).otherwise(0) for t in query.important), F.lit(0))
    return half_up(F.lit(120.0) * hits / max(1, len(query.important))).cast("int")


def fuzzy_points(text: Column, query: Query, least: float = 0.86) -> Column:
    """12 for each longer important term that is missing but for a spelling, among all its distinct tokens."""
    words = F.array_distinct(tokens(text))
    score = F.lit(0)
    alike = lambda t: lambda w: (F.abs(F.length(w) - len(t)) <= 2) & (fuzzy_similarity(w, F.lit(t)) >= least)
    for t in query.important[:12]:
        if len(t) >= 4:
            near = F.exists(words, alike(t))
            score = score + F.when(~F.array_contains(words, t) & near, 12).otherwise(0)
    return score


def hybrid_search(passages: DataFrame, query: str, k: int, keys: list[str]) -> DataFrame:
    """Rows (keys, score, lexical, bm25, proximity, coverage): the k best passages of MIN_SCORE or more."""
    q = Query(query)
    phrase = F.when(F.contains("flat", F.lit(q.phrase)), 130).otherwise(0)
    base = _flattened(passages.select(*keys, "text")).select(*keys, lexical_score(q).cast("int").alias("lexical"), coverage(q).alias("coverage"), phrase.alias("phrase"))
    met = base.join(bm25(passages, query, keys), keys, "left").join(proximity(passages, query, keys), keys, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    total = F.col("lexical") + F.col("coverage") + F.col("phrase") + zero("bm25") + zero("proximity")
    rows = met.select(*keys, total.cast("int").alias("score"), "lexical", zero("bm25").alias("bm25"), zero("proximity").alias("proximity"), "coverage")
    return rows.orderBy(F.desc("score"), *keys).limit(k).where(F.col("score") >= MIN_SCORE)


def fuse(ranked: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of several queries as one: the best score, and a tenth of the worst where there are more."""
    return ranked.groupBy(*keys).agg((F.max("score") + F.when(F.count("*") > 1, F.floor(F.min("score") / 10)).otherwise(0)).cast("int").alias("score"), F.count("*").cast("int").alias("queries"))


def evidence(lines: DataFrame, query: str, keys: list[str], most: int = 6) -> DataFrame:
    """Per group the best lines by query terms, with their neighbours, in order of score and place."""
    q = Query(query)
    flat = normalize_for_search(F.col("line"))
    score = sum((F.when(F.contains(flat, F.lit(t)), 10 * count_word(flat, t) + 2 * count_loose(flat, t)).otherwise(0) for t in q.terms), F.lit(0)) + F.when(F.contains(flat, F.lit(q.phrase)), 40).otherwise(0)
    w = W.partitionBy(*keys).orderBy("pos")
    # Scored below the window, so that the filter above it reads a column and does not score each line again.
    scored = lines.withColumn("score", score.cast("int")).withColumn("context", F.concat_ws(" / ", F.lag("line").over(w), "line", F.lead("line").over(w))).where("score > 0")
    return scored.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("score"), "pos"))).where(F.col("rank") <= most)

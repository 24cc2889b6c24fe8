"""Toxicity by noisy-channel deobfuscation.

A character language model learnt from labelled texts is the source; the channel writes letters
as look-alike symbols, repeats them, or puts separators and spaces between them. For a token that
shows such traces, a lattice of what each character may stand for is decoded by Viterbi over all
states; known words (frequent ones of texts not labelled toxic) and tokens that have but one reading
stand for themselves. Neighbours on a line that together spell a toxic word are read as that word if
one of them is no known word. The restored words are then scored by how often words of their form
(the word, and its beginnings of 3 to 6 letters if it goes on) stand in texts labelled toxic.

A word's evidence against a text is the number of places in toxic texts that differ in both
neighbours (places with one left neighbour count once, and of those left the ones with one right
neighbour), or of such texts if fewer: neither copies, nor many near copies of one text, nor a long
one count much. All distinct texts without the label count for a word. A beginning has the evidence
of its words without the commonest, so that it stands for inflected forms, not for one word;
one that a longer beginning explains gives way to it. Of
all forms only those stay that are in toxic texts too often for chance, given how many are tried.

A text's evidence is the sum of -log(1 - p) over its distinct forms of that kind; its score is a
logistic function of that, fitted on a fifth of the labelled texts that the words were not counted in.

Results for odd input: null and empty texts get the score of a text without evidence; rows with
a null or repeated id are scored each by itself; a document labelled twice is toxic if one label
is; without labelled rows every text gets the score of a half; an empty table gives an empty table;
other columns pass through, an existing column of an output's name is replaced.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter, defaultdict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.llm.common import Memo, cut, per_process, release, released, remainder, slices, small, tune, whole_text

#: The model's size; bytes of labels up to which they are broadcast.
FORMS, GRAMS, LABELS_BYTES = 50_000, 200_000, 64 << 20
#: How many forms may stay by chance, on average; least places of a form.
BY_CHANCE, LEAST = 0.5, 3
#: Share of a beginning's places from which on one longer beginning replaces it.
SAME = 0.9
ORDER = 4
MEMO_ENTRIES = 250_000

#: Letters that a symbol may stand for.
LOOKALIKE = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i", "µ": "u",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i",
}
SEPARATORS = frozenset("-_.*·•~^'`,:;/\\#​‌‍­")
#: Costs of the channel in nats.
C_LOOKALIKE, C_SEPARATOR, C_REPEAT, C_DOUBLE, C_KEEP = 1.0, 0.6, 0.2, 5.0, 9.0

_EDGE = re.compile(r"^[^\w@$!|+(<€£¡]+|[^\w@$+€£]+$|([^\w\s])\1+$|^([^\w\s])\2+")
#: What may be read otherwise in a token of letters alone.
_TRACE = re.compile(rf"(.)\1|[{''.join(c for c in LOOKALIKE if c.isalpha())}]")
#: Four or more characters on a line with anything between them that cannot stand for a letter.
_PIECE, _BETWEEN = r"(?:[^\W_]|[@$!|+(<€£¡])", r"(?:[^\w\n@$!|+(<€£¡]|_)++"
_SPACED = re.compile(rf"(?<!\S){_PIECE}(?:{_BETWEEN}{_PIECE}){{3,}}(?![^\s.,;:!?])")
_GAP = re.compile(_BETWEEN)
#: Neighbouring tokens that may make up one word at most.
PIECES = 8
_PLAIN = re.compile(r"[^\W\d_]+\Z")


class CharModel:
    """Character n-grams with Witten-Bell back-off; ^ opens and $ (as \\x00) closes a word."""

    def __init__(self, grams: dict[str, float]):
        self.next: dict[str, dict[str, float]] = defaultdict(dict)
        for g, n in grams.items():
            for k in range(len(g)):
                ctx = g[k:-1]
                self.next[ctx][g[-1]] = self.next[ctx].get(g[-1], 0.0) + n
        self.total = {c: sum(d.values()) for c, d in self.next.items()}
        self.memo: dict[tuple[str, str], float] = {}

    def cost(self, ctx: str, char: str) -> float:
        key = ctx, char
        if (c := self.memo.get(key)) is None:
            if len(self.memo) > MEMO_ENTRIES:
                self.memo.clear()
            c = self.memo[key] = -math.log(self._p(ctx, char))
        return c

    def _p(self, ctx: str, char: str) -> float:
        lower = self._p(ctx[1:], char) if ctx else 1e-5
        seen = self.next.get(ctx)
        if not seen:
            return lower
        n, kinds = self.total[ctx], len(seen)
        return (seen.get(char, 0.0) + kinds * lower) / (n + kinds)


def decode(token: str, model: CharModel) -> str:
    """The likeliest letters behind a token, by Viterbi over its character lattice."""
    start = "^" * (ORDER - 1)
    states: dict[str, tuple[float, object]] = {start: (0.0, None)}
    for i, c in enumerate(token):
        ways: list[tuple[str, float]] = []
        if c.isalpha():
            ways.append((c, 0.0))
        ways += [(x, C_LOOKALIKE) for x in LOOKALIKE.get(c, "")]
        if c in SEPARATORS or not c.isalnum() and 0 < i < len(token) - 1:
            ways.append(("", C_SEPARATOR))
        elif not c.isalnum():
            ways.append(("", C_SEPARATOR))
        if i and token[i - 1] == c:
            run = i > 1 and token[i - 2] == c or i + 1 < len(token) and token[i + 1] == c
            ways.append(("", C_REPEAT if run else C_DOUBLE))
        if not ways or c.isdigit():
            ways.append((c, C_KEEP))
        after: dict[str, tuple[float, object]] = {}
        for ctx, (cost, path) in states.items():
            for letter, price in ways:
                if letter:
                    total, to, way = cost + price + model.cost(ctx, letter), (ctx + letter)[1:], (letter, path)
                else:
                    total, to, way = cost + price, ctx, path
                if to not in after or total < after[to][0]:
                    after[to] = total, way
        states = after
    _, path = min((cost + model.cost(ctx, "\0"), i, path) for i, (ctx, (cost, path)) in enumerate(states.items()))[0::2]
    out = []
    while path is not None:
        letter, path = path
        out.append(letter)
    return "".join(reversed(out))


def restore(token: str, model: CharModel, known: frozenset[str] = frozenset()) -> str:
    """The word a token stands for; empty where it holds no letter. Known words stand for themselves."""
    t = token.lower()
    while (s := _EDGE.sub("", t)) != t:
        t = s
    if _PLAIN.match(t) and (t in known or not _TRACE.search(t)):
        return t
    if not any(map(str.isalpha, t)):
        return ""
    return decode(t, model)


def forms(word: str) -> list[str]:
    """The forms a word is scored by: itself, and its beginnings (marked by a trailing *)."""
    return [word, *(f"{word[:k]}*" for k in range(3, 7) if len(word) > k)]


@dataclass
class Model:
    """What scoring needs; its size is bounded by FORMS and GRAMS."""

    grams: dict[str, float]
    evidence: dict[str, float]
    base: float
    known: frozenset[str] = frozenset()
    slope: float = 1.0
    name: str = field(default_factory=lambda: uuid.uuid4().hex)

    def scorer(self) -> Scorer:
        """One scorer per process, so that its memo outlives a task."""
        return per_process(("toxicity", self.name), lambda: Scorer(self))


class Scorer:
    """Scores texts; tokens are memoised within MEMO_ENTRIES."""

    def __init__(self, model: Model):
        self.model, self.chars = model, CharModel(model.grams)
        self.of_token = Memo(self._token, MEMO_ENTRIES)
        whole = [w for w in model.evidence if len(w) >= 4 and not w.endswith("*")]
        self.begun = frozenset(w[:k] for w in whole for k in range(1, len(w)))

    def _word(self, word: str) -> str | None:
        """Of a word's forms the one of most evidence."""
        get = self.model.evidence.get
        found = [(get(f, 0.0), f) for f in forms(word) if f in self.model.evidence] if word else ()
        return max(found)[1] if found else None

    def _token(self, token: str) -> tuple[str | None, str]:
        word = restore(token, self.chars, self.model.known)
        return self._word(word), word

    def _spaced(self, run: str) -> list[str]:
        """A word spelt out: the word itself, and whole known words within."""
        joined = restore(_GAP.sub("", run), self.chars)
        longest = max(map(len, self.model.evidence), default=0)
        inner = [joined[a:b] for a in range(len(joined)) for b in range(a + 4, min(len(joined), a + longest) + 1) if joined[a:b] in self.model.evidence]
        return [f for f in (self._word(joined), *inner) if f]

    def _split(self, words: list[str]) -> list[tuple[int, int, str]]:
        """Neighbours (from, to, joined) that together spell a toxic word, one of them at least no known word."""
        out, known, evidence, end = [], self.model.known, self.model.evidence, 0
        for i in [i for i, w in enumerate(words) if w in self.begun]:
            joined = words[i]
            for j in range(i + 1, min(len(words), i + PIECES)):
                joined += words[j]
                if i >= end and len(joined) >= 4 and joined in evidence and not all(not w or w in known for w in words[i : j + 1]):
                    out.append((i, j + 1, joined))
                    end = j + 1
                    break
                if joined not in self.begun:
                    break
        return out

    def evidence(self, text: str) -> float:
        """The sum of the distinct forms' evidence in a text."""
        self.of_token.trim()
        found: set[str | None] = set()
        for line in text.split("\n"):
            read = [self.of_token[t] for t in line.split()]
            found.update(f for f, _ in read)
            found.update(joined for _, _, joined in self._split([w for _, w in read]))
        for m in _SPACED.finditer(text):
            found.update(self._spaced(m[0]))
        return -sum(math.log(1 - self.model.evidence[f]) for f in found if f)

    def score(self, text: str) -> float:
        z = math.log(self.model.base / (1 - self.model.base)) + self.model.slope * self.evidence(text)
        return 1 / (1 + math.exp(-z)) if z > -700 else 0.0

    def restored(self, text: str) -> str:
        """The text with spelt-out and split words joined and every token restored (lines are kept)."""
        out = []
        for line in _SPACED.sub(lambda m: _GAP.sub("", m[0]), text).split("\n"):
            words = [restore(t, self.chars, self.model.known) for t in line.split()]
            for a, b, joined in self._split(words):
                words[a:b] = [joined] + [""] * (b - a - 1)
            out.append(" ".join(filter(None, words)))
        return "\n".join(out)


def _bare(token: str) -> str:
    """A token of letters alone without the marks around it, else empty."""
    w = _EDGE.sub("", token)
    return w if w and _PLAIN.match(w) else ""


def _places(batches):
    """Where words of texts stand: (word, left, right, doc), neighbours and texts by hashes."""
    name = lambda x: xxhash.xxh3_64_intdigest(x) >> 1
    bare = Memo(_bare, MEMO_ENTRIES)
    for batch in batches:
        for part in slices(batch):
            rows: list[tuple] = []
            for text in part.column(0).to_pylist():
                tokens, doc = text.lower().split(), name(text)
                near = [0, *map(name, tokens), 0]
                seen = {(w, near[i], near[i + 2]) for i, t in enumerate(tokens) if (w := bare[t])}
                rows += [(*x, doc) for x in seen]
            bare.trim()
            columns = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["word", "left", "right", "doc"])


def _holding(batches):
    """In how many texts words stand: (word, n), added up before they go on."""
    bare, found = Memo(_bare, MEMO_ENTRIES), Counter()

    def rows():
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])
        found.clear()

    for batch in batches:
        for part in slices(batch):
            for text in part.column(0).to_pylist():
                found.update({bare[t] for t in set(text.lower().split())} - {""})
            bare.trim()
            if len(found) > MEMO_ENTRIES:
                yield from rows()
    yield from rows()


def fit(docs: DataFrame, labels: DataFrame, broadcast_bytes: int = LABELS_BYTES) -> Model:
    """Learns from all labelled rows whose crc32(doc_id as text) mod 3 is not 1; copies of a text are one text, each counts in the calibration."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (remainder("doc_id", 3) != 1))
    known = known.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    met = docs.where(remainder("doc_id", 3) != 1).select("doc_id", whole_text().alias("text")).join(small(known, broadcast_bytes), "doc_id")
    once = met.groupBy(F.xxhash64("text").alias("h"), "toxic").agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    texts = cut(once.select("text", "toxic", "copies", (F.pmod("h", F.lit(5)) == 0).alias("apart")), "labelled")
    toxic = cut(texts.where("not apart AND toxic = 1").select("text").mapInArrow(released(_places), "word string, left long, right long, doc long"), "found")
    others = texts.where("not apart AND toxic = 0").select("text").mapInArrow(released(_holding), "word string, n long").groupBy("word").agg(F.sum("n").alias("b"))
    starts = F.explode(F.array(*(F.when(F.length("word") > k, F.concat(F.substring("word", 1, k), F.lit("*"))) for k in range(3, 7)))).alias("form")
    apart = toxic.groupBy("word", "left").agg(F.min("right").alias("right")).groupBy("word").agg(F.countDistinct("right").alias("places"))
    against = toxic.groupBy("word").agg(F.countDistinct("doc").alias("docs")).join(apart, "word").select("word", F.least("places", "docs").alias("a"))
    words = cut(against.join(others, "word", "full").select("word", F.coalesce("a", F.lit(0)).alias("a"), F.coalesce("b", F.lit(0)).alias("b")), "words")
    seen = words.agg(F.sum("a"), F.sum("b")).first()
    a, b = float(seen[0] or 0), float(seen[1] or 0)
    base = a / (a + b) if a + b else 0.5
    # A beginning gets what all its words but the commonest give it, in at most as many texts as hold one.
    held = toxic.select(starts, "doc").where("form is not null").distinct().groupBy("form").agg(F.count("*").alias("docs"))
    begun = words.select(starts, "a", "b").where("form is not null").groupBy("form").agg((F.sum("a") - F.max("a")).alias("a"), F.sum("b").alias("b"))
    begun = begun.where(F.col("a") >= LEAST).join(held, "form").select("form", F.least("a", "docs").alias("a"), "b")
    rows = cut(words.select(F.col("word").alias("form"), "a", "b").unionByName(begun).where(F.col("a") >= LEAST), "forms")
    tried = max(1, rows.count())
    often = rows.where(F.col("a") > base * (F.col("a") + F.col("b"))).orderBy(F.desc(F.col("a") / (F.col("a") + F.col("b") + 2)), F.desc("a"), "form").limit(FORMS).collect()
    sure = {r.form: r for r in often if log_chance(r.a, r.a + r.b, base) + math.log(tried) < math.log(BY_CHANCE)}
    # A beginning that stands for one longer beginning alone says no more than that.
    longer: dict[str, int] = {}
    for form, r in sure.items():
        if form.endswith("*"):
            longer[form[:-2]] = max(longer.get(form[:-2], 0), r.a)
    evidence = {f: (r.a + 2.0 * base) / (r.a + r.b + 2.0) for f, r in sure.items() if not (f.endswith("*") and longer.get(f[:-1], 0) >= SAME * r.a)}
    padded = F.concat(F.lit("^" * (ORDER - 1)), F.col("word"), F.lit("\0"))
    grams = words.select((F.col("a") + F.col("b")).alias("n"), padded.alias("w"), F.explode(F.sequence(F.lit(1), F.length("word") + 1)).alias("i")).groupBy(F.expr(f"substring(w, i, {ORDER})").alias("g")).agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "g").limit(GRAMS).toArrow()
    common = words.where("b >= 2").orderBy(F.desc("b"), "word").limit(FORMS).select("word").toArrow()
    counts = dict(zip(grams["g"].to_pylist(), map(float, grams["n"].to_pylist()), strict=True))
    model = Model(counts, evidence, 0.5, known=frozenset(common["word"].to_pylist()) - evidence.keys())
    del grams, common
    release()
    rest = weigh(texts.where("apart"), model)
    model.base, model.slope = calibrated(*(rest.column(c).to_numpy() for c in ("evidence", "toxic", "n")))
    model.name = uuid.uuid4().hex
    return model


def weigh(texts: DataFrame, model: Model) -> pa.Table:
    """Rows (evidence, toxic, n) of labelled texts (text, toxic, copies): how many have that evidence, to nine places."""
    held = texts.sparkSession.sparkContext.broadcast(model)  # bounded by FORMS and GRAMS

    def run(batches):
        scorer = held.value.scorer()
        for batch in batches:
            for part in slices(batch):
                yield pa.RecordBatch.from_arrays([pa.array(list(map(scorer.evidence, part.column(0).to_pylist())), pa.float64()), part.column(1), part.column(2)], names=["evidence", "toxic", "copies"])

    each = texts.select("text", "toxic", "copies").mapInArrow(run, "evidence double, toxic int, copies long")
    return each.groupBy(F.round("evidence", 9).alias("evidence"), "toxic").agg(F.sum("copies").alias("n")).orderBy("evidence", "toxic").toArrow()


def log_chance(a: int, n: int, p: float) -> float:
    """The logarithm of the probability of a or more in n at probability p."""
    if p <= 0 or p >= 1:
        return 0.0
    term = math.lgamma(n + 1) - math.lgamma(a + 1) - math.lgamma(n - a + 1) + a * math.log(p) + (n - a) * math.log1p(-p)
    total, part, k = 1.0, 1.0, a
    while k < n and part > 1e-9 * total:
        part *= (n - k) / (k + 1) * p / (1 - p)
        total += part
        k += 1
    return min(0.0, term + math.log(total))


def calibrated(evidence: np.ndarray, toxic: np.ndarray, times: np.ndarray) -> tuple[float, float]:
    """The probability without evidence, and the slope of the log odds by it: logistic regression, held near a slope of 1.

    With labels of one kind only, or none, the share of toxic ones (a half without any) and 1.
    """
    n, hits = int(times.sum()), int((times * toxic).sum())
    prior = (hits + 1.0) / (n + 2.0)
    if not 0 < hits < n:
        return (prior if n else 0.5), 1.0
    x, y, m = evidence, toxic.astype(float), times.astype(float)
    c, k = math.log(prior / (1 - prior)), 1.0
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(c + k * x, -30, 30)))
        w = m * q * (1 - q)
        grad = np.array([(m * (q - y)).sum() + 0.1 * (c + 2), (m * (q - y) * x).sum() + 2 * (k - 1)])
        hess = np.array([[w.sum() + 0.1, (w * x).sum()], [(w * x).sum(), (w * x * x).sum() + 2]])
        step = np.linalg.solve(hess, grad)
        step /= max(1.0, np.abs(step).max())
        c, k = c - step[0], k - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return float(1 / (1 + math.exp(-c))), max(0.1, float(k))


def score(df: DataFrame, model: Model, text: str = "text", out: str = "score", keep: list[str] | None = None, restored: str | None = None) -> DataFrame:
    """Adds a score from 0 to 1 for every whole text, and the restored text where a name for it is given."""
    extra = [out] + ([restored] if restored else [])
    keep = [c for c in (df.columns if keep is None else keep) if c.lower() not in {x.lower() for x in extra}]
    tune(df.sparkSession)
    at = keep.index(text) if text in keep else len(keep)  # the text goes over once
    work = df.select(*[F.col(f"`{c}`") for c in keep], *([] if text in keep else [F.col(f"`{text}`").alias("__text")]))
    held = df.sparkSession.sparkContext.broadcast(model)  # bounded by FORMS and GRAMS

    def run(batches):
        scorer = held.value.scorer()
        for batch in batches:
            for part in slices(batch):
                texts = [t or "" for t in part.column(at).to_pylist()]
                made = [pa.array(list(map(scorer.score, texts)), pa.float64())]
                if restored:
                    made.append(pa.array(list(map(scorer.restored, texts)), pa.string()))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], *made], names=[*keep, *extra])

    fields = [work.schema[c] for c in keep] + [T.StructField(out, T.DoubleType())] + ([T.StructField(restored, T.StringType())] if restored else [])
    return work.mapInArrow(run, T.StructType(fields))

"""Language-model scoring by context-tree weighting over the bytes of texts.

A text is coded as its words, A-Z in lower case, each with a space behind it, and the byte 0x0A at
its end; DEPTH spaces go before it. Every byte is eight binary decisions. A decision's contexts are
the 0 to DEPTH bytes before it, across words; each context node keeps how often the decision went
either way in all training texts, estimates it by Krichevsky-Trofimov, and the context tree weights
all depths: with P_e the estimate's probability of all a node has seen and P_w that of the weighted
mixture, P_w = (P_e + product of the children's P_w) / 2. A byte is predicted by the mixture of the
estimates along its context path, down to the deepest node that exists. A text's score is the sum
over its bytes of the log10 probabilities, its code length; the bytes' probabilities sum to 1.

1. One pass counts the words (by 64-bit hashes) and the steps, a context of DEPTH bytes and a byte,
   of all training texts; steps of other texts come along with a count of 0. Tasks add up what they
   can before anything is shuffled.
2. The subtree below each context of SPLIT bytes is worked out by itself, the levels above as keyed
   tables, upwards for P_w and downwards for the mixture; that gives every step its probability.
3. Texts look their steps up in that table, broadcast if it takes at most BROADCAST_BYTES; else each
   chunk of texts asks for its distinct steps once, by bucket, and meets the answers. They look their
   words up in that of the HEAD most frequent (a fixed number), all others by a join.

Results for odd input: null and empty texts consist of the end alone; repeated rows each get their
row; a null doc_id counts as the empty text where training texts are chosen; without any training
text N and V are 0 and every decision is even; an empty table gives an empty table; other columns
are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm import words
from folioscope.llm.common import cut, forget, released, whole_text

DEPTH = 5
#: Words looked up by broadcast, bytes of predictions up to which these are broadcast, and rows a task holds back.
HEAD, BROADCAST_BYTES, HELD = 1_000_000, 64 << 20, 3_000_000
#: Beyond that: steps of a bucket, bytes of texts that ask for their steps together, and texts of a packed row.
BUCKET_STEPS, CHUNK_BYTES, PACKED_TEXTS = 100_000, 32 << 20, 64
#: The key of the end of a text among the words' hashes.
END = 0


def steps(texts: pa.Array, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys context << 8 | byte of all coded bytes of the texts, end to end, and how many each text has."""
    data, offsets = words.data_of(texts)
    raw, at = data.tobytes(), offsets.tolist()
    # Each text: depth spaces, its words with a space behind each, the end.
    parts = [b" " * depth + b" ".join([*raw[a:b].lower().split(), b"\n"]) for a, b in zip(at, at[1:], strict=False)]
    size = np.array([len(x) for x in parts], np.int64)
    out = b"".join([bytes(7), *parts])
    # The eight bytes up to each place as one number, of which a step keeps the last.
    key = np.ndarray(len(out) - 7, ">u8", out, 0, (1,)).astype(np.uint64) & np.uint64((1 << 8 * (depth + 1)) - 1)
    keep = np.ones(len(key), bool)
    start = np.cumsum(size) - size
    for k in range(depth):
        keep[start + k] = False
    return key[keep].view(np.int64), size - depth


def scores(texts: pa.Array, depth: int, known: np.ndarray, lps: np.ndarray) -> np.ndarray:
    """The summed predictions of each of at most 256 texts; known: sorted steps, all of the texts' among them."""
    keys, coded = steps(texts, depth)
    # Steps of 56 bits at most, and whose they are, sorted together.
    both = keys.view(np.uint64) << np.uint64(8) | np.repeat(np.arange(len(texts), dtype=np.uint64), coded)
    both.sort()
    keys = both >> np.uint64(8)
    heads = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    each = np.repeat(lps[np.searchsorted(known, keys[heads].view(np.int64))], np.diff(np.r_[heads, len(keys)]))
    return np.bincount((both & np.uint64(255)).astype(np.int64), each, len(texts)).astype(float)


class _Sums:
    """Counts by key, added up now and then."""

    def __init__(self):
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, keys: np.ndarray, times: np.ndarray) -> None:
        self.held.append((keys, times))
        self.size += len(keys)
        if self.size > HELD:
            self.close()

    def close(self) -> tuple[np.ndarray, np.ndarray]:
        if len(self.held) > 1:
            keys, at = np.unique(np.concatenate([k for k, _ in self.held]), return_inverse=True)
            self.held = [(keys, np.bincount(at, np.concatenate([t for _, t in self.held]), len(keys)).astype(np.int64))]
        self.size = len(self.held[0][0]) if self.held else 0
        return self.held[0] if self.held else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def count(docs: DataFrame, training: Column, depth: int) -> DataFrame:
    """Rows (kind, key, n): words (kind 0) of training texts, and steps (kind 1) of all, with their counts in training texts."""

    def run(batches):
        found = _Sums(), _Sums()

        def rows():
            for kind, sums in enumerate(found):
                keys, n = sums.close()
                for a in range(0, len(keys), 100_000):
                    b = min(len(keys), a + 100_000)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(b - a, kind, np.int32)), pa.array(keys[a:b]), pa.array(n[a:b])], names=["kind", "key", "n"])
                sums.held, sums.size = [], 0

        for batch in batches:
            for part in words.slices(batch, 0):
                train = part.column(1).to_numpy(zero_copy_only=False).astype(bool)
                for learnt in (True, False):
                    texts = part.column(0).filter(pa.array(train == learnt))
                    if not len(texts):
                        continue
                    keys, n = np.unique(steps(texts, depth)[0], return_counts=True)
                    found[1].add(keys, n if learnt else np.zeros(len(n), np.int64))
                    if learnt:
                        keys, n = np.unique(words.of_texts(texts)[0].view(np.int64), return_counts=True)
                        found[0].add(np.r_[END, keys], np.r_[len(texts), n])
            if max(x.size for x in found) > HELD // 2:
                yield from rows()
        yield from rows()

    work = docs.select(whole_text().alias("text"), F.coalesce(training, F.lit(False)).alias("train"))
    return work.mapInArrow(released(run), "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))


def _lgamma(x: np.ndarray) -> np.ndarray:
    """log Gamma for x >= 0.5: Stirling's series six steps further up."""
    y = x + 6
    product = x * (x + 1) * (x + 2) * (x + 3) * (x + 4) * (x + 5)
    series = 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + series - np.log(product)


_HALF = math.log(0.5)


class Level:
    """The nodes of one depth: keys context << 8 | node, counts, log P_w, and the estimate's share w of it."""

    def __init__(self, keys, n0, n1, below=None):
        self.keys, self.n0, self.n1 = keys, n0, n1
        pe = _lgamma(n0 + 0.5) + _lgamma(n1 + 0.5) - math.log(math.pi) - _lgamma(n0 + n1 + 1.0)
        self.pw = pe if below is None else _HALF + np.logaddexp(pe, below)
        self.w = np.ones(len(keys)) if below is None else np.exp(_HALF + pe - self.pw)
        self.kt = (n1 + 0.5) / (n0 + n1 + 1.0)

    @classmethod
    def deepest(cls, steps_: np.ndarray, times: np.ndarray) -> Level:
        nodes, bits = decisions(steps_)
        keys, at = np.unique(nodes.ravel(), return_inverse=True)
        n = np.broadcast_to(times.astype(float), nodes.shape).ravel()
        ones = np.bincount(at, n * bits.ravel(), len(keys))
        return cls(keys, np.bincount(at, n, len(keys)) - ones, ones)

    def above(self, depth: int) -> Level:
        """The level of that depth, whose nodes are these nodes' parents."""
        keys, at = np.unique(shortened(self.keys, depth), return_inverse=True)
        total = lambda x: np.bincount(at, x, len(keys))
        return Level(keys, total(self.n0), total(self.n1), total(self.pw))

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of keys, and which of them exist."""
        if not len(self.keys):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return at, self.keys[at] == keys


def decisions(steps_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The eight decisions of each step, by rows: the step's key with the byte replaced by the node, and the bit."""
    k = np.arange(8)[:, None]
    byte, context = steps_ & 255, steps_ & ~np.int64(255)
    return context | 1 << k | byte >> 8 - k, byte >> 7 - k & 1


def shortened(keys: np.ndarray, depth: int) -> np.ndarray:
    """Keys of the same decisions in contexts of depth bytes."""
    return keys & np.int64((1 << 8 * (depth + 1)) - 1)


def _subtree(steps_: np.ndarray, times: np.ndarray, depth: int, top: int) -> list[Level]:
    """Levels top to depth of the nodes of the steps that were seen."""
    levels = [Level.deepest(steps_[times > 0], times[times > 0])]
    for d in range(depth - 1, top - 1, -1):
        levels.insert(0, levels[0].above(d))
    return levels


def _mixtures(levels: list[Level], top: int, acc: np.ndarray, rest: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """Per level the prediction where a path ends there; acc, rest: of the first level, what its path has gathered
    and what weight is left."""
    leaves = [first]
    for i, level in enumerate(levels[1:], 1):
        up, _ = levels[i - 1].find(shortened(level.keys, top + i - 1))
        leaves.append(acc[up] + rest[up] * level.kt)
        acc, rest = acc[up] + rest[up] * level.w * level.kt, rest[up] * (1 - level.w)
    return leaves


#: The tree's first levels, of contexts of up to SPLIT bytes, are tables; what hangs below one context of SPLIT bytes is worked out together.
SPLIT = 2


def _stems(counted: DataFrame, depth: int, top: int) -> DataFrame:
    """Rows (node, n0, n1, pw, w) of depth top, from all below."""

    def run(table: pa.Table) -> pa.Table:
        level = _subtree(table["step"].to_numpy(), table["n"].to_numpy(), depth, top)[0]
        return pa.table({"node": level.keys, "n0": level.n0, "n1": level.n1, "pw": level.pw, "w": level.w})

    return counted.where("n > 0").groupBy(_stem("step", top).alias("stem")).applyInArrow(lambda t: run(t), "node long, n0 double, n1 double, pw double, w double")


def _stem(step: str, top: int) -> Column:
    """The last bytes of a step's context, by which subtrees are told apart."""
    return F.expr(f"shiftright({step}, 8) & {(1 << 8 * top) - 1}L")


def build_top(stems: DataFrame, top: int) -> list[DataFrame]:
    """Per depth 0 to top a table (node, leaf, acc, rest) of the path's mixture."""

    def merge(table: pa.Table, depth: int) -> pa.Table:
        level = Level(table["node"].to_numpy(), table["n0"].to_numpy(), table["n1"].to_numpy(), table["below"].to_numpy())
        return pa.table({"node": level.keys, "n0": level.n0, "n1": level.n1, "pw": level.pw, "w": level.w})

    up = lambda node, d: F.expr(f"{node} & {(1 << 8 * (d + 1)) - 1}L")
    levels = [stems]
    for d in range(top - 1, -1, -1):
        sums = levels[0].groupBy(up("node", d).alias("node")).agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("pw").alias("below"))

        def weigh(batches, d=d):
            for batch in batches:
                yield from merge(pa.Table.from_batches([batch]), d).to_batches()

        levels.insert(0, cut(sums.mapInArrow(weigh, stems.schema), f"level{d}"))
    kt = (F.col("n1") + 0.5) / (F.col("n0") + F.col("n1") + 1)
    out = [cut(levels[0].select("node", kt.alias("leaf"), (F.col("w") * kt).alias("acc"), (1 - F.col("w")).alias("rest")), "path0")]
    for d in range(1, top + 1):
        above = out[-1].select(F.col("node").alias("up"), F.col("acc").alias("acc0"), F.col("rest").alias("rest0"))
        met = levels[d].withColumn("up", up("node", d - 1)).join(above, "up")
        leaf = F.col("acc0") + F.col("rest0") * kt
        out.append(cut(met.select("node", leaf.alias("leaf"), (F.col("acc0") + F.col("rest0") * F.col("w") * kt).alias("acc"), (F.col("rest0") * (1 - F.col("w"))).alias("rest")), f"path{d}"))
    return out


def predict(counted: DataFrame, depth: int) -> DataFrame:
    """Rows (step, lp): log10 of the predicted probability of every step in counted (step, n); n is 0 if unseen."""
    top = min(SPLIT, depth)
    paths = build_top(cut(_stems(counted, depth, top), "stems"), top)

    def run(steps_: pa.Table, path: pa.Table) -> pa.Table:
        key, n = steps_["step"].to_numpy(), steps_["n"].to_numpy()
        lp, missing = np.zeros(len(key)), np.zeros(len(key), np.int32)
        levels = _subtree(key, n, depth, top)
        node = path["node"].to_numpy()
        order = np.argsort(node)
        of = lambda c: path[c].to_numpy()[order]
        leaves = _mixtures(levels, top, of("acc"), of("rest"), of("leaf")) if len(node) else [np.zeros(0)] * len(levels)
        nodes, bits = decisions(key)
        for k in range(8):
            p, left = np.full(len(key), np.nan), np.ones(len(key), bool)
            for d in range(len(levels) - 1, -1, -1):
                at, there = levels[d].find(shortened(nodes[k], top + d))
                there &= left
                if there.any():
                    p[there] = leaves[d][at[there]]
                    left &= ~there
            lp += np.where(left, 0.0, np.log10(np.where(left, 0.5, np.where(bits[k] == 1, p, 1 - p))))
            missing |= left.astype(np.int32) << k
        return pa.table({"step": key, "lp": lp, "missing": missing})

    stem = _stem("step", top)
    below = cut(
        counted.groupBy(stem.alias("stem")).cogroup(paths[top].groupBy(_stem("node", top).alias("stem"))).applyInArrow(lambda a, b: run(a, b) if a.num_rows else pa.table({"step": pa.array([], pa.int64()), "lp": pa.array([], pa.float64()), "missing": pa.array([], pa.int32())}), "step long, lp double, missing int"),
        "below",
    )
    done = below.where("missing = 0").select("step", "lp")
    # Decisions of unseen steps that no subtree knows: the deepest node above it, or even odds.
    bit = F.explode(F.expr("filter(transform(sequence(0, 7), k -> struct(k AS k, (step & ~255L) | shiftleft(1L, k) | shiftright(step & 255L, 8 - k) AS node, (shiftright(step, 7 - k) & 1L) AS bit)), x -> (shiftright(missing, x.k) & 1) = 1)")).alias("d")
    open_ = below.where("missing <> 0").select("step", "lp", bit).select("step", "lp", "d.k", "d.bit", F.col("d.node").alias("full"))
    every = paths[0].select("node", "leaf", F.lit(0).alias("depth"))
    for d in range(1, top):
        every = every.unionByName(paths[d].select("node", "leaf", F.lit(d).alias("depth")))
    spread = open_.withColumn("depth", F.explode(F.sequence(F.lit(0), F.lit(max(0, top - 1))))).withColumn("node", F.expr("full & (shiftleft(1L, 8 * (depth + 1)) - 1)"))
    each = spread.join(every, ["depth", "node"], "left").groupBy("step", "lp", "k", "bit").agg(F.max_by("leaf", F.when(F.col("leaf").isNotNull(), F.col("depth"))).alias("leaf"))
    p = F.coalesce("leaf", F.lit(0.5))
    rest = each.groupBy("step", "lp").agg(F.sum(F.log10(F.when(F.col("bit") == 1, p).otherwise(1 - p))).alias("more"))
    return done.unionByName(rest.select("step", (F.col("lp") + F.col("more")).alias("lp")))


def score(docs: DataFrame, training: Column, depth: int = DEPTH, head: int = HEAD, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Rows (doc_id, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) for all rows of docs."""
    if not 0 <= depth <= 6:
        raise ValueError("contexts of up to 6 bytes fit a key")
    spark = docs.sparkSession
    counted = cut(count(docs, training, depth), "counts")
    forget(spark)
    tokens = counted.where("kind = 0").select(F.col("key").alias("tok"), F.col("n").alias("c"))
    n, v = tokens.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    total = float(n + v + 1)
    predictions = cut(predict(counted.where("kind = 1").select(F.col("key").alias("step"), "n"), depth), "predictions")
    top = tokens.orderBy(F.desc("c"), "tok").limit(head).toArrow()  # a fixed number
    order = np.argsort(top.column("tok").to_numpy())
    many = predictions.count()
    in_place = 16 * many <= broadcast_bytes
    steps_, lp = np.zeros(0, np.int64), np.zeros(0)
    if in_place:
        got = predictions.toArrow()
        by = np.argsort(got.column("step").to_numpy())
        steps_, lp = got.column("step").to_numpy()[by], got.column("lp").to_numpy()[by]
    held = spark.sparkContext.broadcast((top.column("tok").to_numpy()[order], top.column("c").to_numpy()[order], steps_, lp))

    def run(batches):
        toks, counts, known_steps, lps = held.value
        base = np.log10((counts + 1) / total)
        for batch in batches:
            for part in words.slices(batch, 1):
                rows = part.num_rows
                score = scores(part.column(1), depth, known_steps, lps) if in_place else np.zeros(rows)
                flat, many = words.of_texts(part.column(1))
                # Each text's words, then its end.
                word = np.insert(flat.view(np.int64), np.cumsum(many), END)
                owner = np.repeat(np.arange(rows), many + 1)
                at = np.searchsorted(toks, word)
                at[at == len(toks)] = 0
                there = toks[at] == word if len(toks) else np.zeros(len(word), bool)
                k = np.bincount(owner[there], counts[at[there]] > 0, rows).astype(np.int64) if len(toks) else np.zeros(rows, np.int64)
                b = np.bincount(owner[there], base[at[there]], rows).astype(float) if len(toks) else np.zeros(rows)
                pairs, tf = np.unique(np.stack([owner[~there], word[~there]]), axis=1, return_counts=True) if not there.all() else (np.zeros((2, 0), np.int64), np.zeros(0, np.int64))
                size = np.diff(words.data_of(part.column(1))[1])
                own = pa.StructArray.from_arrays([pa.array(many + 1), pa.array(k), pa.array(b), pa.array(score), pa.array(size)], names=["n", "k", "b", "s", "size"])
                none = pa.nulls(len(tf), own.type)
                ids, hashes = part.column(0), part.column(2)
                who = pa.array(pairs[0])
                # A text's own row is dealt by its hash; other rows carry words that are not in the broadcast table.
                yield pa.RecordBatch.from_arrays([ids, hashes, hashes, pa.array(np.ones(rows, np.int64)), own], names=["doc_id", "h", "tok", "tf", "own"])
                yield pa.RecordBatch.from_arrays([ids.take(who), hashes.take(who), pa.array(pairs[1]), pa.array(tf), none], names=["doc_id", "h", "tok", "tf", "own"])

    work = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).withColumn("h", F.xxhash64("text"))
    found = work.mapInArrow(released(run), "doc_id long, h long, tok long, tf long, own struct<n:long,k:long,b:double,s:double,size:long>")
    met = found.join(tokens, "tok", "left") if v > head else found.withColumn("c", F.lit(None).cast("long"))
    own = F.col("own")
    parts = met.groupBy("doc_id", "h").agg(
        F.sum(F.expr("CAST(own IS NOT NULL AS long)")).alias("copies"),
        F.sum("own.n").alias("n"),
        F.sum(F.when(own.isNotNull(), F.col("own.k")).otherwise(F.expr("CASE WHEN c > 0 THEN tf ELSE 0 END"))).alias("k"),
        F.sum(F.when(own.isNotNull(), F.col("own.b")).otherwise(F.col("tf") * F.log10((F.coalesce("c", F.lit(0)) + 1) / F.lit(total)))).alias("b"),
        F.sum("own.s").alias("s"),
        F.max("own.size").alias("size"),
    )
    if not in_place:
        sums = _joined_scores(work, predictions, many, depth)
        parts = parts.drop("s").join(sums, parts["doc_id"].eqNullSafe(sums["__id"]) & (parts["h"] == sums["__h"])).drop("__id", "__h")
    each = lambda c: F.col(c) / F.col("copies")
    return parts.select(
        "doc_id",
        each("n").cast("long").alias("n_tokens"),
        each("k").cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        each("b").alias("base_score"),
        each("s").alias("score"),
        (-each("s") * math.log2(10) / F.greatest(F.col("size"), F.lit(1))).alias("bits_per_byte"),
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"),
    ).drop("copy")


def _packed(keys: np.ndarray, bits: int):
    """Sorted steps by bucket: (bucket, which they are, their differences byte plane by byte plane)."""
    bucket = (words.mix(keys.view(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
    by = np.argsort(bucket, kind="stable")
    heads = np.flatnonzero(np.r_[True, bucket[by][1:] != bucket[by][:-1]][: len(by)])
    for a, b in zip(heads.tolist(), [*heads[1:].tolist(), len(by)], strict=True):
        pick = by[a:b]
        yield int(bucket[pick[0]]), pick, np.diff(keys[pick], prepend=0).view(np.uint8).reshape(-1, 8).T.tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(raw, np.uint8).reshape(8, -1).T.copy().view(np.int64).ravel())


def _table(parts: list[tuple[bytes, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted steps and their predictions, of packed pieces."""
    keys, lps = np.concatenate([_unpacked(k) for k, _ in parts]), np.concatenate([np.frombuffer(v) for _, v in parts])
    by = np.argsort(keys)
    return keys[by], lps[by]


_ASKED = "chunk long, bucket int, data binary, lps binary"


def _rows(chunk: int | None, bucket: int | None, data, lps: bytes | None) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([bucket], pa.int32()), pa.array([data], pa.binary()), pa.array([lps], pa.binary())], names=["chunk", "bucket", "data", "lps"])


def _joined_scores(work: DataFrame, predictions: DataFrame, many: int, depth: int) -> DataFrame:
    """Rows (__id, __h, s): the summed scores of all rows of a text, where the `many` predictions are not broadcast.

    Texts are dealt in chunks. A chunk asks for each of its distinct steps once, in one row for each bucket
    of steps; the answers meet its packed texts again. No row stands for a single step of a text.
    """
    bits = max(0, (many // BUCKET_STEPS).bit_length())

    def known(batches):
        held, size = [], 0

        def rows():
            keys, lps = (np.concatenate(x) for x in zip(*held, strict=True))
            by = np.argsort(keys)
            keys, lps = keys[by], lps[by]
            for bucket, pick, raw in _packed(keys, bits):
                yield _rows(None, bucket, raw, lps[pick].tobytes())

        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            size += batch.num_rows
            if size > HELD:
                yield from rows()
                held, size = [], 0
        if size:
            yield from rows()

    def asked(batches):
        chunk, size, found = TaskContext.get().partitionId() << 32, 0, _Sums()

        def asks():
            for bucket, _, raw in _packed(found.close()[0], bits):
                yield _rows(chunk, bucket, raw, None)

        for batch in batches:
            for part in words.slices(batch, 1, PACKED_TEXTS):
                keys, n = np.unique(steps(part.column(1), depth)[0], return_counts=True)
                found.add(keys, n)
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                    out.write_batch(part)
                yield _rows(chunk, None, sink.getvalue().to_pybytes(), None)
                size += part.column(1).nbytes
                if size > CHUNK_BYTES:
                    yield from asks()
                    chunk, size, found = chunk + 1, 0, _Sums()
        if size:
            yield from asks()

    def answers(batches):
        now, held, table = None, [], None
        for batch in batches:
            for chunk, bucket, data, lps in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bucket != now:
                    now, held, table = bucket, [], None
                if chunk is None:
                    held.append((data, lps))
                    continue
                if table is None:
                    table, held = _table(held), []
                yield _rows(chunk, bucket, data, table[1][np.searchsorted(table[0], _unpacked(data))].tobytes())

    def summed(batches):
        now, held, table = None, [], None
        for batch in batches:
            for chunk, bucket, data, lps in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if chunk != now:
                    now, held, table = chunk, [], None
                if bucket is not None:
                    held.append((data, lps))
                    continue
                if table is None:
                    table, held = _table(held), []
                part = pa.ipc.open_stream(data).read_next_batch()
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(scores(part.column(1), depth, *table))], names=["__id", "__h", "s"])

    texts = cut(work.mapInArrow(released(asked), _ASKED), "asked")
    ask = predictions.mapInArrow(released(known), _ASKED).unionByName(texts.where("bucket is not null"))
    answered = ask.repartition("bucket").sortWithinPartitions("bucket", F.col("chunk").asc_nulls_first()).mapInArrow(released(answers), _ASKED)
    met = texts.where("bucket is null").unionByName(answered).repartition("chunk").sortWithinPartitions("chunk", F.col("bucket").asc_nulls_last())
    return met.mapInArrow(released(summed), "__id long, __h long, s double").groupBy("__id", "__h").agg(F.sum("s").alias("s"))

"""N-gram Jaccard join: classes of documents whose shingle sets are alike, by signature trees.

Documents are alike when the Jaccard similarity of their sets of distinct word shingles reaches a
threshold; classes are the components of that relation. Every step is exact:

1. A pass hashes each text's shingles. Equal sets are one node from here on (sid, a hash of the
   set), so copies are never paired. Shingles that repeat much are listed (HOT, a fixed number).
2. A second pass emits the shingles of a fixed share of the hash space, but for the hot ones. A
   shingle that no other set has cannot be in an intersection; a set with more of them than the
   threshold allows it to miss has no partner and leaves. The rest keep a prefix: as many shingles
   as they may miss and one more, rarest first. Two alike sets share one of their prefixes.
3. Sets that share a prefix shingle, in runs of compatible sizes, form candidate groups.
4. Within a group, in units of bounded weight, a signature tree is built: its nodes hold the OR
   and the AND of their sets' bitmaps and the range of set sizes. Two nodes are traversed together
   and left as soon as their greatest possible overlap is too small, or all below is known to be
   one class already; sets at the leaves are compared exactly.

Groups beyond one unit are split by size and hash; units of one part, and of neighbouring parts,
go first, and then only those pairs of parts that still hold different classes.

Results for odd input: null and empty texts have no shingles and are linked with nothing; texts
of fewer words than a shingle have one, the whole sequence; repeated rows give repeated rows; rows
without a doc_id are counted but linked with nothing (component null); an empty table gives an
empty table; other columns are not read. Sets are told apart by 64-bit hashes.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm import words as words_
from folioscope.llm.common import cut, forget, released, small, whole_text
from folioscope.llm.graph import components

#: Frequent shingles that order prefixes; weight (shingles) of one side of a unit; sixteenths of the hash space that the second pass emits.
HOT, UNIT_WEIGHT, SHARE = 100_000, 200_000, 6
#: Bytes up to which the candidates' ids are broadcast to fetch their texts; beyond, they are joined.
BROADCAST_BYTES = 32 << 20
#: Sets remembered as sent by a task; rows of one shingle held by one; a set is broadcast if more than one in OFTEN documents has it.
SENT_ENTRIES, CROWD, OFTEN = 100_000, 1 << 19, 1_000
BITS, LEAF, FAN = 1024, 16, 4
_P = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(texts: pa.Array, words: int = 5) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its shingles (A-Z in lower case, words between white space)."""
    h, counts = words_.of_texts(texts)
    whole = np.full(max(0, len(h) - words + 1), words, np.uint64)
    for i in range(words):
        whole = (whole ^ h[i : len(h) - words + 1 + i]) * _P
        whole ^= whole >> np.uint64(29)
    out, at = [], 0
    for n in counts.tolist():
        if n >= words:
            out.append(np.unique(whole[at : at + n - words + 1]))
        elif n:
            short = np.full(1, n, np.uint64)
            for i in range(n):
                short = (short ^ h[at + i]) * _P
                short ^= short >> np.uint64(29)
            out.append(short)
        else:
            out.append(np.zeros(0, np.uint64))
        at += n
    return out


def shingles(text: str, words: int = 5) -> np.ndarray:
    return shingle_sets(pa.array([text]), words)[0]


def _sid(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def _needed(n: int, percent: int) -> int:
    """The least overlap of a set of n with an alike one."""
    return -(-percent * n // 100)


def _sets(docs: DataFrame, words: int) -> DataFrame:
    """Rows (doc_id, t, n, sid, key, times): one per text, and one per shingle that repeats among nearby texts."""

    def run(batches):
        held: list[np.ndarray] = []
        size = 0

        def repeated():
            keys, times = np.unique(np.concatenate(held), return_counts=True)
            often = times >= 4
            k, t = keys[often].view(np.int64), times[often]
            none = pa.nulls(len(k), pa.int64())
            return pa.RecordBatch.from_arrays([none, none, none, none, pa.array(k), pa.array(t.astype(np.int64))], names=["doc_id", "t", "n", "sid", "key", "times"])

        for batch in batches:
            for part in words_.slices(batch, 1):
                sets = shingle_sets(part.column(1), words)
                blank = pa.nulls(len(sets), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array([_sid(s) for s in sets], pa.int64()), blank, blank], names=["doc_id", "t", "n", "sid", "key", "times"])
                held += sets
                size += sum(map(len, sets))
                if size > 1_000_000:
                    yield repeated()
                    held, size = [], 0
        if held:
            yield repeated()

    return docs.select("doc_id", "text", F.xxhash64("text").alias("t")).mapInArrow(released(run), "doc_id long, t long, n long, sid long, key long, times long")


def _emitted(docs: DataFrame, hot, words: int, percent: int) -> DataFrame:
    """Rows (key, sid, kind): kind 0 a shingle of the share, 1 one that fills up a short prefix; from 2 on the
    set's own row: key is sid, kind is 2 + (n << 31 | number of kind 0)."""

    def run(batches):
        hot_keys, hot_rank = hot.value
        sent: set[int] = set()  # copies of a set need not be sent again; forgetting some is harmless
        for batch in batches:
            for part in words_.slices(batch, 0):
                keys, sids, kinds = [], [], []
                for s in shingle_sets(part.column(0), words):
                    n = len(s)
                    sid = _sid(s)
                    if not n or sid in sent:
                        continue
                    sent.add(sid)
                    at = np.searchsorted(hot_keys, s)
                    at[at == len(hot_keys)] = 0
                    is_hot = hot_keys[at] == s if len(hot_keys) else np.zeros(n, bool)
                    cold = s[~is_hot]
                    cut_at = int(np.searchsorted(cold, np.uint64(SHARE << 60)))
                    fill = cold[:0]
                    short = n - _needed(n, percent) + 1 - cut_at
                    if short > 0:
                        fill = cold[cut_at : cut_at + short]
                        short -= len(fill)
                        if short > 0:
                            frequent = s[is_hot]
                            fill = np.concatenate([fill, frequent[np.argsort(hot_rank[at[is_hot]], kind="stable")[:short]]])
                    keys += [cold[:cut_at].view(np.int64), fill.view(np.int64), np.array([sid])]
                    sids.append(np.full(cut_at + len(fill) + 1, sid))
                    kinds.append(np.concatenate([np.zeros(cut_at, np.int64), np.ones(len(fill), np.int64), [2 + (n << 31 | cut_at)]]))
                if len(sent) > SENT_ENTRIES:
                    sent.clear()
                if keys:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (keys, sids, kinds)], names=["key", "sid", "kind"])

    return docs.select("text").mapInArrow(released(run), "key long, sid long, kind long")


def _runs(batches, columns: int, most: int | None = None):
    """Sorted record batches as numpy columns, cut so that equal values of the first stay together, and False.

    A run of more than `most` rows comes alone and in pieces, with True.
    """
    held: list = []
    size, key, crowded = 0, None, False

    def joined(parts):
        return [np.concatenate(x) for x in zip(*parts, strict=True)] if len(parts) > 1 else parts[0]

    for batch in batches:
        now = [batch.column(i).to_numpy() for i in range(columns)]
        if not len(now[0]):
            continue
        end = 0 if key is None else int(np.searchsorted(now[0], key, "right"))
        if end < len(now[0]):  # the run that was held, if any, ends here
            last = int(np.searchsorted(now[0], now[0][-1]))
            if crowded and size + end:
                yield joined([*held, [x[:end] for x in now]]), True
                held, size = [], 0
            elif crowded:
                held, size = [], 0
            whole = [*held, [x[end if crowded else 0 : last] for x in now]]
            if sum(len(x[0]) for x in whole):
                yield joined(whole), False
            held, key, crowded = [[x[last:] for x in now]], now[0][-1], False
            size = len(held[0][0])
        else:
            held.append(now)
            size += end
        if most and size > most:
            yield joined(held), True
            held, size, crowded = [], 0, True
    if size:
        yield joined(held), crowded


def _shared(emitted: DataFrame) -> DataFrame:
    """Of the emitted rows those whose shingle several sets have (df > 1, counted up to CROWD), and each set's own row (df 0)."""

    def run(batches):
        for (key, sid, kind), crowded in _runs(batches, 3, CROWD):
            first = np.ones(len(key), bool)  # copies send the same rows
            first[1:] = (key[1:] != key[:-1]) | (sid[1:] != sid[:-1]) | (kind[1:] != kind[:-1])
            key, sid, kind = key[first], sid[first], kind[first]
            own = kind >= 2
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            count = np.full(len(starts), CROWD) if crowded else np.add.reduceat((~own).astype(np.int64), starts)
            df = np.repeat(count, np.diff(np.r_[starts, len(key)]))
            keep = own | (df > 1)
            yield pa.RecordBatch.from_arrays([pa.array(sid[keep]), pa.array(key[keep]), pa.array(np.where(own, 0, df)[keep]), pa.array(kind[keep])], names=["sid", "key", "df", "kind"])

    dealt = emitted.repartition("key").sortWithinPartitions("key", "sid", "kind")
    return dealt.mapInArrow(released(run), "sid long, key long, df long, kind long")


def _prefixes(shared: DataFrame, percent: int) -> DataFrame:
    """Rows (key, sid, n): the shared shingles in the prefixes of sets that can have a partner."""

    def run(batches):
        for (sid, key, df, kind), _ in _runs(batches, 4):
            starts = np.flatnonzero(np.r_[True, sid[1:] != sid[:-1]])
            ends = np.r_[starts[1:], len(sid)]
            keys, sids, sizes = [], [], []
            for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
                own = int(kind[a:b].max()) - 2  # every set has its own row; copies have equal ones
                n, emitted = own >> 31, own & (1 << 31) - 1
                first = a + int(np.searchsorted(df[a:b], 1))
                kinds = kind[first:b]
                many = int((kinds == 0).sum())
                prefix = n - _needed(n, percent) + 1
                room = prefix - (emitted - many) if emitted >= prefix else b - first
                if room <= 0 or first == b:
                    continue
                pick = key[first:b][:room] if emitted >= prefix else key[first:b]
                keys.append(pick)
                sids.append(np.full(len(pick), sid[a]))
                sizes.append(np.full(len(pick), n))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (keys, sids, sizes)], names=["key", "sid", "n"])

    dealt = shared.repartition("sid").sortWithinPartitions("sid", "df", "kind", "key")
    return dealt.mapInArrow(released(run), "key long, sid long, n long")


def _candidate_edges(prefixes: DataFrame, percent: int) -> DataFrame:
    """Stars over sets with a common prefix shingle, cut where sizes are too far apart; rows stream, none is held."""

    def run(batches):
        was = leader = None
        for batch in batches:
            key, sid, n = (batch.column(i).to_numpy() for i in range(3))
            if not len(key):
                continue
            goes_on = was is not None and was[0] == key[0] and 100 * was[1] >= percent * n[0]
            new = np.r_[not goes_on, (key[1:] != key[:-1]) | (100 * n[:-1] < percent * n[1:])]
            at = np.maximum.accumulate(np.where(new, np.arange(len(key)), -1))
            leaders = np.where(at >= 0, sid[at], leader if goes_on else 0)
            was, leader = (key[-1], n[-1]), leaders[-1]
            pick = leaders != sid
            pairs = np.unique(np.stack([leaders[pick], sid[pick]], 1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["a", "b"])

    dealt = prefixes.repartition("key").sortWithinPartitions("key", "n", "sid")
    return dealt.mapInArrow(released(run), "a long, b long").distinct()


# --- signature trees ---------------------------------------------------------------------------


def bitmaps(sets: list[np.ndarray]) -> np.ndarray:
    out = np.zeros((len(sets), BITS // 64), np.uint64)
    for i, s in enumerate(sets):
        bit = s >> np.uint64(64 - (BITS.bit_length() - 1))
        np.bitwise_or.at(out[i], (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
    return out


class Node:
    __slots__ = ("a", "b", "all_", "any_", "below", "least", "most")

    def __init__(self, a, b, any_, all_, least, most, below):
        self.a, self.b, self.any_, self.all_, self.least, self.most, self.below = a, b, any_, all_, least, most, below


class SignatureTree:
    """A tree over sets in order of size; nodes know OR and AND of bitmaps and the range of sizes."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets, self.sizes, self.bits = sets, np.array([len(s) for s in sets]), bitmaps(sets)
        level = [self._leaf(a, min(a + LEAF, len(sets))) for a in range(0, len(sets), LEAF)]
        while len(level) > 1:
            level = [self._above(level[i : i + FAN]) for i in range(0, len(level), FAN)]
        self.root = level[0] if level else None

    def _leaf(self, a, b):
        n = self.sizes[a:b]
        return Node(a, b, np.bitwise_or.reduce(self.bits[a:b]), np.bitwise_and.reduce(self.bits[a:b]), int(n.min()), int(n.max()), ())

    @staticmethod
    def _above(nodes):
        any_, all_ = nodes[0].any_, nodes[0].all_
        for x in nodes[1:]:
            any_, all_ = any_ | x.any_, all_ & x.all_
        return Node(nodes[0].a, nodes[-1].b, any_, all_, min(x.least for x in nodes), max(x.most for x in nodes), tuple(nodes))


def _may_meet(x: Node, y: Node, percent: int) -> bool:
    """Whether the greatest possible overlap below two nodes can reach the threshold."""
    most = min(x.most - int(np.bitwise_count(x.all_ & ~y.any_).sum()), y.most - int(np.bitwise_count(y.all_ & ~x.any_).sum()))
    least = max(x.least, y.least)
    return most > 0 and 100 * most >= percent * max(least, most) if most >= least else 100 * most >= percent * least


def join_trees(left: SignatureTree, right: SignatureTree, labels: np.ndarray, shift: int, percent: int) -> list[tuple[int, int]]:
    """Links between sets of two trees (or of one with itself) that join classes; labels are changed.

    labels[i] is the class of set i of the left tree, labels[shift + j] that of set j of the right.
    Node pairs whose sets are one class already are left out: their links change nothing.
    """
    links: list[tuple[int, int]] = []
    if not left.root or not right.root:
        return links
    same = left is right
    stack = [(left.root, right.root)]
    while stack:
        x, y = stack.pop()
        of_x, of_y = labels[x.a : x.b], labels[shift + y.a : shift + y.b]
        if of_x[0] == of_y[0] and (of_x == of_x[0]).all() and (of_y == of_x[0]).all():
            continue
        if not _may_meet(x, y, percent):
            continue
        if x.below or y.below:
            if x.below and (not y.below or x.b - x.a >= y.b - y.a):
                pairs = [(c, y) for c in x.below]
            else:
                pairs = [(x, c) for c in y.below]
            if same and x is y:
                pairs = [(c, d) for i, c in enumerate(x.below) for d in x.below[i:]]
            stack += reversed(pairs)
            continue
        xb, yb = left.bits[x.a : x.b], right.bits[y.a : y.b]
        nx, ny = left.sizes[x.a : x.b, None], right.sizes[None, y.a : y.b]
        miss_x = np.bitwise_count(xb[:, None] & ~yb[None]).sum(2, dtype=np.int64)
        miss_y = np.bitwise_count(yb[None] & ~xb[:, None]).sum(2, dtype=np.int64)
        most = np.minimum(nx - miss_x, ny - miss_y)
        for i, j in np.argwhere(100 * most >= percent * (nx + ny - most)).tolist():
            i, j = x.a + i, y.a + j
            if same and i >= j or labels[i] == labels[shift + j]:
                continue
            s, t = left.sets[i], right.sets[j]
            at = np.searchsorted(t, s)
            at[at == len(t)] = 0
            both = int((t[at] == s).sum())
            if 100 * both >= percent * (len(s) + len(t) - both):
                links.append((i, j))
                labels[labels == labels[shift + j]] = labels[i]
    return links


def _compare(table: pa.Table, words: int, percent: int) -> pa.Table:
    """Links (a, b) of one unit: rows (unit, side, sid, label, text); side 0 alone, or sides 0 and 1."""
    sides: list[tuple[list, list, list]] = []
    for side in (0, 1):
        found = {}
        rows = table.filter(pc.equal(table["side"], side))
        texts = rows["text"].combine_chunks() if rows.num_rows else pa.array([], pa.string())
        for sid, label, s in zip(rows["sid"].to_pylist(), rows["label"].to_pylist(), shingle_sets(texts, words), strict=True):
            if sid not in found and _sid(s) == sid:
                found[sid] = s, label
        order = sorted(found, key=lambda x: (len(found[x][0]), x))
        sides.append((order, [found[x][0] for x in order], [found[x][1] for x in order]))
    (ids, sets, names), (ids2, sets2, names2) = sides
    _, labels = np.unique(np.array(names + names2, np.int64), return_inverse=True)
    tree = SignatureTree(sets)
    if ids2:
        links = [(ids[i], ids2[j]) for i, j in join_trees(tree, SignatureTree(sets2), labels, len(ids), percent)]
    else:
        links = [(ids[i], ids[j]) for i, j in join_trees(tree, tree, labels, 0, percent)]
    return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})


def _links(units: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Units (u1, u2, comp, part, side, part's label columns follow from texts) joined with their texts and compared."""
    met = units.join(texts, ["comp", "part"]).select("unit", "side", "sid", "label", "text")
    return met.groupBy("unit").applyInArrow(lambda t: _compare(t, words, percent), "a long, b long")


def classes(docs: DataFrame, words: int = 5, percent: int = 75, by_text: bool = False) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id) for all rows of docs (doc_id, text).

    Two documents are alike when 100 * overlap >= percent * union of their shingle sets. With
    by_text also t, a hash of the row's text, and class, which is the same for all rows of a class
    and for no others, whatever texts stand under one id (null where nothing can be linked).
    """
    spark = docs.sparkSession
    work = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    found = cut(_sets(work, words), "sets")
    sets = found.where("n is not null").select("doc_id", "t", "n", "sid")
    often = found.where("key is not null").groupBy("key").agg(F.sum("times").alias("times")).where("times >= 64").orderBy(F.desc("times"), "key").limit(HOT).toArrow()
    keys = often.column("key").to_numpy().view(np.uint64)
    order = np.argsort(keys)
    hot = spark.sparkContext.broadcast((keys[order], (len(keys) - 1 - np.arange(len(keys)))[order]))  # the most frequent last
    prefixes = cut(_prefixes(_shared(_emitted(work.where("doc_id is not null"), hot, words, percent)), percent), "prefixes")
    forget(spark)
    grouped = components(_candidate_edges(prefixes, percent), "groups")
    forget(spark, prefixes)
    groups = grouped.select(F.col("node").alias("sid"), F.col("component").alias("comp"))
    owners = cut(sets.where("doc_id is not null and n > 0").groupBy("sid").agg(F.min(F.struct("doc_id", "t")).alias("at"), F.first("n").alias("n"), F.count("*").alias("times")), "owners")
    members = groups.join(owners.select("sid", "at.doc_id", "at.t", "n"), "sid")
    # Parts of bounded weight: by step of size, then by hash.
    step = F.floor(F.log(F.col("n").cast("double")) / math.log(1.15)).cast("int")
    sized = members.withColumn("step", step)
    weight = sized.groupBy("comp").agg(F.sum("n").alias("weight"))
    by_step = sized.groupBy("comp", "step").agg(F.sum("n").alias("step_weight"))
    whole = F.col("weight") <= UNIT_WEIGHT
    parts = F.greatest(F.lit(1), F.ceil(F.col("step_weight") / UNIT_WEIGHT)).cast("int")
    dealt = sized.join(weight, "comp").join(by_step, ["comp", "step"])
    dealt = dealt.select("sid", "comp", "doc_id", "t", "n", F.when(whole, F.lit(-1)).otherwise(F.col("step")).alias("step"), F.when(whole, F.lit(0)).otherwise(F.pmod(F.xxhash64("sid"), parts)).cast("int").alias("deal"))
    dealt = cut(dealt.withColumn("part", F.concat_ws(":", "step", "deal")), "dealt")
    wanted = small(dealt.select("doc_id", "t", "sid", "comp", "part"), BROADCAST_BYTES)
    texts = cut(_once(work.withColumn("t", F.xxhash64("text")).join(wanted, ["doc_id", "t"]).select("comp", "part", "sid", "text")), "texts")
    spots = dealt.select("comp", "part", "step", "deal").distinct()
    other = spots.select("comp", F.col("part").alias("part2"), F.col("step").alias("step2"), F.col("deal").alias("deal2"))
    reach = int(math.ceil(math.log(100 / percent) / math.log(1.15))) + 1
    pairs = spots.where("step >= 0").join(other, "comp").where(F.expr(f"step2 - step BETWEEN 0 AND {reach} AND (step2 > step OR deal2 > deal)"))
    near = F.expr("(step2 = step AND deal2 = deal + 1) OR (step2 = step + 1 AND deal = 0 AND deal2 = 0)")
    sided = lambda df: df.select("comp", F.concat_ws("|", "comp", "part", "part2").alias("unit"), F.explode(F.array(F.struct("part", F.lit(0).alias("side")), F.struct(F.col("part2").alias("part"), F.lit(1).alias("side")))).alias("s")).select("comp", "unit", "s.part", "s.side")
    alone = spots.select("comp", F.concat_ws("|", "comp", "part").alias("unit"), "part", F.lit(0).alias("side"))
    plain = texts.withColumn("label", F.col("sid"))
    links = cut(_links(alone, plain, words, percent), "links")
    known = components(links, "known")
    for some in (pairs.where(near), pairs.where(~near)):
        if some.isEmpty():
            continue
        label = dealt.join(known.withColumnRenamed("node", "sid"), "sid", "left").select("comp", "part", "sid", F.coalesce("component", "sid").alias("label"))
        label = cut(label, "labels")
        # A pair of parts that is one class already is left out; texts are fetched for the others alone.
        seen = label.groupBy("comp", "part").agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
        ranged = some.join(seen, ["comp", "part"]).join(seen.select("comp", F.col("part").alias("part2"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2")), ["comp", "part2"])
        open_ = cut(ranged.where("lo <> hi OR lo2 <> hi2 OR lo <> lo2").select("comp", "part", "part2"), "open")
        if not open_.isEmpty():
            parts_ = open_.select("comp", F.explode(F.array("part", "part2")).alias("part")).distinct()
            needed = cut(label.join(parts_, ["comp", "part"], "left_semi"), "needed")
            labelled = texts.join(small(needed, BROADCAST_BYTES), ["comp", "part", "sid"])
            more = cut(_links(sided(open_), labelled, words, percent), "links")
            known = components(known.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more), "known")
        forget(spark, label)
    forget(spark, dealt, texts, grouped)
    linked = known.select(F.col("node").alias("sid"), "component")
    # Documents meet their sets' classes; sets that many documents have are broadcast, at most OFTEN of them.
    classed = owners.join(linked, "sid", "left").select("sid", "times", F.col("at.doc_id").alias("least"), F.coalesce("component", "sid").alias("class"))
    least = classed.groupBy("class").agg(F.min("least").alias("component_id"))
    of_set = cut(classed.join(least, "class").select("sid", "times", "component_id", "class"), "of_set")
    many = of_set.agg(F.sum("times")).first()[0] or 0
    common = of_set.where(F.col("times") * OFTEN > many).select("sid", "component_id", "class")
    rest = of_set.where(F.col("times") * OFTEN <= many).select("sid", "component_id", "class")
    linkable = F.col("doc_id").isNotNull() & (F.col("n") > 0)
    is_common = F.coalesce(F.col("is_common"), F.lit(False))
    marked = sets.join(F.broadcast(common.withColumn("is_common", F.lit(True))), "sid", "left")
    names = ["doc_id", F.col("n").alias("n_shingles"), "component_id", *(["t", "class"] if by_text else [])]
    alone = sets.where(~linkable).withColumn("component_id", F.col("doc_id")).withColumn("class", F.lit(None).cast("long"))
    rest = marked.where(~is_common & linkable).drop("component_id", "class").join(rest, "sid")
    return marked.where(is_common & linkable).select(*names).unionByName(rest.select(*names)).unionByName(alone.select(*names))


def _once(texts: DataFrame) -> DataFrame:
    """texts (comp, part, sid, text) with a set that a task has sent lately left out: a row may be repeated many times."""

    def run(batches):
        sent: set[int] = set()
        for batch in batches:
            new = []
            for sid in batch.column(2).to_pylist():
                new.append(sid not in sent)
                sent.add(sid)
            if len(sent) > SENT_ENTRIES:
                sent.clear()
            yield batch.filter(pa.array(new, pa.bool_()))

    return texts.mapInArrow(released(run), texts.schema)

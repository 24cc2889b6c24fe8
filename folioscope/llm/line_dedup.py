"""Line dedup: an exact set-similarity join of all lines of all documents.

A line's set is its distinct words (A-Z in lower case, between white space); lines of fewer than
min_words distinct words (1 by default: only blank lines) are never compared and stay. A line goes
if an earlier line, by (doc_id, line number), has the same set or one whose Jaccard similarity
reaches the threshold, whether or not that earlier line goes itself. So the result does not depend
on any order of work.

1. One pass hashes the lines' sets and counts words, all of them, in a table of fixed size. The
   order of words is by that count, from rare to frequent, then by hash.
2. A second pass emits each set's prefix in that order: as many words as an alike set may lack, and
   one more. Alike sets share one. Rows carry the word's position, the set's size and a parity map
   of 128 bits (512 for long sets), packed by bucket of words.
3. Sets that meet at a word are candidates if their sizes fit, the words from that position on
   could still give the overlap (alike sets meet at their first common word too), and the parity
   maps differ in no more bits than alike sets can. A bucket of too many pairs is dealt as pairs
   of blocks over many tasks.
4. For each set its best earlier candidates are verified on the lines themselves; the sets for
   which those fail although there are more get all of theirs verified.

Results for odd input: null and empty texts stay as they are; a document all of whose lines go
keeps an empty text; rows without a doc_id are neither compared nor changed; rows repeated with
one doc_id and text are treated alike, as one document; other columns pass through; an empty
table gives an empty table. Lines end at "\\n". Sets and words are told apart by 64-bit
and, within a line, 44-bit hashes.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm import words
from folioscope.llm.common import cut, forget, released, slices, small, whole_text

MIN_WORDS, PERCENT = 1, 75
#: Counters of words (a power of two; above it words share them), sets remembered as sent by a task.
COUNTERS, SENT_ENTRIES = 1 << 20, 100_000
#: Prefix rows of a bucket aimed at, held back by a task, and of a packed row; pairs, and rows, from which a bucket is dealt in blocks of BUCKET_ROWS.
BUCKET_ROWS, HELD_ROWS, PACKED_ROWS, MANY_PAIRS, MANY_ROWS = 50_000, 200_000, 500, 200_000_000, 1_000_000
#: Words from which a set has a wide parity map.
WIDE = 128
#: Candidates verified first, and kept, for each set; sets with more of them are taken up again if need be.
FIRST, KEPT = 2, 8
#: Bytes up to which a table is broadcast rather than joined by shuffling.
BROADCAST_BYTES = 32 << 20
_TOP = np.uint64(1 << 63)
#: Lines whose words are sorted together, and bits of a word's hash: with 8 bits of its order they fill 64.
_GROUP, _BITS = 4096, 44


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _counter(keys: np.ndarray) -> np.ndarray:
    return (keys >> np.uint64(_BITS - COUNTERS.bit_length() + 1)).astype(np.int64)


def _groups(part, min_words: int, order: np.ndarray | None = None, near: np.ndarray | None = None):
    """For up to _GROUP lines of an Arrow slice (doc_id, text, h) at a time: doc ids, hashes and line numbers of
    those with a set, and its words: their owner, their hash in the order of words, the sets' starts and sizes, and sids.
    With near, only lines with a word whose counter is marked there."""
    of_text, lines, counts, all_keys = words.of_lines(part.column(1))
    if not len(lines):
        return
    all_keys >>= np.uint64(64 - _BITS)
    of = [part.column(0).to_numpy()[of_text], part.column(2).to_numpy()[of_text], lines.astype(np.int32)]
    if near is not None:
        line = np.repeat(np.arange(len(counts)), counts)
        keep = np.zeros(len(counts), bool)
        keep[line[near[_counter(all_keys)]]] = True
        all_keys, counts, of = all_keys[keep[line]], counts[keep], [x[keep] for x in of]
    ends = np.r_[0, np.cumsum(counts)]
    for a in range(0, len(counts), _GROUP):
        b = min(a + _GROUP, len(counts))
        keys = all_keys[ends[a] : ends[b]]
        packed = np.repeat(np.arange(b - a, dtype=np.uint64), counts[a:b]) << np.uint64(52) | keys
        if order is not None:
            packed |= order[_counter(keys)].astype(np.uint64) << np.uint64(_BITS)
        packed.sort()
        packed = packed[np.r_[True, packed[1:] != packed[:-1]]]
        owner = (packed >> np.uint64(52)).astype(np.int64)
        n = np.bincount(owner, minlength=b - a)
        good = n >= min_words
        if not good.all():
            packed = packed[good[owner]]
            n = n[good]
            owner = np.repeat(np.arange(len(n)), n)
            if not len(n):
                continue
        starts = np.cumsum(n) - n
        keys = packed & np.uint64((1 << _BITS) - 1)
        mixed = _mix(keys * np.uint64(0xD6E8FEB86659FD93))
        sid = (_mix(np.add.reduceat(mixed, starts) + n.astype(np.uint64)) ^ _TOP).view(np.int64)
        yield [x[a:b][good] for x in of], (owner, keys, mixed), starts, n, sid


def _prefix(n: np.ndarray, percent: int) -> np.ndarray:
    return n - -(-percent * n // 100) + 1


_LINES = "doc_id long, h long, line int, sid long, counts binary, prefixes long"


def _lines(docs: DataFrame, min_words: int, percent: int) -> DataFrame:
    """Per compared line a row (doc_id, h, line, sid); per task one with its counts of words and the length of all prefixes."""

    def run(batches):
        counts, held, size, prefixes = np.zeros(COUNTERS, np.uint32), [], 0, 0
        for batch in batches:
            for part in words.slices(batch, 1):
                for (names, hashes, numbers), (_, keys, _), _, n, sid in _groups(part, min_words):
                    none = pa.nulls(len(n))
                    yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(hashes), pa.array(numbers), pa.array(sid), none.cast(pa.binary()), none.cast(pa.int64())], names=["doc_id", "h", "line", "sid", "counts", "prefixes"])
                    held.append(_counter(keys).astype(np.int32))
                    size += len(keys)
                    prefixes += int(_prefix(n, percent).sum())
                    if size > 2_000_000:
                        counts += np.bincount(np.concatenate(held), minlength=COUNTERS).astype(np.uint32)
                        held, size = [], 0
        if held:
            counts += np.bincount(np.concatenate(held), minlength=COUNTERS).astype(np.uint32)
        if prefixes:
            none = pa.nulls(1)
            yield pa.RecordBatch.from_arrays([*(none.cast(t) for t in (pa.int64(), pa.int64(), pa.int32(), pa.int64())), pa.array([zlib.compress(counts, 1)]), pa.array([prefixes])], names=["doc_id", "h", "line", "sid", "counts", "prefixes"])

    return docs.mapInArrow(released(run), _LINES)


def _order(counted: DataFrame) -> tuple[np.ndarray, int]:
    """The order of words by counter, five steps for each doubling of the count, and the length of all prefixes."""

    def run(batches):
        total, prefixes = np.zeros(COUNTERS, np.uint64), 0
        for batch in batches:
            for raw, more in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                kind = np.uint32 if len(raw := zlib.decompress(raw)) == 4 * COUNTERS else np.uint64
                total += np.frombuffer(raw, kind)
                prefixes += more
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()]), pa.array([prefixes])], names=["counts", "prefixes"])

    def squeezed(batches):
        for batch in run(batches):
            yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(batch.column(0)[0].as_py(), 1)]), batch.column(1)], names=["counts", "prefixes"])

    def packed(batches):
        for batch in run(batches):
            total = np.frombuffer(batch.column(0)[0].as_py(), np.uint64).astype(np.float64)
            order = np.minimum(255, 5 * np.log2(total + 1)).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(order.tobytes(), 1)]), batch.column(1)], names=["counts", "prefixes"])

    # Tables of a fixed size: eight are added up from all, then one from those.
    some = counted.select("counts", "prefixes").repartition(8).mapInArrow(squeezed, "counts binary, prefixes long")
    rows = some.repartition(1).mapInArrow(packed, "counts binary, prefixes long").collect()
    if not rows:
        return np.zeros(COUNTERS, np.uint8), 0
    return np.frombuffer(zlib.decompress(rows[0].counts), np.uint8), rows[0].prefixes


# --- packed prefix rows -------------------------------------------------------------------------

_COLUMNS = {"key": np.uint32, "sid": np.int64, "doc": np.int64, "line": np.int32, "size": np.int32, "pos": np.int32, "p0": np.uint64, "p1": np.uint64}


def _planes(x: np.ndarray) -> bytes:
    """An array byte plane by byte plane, so that equal upper bytes lie together and compress."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T.tobytes()


def _pack(rows: dict[str, np.ndarray], wide: np.ndarray) -> bytes:
    return struct.pack("<II", len(rows["key"]), len(wide)) + b"".join(_planes(rows[c]) for c in _COLUMNS) + wide.tobytes()


def _unpack(raws) -> dict[str, np.ndarray]:
    """The columns of packed rows, and wide: the wide maps, row 0 standing for none, with at: which is whose."""
    parts: dict[str, list] = {c: [] for c in _COLUMNS}
    wides = [np.zeros((1, 8), np.uint64)]
    for raw in raws:
        m, w = struct.unpack_from("<II", raw)
        at = 8
        for c, kind in _COLUMNS.items():
            width = np.dtype(kind).itemsize
            parts[c].append(np.frombuffer(raw, np.uint8, m * width, at).reshape(width, m).T.copy().view(kind).ravel())
            at += m * width
        wides.append(np.frombuffer(raw, np.uint64, w * 8, at).reshape(w, 8))
    out = {c: np.concatenate(x) for c, x in parts.items()}
    is_wide = out["size"] > WIDE
    out["at"] = np.where(is_wide, np.cumsum(is_wide), 0)
    out["wide"] = np.concatenate(wides)
    return out


def _emitted(docs: DataFrame, order: np.ndarray, buckets: int, min_words: int, percent: int) -> DataFrame:
    """Packed prefix rows (bucket, rows) of the sets of all lines."""
    ranks = docs.sparkSession.sparkContext.broadcast(order)  # COUNTERS bytes
    shift = np.uint32(32 - buckets.bit_length() + 1)

    def flush(held):
        rows = {c: np.concatenate([x[c] for x in held]) for c in [*_COLUMNS, "set"]}
        maps, first = [x["maps"] for x in held], np.cumsum([0, *(len(x["maps"]) for x in held)])
        rows["set"] = np.concatenate([x["set"] + f for x, f in zip(held, first, strict=False)])
        maps = np.concatenate(maps)
        bucket = (rows["key"] >> shift).astype(np.int64) if buckets > 1 else np.zeros(len(rows["key"]), np.int64)
        by = np.argsort(bucket, kind="stable")
        bucket = bucket[by]
        heads = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        nos, packs = [], []
        for a, b in zip(heads.tolist(), [*heads[1:].tolist(), len(by)], strict=True):
            for at in range(a, b, PACKED_ROWS):
                pick = by[at : min(b, at + PACKED_ROWS)]
                some = {c: rows[c][pick] for c in _COLUMNS}
                nos.append(int(bucket[a]))
                packs.append(_pack(some, maps[rows["set"][pick][some["size"] > WIDE]]))
        for at in range(0, len(nos), 256):
            yield pa.RecordBatch.from_arrays([pa.array(nos[at : at + 256], pa.int32()), pa.array(packs[at : at + 256], pa.binary())], names=["bucket", "rows"])

    def run(batches):
        order = ranks.value
        sent: dict[int, int] = {}
        held, size = [], 0
        for batch in batches:
            for part in words.slices(batch, 1):
                for (names, _, numbers), (owner, keys, mixed), starts, n, sid in _groups(part, min_words, order):
                    good = np.ones(len(n), bool)
                    for i, (s, doc, line) in enumerate(zip(sid.tolist(), names.tolist(), numbers.tolist(), strict=True)):  # a set is sent again only for an earlier line
                        at = doc << 32 | line
                        if sent.get(s, at + 1) <= at:
                            good[i] = False
                        else:
                            sent[s] = at
                    if len(sent) > SENT_ENTRIES:
                        sent.clear()
                    bit = mixed >> np.uint64(55)
                    maps = np.zeros(len(n) * 8, np.uint64)
                    np.bitwise_xor.at(maps, owner * 8 + (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
                    maps = maps.reshape(-1, 8)
                    pos = np.arange(len(keys)) - starts[owner]
                    take = good[owner] & (pos < _prefix(n, percent)[owner])
                    o = owner[take]
                    narrow = np.bitwise_xor.reduce(maps.reshape(-1, 4, 2), axis=1)
                    held.append({"key": keys[take].astype(np.uint32), "sid": sid[o], "doc": names[o], "line": numbers[o], "size": n[o].astype(np.int32), "pos": pos[take].astype(np.int32), "p0": narrow[o, 0], "p1": narrow[o, 1], "set": o, "maps": maps})
                    size += len(o)
                if size > HELD_ROWS:
                    yield from flush(held)
                    held, size = [], 0
        if size:
            yield from flush(held)

    return docs.mapInArrow(released(run), "bucket int, rows binary")


# --- candidates ---------------------------------------------------------------------------------

_PAIRS = ["x", "x_doc", "x_line", "y", "y_doc", "y_line", "apart"]
_FOUND = "x long, x_doc long, x_line int, y long, y_doc long, y_line int, apart int"


def _sorted(rows: dict[str, np.ndarray], percent: int):
    """Rows by word and size, each set once for a word at its earliest line, and how many of the next rows each may pair with."""
    by = np.lexsort((rows["line"], rows["doc"], rows["sid"], rows["size"], rows["key"]))
    key, sid = rows["key"][by], rows["sid"][by]
    by = by[np.r_[True, (key[1:] != key[:-1]) | (sid[1:] != sid[:-1])]]
    r = {c: (x if c == "wide" else x[by]) for c, x in rows.items()}
    size = r["size"].astype(np.int64)
    group = np.cumsum(np.r_[False, r["key"][1:] != r["key"][:-1]]) << 32
    reach = np.searchsorted(group + size, group + 100 * size // percent, "right") - np.arange(len(size)) - 1
    # Where it is the smaller set of a pair, the word must lie early enough for the least overlap.
    reach[(100 + percent) * (size - r["pos"]) < 2 * percent * size] = 0
    return r, reach


def _met(r, reach, percent: int, sides=None):
    """Index arrays (x, y, apart) of candidate pairs: y earlier than x."""
    ends = np.cumsum(reach)
    size, pos = r["size"].astype(np.int64), r["pos"].astype(np.int64)
    a = 0
    while a < len(reach):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + 500_000, "right")))
        c = reach[a:b]
        i = np.repeat(np.arange(a, b), c)
        if len(i):
            j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(c) - c, c)
            total = size[i] + size[j]
            ok = np.minimum(size[i] - pos[i], size[j] - pos[j]) * (100 + percent) >= percent * total
            if sides is not None:
                ok &= sides[i] != sides[j]
            i, j, total = i[ok], j[ok], total[ok]
            most = (100 - percent) * total // (100 + percent)
            apart = np.bitwise_count(r["p0"][i] ^ r["p0"][j]).astype(np.int32) + np.bitwise_count(r["p1"][i] ^ r["p1"][j])
            ok = apart <= most
            i, j, apart, most = i[ok], j[ok], apart[ok], most[ok]
            long_ = np.flatnonzero((r["at"][i] > 0) & (r["at"][j] > 0))
            if len(long_):
                apart[long_] = np.bitwise_count(r["wide"][r["at"][i[long_]]] ^ r["wide"][r["at"][j[long_]]]).sum(1)
                ok = apart <= most
                i, j, apart = i[ok], j[ok], apart[ok]
            doc, line, sid = r["doc"], r["line"], r["sid"]
            later = (doc[i] > doc[j]) | (doc[i] == doc[j]) & ((line[i] > line[j]) | (line[i] == line[j]) & (sid[i] > sid[j]))
            other = sid[i] != sid[j]
            yield np.where(later, i, j)[other], np.where(later, j, i)[other], apart[other]
        a = b


def _nearest(r, found):
    """Of the candidates found for a set the KEPT + 1 nearest: more show that some are left out."""
    x, y, apart = (np.concatenate(v) for v in zip(*found, strict=True))
    sx, sy = r["sid"][x], r["sid"][y]
    by = np.lexsort((sy, r["line"][y], r["doc"][y], apart, sx))
    x, y, apart, sx, sy = x[by], y[by], apart[by], sx[by], sy[by]
    new = np.r_[True, (sx[1:] != sx[:-1]) | (sy[1:] != sy[:-1])][: len(x)]
    x, y, apart, sx = x[new], y[new], apart[new], sx[new]
    head = np.flatnonzero(np.r_[True, sx[1:] != sx[:-1]][: len(x)])
    near = np.arange(len(x)) - np.repeat(head, np.diff(np.r_[head, len(x)])) <= KEPT
    return x[near], y[near], apart[near]


def _paired(r, reach, percent: int, sides=None):
    found, size = [], 0
    for some in _met(r, reach, percent, sides):
        found.append(some)
        size += len(some[0])
        if size > 1_000_000:
            found = [_nearest(r, found)]
            size = len(found[0][0])
    x, y, apart = _nearest(r, found) if found else (np.zeros(0, np.int64),) * 3
    return [pa.array(v) for v in (r["sid"][x], r["doc"][x], r["line"][x], r["sid"][y], r["doc"][y], r["line"][y], apart.astype(np.int32))]


def _buckets(batches):
    """Sorted batches (bucket, rows): each bucket's packed rows, in pieces of at most MANY_ROWS rows; whether there are more."""
    now, held, size, cut_off = None, [], 0, False
    for batch in batches:
        for bucket, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            m = struct.unpack_from("<I", raw)[0]
            if held and (bucket != now or size + m > MANY_ROWS):
                cut_off = bucket == now or cut_off
                yield now, held, cut_off
                held, size = [], 0
                cut_off = cut_off and bucket == now
            now = bucket
            held.append(raw)
            size += m
    if held:
        yield now, held, cut_off


def _candidates(packed: DataFrame, first: DataFrame, percent: int) -> DataFrame:
    """Rows (x, x_doc, x_line, y, y_doc, y_line, apart): an earlier set y that x may be alike, the nearest for each bucket of words."""
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]

    def run(batches):
        nos: dict[int, int] = {}
        for bucket, raws, more in _buckets(batches):
            if not more:
                r, reach = _sorted(_unpack(raws), percent)
                if int(reach.sum()) <= MANY_PAIRS:
                    got = _paired(r, reach, percent)
                    none = pa.nulls(len(got[0]))
                    yield pa.RecordBatch.from_arrays([*got, none.cast(pa.int32()), none.cast(pa.int32()), none.cast(pa.binary())], names=[*_PAIRS, "bucket", "block", "rows"])
                    continue
            per = max(1, BUCKET_ROWS // PACKED_ROWS)
            for at in range(0, len(raws), per):  # dealt below
                no = nos[bucket] = nos.get(bucket, -1) + 1
                block = b"".join(struct.pack("<I", len(x)) + x for x in raws[at : at + per])
                yield pa.RecordBatch.from_arrays([*(pa.nulls(1).cast(t) for t in types), pa.array([bucket], pa.int32()), pa.array([no], pa.int32()), pa.array([block], pa.binary())], names=[*_PAIRS, "bucket", "block", "rows"])

    def apart(block: bytes):
        at = 0
        while at < len(block):
            n = struct.unpack_from("<I", block, at)[0]
            yield block[at + 4 : at + 4 + n]
            at += 4 + n

    def cross(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                a, b = (batch.column(c)[i].as_py() for c in (0, 1))
                left = _unpack(apart(a))
                if b is None:
                    r, reach = _sorted(left, percent)
                    got = _paired(r, reach, percent)
                else:
                    both = _unpack([*apart(a), *apart(b)])
                    both["side"] = np.arange(len(both["key"])) >= len(left["key"])
                    r, reach = _sorted(both, percent)
                    got = _paired(r, reach, percent, r["side"])
                yield pa.RecordBatch.from_arrays(got, names=_PAIRS)

    dealt = packed.repartition("bucket").sortWithinPartitions("bucket")
    found = cut(dealt.mapInArrow(released(run), f"{_FOUND}, bucket int, block int, rows binary"), "candidates")
    forget(packed.sparkSession)
    pairs, blocks = found.where("rows is null").select(*_PAIRS), found.where("rows is not null").select("bucket", "block", "rows")
    if blocks.isEmpty():
        return pairs
    spots = blocks.select("bucket", "block")
    met = spots.alias("a").join(spots.alias("b"), F.expr("a.bucket = b.bucket and a.block <= b.block")).select("a.bucket", F.col("a.block").alias("block"), F.col("b.block").alias("other"))
    both = met.join(blocks.withColumnRenamed("rows", "left"), ["bucket", "block"]).join(blocks.select("bucket", F.col("block").alias("other"), F.col("rows").alias("right")), ["bucket", "other"])
    both = both.repartition("bucket", "block", "other").select("left", F.when(F.col("block") != F.col("other"), F.col("right")).alias("right"))
    # Two blocks do not know of a set's copies in a third: what is said of another place than its first is dropped.
    places = first.select(F.col("sid").alias("x"), F.col("at.doc_id").alias("x_doc"), F.col("at.line").alias("x_line"))
    return pairs.unionByName(both.mapInArrow(released(cross), _FOUND).join(places, ["x", "x_doc", "x_line"], "left_semi").select(*_PAIRS))


def _all_candidates(packed: DataFrame, open_: DataFrame, percent: int) -> DataFrame:
    """All earlier candidates of the sets x in open_, without any limit, by a join on the word."""

    def rows(batches):
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                r = _unpack([raw])
                yield pa.RecordBatch.from_arrays([pa.array(r["key"].astype(np.int64)), *(pa.array(r[c]) for c in ("sid", "doc", "line", "size", "pos")), *(pa.array(r[c].view(np.int64)) for c in ("p0", "p1"))], names=["key", "sid", "doc_id", "line", "size", "pos", "p0", "p1"])

    prefix = packed.select("rows").mapInArrow(rows, "key long, sid long, doc_id long, line int, size int, pos int, p0 long, p1 long")
    wanted = _small(cut(open_.select(F.col("x").alias("sid")), "open"))
    keys = cut(prefix.join(wanted, "sid", "left_semi").select("key").distinct(), "keys")
    near = prefix.join(_small(keys), "key", "left_semi")
    one = cut(near.groupBy("key", "sid").agg(F.min(F.struct("doc_id", "line")).alias("at"), *(F.first(c).alias(c) for c in ("size", "pos", "p0", "p1"))), "near")
    x = one.join(wanted, "sid", "left_semi")
    n = lambda a: F.col(f"{a}.size")
    least = F.least(n("x") - F.col("x.pos"), n("y") - F.col("y.pos"))
    fits = (F.least(n("x"), n("y")) * 100 >= F.greatest(n("x"), n("y")) * percent) & ((100 + percent) * least >= percent * (n("x") + n("y")))
    apart = F.bit_count(F.col("x.p0").bitwiseXOR(F.col("y.p0"))) + F.bit_count(F.col("x.p1").bitwiseXOR(F.col("y.p1")))
    close = apart * (100 + percent) <= (100 - percent) * (n("x") + n("y"))
    met = x.alias("x").join(one.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.struct("y.at", "y.sid") < F.struct("x.at", "x.sid")) & fits & close)
    return met.select(F.col("x.sid").alias("x"), F.col("y.sid").alias("y")).distinct()


def _scanned(docs: DataFrame, first: DataFrame, open_: DataFrame, order: np.ndarray, min_words: int, percent: int) -> DataFrame | None:
    """Rows (x, y): all earlier sets y that the sets x in open_ are alike by their words' hashes, by a scan of all lines.

    None if the lines of open_ take more than BROADCAST_BYTES.
    """
    places = cut(open_.join(first, F.col("x") == F.col("sid")).select("sid", "at.*"), "open")
    texts = docs.join(_small(places.select("doc_id", "h").distinct()), ["doc_id", "h"], "left_semi")
    lines = texts.select("doc_id", "h", F.posexplode(F.split("text", "\n")).alias("line", "words"))
    got = cut(lines.join(_small(places), ["doc_id", "h", "line"]).select("sid", "doc_id", "line", "words").dropDuplicates(["sid"]), "lines")
    if (got.agg(F.sum(F.octet_length("words") + 64)).first()[0] or 0) > BROADCAST_BYTES:
        return None
    rows = sorted(got.collect())
    keys, counts = words.of_texts(pa.array([r.words for r in rows]))
    sets = [np.unique(x >> np.uint64(64 - _BITS)) for x in np.split(keys, np.cumsum(counts)[:-1])]
    if not rows:
        return open_.select("x", F.col("x").alias("y")).limit(0)
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    by = np.argsort(flat, kind="stable")
    # An alike set has one of the rarest words of x: as many as it may lack, and one more.
    near = np.zeros(COUNTERS, bool)
    for x in sets:
        at = _counter(x)
        near[at[np.argsort(order[at], kind="stable")[: int(_prefix(np.array(len(x)), percent))]]] = True
    held = docs.sparkSession.sparkContext.broadcast((flat[by], owner[by], [len(x) for x in sets], [(r.doc_id, r.line, r.sid) for r in rows], near))

    def run(batches):
        index, of, sizes, at, near = held.value
        sizes = np.array(sizes)
        place = np.array([x[:2] for x in at], np.int64)
        sids = np.array([x[2] for x in at], np.int64)
        for batch in batches:
            for part in words.slices(batch, 1):
                for (names, _, numbers), (line, keys, _), _, n, sid in _groups(part, min_words, None, near):
                    lo = np.searchsorted(index, keys)
                    many = np.searchsorted(index, keys, "right") - lo
                    total = int(many.sum())
                    if not total:
                        continue
                    pick = np.repeat(lo, many) + np.arange(total) - np.repeat(np.cumsum(many) - many, many)
                    pair, both = np.unique(np.repeat(line, many) * len(sizes) + of[pick], return_counts=True)
                    i, j = pair // len(sizes), pair % len(sizes)
                    earlier = (names[i] < place[j, 0]) | (names[i] == place[j, 0]) & (numbers[i] < place[j, 1])
                    ok = earlier & (100 * both >= percent * (n[i] + sizes[j] - both)) & (sid[i] != sids[j])
                    yield pa.RecordBatch.from_arrays([pa.array(sids[j[ok]]), pa.array(sid[i[ok]])], names=["x", "y"])

    return docs.mapInArrow(released(run), "x long, y long").distinct()


def _small(df: DataFrame) -> DataFrame:
    return small(df, BROADCAST_BYTES)


def _verified(pairs: DataFrame, first: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """The sets x of pairs (x, y) that are alike one of their y, compared on the words of the lines they first stand in."""
    wanted = _small(cut(pairs.select(F.explode(F.array("x", "y")).alias("sid")).distinct(), "sids"))
    wanted = cut(first.join(wanted, "sid").select("sid", "at.*"), "wanted")
    texts = docs.join(_small(wanted.select("doc_id", "h").distinct()), ["doc_id", "h"], "left_semi")
    lines = texts.select("doc_id", "h", F.posexplode(F.split("text", "\n")).alias("line", "words"))
    got = lines.join(_small(wanted), ["doc_id", "h", "line"]).select("sid", "words")
    got = cut(got.dropDuplicates(["sid"]), "lines")
    met = pairs.distinct().join(got.select(F.col("sid").alias("y"), F.col("words").alias("of_y")), "y").join(got.select(F.col("sid").alias("x"), F.col("words").alias("of_x")), "x")

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                ok = []
                for a, b in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    s, t = (set(v.encode("utf-8", "surrogatepass").lower().split()) for v in (a, b))
                    both = len(s & t)
                    ok.append(100 * both >= percent * (len(s) + len(t) - both))
                yield pa.RecordBatch.from_arrays([part.column(0).filter(pa.array(ok, pa.bool_()))], names=["x"])

    return met.select("x", "of_x", "of_y").mapInArrow(run, "x long").distinct()


def removed_lines(docs: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """Rows (doc_id, h, line): the lines that go; h is a hash of the text they stand in."""
    work = _work(docs).where("doc_id is not null")
    found = cut(_lines(work, min_words, percent), "lines")
    lines = found.where("counts is null").select("doc_id", "h", "line", "sid")
    order, prefixes = _order(found.where("counts is not null"))
    buckets = 1 << max(0, (prefixes // BUCKET_ROWS).bit_length())
    packed = _emitted(work, order, min(buckets, 1 << 30), min_words, percent)
    first = cut(lines.groupBy("sid").agg(F.min(F.struct("doc_id", "line", "h")).alias("at"), F.count("*").alias("times")), "first")
    pairs = _candidates(packed, first, percent).groupBy("x", "y").agg(F.min("apart").alias("apart"), F.min(F.struct("y_doc", "y_line")).alias("y_at"))
    ranked = pairs.groupBy("x").agg(F.sort_array(F.collect_list(F.struct("apart", "y_at", "y"))).alias("all"))
    best = cut(ranked.select("x", F.slice("all.y", 1, KEPT).alias("some"), (F.size("all") > KEPT).alias("more")), "pairs")
    forget(docs.sparkSession)
    flat = lambda df, some: df.select("x", F.explode(some).alias("y"))
    alike = cut(_verified(flat(best, F.slice("some", 1, FIRST)), first, work, percent), "alike")
    left = cut(best.join(alike, "x", "left_anti"), "left")
    second = left.where(F.size("some") > FIRST)
    if not second.isEmpty():
        alike = cut(alike.unionByName(_verified(flat(second, F.slice("some", FIRST + 1, KEPT)), first, work, percent)), "alike")
    open_ = left.where("more").select("x").join(alike, "x", "left_anti")
    if not open_.isEmpty():
        if (rest := _scanned(work, first, open_, order, min_words, percent)) is None:
            rest = _all_candidates(packed, open_, percent)
        alike = cut(alike.unionByName(_verified(cut(rest, "all"), first, work, percent)).distinct(), "alike")
    # Only sets that stand in several places, or are alike an earlier one, have lines that go.
    marked = first.join(alike.select(F.col("x").alias("sid"), F.lit(True).alias("gone")), "sid", "left").where("times > 1 or gone")
    met = lines.join(_small(cut(marked.select("sid", "at", "gone"), "marked")), "sid").where(F.col("gone") | (F.struct("doc_id", "line", "h") != F.col("at")))
    return met.select("doc_id", "h", "line")


def _work(docs: DataFrame) -> DataFrame:
    work = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    return work.withColumn("h", F.xxhash64("text"))


def dedup_lines(docs: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """docs without the lines that go: its columns, with text shortened, and n_lines and n_removed."""
    gone = cut(_masks(removed_lines(docs, percent, min_words).groupBy("doc_id", "h").agg(F.collect_set("line").alias("gone"))), "gone")
    names = [c for c in docs.columns if c.lower() not in ("n_lines", "n_removed")]
    rows = docs.select(*[F.col(f"`{c}`") for c in names], F.xxhash64(whole_text()).alias("__h"))
    marks = gone.select(F.col("doc_id").alias("__id"), F.col("h").alias("__of"), F.col("mask").alias("__mask"), F.col("many").alias("__many"))
    met = rows.join(_small(marks), (rows["doc_id"].cast("long") == F.col("__id")) & (F.col("__h") == F.col("__of")), "left")
    lines = F.split(F.col("text").cast("string"), "\n")
    stays = lambda _, i: F.substring("__mask", i + 1, 1) != F.lit(b"\x01")
    kept = F.array_join(F.filter(lines, stays), "\n")
    shown = [F.when(F.col("__mask").isNull(), F.col("text")).otherwise(kept).alias(c) if c == "text" else F.col(f"`{c}`") for c in names]
    n_lines = F.when(whole_text() == "", 0).otherwise(F.size(lines))
    return met.select(*shown, n_lines.alias("n_lines"), F.coalesce("__many", F.lit(0)).alias("n_removed"))


def _masks(gone: DataFrame) -> DataFrame:
    """Rows (doc_id, h, mask, many): a byte for each line, 1 where it goes, so that a line is looked up at once."""

    def run(batches):
        for batch in batches:
            out, many = [], []
            for lines in batch.column(2).to_pylist():
                mask = bytearray(max(lines) + 1)
                for i in lines:
                    mask[i] = 1
                out.append(bytes(mask))
                many.append(len(lines))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary()), pa.array(many, pa.int32())], names=["doc_id", "h", "mask", "many"])

    return gone.mapInArrow(run, "doc_id long, h long, mask binary, many int")

"""Exact top-k inner-product search by pivot-table elimination.

Adding one coordinate sqrt(M^2 - |x|^2) to every candidate (0 to a query) turns largest inner
products into smallest Euclidean distances. Each candidate's distances to a fixed set of pivots
are computed once; for a query the largest |d(q,p) - d(x,p)| over the pivots is a lower bound on
d(q,x), so an upper bound on the score.

1. Candidates are sorted by their nearest pivot and the distance to it and packed into blocks; a
   block knows the range of its distances to every pivot.
2. Every query starts with its k-th best score among PROBES vectors (a fixed number).
3. Blocks are dealt in that order. A query is sent only to deals with a block whose bound reaches
   its k-th best score; there blocks are taken in order of their bound, the k-th best score being
   carried on, until no remaining block's bound reaches it.
4. Within a block the candidates' own bounds are tried on a few of them. Where they rule out most,
   each query's candidates are evaluated in the order of their bounds; where they do not (vectors
   without any clusters), one matrix product gives all scores.

Nothing grows with the table in one task or on the driver: a deal holds at most DEAL_BLOCKS blocks
and QUERIES queries at most meet it in one task; the ranges of the blocks are broadcast up to
RANGES_BYTES, and beyond that every query goes to all deals.

Results for odd input: vectors that are null, hold a null or non-finite component (or one whose
256-fold is not finite) and rows without an id take no part; only vectors of the same length are
compared; a repeated query row is one query; repeated candidate rows each count; a query's own id
is never its candidate; ties go to the smaller vec_id; scores beyond the range of long are held
at its ends, and tie there; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscope.llm.common import cut

PIVOTS, PROBES = 32, 2048
#: Candidates of a block at most and before it may end with a pivot's; blocks of a deal; queries sent together, and meeting a deal in one task.
BLOCK_ROWS, LEAST_ROWS, DEAL_BLOCKS, QUERY_ROWS, QUERIES = 1024, 256, 128, 512, 1 << 16
RANGES_BYTES = 64 << 20
_LONG = (-(1 << 63), (1 << 63) - 1)


def _quantized(vectors: DataFrame, scale: int) -> DataFrame:
    """Rows (vec_id, dim, v): floor(scale * x) of each usable vector as little-endian doubles."""

    def run(batches):
        for batch in batches:
            ids, dims, out = [], [], []
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if i is None or not v.is_valid or v.values.null_count:
                    continue
                with np.errstate(over="ignore", invalid="ignore"):
                    x = np.floor(v.values.to_numpy(zero_copy_only=False).astype("<f8") * scale)
                if np.isfinite(x).all():
                    ids.append(i)
                    dims.append(len(x))
                    out.append(x.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(dims, pa.int32()), pa.array(out, pa.binary())], names=["vec_id", "dim", "v"])

    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(run, "vec_id long, dim int, v binary")


class Pivots:
    """The pivot vectors of one length, the probes they begin, and the bound M^2 on squared candidate norms."""

    def __init__(self, ids: np.ndarray, mat: np.ndarray, top: float, pivots: int = PIVOTS):
        self.probe_ids, self.probes, self.top = ids, mat, top
        self.mat = mat[:pivots]
        self.norms = (self.mat**2).sum(1)
        self.lift = np.sqrt(np.maximum(0, top - self.norms))
        self.usable = bool(np.isfinite(top))

    def of_candidates(self, x: np.ndarray) -> np.ndarray:
        norms = (x**2).sum(1)
        lift = np.sqrt(np.maximum(0, self.top - norms))
        d = norms[:, None] + self.norms - 2 * (x @ self.mat.T) + (lift[:, None] - self.lift) ** 2
        return np.sqrt(np.maximum(0, d))

    def of_queries(self, q: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0, (q**2).sum(1)[:, None] + self.top - 2 * (q @ self.mat.T)))

    def bound(self, norms: np.ndarray, lower: np.ndarray) -> np.ndarray:
        """The greatest score of queries of these squared norms at these distances or farther."""
        if not self.usable:
            return np.full(lower.shape, np.inf)
        total = (norms + self.top).reshape(-1, *[1] * (lower.ndim - 1))
        upper = (total - lower**2) / 2 + 1e-5 * total + 1e-6  # far above the rounding of float32 distances
        return np.where(np.isnan(upper), np.inf, upper)

    def of_blocks(self, norms: np.ndarray, q_dist: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Queries x blocks: the greatest score a query may have in a block."""
        lower = np.zeros((len(q_dist), len(lo)))
        for p in range(q_dist.shape[1]):
            d = q_dist[:, p, None]
            np.maximum(lower, np.maximum(lo[None, :, p] - d, d - hi[None, :, p]), out=lower)
        return self.bound(norms, lower)

    def least(self, q_ids: np.ndarray, q: np.ndarray, k: int) -> np.ndarray:
        """The k-th best score of each query among the probes, which holds for all candidates."""
        if len(self.probe_ids) <= k or not _exact(q, self.probes):
            return np.full(len(q), -np.inf)
        got = q @ self.probes.T
        got[q_ids[:, None] == self.probe_ids] = -np.inf
        return np.partition(got, -k, axis=1)[:, -k]


def _largest(x: np.ndarray) -> float:
    return float(np.abs(x).max(initial=0))


def _exact(q: np.ndarray, x: np.ndarray) -> bool:
    """Whether doubles hold all inner products of whole numbers."""
    return q.shape[1] * _largest(q) * _largest(x) < 2**53


def _scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products, queries x candidates; in Python numbers, held within long, where doubles could round."""
    most = q.shape[1] * _largest(q) * _largest(x)
    if most < 2**24:
        return (q.astype(np.float32) @ x.T.astype(np.float32)).astype(np.float64)
    if most < 2**53:
        return q @ x.T
    rows = [[int(b) for b in r] for r in x.tolist()]
    out = np.empty((len(q), len(x)), object)
    for i, y in enumerate(q.tolist()):
        y = [int(b) for b in y]
        out[i] = [min(max(sum(a * b for a, b in zip(r, y, strict=True)), _LONG[0]), _LONG[1]) for r in rows]
    return out


class Search:
    """The k best candidates of each of some queries, block by block."""

    def __init__(self, q_ids: np.ndarray, q: np.ndarray, pivots: Pivots, k: int, least: np.ndarray | None = None):
        self.ids, self.q, self.pivots, self.k = q_ids, q, pivots, k
        self.norms, self.dist = (q**2).sum(1), pivots.of_queries(q)
        self.least = pivots.least(q_ids, q, k) if least is None else least.copy()
        self.best: list[list[tuple]] = [[] for _ in q_ids]

    def run(self, blocks: list[tuple], lo: np.ndarray, hi: np.ndarray) -> None:
        """Blocks (ids, vectors, distances) in order of their bounds; of each only the queries it may matter to."""
        upper = self.pivots.of_blocks(self.norms, self.dist, lo, hi)
        for b in np.argsort(-upper.mean(0), kind="stable").tolist():
            who = np.flatnonzero(upper[:, b] >= self.least)
            if len(who):
                self._block(who, *blocks[b])

    def _block(self, who: np.ndarray, ids: np.ndarray, x: np.ndarray, dist: np.ndarray) -> None:
        tried, some = who[:: max(1, len(who) // 16)], slice(None, None, max(1, len(ids) // 16))
        if (self._bounds(tried, dist[some]) >= self.least[tried, None]).mean() > 0.25:
            got = _scores(self.q[who], x)
            if got.dtype == object:
                hit = np.ones(got.shape, bool)
            else:
                hit = got >= self.least[who, None]
            hit &= self.ids[who, None] != ids
            rows, cols = np.nonzero(hit)
            self._take(who[rows], ids[cols], got[rows, cols])
            return
        for at in range(0, len(who), 64):
            upper = self._bounds(who[at : at + 64], dist)
            for i, bounds in zip(who[at : at + 64].tolist(), upper, strict=True):
                order = np.argsort(-bounds, kind="stable")
                order = order[(bounds[order] >= self.least[i]) & (ids[order] != self.ids[i])]
                step = 16
                while len(order):
                    now, order = order[:step], order[step:]
                    self._take(np.full(len(now), i), ids[now], _scores(self.q[i : i + 1], x[now])[0])
                    order, step = order[: int((bounds[order] >= self.least[i]).sum())], 2 * step

    def _bounds(self, who: np.ndarray, dist: np.ndarray) -> np.ndarray:
        lower = np.zeros((len(who), len(dist)))
        for p in range(dist.shape[1]):
            np.maximum(lower, np.abs(dist[None, :, p] - self.dist[who, p, None]), out=lower)
        return self.pivots.bound(self.norms[who], lower)

    def _take(self, who: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        if not len(who):
            return
        starts = np.flatnonzero(np.r_[True, who[1:] != who[:-1]]).tolist()
        for a, b in zip(starts, [*starts[1:], len(who)], strict=True):
            i, some = int(who[a]), scores[a:b]
            held = (min(max(int(s), _LONG[0]), _LONG[1]) for s in some.tolist())
            best = self.best[i] = sorted([*self.best[i], *((-s, c) for s, c in zip(held, ids[a:b].tolist(), strict=True))])[: self.k]
            if len(best) == self.k:
                self.least[i] = max(self.least[i], float(-best[-1][0]))

    def rows(self) -> pa.RecordBatch:
        found = [(q, c, -s) for q, best in zip(self.ids.tolist(), self.best, strict=True) for s, c in best]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], pa.int64()) for i in range(3)], names=["query_id", "vec_id", "score"])


def _matrix(raw: bytes, dim: int, rows: int, kind: str = "<f8") -> np.ndarray:
    return np.frombuffer(raw, kind).reshape(rows, dim).astype(np.float64)


def _blocks(rows: DataFrame, table) -> DataFrame:
    """Rows (dim, ids, mat, dist, lo, hi): candidates in the order of their nearest pivot, packed."""

    def homes(batches):
        for batch in batches:
            dims = batch.column(1).to_numpy()
            home, far = np.zeros(len(dims), np.int32), np.zeros(len(dims))
            values = batch.column(2)
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                p = table.value[dim]
                if dim and p.usable:
                    d = p.of_candidates(_matrix(b"".join(values.take(pa.array(at)).to_pylist()), dim, len(at)))
                    home[at], far[at] = d.argmin(1), d.min(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(home), pa.array(far)], names=["vec_id", "dim", "v", "home", "far"])

    def pack(batches):
        held: list[tuple] = []
        now = None

        def close():
            dim = now[0]
            p, x = table.value[dim], _matrix(b"".join(v for _, v in held), dim, len(held))
            dist = p.of_candidates(x).astype("<f4") if p.usable else np.zeros((len(x), len(p.mat)), "<f4")
            return pa.RecordBatch.from_pydict({"dim": pa.array([dim], pa.int32()), "ids": pa.array([np.array([i for i, _ in held], "<i8").tobytes()], pa.binary()), "mat": pa.array([x.astype("<f8").tobytes()], pa.binary()), "dist": pa.array([dist.tobytes()], pa.binary()), "lo": pa.array([dist.min(0).tobytes()], pa.binary()), "hi": pa.array([dist.max(0).tobytes()], pa.binary())})

        for batch in batches:
            for i, dim, v, home in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                if held and (dim != now[0] or len(held) >= BLOCK_ROWS or home != now[1] and len(held) >= LEAST_ROWS):
                    yield close()
                    held = []
                now = dim, home
                held.append((i, v))
        if held:
            yield close()

    placed = rows.mapInArrow(homes, "vec_id long, dim int, v binary, home int, far double")
    dealt = placed.repartitionByRange("dim", "home", "far", "vec_id").sortWithinPartitions("dim", "home", "far", "vec_id")
    return dealt.mapInArrow(pack, "dim int, ids binary, mat binary, dist binary, lo binary, hi binary")


def _packed(rows: DataFrame, size: int) -> DataFrame:
    """Rows (dim, ids, mat): up to size vectors of one length each, packed where they lie."""

    def run(batches):
        held: dict[int, tuple[list, list]] = {}

        def close(dim):
            ids, mats = held.pop(dim)
            return pa.RecordBatch.from_pydict({"dim": pa.array([dim], pa.int32()), "ids": pa.array([np.array(ids, "<i8").tobytes()], pa.binary()), "mat": pa.array([b"".join(mats)], pa.binary())})

        for batch in batches:
            for i, dim, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids, mats = held.setdefault(dim, ([], []))
                ids.append(i)
                mats.append(v)
                if len(ids) == size:
                    yield close(dim)
        for dim in list(held):
            yield close(dim)

    return rows.select("vec_id", "dim", "v").mapInArrow(run, "dim int, ids binary, mat binary")


def top_k(vectors: DataFrame, query_filter, k: int = 5, scale: int = 256, pivots: int = PIVOTS) -> DataFrame:
    """Rows (query_id, rank, vec_id, score) for the queries that query_filter (a column over vec_id) selects."""
    spark = vectors.sparkSession
    rows = cut(_quantized(vectors, scale), "vectors")
    # The probes: a fixed number of vectors of each length, those of least hash; the pivots are the first of them.
    hashed = rows.select("vec_id", "dim", "v", F.xxhash64("vec_id", "v").alias("h"))
    pick = hashed.withColumn("n", F.row_number().over(W.partitionBy("dim").orderBy("h", "vec_id"))).where(F.col("n") <= max(pivots, PROBES))

    def largest(batches):
        top: dict[int, float] = {}
        for batch in batches:
            for dim, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with np.errstate(over="ignore"):
                    top[dim] = max(top.get(dim, 0.0), float((np.frombuffer(v, "<f8") ** 2).sum()))
        yield pa.RecordBatch.from_pydict({"dim": pa.array(list(top), pa.int32()), "top": pa.array(list(top.values()), pa.float64())})

    tops = {r.dim: r.top for r in rows.select("dim", "v").mapInArrow(largest, "dim int, top double").groupBy("dim").agg(F.max("top").alias("top")).collect()}
    chosen: dict[int, list] = {}
    for r in pick.select("vec_id", "dim", "v", "n").collect():
        chosen.setdefault(r.dim, []).append(r)
    made = {}
    for d, rs in chosen.items():
        rs.sort(key=lambda r: r.n)
        made[d] = Pivots(np.array([r.vec_id for r in rs]), np.stack([np.frombuffer(bytes(r.v), "<f8") for r in rs]), tops[d], pivots)
    table = spark.sparkContext.broadcast(made)

    found = cut(_blocks(rows, table).withColumn("b", F.monotonically_increasing_id()), "candidates")
    # Blocks in order are dealt: enough deals to keep all cores busy, of at most DEAL_BLOCKS blocks.
    parts = found.groupBy(F.shiftright("b", 33).alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect()  # one row per partition
    many = sum(r.n for r in parts)
    if not many:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    size = max(1, min(DEAL_BLOCKS, many // (2 * spark.sparkContext.defaultParallelism)))
    first, before = {}, 0
    for r in parts:
        first[r.part] = before
        before += r.n
    at = F.create_map(*(F.lit(x) for p, n in first.items() for x in (p, n)))
    numbered = at[F.shiftright("b", 33)] + F.col("b").bitwiseAND(F.lit((1 << 33) - 1))
    candidates = found.withColumn("deal", F.floor(numbered / size).cast("int"))
    deals = -(-many // size)
    queries = _packed(rows.where(query_filter).dropDuplicates(["vec_id", "v"]), QUERY_ROWS)
    n_queries = rows.where(query_filter).count()
    sets = max(1, -(-n_queries // QUERIES))
    width = 8 + 8 * pivots
    ranges = None
    if many * width <= RANGES_BYTES:
        got = candidates.select("dim", "deal", "lo", "hi").toArrow().to_pydict()
        ranges = {}
        for dim in set(got["dim"]):
            pick = [i for i, d in enumerate(got["dim"]) if d == dim]
            ranges[dim] = (np.array([got["deal"][i] for i in pick]), *(np.stack([np.frombuffer(got[c][i], "<f4") for i in pick]).astype(np.float64) for c in ("lo", "hi")))
    ranges = spark.sparkContext.broadcast(ranges)

    def send(batches):
        """Each pack of queries to the deals that may matter to one of them: (deal, part, dim, ids, mat, least)."""
        no = 0
        for batch in batches:
            for dim, ids, mat in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                q_ids, q, p = np.frombuffer(ids, "<i8"), _matrix(mat, dim, len(ids) // 8), table.value[dim]
                least = p.least(q_ids, q, k)
                if ranges.value is None:
                    who = {d: slice(None) for d in range(deals)}
                else:
                    of, lo, hi = ranges.value[dim]
                    reach = p.of_blocks((q**2).sum(1), p.of_queries(q), lo, hi) >= least[:, None]
                    who = {d: np.flatnonzero(reach[:, of == d].any(1)) for d in np.unique(of).tolist()}
                no += 1
                for d, some in who.items():
                    if len(q_ids[some]):
                        yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([(no + int(q_ids[0])) % sets], pa.int32()), pa.array([dim], pa.int32()), *(pa.array([x[some].tobytes()], pa.binary()) for x in (q_ids, q, least))], names=["deal", "part", "dim", "ids", "mat", "least"])

    sent = queries.mapInArrow(send, "deal int, part int, dim int, ids binary, mat binary, least binary")
    sent = sent.select("deal", "part", F.lit(1).alias("kind"), "dim", "ids", "mat", "least", *(F.lit(None).cast("binary").alias(c) for c in ("dist", "lo", "hi")))
    parted = candidates.select("deal", F.explode(F.sequence(F.lit(0), F.lit(sets - 1))).alias("part"), F.lit(0).alias("kind"), "dim", "ids", "mat", F.lit(None).cast("binary").alias("least"), "dist", "lo", "hi")

    def run(batches):
        now, blocks, ends = None, {}, {}
        for batch in batches:
            for i in range(batch.num_rows):
                deal, part, kind, dim, ids, mat, least, dist, lo, hi = (c[i].as_py() for c in batch.columns)
                if (deal, part) != now:
                    now, blocks, ends = (deal, part), {}, {}
                ids = np.frombuffer(ids, "<i8")
                p = table.value[dim]
                if kind == 0:
                    blocks.setdefault(dim, []).append((ids, _matrix(mat, dim, len(ids)), _matrix(dist, len(p.mat), len(ids), "<f4")))
                    ends.setdefault(dim, []).append((np.frombuffer(lo, "<f4"), np.frombuffer(hi, "<f4")))
                elif dim in blocks:
                    search = Search(ids, _matrix(mat, dim, len(ids)), p, k, np.frombuffer(least, "<f8"))
                    search.run(blocks[dim], *(np.stack(x).astype(np.float64) for x in zip(*ends[dim], strict=True)))
                    yield search.rows()

    met = parted.unionByName(sent).repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1), "deal", "part").sortWithinPartitions("deal", "part", "kind")
    best = met.mapInArrow(run, "query_id long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")).alias("rank")
    return best.select("query_id", rank, "vec_id", "score").where(F.col("rank") <= k)

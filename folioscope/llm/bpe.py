"""Byte-level BPE encoding and decoding.

Two tiers: a minimal perfect hash resolves a pre-token that is itself a vocabulary entry;
any other pre-token is merged with a heap of candidate pairs over linked byte ranges.

Results for odd input: a null or empty text gives an empty id list, null ids decode to empty
bytes, repeated rows are each encoded, other columns pass through untouched (an existing column
with the output's name is replaced), an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import heapq
import re
import uuid
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.llm.common import Memo, per_process, release, slices, whole_text

_M64 = (1 << 64) - 1
#: Memoised chunks per Python worker, in each of two generations.
MEMO_ENTRIES = 250_000


class MinimalPerfectHash:
    """Hash-and-displace over a fixed key set: n keys, n slots, keys kept for verification."""

    def __init__(self, keys: list[bytes], values: list[int]):
        n = self.n = len(keys)
        self.buckets = max(1, n // 4)
        self.disp = [0] * self.buckets
        self.keys: list[bytes | None] = [None] * n
        self.values = [0] * n
        groups: dict[int, list[tuple[int, int]]] = {}
        for i, k in enumerate(keys):
            h = xxhash.xxh3_64_intdigest(k)
            groups.setdefault((h >> 40) % self.buckets, []).append((h, i))
        free = [True] * n
        ordered = sorted(groups.items(), key=lambda g: -len(g[1]))
        single = [g for g in ordered if len(g[1]) == 1]
        for b, members in ordered:
            if len(members) == 1:
                continue
            d = 1
            while True:
                slots = {self._slot(h, d) for h, _ in members}
                if len(slots) == len(members) and all(free[s] for s in slots):
                    break
                d += 1
            self.disp[b] = d
            for h, i in members:
                self._put(self._slot(h, d), keys[i], values[i], free)
        left = (s for s in range(n) if free[s])
        for b, [(_, i)] in single:  # the rest go straight to free slots
            s = next(left)
            self.disp[b] = -s - 1
            self.keys[s], self.values[s] = keys[i], values[i]

    def _slot(self, h: int, d: int) -> int:
        return ((((h ^ (d * 0x9E3779B97F4A7C15)) & _M64) * 0xFF51AFD7ED558CCD & _M64) >> 24) % self.n

    def _put(self, slot: int, key: bytes, value: int, free: list[bool]) -> None:
        free[slot] = False
        self.keys[slot], self.values[slot] = key, value

    def get(self, key: bytes) -> int | None:
        if not self.n:
            return None
        h = xxhash.xxh3_64_intdigest(key)
        d = self.disp[(h >> 40) % self.buckets]
        s = -d - 1 if d < 0 else self._slot(h, d)
        return self.values[s] if self.keys[s] == key else None


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a vocabulary file of lines `base64 rank`."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def newer_letters() -> str:
    """Code points that `regex` takes for letters or numbers and tiktoken's older Unicode tables don't."""
    import tiktoken

    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    single = {bytes([i]): i for i in range(256)}
    odd: set[str] = set()
    for kind in (r"\p{L}", r"\p{N}"):
        known = bytes(tiktoken.Encoding("class", pat_str=kind, mergeable_ranks=single, special_tokens={}).encode_ordinary(every)).decode()
        odd |= set(regex.findall(kind, every)) - set(known)
    return "".join(sorted(odd))


@dataclass
class Vocabulary:
    """What executors need of a vocabulary; its size is that of the vocabulary file."""

    lookup: MinimalPerfectHash
    bytes_: list[int | None]
    pairs: dict[int, int]
    pieces: list[bytes]
    pattern: str
    odd: str = ""
    name: str = field(default_factory=lambda: uuid.uuid4().hex)

    @classmethod
    def of(cls, ranks: dict[bytes, int], pattern: str) -> Vocabulary:
        keys = list(ranks)
        pieces = [b""] * (max(ranks.values(), default=-1) + 1)
        for k, r in ranks.items():
            pieces[r] = k
        return cls(MinimalPerfectHash(keys, [ranks[k] for k in keys]), [ranks.get(bytes([i])) for i in range(256)], pair_table(ranks), pieces, pattern, newer_letters())

    def encoder(self) -> Encoder:
        """One encoder per process, so that its memo outlives a task."""
        return per_process(("bpe", self.name), lambda: Encoder(self))


#: Bits of an id in a pair's key, and of a position in a heap entry.
_ID, _AT = 20, 40


def pair_table(ranks: dict[bytes, int]) -> dict[int, int]:
    """Rank of what two entries make together, by left << _ID | right."""
    out = {}
    for piece, rank in ranks.items():
        for i in range(1, len(piece)):
            if (a := ranks.get(piece[:i])) is not None and (b := ranks.get(piece[i:])) is not None:
                out[a << _ID | b] = rank
    return out


def merge(ids: list[int], pair) -> list[int]:
    """Ids of one pre-token, given those of its bytes: always the pair of least rank, leftmost first.

    pair(left << _ID | right) is the rank of two ids' merge, or None. ids is used up.
    """
    n = len(ids)
    heap = [r << _AT | i for i in range(n - 1) if (r := pair(ids[i] << _ID | ids[i + 1])) is not None]
    if not heap:
        return ids
    heapq.heapify(heap)
    pop, push = heapq.heappop, heapq.heappush
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    mask = (1 << _AT) - 1
    while heap:
        top = pop(heap)
        i = top & mask
        j = after[i]
        if ids[i] < 0 or j == n or pair(ids[i] << _ID | ids[j]) != top >> _AT:  # a side has changed since
            continue
        r = ids[i] = top >> _AT
        ids[j] = -1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            if (x := pair(r << _ID | ids[k])) is not None:
                push(heap, x << _AT | i)
        h = before[i]
        if h >= 0 and (x := pair(ids[h] << _ID | r)) is not None:
            push(heap, x << _AT | h)
    return [x for x in ids if x >= 0]


#: Two white-space characters in a row: only there could a split at spaces and line ends part a pre-token.
_DOUBLE_SPACE = re.compile(r"\s\s")


class Encoder:
    """Encodes texts with a vocabulary. Chunks between spaces are memoised within MEMO_ENTRIES."""

    def __init__(self, vocabulary: Vocabulary):
        self.pattern = regex.compile(vocabulary.pattern)
        self.plain = dict.fromkeys(map(ord, vocabulary.odd), "\U000e0fff")  # neither letter, number nor space
        self.odd = frozenset(vocabulary.odd)
        self.lookup = vocabulary.lookup.get
        self.of_byte = vocabulary.bytes_
        self.pair = vocabulary.pairs.get
        self.follows = Memo(self._piece, MEMO_ENTRIES)

    def find(self, chunk: str) -> list[str]:
        """The pre-tokens of a chunk."""
        if chunk.isascii() or self.odd.isdisjoint(chunk):
            return self.pattern.findall(chunk)
        return [chunk[m.start() : m.end()] for m in self.pattern.finditer(chunk.translate(self.plain))]

    def _ids(self, chunk: str) -> bytes:
        out: list[int] = []
        for pre in self.find(chunk):
            key = pre.encode("utf-8", "surrogatepass")
            whole = self.lookup(key)
            if whole is not None:
                out.append(whole)
                continue
            ids = [self.of_byte[b] for b in key]
            if None in ids:
                raise ValueError(f"the vocabulary lacks a byte of {key!r}")
            out += merge(ids, self.pair)
        return np.array(out, "<i4").tobytes()

    def _piece(self, piece: str) -> bytes:
        if piece[-1:] in (",", ".") and "a" <= piece[-2:-1].lower() <= "z":  # a mark after a letter is a pre-token
            return self.follows[piece[:-1]] + self._ids(piece[-1])
        return self._ids(piece if piece[:1] == "\n" else " " + piece)

    def encode(self, text: str) -> bytes:
        """Ids of the text as little-endian 32-bit integers."""
        if not text:
            return b""
        if _DOUBLE_SPACE.search(text):
            return self._ids(text)
        first, *rest = text.replace("\n", " \n").split(" ")
        out = self._ids(first) + b"".join(map(self.follows.__getitem__, rest))
        self.follows.trim()
        return out


def vocabulary(spark, path: str, pattern: str):
    """The vocabulary file broadcast for encode() and decode()."""
    out = spark.sparkContext.broadcast(Vocabulary.of(read_ranks(path), pattern))
    release()  # making it takes several times its memory
    return out


def _split_tail(df: DataFrame, out: str) -> list[str]:
    return [c for c in df.columns if c.lower() != out.lower()]


def encode(df: DataFrame, vocab, text: str = "text", out: str = "ids", keep: list[str] | None = None, checked: bool = False) -> DataFrame:
    """Adds the id list of every whole text; keep names the columns that pass through (all by default).

    With checked each list is decoded again, and a text that does not come back is an error.
    """
    keep = _split_tail(df, out) if keep is None else [c for c in keep if c.lower() != out.lower()]
    work = df.select(*[F.col(f"`{c}`") for c in keep], whole_text(f"`{text}`").alias("__text"))

    def run(batches):
        encoder = vocab.value.encoder()
        for batch in batches:
            for part in slices(batch):
                texts = part.column(len(keep)).to_pylist()
                ids = [encoder.encode(t) for t in texts]
                if checked:
                    pieces = vocab.value.pieces
                    for t, x in zip(texts, ids, strict=True):
                        if b"".join(map(pieces.__getitem__, np.frombuffer(x, "<i4").tolist())) != t.encode("utf-8", "surrogatepass"):
                            raise ValueError("decoding does not give the text back")
                ends = np.zeros(len(ids) + 1, "<i4")
                np.cumsum([len(x) // 4 for x in ids], out=ends[1:])
                values = pa.py_buffer(b"".join(ids))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, values]))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], lists], names=[*keep, out])

    fields = [work.schema[c] for c in keep] + [T.StructField(out, T.ArrayType(T.IntegerType()))]
    return work.mapInArrow(run, T.StructType(fields))


def decode(df: DataFrame, vocab, ids: str = "ids", out: str = "decoded", keep: list[str] | None = None) -> DataFrame:
    """Adds the bytes that an id list stands for; null lists give empty bytes."""
    keep = _split_tail(df, out) if keep is None else [c for c in keep if c.lower() != out.lower()]
    work = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{ids}`").alias("__ids"))

    def run(batches):
        pieces = vocab.value.pieces
        size = np.array([len(p) for p in pieces], np.int64)
        start = np.cumsum(size) - size
        blob = np.frombuffer(b"".join(pieces), np.uint8)
        for batch in batches:
            for part in slices(batch, 32):
                lists = part.column(len(keep))
                flat = lists.flatten().to_numpy(zero_copy_only=False)
                each = size[flat]
                ends = np.r_[0, np.cumsum(each)]
                text = blob[np.repeat(start[flat] - ends[:-1], each) + np.arange(ends[-1])]
                counts = np.array([0 if n is None else n for n in pc.list_value_length(lists).to_pylist()], np.int64)
                at = ends[np.r_[0, np.cumsum(counts)]].astype("<i4")
                made = pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(text.tobytes())])
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], made], names=[*keep, out])

    fields = [work.schema[c] for c in keep] + [T.StructField(out, T.BinaryType())]
    return work.mapInArrow(run, T.StructType(fields))

"""Token-id output: one concatenated id array with Elias-Fano document boundaries.

Documents are dealt in ascending doc_id order over shards (the partitions of a range sort); each
shard is a run of self-contained blocks. A block holds the ids of its documents end to end in 16
or 32 bits, their boundaries and doc ids as Elias-Fano sequences with sampled select directories,
and its place in the shard. A manifest of one row per shard gives the ids of all shards before it.
Blocks are bytes in a Parquet column: Spark's committers make the write safe under retries, and
any store Spark reaches will do.

Results for odd input: null texts are empty and hold only the end id; a null doc_id sorts first
and reads back null; repeated rows are written one by one, ties in text order; other columns are
not read; an empty table gives no blocks and no rows.
"""

from __future__ import annotations

import struct
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.llm.common import Memo, per_process, slices, whole_text

#: Every so many set bits the select directory keeps a position.
SAMPLE = 256
#: Ids after which a block is closed, and words memoised per Python worker, in each of two generations.
BLOCK_IDS, MEMO_ENTRIES = 1 << 20, 240_000
_MAGIC = b"FSEF1"


def _byte_chars() -> list[str]:
    """The character a byte-level vocabulary writes for each byte: printable ones stand for themselves, others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(256 + rest.index(b)) for b in range(256)]


_BYTE_CHARS = _byte_chars()


class EliasFano:
    """A non-decreasing sequence of non-negative integers below 2**62 in near-minimal space."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def of(cls, values) -> EliasFano:
        v = np.asarray(values, np.int64)
        n = len(v)
        top = int(v[-1]) if n else 0
        width = max(0, (top // max(n, 1)).bit_length() - 1)
        high_at = (v >> width) + np.arange(n, dtype=np.int64)
        bits = np.zeros((int(high_at[-1]) + 1 if n else 0) + 7 & ~7, np.uint8)
        bits[high_at] = 1
        low = np.zeros(0, np.uint8)
        if width and n:
            rest = (v & ((1 << width) - 1)).astype(np.uint64)
            low = np.packbits(((rest[:, None] >> np.arange(width, dtype=np.uint64)) & 1).astype(np.uint8).ravel(), bitorder="little")
        return cls(n, width, low, np.packbits(bits, bitorder="little"), high_at[::SAMPLE].astype(np.uint32))

    def select(self, i: int) -> int:
        """The i-th value: a sampled jump, then a scan within one sample's reach."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at = int(self.samples[i // SAMPLE])
        left, byte = i % SAMPLE, at // 8
        end = int(self.samples[i // SAMPLE + 1]) + 1 if i // SAMPLE + 1 < len(self.samples) else len(self.high) * 8
        ones = np.flatnonzero(np.unpackbits(self.high[byte : (end + 7) // 8], bitorder="little"))
        pos = int(ones[np.searchsorted(ones, at - byte * 8) + left]) + byte * 8
        return (pos - i) << self.low_bits | self._low(i)

    def _low(self, i: int) -> int:
        if not self.low_bits:
            return 0
        a = i * self.low_bits
        word = int.from_bytes(self.low[a // 8 : (a + self.low_bits + 7) // 8].tobytes(), "little")
        return word >> a % 8 & (1 << self.low_bits) - 1

    def values(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        out = (ones - np.arange(self.n)).astype(np.int64) << self.low_bits
        if self.low_bits and self.n:
            bits = np.unpackbits(self.low, bitorder="little")[: self.n * self.low_bits].reshape(self.n, self.low_bits)
            out |= bits.astype(np.int64) @ (np.int64(1) << np.arange(self.low_bits, dtype=np.int64))
        return out

    def to_bytes(self) -> bytes:
        return struct.pack("<QBQQ", self.n, self.low_bits, len(self.low), len(self.high)) + self.low.tobytes() + self.high.tobytes() + self.samples.astype("<u4").tobytes()

    @classmethod
    def read(cls, raw: memoryview, at: int) -> tuple[EliasFano, int]:
        n, width, a, b = struct.unpack_from("<QBQQ", raw, at)
        at += struct.calcsize("<QBQQ")
        low = np.frombuffer(raw, np.uint8, a, at)
        high = np.frombuffer(raw, np.uint8, b, at + a)
        s = -(-n // SAMPLE)
        return cls(n, width, low, high, np.frombuffer(raw, "<u4", s, at + a + b)), at + a + b + 4 * s


def pack_block(doc_ids: list[int | None], ids: list[bytes], start: int, wide: bool) -> bytes:
    """One block: header, boundaries, doc ids (nulls first, counted), then the ids."""
    ends = np.cumsum([0, *(len(x) // 4 for x in ids)])
    known = [d for d in doc_ids if d is not None]
    base = known[0] if known else 0
    body = b"".join(ids) if wide else np.frombuffer(b"".join(ids), "<u4").astype("<u2").tobytes()
    head = struct.pack("<5sBqqQ", _MAGIC, 4 if wide else 2, start, base, len(doc_ids) - len(known))
    names = np.array([d - base for d in known], np.uint64)
    if len(names) and int(names[-1]) >> 62:
        raise ValueError("doc ids of a block lie further apart than 2**62")
    return head + EliasFano.of(ends).to_bytes() + EliasFano.of(names.astype(np.int64)).to_bytes() + body


class Block:
    """Reads a packed block; document(i) fetches one document by select alone."""

    def __init__(self, raw: bytes):
        view = memoryview(raw)
        magic, self.item, self.start, self.base, self.nulls = struct.unpack_from("<5sBqqQ", view, 0)
        if magic != _MAGIC:
            raise ValueError("not an id block")
        self.ends, at = EliasFano.read(view, struct.calcsize("<5sBqqQ"))
        self.names, at = EliasFano.read(view, at)
        self.ids = np.frombuffer(view, "<u4" if self.item == 4 else "<u2", offset=at)

    def __len__(self) -> int:
        return self.ends.n - 1

    def document(self, i: int) -> np.ndarray:
        return self.ids[self.ends.select(i) : self.ends.select(i + 1)]

    def doc_ids(self) -> list[int | None]:
        return [None] * self.nulls + [self.base + x for x in self.names.values().tolist()]


class _Words(Memo):
    """Ids by word; those of a word with a mark behind it are put together each time."""

    def __missing__(self, word: str) -> bytes:
        # Marks are split from letters, but not from a combining sign, which the lower case of a letter may end in.
        if word[-1:] in _MARKS and word[-2:-1].isalpha() and word[-2] < "\u0180" and len(word[-2].lower()) == 1:
            return self[word[:-1]] + self[word[-1]]
        return super().__missing__(word)


_MARKS = (",", ".")


class WordEncoder:
    """The tokenizers library over chunks between spaces and line ends, memoised within MEMO_ENTRIES.

    The tokenizer drops white space and its patterns never reach across it, so the ids of a text
    are those of its chunks end to end. `chunked=False` encodes whole texts.
    """

    def __init__(self, spec: str, end_id: int, chunked: bool = True):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.model = self.tokenizer.model
        self.end = np.array([end_id], "<u4").tobytes()
        self.words = _Words(self._word, MEMO_ENTRIES)
        self.chunked = chunked

    def _word(self, word: str) -> bytes:
        low = word.lower()
        if low.isalpha() and word.isalpha() and max(word) < "\u0180":  # one word to the tokenizer, whose normalizers do no more
            spelt = low if low.isascii() else "".join(map(_BYTE_CHARS.__getitem__, low.encode()))
            return array("I", [t.id for t in self.model.tokenize(spelt)]).tobytes()
        return array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.chunked:
            return [np.array(e.ids, "<u4").tobytes() + self.end for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
        self.words.trim()
        of = self.words.__getitem__
        return [b"".join(map(of, self._plain(t).replace("\n", " ").split(" "))) + self.end for t in texts]

    @staticmethod
    def _plain(text: str) -> str:
        """The text in lower case where the tokenizer would do no else; special tokens stay what they are."""
        return text.lower() if text.isascii() and "<|" not in text else text


def _encoder(spec: str, end_id: int, chunked: bool) -> WordEncoder:
    """One encoder per process, so that its memo outlives a task."""
    return per_process(("ids", hash(spec), end_id, chunked), lambda: WordEncoder(spec, end_id, chunked))


def write(docs: DataFrame, path: str, tokenizer_file: str, end_id: int = 2, chunked: bool = True) -> None:
    """Writes the ids of all documents below path: `blocks`, and a `manifest` of one row per shard."""
    spark = docs.sparkSession
    with open(tokenizer_file, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())  # a vocabulary file, a few MB whatever the input

    def run(batches):
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        encoder = _encoder(spec.value, end_id, chunked)
        wide = encoder.tokenizer.get_vocab_size(True) > 65536 or end_id > 65535
        names: list = []
        held: list[bytes] = []
        start = size = seq = 0

        def close():
            raw = pack_block(names, held, start, wide)
            first = next((d for d in names if d is not None), None)
            return pa.RecordBatch.from_pydict({"shard": [shard], "seq": [seq], "first_doc_id": [first], "docs": [len(names)], "start": [start], "ids": [size], "block": [raw]}, schema=pa.schema([("shard", pa.int32()), ("seq", pa.int32()), ("first_doc_id", pa.int64()), ("docs", pa.int64()), ("start", pa.int64()), ("ids", pa.int64()), ("block", pa.binary())]))

        for batch in batches:
            for part in slices(batch, 64):
                for name, x in zip(part.column(0).to_pylist(), encoder.encode(part.column(1).to_pylist()), strict=True):
                    first = next((d for d in names if d is not None), name)
                    if names and (size + len(x) // 4 > BLOCK_IDS or name is not None and name - first >> 62):
                        yield close()
                        start, size, seq = start + size, 0, seq + 1
                        names, held = [], []
                    names.append(name)
                    held.append(x)
                    size += len(x) // 4
        if names:
            yield close()

    work = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    dealt = work.repartitionByRange("doc_id").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    dealt.mapInArrow(run, "shard int, seq int, first_doc_id long, docs long, start long, ids long, block binary").write.parquet(f"{path}/blocks")
    shards = spark.read.parquet(f"{path}/blocks").groupBy("shard").agg(F.sum("docs").alias("docs"), F.sum("ids").alias("ids"), F.count("*").alias("blocks"))
    before = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)  # one row per shard, not per document
    shards.select("*", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("ids_before"), F.coalesce(F.sum("docs").over(before), F.lit(0)).alias("docs_before")).coalesce(1).write.parquet(f"{path}/manifest")


def read(spark: SparkSession, path: str, crc32: bool = False) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids) of all documents written below path.

    With crc32 the last column is instead ids_crc32, the crc32 of the ids read, as little-endian
    unsigned 32-bit integers.
    """
    placed = spark.read.parquet(f"{path}/blocks").select("shard", "block").join(F.broadcast(spark.read.parquet(f"{path}/manifest").select("shard", "ids_before")), "shard")

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                block = Block(batch.column("block")[i].as_py())
                ends = block.ends.values()
                begin = ends[:-1] + block.start + batch.column("ids_before")[i].as_py()
                if crc32:
                    raw, at = memoryview(block.ids.astype("<u4")).cast("B"), (ends * 4).tolist()
                    last = pa.array([zlib.crc32(raw[a:b]) for a, b in zip(at, at[1:], strict=False)], pa.int64())
                else:
                    last = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(block.ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array(block.doc_ids(), pa.int64()), pa.array(begin), pa.array(np.diff(ends)), last], names=["doc_id", "start", "n_tokens", "ids_crc32" if crc32 else "ids"])

    last = "ids_crc32 long" if crc32 else "ids array<int>"
    return placed.select("block", "ids_before").mapInArrow(run, T.StructType.fromDDL(f"doc_id long, start long, n_tokens long, {last}"))

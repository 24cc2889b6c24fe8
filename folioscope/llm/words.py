"""Hashes of the words of whole Arrow slices of texts, without a Python object for each word.

Words are what lies between the white space bytes 0x09-0x0D and 0x20; A-Z count as a-z. A word's
hash is a polynomial over its bytes modulo 2**64, mixed: prefix sums over a window of text give
all its words' polynomials at once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Bytes of text hashed at a time (but a longer word is hashed whole; eight times it stays below the 1 MB from which memory is mapped), and bytes of a slice aimed at.
WINDOW, SLICE_BYTES = 1 << 16, 1 << 19
_P = 0x9E3779B97F4A7C15
_M = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def _byte_values() -> np.ndarray:
    v = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(_P)) | np.uint64(1)
    v[ord("A") : ord("Z") + 1] = v[ord("a") : ord("z") + 1]
    return v


_VALUES = _byte_values()
_WORD = np.ones(256, bool)
_WORD[[9, 10, 11, 12, 13, 32]] = False
_POWERS: list[np.ndarray] = [np.zeros(0, np.uint64), np.zeros(0, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    """The first n powers of _P and of its inverse modulo 2**64; kept up to a window."""
    if len(_POWERS[0]) >= n:
        return _POWERS
    m = max(n, WINDOW)
    made = []
    for p in (_P, pow(_P, -1, 1 << 64)):
        x = np.full(m, p, np.uint64)
        x[0] = 1
        made.append(np.multiply.accumulate(x))
    if m == WINDOW:
        _POWERS[:] = made
    return made


def data_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array without nulls, and where each text begins and the last ends."""
    if not pa.types.is_string(texts.type):
        texts = texts.cast(pa.string())
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each word begins and ends; words never reach across texts."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = _WORD[data]
    change = inside[1:] != inside[:-1]
    begin, end = change & inside[1:], change & inside[:-1]
    cuts = offsets[(offsets > 0) & (offsets < len(data))]
    both = cuts[inside[cuts] & inside[cuts + 1]]
    begin[both] = end[both] = True
    return np.flatnonzero(begin), np.flatnonzero(end)


def hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words."""
    out = np.empty(len(begin), np.uint64)
    a = 0
    while a < len(begin):
        at = begin[a]
        b = max(a + 1, int(np.searchsorted(end, at + WINDOW, "right")))
        part = data[at : end[b - 1]]
        power, inverse = _powers(len(part))
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_VALUES[part] * power[: len(part)], out=sums[1:])
        s, e = begin[a:b] - at, end[a:b] - at
        out[a:b] = (sums[e] - sums[s]) * inverse[s]
        a = b
    return mix(out)


def of_texts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The words' hashes of all texts end to end, and the number of words of each."""
    data, offsets = data_of(texts)
    begin, end = spans(data, offsets)
    return hashes(data, begin, end), np.diff(np.searchsorted(begin, offsets))


def of_lines(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For all lines with a word: the text they stand in, their number, their words; and all words' hashes."""
    data, offsets = data_of(texts)
    begin, end = spans(data, offsets)
    breaks = np.flatnonzero(data == 10)
    starts = np.unique(np.r_[offsets[:-1], breaks + 1])
    starts = starts[starts < len(data)]
    counts = np.diff(np.searchsorted(begin, np.r_[starts, len(data)]))
    starts, counts = starts[counts > 0], counts[counts > 0]
    text = np.searchsorted(offsets, starts, "right") - 1
    number = np.searchsorted(breaks, starts) - np.searchsorted(breaks, offsets[text])
    return text, number, counts, hashes(data, begin, end)


def slices(batch, column: int, rows: int = 256):
    """Slices of an Arrow batch of at most `rows` rows and, but for single long texts, SLICE_BYTES bytes of the column."""
    _, offsets = data_of(batch.column(column))
    a = 0
    while a < batch.num_rows:
        b = max(a + 1, min(a + rows, int(np.searchsorted(offsets, offsets[a] + SLICE_BYTES, "right")) - 1))
        yield batch.slice(a, b - a)
        a = b

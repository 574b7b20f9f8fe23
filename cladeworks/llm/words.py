"""Vectorised word and shingle hashing over Arrow string buffers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: The separators of the word pattern ``[^\x20\x09-\x0D]+``, as bytes.
SPACE_BYTES = b" \t\n\x0b\x0c\r"

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACE_BYTES)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_SHINGLE_MULTIPLIERS = np.array(
    [0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB],
    dtype=np.uint64,
)
_BLOCK_BYTES = 256 << 10


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit values, so that every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class _Powers:
    """Powers of the hash base, grown on demand."""

    table = np.ones(1, np.uint64)

    @classmethod
    def upto(cls, n: int) -> np.ndarray:
        if len(cls.table) < n:
            size = 1 << (n - 1).bit_length()
            cls.table = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, _BASE)]), dtype=np.uint64)
        return cls.table


def string_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary array; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_null(column.type):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def segment_hashes(raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """64-bit hash of each segment ``raw[start : start + length]``; segments are ordered and do not overlap."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = int(np.searchsorted(starts, starts[i] + _BLOCK_BYTES, "left"))
        j = max(j, i + 1)
        s, n = starts[i:j], lengths[i:j]
        first = np.cumsum(n) - n
        at = np.arange(int(n.sum())) - np.repeat(first, n)
        values = raw[at + np.repeat(s, n)].astype(np.uint64) + np.uint64(1)
        values *= _Powers.upto(int(n.max(initial=1)))[at]
        h = np.add.reduceat(values, first) if len(values) else np.zeros(0, np.uint64)
        out[i:j] = mix64(h ^ (n.astype(np.uint64) << np.uint64(48)))
        i = j
    return out


def words(raw: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of the texts in a buffer, and for each text the number of words before it."""
    space = _IS_SPACE[raw]
    begins = ~space
    begins[1:] &= space[:-1] | False
    edges = offsets[(offsets > 0) & (offsets < len(raw))]
    begins[edges] = ~space[edges]
    starts = np.flatnonzero(begins)
    stops = np.zeros(len(raw) + 1, bool)
    stops[1:][~space] = True
    stops[1:-1] &= space[1:]
    stops[edges[~space[edges - 1]]] = True
    ends = np.flatnonzero(stops)
    data = _LOWER[raw] if lower else raw
    return segment_hashes(data, starts, ends - starts), np.searchsorted(starts, offsets)


def shingle_sets(column: pa.Array, width: int = 5):
    """Yield for each text the sorted distinct 64-bit hashes of its ``width``-word shingles.

    A text of fewer words gives its whole sequence as one shingle; a text
    without words, or null, gives an empty array.
    """
    raw, offsets = string_buffer(column)
    hashes, at = words(raw, offsets)
    if len(hashes) >= width:
        rolled = np.zeros(len(hashes) - width + 1, np.uint64)
        for k in range(width):
            rolled += hashes[k : len(hashes) - width + 1 + k] * _SHINGLE_MULTIPLIERS[k % 5] * np.uint64(2 * (k // 5) + 1)
        rolled = mix64(rolled)
    else:
        rolled = np.zeros(0, np.uint64)
    for i in range(len(at) - 1):
        a, b = at[i], at[i + 1]
        if b - a >= width:
            yield np.unique(rolled[a : b - width + 1])
        elif b > a:
            few = hashes[a:b] * _SHINGLE_MULTIPLIERS[: b - a] if b - a <= 5 else mix64(np.cumsum(hashes[a:b]))
            yield mix64(np.array([few.sum() ^ np.uint64(b - a)], np.uint64))
        else:
            yield np.zeros(0, np.uint64)

"""Minimal perfect hashing of sets of 64-bit keys, in shards, and dense vectors under it.

Keys are dealt to shards by the high bits of a mixed hash.  A shard's function
has levels: on each, the keys still left hash into an array of ``GAMMA`` bits a key; a key that
meets no other one there sets its bit and is done, the others go to the next
level.  A key's index is the number of bits set before its own.  Foreign keys
may get an index too, so a table keeps each index's key and compares it.
"""

from __future__ import annotations

import numpy as np

from .words import mix64

GAMMA = 2
_STEP = 0x9E3779B97F4A7C15


def shard_of(keys: np.ndarray, bits: int) -> np.ndarray:
    """The shard of each key, from ``bits`` bits of its hash."""
    return (mix64(keys) >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)


def _place(keys: np.ndarray, level: int, size) -> np.ndarray:
    return (mix64(keys + np.uint64((level + 1) * _STEP % (1 << 64))) % np.asarray(size, np.uint64)).astype(np.int64)


def build(keys: np.ndarray) -> list[np.ndarray]:
    """The levels of a function over different ``keys``: for each an array of booleans."""
    levels, left = [], np.asarray(keys, np.uint64)
    while len(left):
        size = GAMMA * len(left)
        at = _place(left, len(levels), size)
        taken = np.bincount(at, minlength=size)
        levels.append(taken == 1)
        left = left[taken[at] != 1]
    return levels


def pack(levels: list[np.ndarray]) -> tuple[bytes, list[int]]:
    """(bits, sizes of the levels)."""
    return np.packbits(np.concatenate(levels) if levels else np.zeros(0, bool)).tobytes(), [len(x) for x in levels]


class Hash:
    """The functions of all shards as one: ``index`` gives places from 0 to the number of keys."""

    def __init__(self, shards: list[tuple[bytes, list[int]]], bits: int):
        self.bits, self.depth = bits, max((len(s) for _, s in shards), default=0)
        self.size, self.start = (np.zeros((max(1, self.depth), len(shards)), np.int64) for _ in range(2))
        flat, first, self.offset = [], 0, np.zeros(len(shards) + 1, np.int64)
        for k, (raw, sizes) in enumerate(shards):
            n = sum(sizes)
            flat.append(np.unpackbits(np.frombuffer(raw, np.uint8), count=n).astype(bool))
            self.size[: len(sizes), k] = sizes
            self.start[: len(sizes), k] = first + np.cumsum([0, *sizes[:-1]]) if sizes else 0
            first += n
            self.offset[k + 1] = self.offset[k] + int(flat[-1].sum())
        padded = np.concatenate([*flat, np.zeros(64 - first % 64, bool)])
        # Bits before each block of 64; what stands between is counted at look-up.
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words))]).astype(np.int64)

    def index(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key; -1 for a key that is certainly foreign."""
        keys = np.asarray(keys, np.uint64)
        out, left, shard = np.full(len(keys), -1, np.int64), np.arange(len(keys)), shard_of(keys, self.bits)
        for level in range(self.depth):
            size = self.size[level, shard[left]]
            left, size = left[size > 0], size[size > 0]
            if not len(left):
                break
            at = self.start[level, shard[left]] + _place(keys[left], level, size)
            block, bit = self.words[at >> 6], (at & 63).astype(np.uint64)
            hit = (block >> bit & np.uint64(1)).astype(bool)
            below = (np.uint64(1) << bit[hit]) - np.uint64(1)
            out[left[hit]] = self.before[at[hit] >> 6] + np.bitwise_count(block[hit] & below)
            left = left[~hit]
        return out


class PairTable:
    """Counts by key: the key that belongs to an index is stored and compared."""

    def __init__(self, shards: list[tuple[bytes, list[int], bytes, bytes]], bits: int):
        self.hash = Hash([(raw, sizes) for raw, sizes, _, _ in shards], bits)
        self.keys = np.concatenate([np.frombuffer(k, "<u8") for _, _, k, _ in shards]) if shards else np.zeros(0, np.uint64)
        self.counts = np.concatenate([np.frombuffer(c, "<i8") for _, _, _, c in shards]) if shards else np.zeros(0, np.int64)

    def count(self, keys: np.ndarray) -> np.ndarray:
        """The count of each key, 0 for one that the table does not hold."""
        if not len(self.keys):
            return np.zeros(len(keys), np.int64)
        at = self.hash.index(keys)
        known = (at >= 0) & (self.keys[at] == keys)
        return np.where(known, self.counts[at], 0)

"""Encoding texts chunk by chunk, each different chunk once.

A tokenizer that never merges across certain places in a text encodes the
pieces between them one by one to the same ids.  The texts of a batch are cut
at such places with array operations, equal chunks are found by hash and
confirmed byte by byte, and only chunks that the worker has not met go through
the tokenizer library.  The table of known chunks has a bound; when it is full,
only those of the texts at hand stay.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain, repeat

import numpy as np

from .words import segment_hashes

SLICE_BYTES = 2 << 20


class ChunkTable:
    """Ids of the chunks met so far."""

    def __init__(self, encode: Callable[[list[bytes]], list[list[int]]], most: int = 200_000):
        self.encode, self.most = encode, most
        self._clear()

    def _clear(self):
        self.slots: dict[bytes, int] = {}
        self.start, self.count = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.flat, self.used = np.zeros(1 << 16, np.uint16), 0

    def _put(self, keys: list[bytes], ids: np.ndarray, counts: np.ndarray) -> None:
        total, first, n = len(ids), len(self.slots), len(keys)
        while first + n > len(self.start):
            self.start, self.count = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.count))
        if total and ids.max() > 65535 and self.flat.dtype == np.uint16:
            self.flat = self.flat.astype(np.uint32)
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + total] = ids
        self.start[first : first + n] = self.used + np.cumsum(counts) - counts
        self.count[first : first + n] = counts
        self.used += total
        self.slots.update(zip(keys, range(first, first + n), strict=True))

    def _add(self, keys: list[bytes]) -> None:
        lists = self.encode(keys)
        counts = np.fromiter(map(len, lists), np.int64, len(lists))
        self._put(keys, np.fromiter(chain.from_iterable(lists), np.int64, int(counts.sum())), counts)

    def _gather(self, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        counts = self.count[slot]
        return self.flat[np.repeat(self.start[slot] - np.cumsum(counts) + counts, counts) + np.arange(int(counts.sum()))], counts

    def ids(self, raw: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all chunks in order, number of ids of each chunk)."""
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        lengths = stops - starts
        _, first, inverse = np.unique(segment_hashes(raw, starts, lengths), return_index=True, return_inverse=True)
        if not _same(raw, starts, lengths, first[inverse]):
            seen: dict[bytes, int] = {}
            keys = [raw[a:b].tobytes() for a, b in zip(starts.tolist(), stops.tolist(), strict=True)]
            inverse = np.fromiter((seen.setdefault(k, len(seen)) for k in keys), np.int64, len(keys))
            different = list(seen)
        else:
            data = raw.tobytes()
            different = [data[a:b] for a, b in zip(starts[first].tolist(), stops[first].tolist(), strict=True)]
        found = np.array([*map(self.slots.get, different, repeat(-1))], np.int64)
        unknown = np.flatnonzero(found < 0)
        if len(unknown):
            if len(self.slots) + len(unknown) > self.most:
                # What the texts at hand share with earlier ones stays.
                known = np.flatnonzero(found >= 0)
                kept = self._gather(found[known])
                self._clear()
                self._put([different[k] for k in known.tolist()], *kept)
                found[known] = np.arange(len(known))
            found[unknown] = len(self.slots) + np.arange(len(unknown))
            self._add([different[k] for k in unknown.tolist()])
        return self._gather(found[inverse])


def _same(raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray, model: np.ndarray) -> bool:
    """Whether each chunk equals its model chunk, byte by byte."""
    if not np.array_equal(lengths, lengths[model]):
        return False
    step = 1 << 18
    for i in range(0, len(starts), step):
        n = lengths[i : i + step]
        at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        if not np.array_equal(raw[at + np.repeat(starts[i : i + step], n)], raw[at + np.repeat(starts[model[i : i + step]], n)]):
            return False
    return True


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``most`` bytes, at least one text each."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        j = min(j, n)
        yield i, j
        i = j


def per_text(counts: np.ndarray, starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each text the number of ids before it; chunks lie within texts."""
    before = np.concatenate([[0], np.cumsum(counts)])
    return before[np.searchsorted(starts, offsets)]

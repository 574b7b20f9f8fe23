"""Byte-level BPE encoding of whole columns with the tokenizers library.

The split pattern of such tokenizers ends a piece at known places: before
white space that follows anything else, around the last white-space character
of a run, and where ASCII letters, digits and punctuation meet.  Cut there,
the chunks encode to the same ids as the whole text.  Texts that hold an added
token's string go through the library as they are.
"""

from __future__ import annotations

import json

import numpy as np

from .chunks import SLICE_BYTES, ChunkTable, per_text, slices

# Byte classes: white space, letter, digit, punctuation, apostrophe, anything else, white space of several bytes.
_W, _L, _N, _P, _Q, _U, _V = range(7)
_CLASS = np.full(256, _U, np.uint8)
for _b in range(33, 127):
    _CLASS[_b] = _L if chr(_b).isalpha() else _N if chr(_b).isdigit() else _P
_CLASS[[9, 10, 11, 12, 13, 32]] = _W
_CLASS[39] = _Q
_PAIR = np.zeros((7, 7), bool)
for _a in (_L, _N, _P):
    for _c in (_L, _N, _P, _Q):
        _PAIR[_a, _c] = _a != _c and not (_a == _P and _c == _Q)
for _a in (_L, _N, _P, _Q, _U):
    _PAIR[_a, _W] = _PAIR[_a, _V] = True


def _classes(raw: np.ndarray) -> np.ndarray:
    out = _CLASS[raw]
    if (raw >= 0xC2).any():
        two = np.flatnonzero((raw[:-1] == 0xC2) & ((raw[1:] == 0x85) | (raw[1:] == 0xA0)))
        for k in (0, 1):
            out[two + k] = _V
    if ((raw >= 0xE1) & (raw <= 0xE3)).any() and len(raw) > 2:
        a, b, c = raw[:-2], raw[1:-1], raw[2:]
        e2 = (a == 0xE2) & (((b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))) | ((b == 0x81) & (c == 0x9F)))
        three = np.flatnonzero(e2 | ((a == 0xE1) & (b == 0x9A) & (c == 0x80)) | ((a == 0xE3) & (b == 0x80) & (c == 0x80)))
        for k in (0, 1, 2):
            out[three + k] = _V
    return out


def cuts(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, stops) of the chunks of the texts in a buffer."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cls = _classes(raw)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    cut = edge.copy()
    cut[1:n] |= _PAIR[cls[:-1], cls[1:]]
    # The last white-space byte of a run that something else follows, in the same text.
    last = np.zeros(n, bool)
    last[:-1] = (cls[:-1] == _W) & (cls[1:] != _W) & (cls[1:] != _V) & ~edge[1:n]
    cut[:n] |= last
    cut[1:] |= last & (raw != 32)
    at = np.flatnonzero(cut)
    return at[:-1], at[1:]


def byte_alphabet() -> dict[int, str]:
    """The printable stand-in of each byte: itself where it is visible in Latin-1, else the next code point from 256."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class ByteBpe:
    """Whole texts to ids, as ``Tokenizer.encode(text, add_special_tokens=False)`` gives them; with ``plain`` the strings of special tokens are text like any other."""

    def __init__(self, path: str, plain: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        split = spec.get("pre_tokenizer") or {}
        self.by_chunk = (
            split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True)
            and spec.get("normalizer") is None and spec["model"]["type"] == "BPE" and not spec["model"].get("dropout")
            and not spec["model"].get("ignore_merges") and not any(x["lstrip"] or x["rstrip"] or x["single_word"] for x in spec["added_tokens"])
        )
        self.added = [x["content"].encode() for x in spec["added_tokens"] if not (plain and x["special"])]
        self.alphabet = byte_alphabet()
        self.table, self.slice_bytes = ChunkTable(self._encode), SLICE_BYTES

    def _plain(self, text: bytes) -> list[int]:
        return self.tokenizer.encode(text.decode(), add_special_tokens=False).ids

    def _encode(self, chunks: list[bytes]) -> list[list[int]]:
        model, alphabet, out = self.tokenizer.model.tokenize, self.alphabet, []
        for chunk in chunks:
            word = chunk[1:] if chunk[:1] == b" " and len(chunk) > 1 else chunk
            text = word.decode()
            # A run of Latin letters is one piece of the split, so that the model can have it at once.
            if text.isalpha() and max(text) < "ɐ":
                out.append([t.id for t in model(chunk.decode("latin-1").translate(alphabet))])
            else:
                out.append(self._plain(chunk))
        return out

    def encode(self, raw: np.ndarray, offsets: np.ndarray):
        """Yield ``(first text, ids, bounds)`` for slices of the texts in a buffer; text k of a slice has ``ids[bounds[k]:bounds[k + 1]]``."""
        for i, j in slices(offsets, self.slice_bytes):
            part, at = raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            data = part.tobytes()
            if not self.by_chunk or any(x in data for x in self.added):
                lists = [self._plain(data[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                bounds = np.cumsum([0, *map(len, lists)])
                yield i, np.fromiter((x for ids in lists for x in ids), np.uint32, int(bounds[-1])), bounds
                continue
            starts, stops = cuts(part, at)
            ids, counts = self.table.ids(part, starts, stops)
            yield i, ids.astype(np.uint32), per_text(counts, starts, at)


_KNOWN: dict[tuple[str, bool], ByteBpe] = {}


def encoder(path: str, plain: bool = False) -> ByteBpe:
    """The worker's encoder for a file; its table of chunks lasts from task to task."""
    if (path, plain) not in _KNOWN:
        _KNOWN[path, plain] = ByteBpe(path, plain)
    return _KNOWN[path, plain]

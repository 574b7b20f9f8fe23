"""SentencePiece encoding and decoding with offsets into the original bytes.

A model's character map (a double array over UTF-8 with replacement strings)
is applied by longest prefix, and every normalised byte remembers the original
byte it comes from.  The pieces, taken from the sentencepiece library, tile
the normalised text; projected through that alignment, each piece gets a span
of the original bytes.

If the model leaves characters as they are and none of its pieces crosses the
start of a blank run or a line feed, texts are cut there and each different
chunk is encoded once.  Other models encode whole texts.  Null texts are
empty; texts are encoded whole, whatever their length.  Identifiers may be null or repeated, each row gives a row; extra columns are ignored, an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import SLICE_BYTES, ChunkTable, per_text, slices
from .words import string_buffer

BLANK = "▁".encode()
#: Ids that go to the library in one call for decoding, about.
_DECODE_IDS = 50_000


def _fields(raw: bytes):
    """The (number, value) pairs of a protocol-buffer message."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            b = raw[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(raw):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            n = varint() if kind == 2 else 4 if kind == 5 else 8
            yield tag >> 3, raw[at : at + n]
            at += n


class CharacterMap:
    """The compiled character map of a normaliser.

    Layout: byte length of the double array, the array of 32-bit units, then
    zero-ended replacement strings.  A unit holds a label, an offset to its
    children and whether a value follows; values are offsets of replacements.
    """

    def __init__(self, blob: bytes):
        n = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", n // 4, 4).tolist() if n else []
        self.strings = blob[4 + n :]

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & (1 << 9)) >> 6)

    def longest(self, raw: bytes, at: int) -> tuple[int, bytes] | None:
        """The longest entry that ``raw`` has at ``at``: its length and its replacement."""
        units, found = self.units, None
        if not units:
            return None
        node = self._offset(units[0])
        for k in range(at, len(raw)):
            b = raw[k]
            node ^= b
            if node >= len(units) or (units[node] & ((1 << 31) | 0xFF)) != b:
                break
            unit = units[node]
            node ^= self._offset(unit)
            if unit >> 8 & 1:
                start = units[node] & ((1 << 31) - 1)
                found = k - at + 1, self.strings[start : self.strings.index(b"\0", start)]
        return found


class Normalizer:
    """A model's normalisation with source alignment."""

    def __init__(self, spec: bytes):
        values = dict(_fields(spec))
        self.map = CharacterMap(values.get(2, b""))
        self.dummy_prefix = bool(values.get(3, 1))
        self.squeeze = bool(values.get(4, 1))
        self.escape = bool(values.get(5, 1))
        self.plain = not self.map.units and not self.squeeze and self.escape

    def normalize(self, raw: bytes) -> tuple[bytes, np.ndarray]:
        """The normalised bytes, and for each of them (and the end) the original offset.

        Bytes that the map leaves alone keep their own offset; all bytes of a
        replacement have the offset where the replaced characters begin.
        """
        return self._whole(raw) if self.plain else self._walk(raw)

    def _whole(self, raw: bytes) -> tuple[bytes, np.ndarray]:
        """``_walk`` for an empty map that keeps all blanks, with array operations."""
        if not raw:
            return b"", np.zeros(1, np.int64)
        data = np.frombuffer(raw, np.uint8)
        width = np.where(data == 32, len(BLANK), 1)
        lead = len(BLANK) if self.dummy_prefix else 0
        source = np.concatenate([np.zeros(lead, np.int64), np.repeat(np.arange(len(data)), width), [len(data)]])
        return (BLANK if lead else b"") + raw.replace(b" ", BLANK), source

    def _walk(self, raw: bytes) -> tuple[bytes, np.ndarray]:
        out, source, at = bytearray(), [], 0
        blank = BLANK if self.escape else b" "
        pieces: list[tuple[bytes, int, int, bool]] = []
        while at < len(raw):
            hit = self.map.longest(raw, at)
            if hit is None:
                b = raw[at]
                n = 1 if b < 128 else 2 if b < 224 else 3 if b < 240 else 4
                pieces.append((raw[at : at + n], at, n, True))
            else:
                n = hit[0]
                pieces.append((hit[1], at, n, False))
            at += n
        if self.squeeze:
            while pieces and not pieces[0][0].strip(b" "):
                pieces.pop(0)
        if not pieces:
            return b"", np.array([len(raw)])
        if self.dummy_prefix:
            out += blank
            source += [pieces[0][1]] * len(blank)
        after_blank = self.squeeze
        for text, start, _, own in pieces:
            if self.squeeze and after_blank:
                text = text.lstrip(b" ")
            for k, b in enumerate(text):
                byte = blank if b == 32 else bytes((b,))
                out += byte
                source += [start + k if own else start] * len(byte)
            if text:
                after_blank = text.endswith(b" ")
        stop = pieces[-1][1] + pieces[-1][2]
        if self.squeeze:
            while out.endswith(blank):
                stop = source[len(out) - len(blank)]
                del out[len(out) - len(blank) :], source[len(source) - len(blank) :]
            if not out:
                return b"", np.array([len(raw)])
        return bytes(out), np.array([*source, stop])


class Pieces:
    """A model with encoding, spans and decoding."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        top = list(_fields(self.library.serialized_model_proto()))
        self.normalizer = Normalizer(next((v for k, v in top if k == 3), b""))
        trainer = dict(_fields(next((v for k, v in top if k == 2), b"")))
        pieces = [dict(_fields(v)) for k, v in top if k == 1]
        self.names = [p.get(1, b"") for p in pieces]
        kinds = [p.get(3, 1) for p in pieces]
        self.wide = np.array([1 if k == 6 else 0 if k == 3 else len(p) for k, p in zip(kinds, self.names, strict=True)], np.int64)
        model = [p for k, p in zip(kinds, self.names, strict=True) if k == 1]
        whole = not any(self._crosses(p) for p in model)
        self.by_chunk = (
            self.normalizer.plain and self.normalizer.dummy_prefix and whole and trainer.get(3) == 2 and not trainer.get(24, 0)
            and 4 not in kinds and 6 in kinds and not any(b"\n" in p for p in model)
        )
        self.bos, self.eos = self.library.bos_id(), self.library.eos_id()
        self.table, self.slice_bytes = ChunkTable(self._encode), SLICE_BYTES // 4

    @staticmethod
    def _crosses(piece: bytes) -> bool:
        """Whether a blank follows something else in a piece."""
        rest = piece
        while rest.startswith(BLANK):
            rest = rest[len(BLANK) :]
        return BLANK in rest

    def _encode(self, chunks: list[bytes]) -> list[list[int]]:
        """A chunk starts with a blank, which the library's own prefix stands for, or is put after a line feed."""
        own = [c[:1] == b" " and len(c) > 1 for c in chunks]
        lists = self.library.encode([c[1:].decode() if x else "\n" + c.decode() for c, x in zip(chunks, own, strict=True)], num_threads=1)
        return [ids if x else ids[2:] for ids, x in zip(lists, own, strict=True)]

    def encode(self, raw: np.ndarray, offsets: np.ndarray):
        """Yield ``(first text, ids, bounds)`` for slices of texts, without begin and end ids."""
        for i, j in slices(offsets, self.slice_bytes):
            part, at = raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            data = part.tobytes()
            if not self.by_chunk or BLANK in data or b"\0" in data:
                lists = self.library.encode([data[a:b].decode() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], num_threads=1)
                bounds = np.cumsum([0, *map(len, lists)])
                yield i, np.fromiter((x for ids in lists for x in ids), np.uint32, int(bounds[-1])), bounds
                continue
            # Each text that has any bytes gets the prefix blank.
            full = np.flatnonzero(np.diff(at) > 0)
            padded = np.insert(part, at[:-1][full], 32)
            moved = at + np.concatenate([[0], np.cumsum(np.diff(at) > 0)])
            cut = np.zeros(len(padded) + 1, bool)
            cut[moved] = True
            blank, feed = padded == 32, padded == 10
            cut[1:-1] |= blank[1:] & ~blank[:-1]
            cut[:-1] |= feed
            cut[1:] |= feed
            where = np.flatnonzero(cut)
            starts, stops = where[:-1], where[1:]
            ids, counts = self.table.ids(padded, starts, stops)
            yield i, ids.astype(np.uint32), per_text(counts, starts, moved)

    def spans(self, text: bytes, ids: np.ndarray) -> np.ndarray:
        """For each id the (start, stop) of its bytes in ``text``, projected through the normaliser's alignment; begin and end ids have empty spans."""
        ids = np.asarray(ids, np.int64)
        normal, source = self.normalizer.normalize(text)
        width = self.wide[ids].copy()
        unknown = np.flatnonzero(ids == self.library.unk_id())
        if len(unknown):
            surfaces = [p.surface for p in self.library.encode(text.decode(), out_type="immutable_proto").pieces]
            inner = np.flatnonzero((ids != self.bos) & (ids != self.eos))
            for k, i in enumerate(inner.tolist()):
                if ids[i] == self.library.unk_id():
                    width[i] = len(self.library.normalize(surfaces[k]).encode()) or len(surfaces[k].encode())
        stop = np.minimum(np.cumsum(width), len(normal))
        return np.stack([source[np.maximum(stop - width, 0)], source[stop]], 1)


_KNOWN: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    """The worker's model for a file; its table of chunks lasts from task to task."""
    if path not in _KNOWN:
        _KNOWN[path] = Pieces(path)
    return _KNOWN[path]


_ENCODED = "doc_id long, ids array<int>, starts array<int>, stops array<int>"
_DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, covered_bytes long"


def _columns(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _encoded(model: Pieces, column):
    """Yield ``(row, ids with begin and end, text bytes)``."""
    raw, offsets = string_buffer(column)
    for i, ids, bounds in model.encode(raw, offsets):
        n = len(bounds) - 1
        full = np.empty(len(ids) + 2 * n, np.uint32)
        at = bounds + 2 * np.arange(n + 1)
        full[np.arange(len(ids)) + np.repeat(2 * np.arange(n) + 1, np.diff(bounds))] = ids
        full[at[:-1]], full[at[1:] - 1] = model.bos, model.eos
        for k in range(n):
            yield i + k, full[at[k] : at[k + 1]], raw[offsets[i + k] : offsets[i + k + 1]]


def encode(docs: DataFrame, model_path: str) -> DataFrame:
    """Ids, begin and end included, and each id's span of original bytes."""
    lists = pa.list_(pa.int32())
    schema = pa.schema([("doc_id", pa.int64()), ("ids", lists), ("starts", lists), ("stops", lists)])

    def run(batches):
        model = pieces(model_path)
        for batch in batches:
            columns = [[], [], []]
            for _, ids, text in _encoded(model, batch.column(1)):
                spans = model.spans(text.tobytes(), ids)
                for c, x in zip(columns, (ids, spans[:, 0], spans[:, 1]), strict=True):
                    c.append(x.astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, lists) for c in columns)], schema=schema)

    return _columns(docs).mapInArrow(run, _ENCODED)


def digests(docs: DataFrame, model_path: str) -> DataFrame:
    """Per row the digests of the ids and of the text that the library decodes from them, and how many bytes the spans cover.

    Every piece is projected to its original bytes through the normaliser's
    alignment, so ``covered_bytes`` is the length of a text whose pieces tile it.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("covered_bytes", pa.int64())])

    def run(batches):
        model = pieces(model_path)
        for batch in batches:
            columns, held, size = [[], [], [], []], [], 0

            def decode():
                columns[2].extend(hashlib.sha256(x.encode()).hexdigest() for x in model.library.decode(held, num_threads=1))
                held.clear()

            for _, ids, text in _encoded(model, batch.column(1)):
                spans = model.spans(text.tobytes(), ids)
                for k, x in ((0, len(ids)), (1, hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest()), (3, int((spans[:, 1] - spans[:, 0]).sum()))):
                    columns[k].append(x)
                held.append(ids.tolist())
                size += len(ids)
                if size > _DECODE_IDS:
                    decode()
                    size = 0
            if held:
                decode()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.string()), pa.array(columns[3], pa.int64())], schema=schema)

    return _columns(docs).mapInArrow(run, _DIGESTS)

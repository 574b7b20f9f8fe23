"""Binary token files by bit-plane shuffling.

Ids are cut into blocks of ``BLOCK_IDS``.  A block is transposed into byte
planes (all lowest bytes, all second bytes, ...) or bit planes, so that the
high planes, which hardly vary, compress to almost nothing; every plane is a
zstandard frame of its own.  A file is

    magic, frames, footer, footer length (8 bytes), magic

with the footer (zstandard over JSON and two arrays) holding the block size,
the plane kind, the offset of every frame (the chunk index) and for each
document its identifier and number of ids.  A reader can fetch any range of
ids by seeking to its blocks.

Documents lie in ascending order of ``doc_id`` (null first) across the files,
those of one identifier by a hash of their text, so that reruns agree and the
rows of one identifier, however many, may lie in several files.
Each task writes its range to the shared folder under a name of its own; the
manifest names the files of successful attempts.  Null texts are empty; every
document ends with ``end_id``; repeated rows are documents of their own.
Texts are encoded whole, whatever their length; extra columns are ignored, an
empty table gives no files.
"""

from __future__ import annotations

import json
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .byte_bpe import encoder
from .runtime import attempt_name, discard, materialize, open_input, open_output, parts_for, shared_dir
from .words import string_buffer

MAGIC = b"PLANES01"
BLOCK_IDS = 1 << 16
_NULL_DOC = -(2**63)


def to_planes(ids: np.ndarray, kind: str) -> list[bytes]:
    """The planes of a block, lowest first."""
    raw = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    planes = [np.ascontiguousarray(raw[:, k]) for k in range(4)]
    if kind == "bit":
        planes = [np.packbits((p >> k) & 1) for p in planes for k in range(8)]
    return [p.tobytes() for p in planes]


def from_planes(planes: list[bytes], n: int, kind: str) -> np.ndarray:
    rows = [np.frombuffer(p, np.uint8) for p in planes]
    if kind == "bit":
        bits = [np.unpackbits(p, count=n) for p in rows]
        rows = [sum((bits[8 * b + k] << np.uint8(k) for k in range(1, 8)), bits[8 * b].copy()) for b in range(4)]
    out = np.empty((n, 4), np.uint8)
    for k, p in enumerate(rows):
        out[:, k] = p
    return out.reshape(-1).view("<u4")


class PlaneWriter:
    """Writes one file, a block at a time."""

    def __init__(self, uri: str, kind: str = "byte", level: int = 1, block: int = BLOCK_IDS):
        import zstandard

        self.out, self.kind, self.block = open_output(uri), kind, block
        self.zstd = zstandard.ZstdCompressor(level=level)
        self.out.write(MAGIC)
        self.at, self.index, self.held, self.n_held, self.n_ids = len(MAGIC), [], [], 0, 0
        self.docs, self.lengths = [], []

    def add(self, doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> None:
        self.docs.append(doc_ids.astype("<i8"))
        self.lengths.append(lengths.astype("<i8"))
        self.held.append(ids)
        self.n_held += len(ids)
        self.n_ids += len(ids)
        if self.n_held >= self.block:
            self._flush(self.n_held - self.n_held % self.block)

    def _flush(self, n: int) -> None:
        ids = np.concatenate(self.held) if self.held else np.zeros(0, np.uint32)
        for a in range(0, n, self.block):
            frames = [self.zstd.compress(p) for p in to_planes(ids[a : min(n, a + self.block)], self.kind)]
            sizes = [len(f) for f in frames]
            self.index.append([self.at, *sizes])
            self.out.write(b"".join(frames))
            self.at += sum(sizes)
        self.held, self.n_held = [ids[n:]], len(ids) - n

    def close(self) -> None:
        self._flush(self.n_held)
        head = json.dumps({"block": self.block, "kind": self.kind, "ids": self.n_ids, "docs": sum(map(len, self.docs)), "index": self.index}).encode()
        arrays = b"".join(x.tobytes() for x in (*self.docs, *self.lengths))
        footer = self.zstd.compress(struct.pack("<Q", len(head)) + head + arrays)
        self.out.write(footer + struct.pack("<Q", len(footer)) + MAGIC)
        self.out.close()


class PlaneReader:
    """Random access to one file."""

    def __init__(self, uri: str):
        import zstandard

        self.file = open_input(uri)
        self.zstd = zstandard.ZstdDecompressor()
        end = self.file.size()
        self.file.seek(end - 16)
        tail = self.file.read(16)
        if tail[8:] != MAGIC:
            raise ValueError(f"{uri} is no plane file")
        n = struct.unpack("<Q", tail[:8])[0]
        self.file.seek(end - 16 - n)
        footer = self.zstd.decompress(self.file.read(n))
        m = struct.unpack("<Q", footer[:8])[0]
        head = json.loads(footer[8 : 8 + m])
        self.block, self.kind, self.n_ids, self.index = head["block"], head["kind"], head["ids"], head["index"]
        both = np.frombuffer(footer, "<i8", 2 * head["docs"], 8 + m)
        self.docs, self.lengths = both[: head["docs"]], both[head["docs"] :]

    def read_block(self, k: int) -> np.ndarray:
        at, *sizes = self.index[k]
        self.file.seek(at)
        raw = self.file.read(sum(sizes))
        planes, a = [], 0
        for n in sizes:
            planes.append(self.zstd.decompress(raw[a : a + n]))
            a += n
        return from_planes(planes, min(self.block, self.n_ids - k * self.block), self.kind)

    def read(self, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop`` of the file."""
        if stop <= start:
            return np.zeros(0, np.uint32)
        first, last = start // self.block, (stop - 1) // self.block
        ids = np.concatenate([self.read_block(k) for k in range(first, last + 1)])
        return ids[start - first * self.block : stop - first * self.block]

    def documents(self):
        """Yield ``(doc_id, start in the file, ids)`` in order, holding one block and one document at most."""
        held, k, at = np.zeros(0, np.uint32), 0, 0
        for doc, n in zip(self.docs.tolist(), self.lengths.tolist(), strict=True):
            if len(held) < n:
                parts, have = [held], len(held)
                while have < n:
                    parts.append(self.read_block(k))
                    have += len(parts[-1])
                    k += 1
                held = np.concatenate(parts)
            yield None if doc == _NULL_DOC else doc, at, held[:n]
            held = held[n:]
            at += n

    def close(self) -> None:
        self.file.close()


_MANIFEST = "path string, first_doc long, first_mark long, last_doc long, docs long, ids long"


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int = 0, folder: str | None = None, kind: str = "byte", level: int = 1) -> DataFrame:
    """Encode ``docs (doc_id, text)`` and write plane files; returns the manifest with each file's ``start``."""
    spark = docs.sparkSession
    target = folder or f"{shared_dir(spark)}/tokens"

    def run(batches):
        model, writer, path, first, mark, last, n_docs = encoder(tokenizer), None, None, None, None, None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                path = f"{target}/{attempt_name()}.planes"
                writer = PlaneWriter(path, kind, level)
            ids_of = batch.column(0).fill_null(_NULL_DOC).to_numpy(zero_copy_only=False)
            if first is None:
                first, mark = ids_of[0], batch.column(2)[0].as_py()
            last, n_docs = ids_of[-1], n_docs + len(ids_of)
            raw, offsets = string_buffer(batch.column(1))
            for i, ids, bounds in model.encode(raw, offsets):
                n = len(bounds) - 1
                ended = np.full(len(ids) + n, end_id, np.uint32)
                ended[np.arange(len(ids)) + np.repeat(np.arange(n), np.diff(bounds))] = ids
                writer.add(ids_of[i : i + n], np.diff(bounds) + 1, ended)
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "first_doc": [int(first)], "first_mark": [mark], "last_doc": [int(last)], "docs": [n_docs], "ids": [writer.n_ids]})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = parts_for(rows, F.coalesce(F.octet_length("text"), F.lit(0)))
    marked = rows.withColumn("mark", F.xxhash64("text"))
    ordered = marked.repartitionByRange(parts, "doc_id", "mark").sortWithinPartitions("doc_id", "mark")
    files = materialize(ordered.mapInArrow(run, _MANIFEST), "manifest")
    before = Window.orderBy("first_doc", "first_mark", "path").rowsBetween(Window.unboundedPreceding, -1)
    starts = materialize(files.withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0)).cast("long")), "starts")
    discard(files)
    return starts


_READ = "doc_id long, start long, n_tokens long, ids_crc32 long"
_READ_SCHEMA = pa.schema([(x.split()[0], pa.int64()) for x in _READ.split(", ")])


def read_tokens(manifest: DataFrame) -> DataFrame:
    """One row per document of the files: its start over all files, its number of ids, and their CRC-32."""

    def run(batches):
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                reader, columns = PlaneReader(path), [[] for _ in range(4)]
                for doc, at, ids in reader.documents():
                    for c, x in zip(columns, (doc, start + at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())), strict=True):
                        c.append(x)
                    if len(columns[0]) >= 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=_READ_SCHEMA)
                        columns = [[] for _ in range(4)]
                reader.close()
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=_READ_SCHEMA)

    return manifest.repartition(max(1, manifest.count())).select("path", "start").mapInArrow(run, _READ)

"""CSV in splittable blocks, read as its quotes say.

A record may hold line feeds inside quotes, so a block alone cannot tell where
its records begin.  A first pass counts the quotes of each block; a running
sum over the blocks of a file tells whether a block begins inside quotes.  In
the second pass every block cuts out the records that begin in it, reads on to
the end of the last one, and parses them.

That holds as long as quotes stand where they may: around whole fields, and
doubled within.  The first pass sees whether a quote stands anywhere else, for both
states that the block can begin in; a file with such a quote is read
by one task from its start, in which it is a character like any other.

Records end with ``\\n``, ``\\r\\n`` or ``\\r``.  Empty lines are no records;
missing fields are null, fields beyond the header's are ignored.  Text is
UTF-8, with a byte-order mark or without; bytes that are not become U+FFFD.
"""

from __future__ import annotations

import csv
import io
import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .files import open_input

BLOCK_BYTES = 16 << 20
_READ_ON = 1 << 20
_BATCH_ROWS = 20_000
_BOM = b"\xef\xbb\xbf"


def _records(text: io.TextIOBase):
    csv.field_size_limit(sys.maxsize)
    return (r for r in csv.reader(text) if r)


def _stream(file, size: int):
    """A whole file as text, read piece by piece."""
    file.seek(0)
    return io.TextIOWrapper(io.BufferedReader(file, 1 << 20), encoding="utf-8-sig", errors="replace", newline="") if size else io.StringIO("")


class _Raw(io.RawIOBase):
    """An Arrow file as Python's own kind."""

    def __init__(self, file):
        self.file = file

    def readable(self):
        return True

    def seekable(self):
        return True

    def seek(self, at, whence=0):
        return self.file.seek(at, whence)

    def readinto(self, buffer):
        data = self.file.read(len(buffer))
        buffer[: len(data)] = data
        return len(data)


def header(file, size: int) -> tuple[list[str], int]:
    """The names in a file's first record, and the byte at which that one begins."""
    names = next(_records(_stream(_Raw(file), size)), [])
    file.seek(0)
    data, lead = file.read(4096), 0
    at = 3 if data.startswith(_BOM) else 0
    while data:
        rest = data[at:].lstrip(b"\r\n")
        if rest:
            return names, 0 if len(rest) == len(data) - at else lead + len(data) - len(rest)
        lead, data, at = lead + len(data), file.read(4096), 0
    return names, 0


def irregular(data: np.ndarray, before: int, after: int) -> tuple[bool, bool]:
    """Whether a quote of a block stands where none may, if the block begins outside quotes and if it begins inside; ``before`` and ``after`` are its neighbours' bytes, -1 at an end of the file."""
    at = np.flatnonzero(data == 34)
    if not len(at):
        return False, False
    wide = np.concatenate([[before], data, [after]])
    allowed = np.array([44, 10, 13, 34, -1])
    opens, closes = ~np.isin(wide[at], allowed), ~np.isin(wide[at + 2], allowed)
    first = np.arange(len(at)) % 2 == 0
    return bool((opens & first).any() or (closes & ~first).any()), bool((opens & ~first).any() or (closes & first).any())


def boundaries(data: np.ndarray, inside: int, following: int) -> np.ndarray:
    """Where records begin after a line end of ``data``; ``inside`` says whether it begins inside quotes, ``following`` is the byte after it."""
    quotes = np.flatnonzero(data == 34)
    ends = np.flatnonzero((data == 10) | (data == 13))
    after = np.append(data[1:], following if following >= 0 else 0)
    ends = ends[~((data[ends] == 13) & (after[ends] == 10))]
    return ends[(np.searchsorted(quotes, ends) + inside) % 2 == 0] + 1


def cut(file, start: int, stop: int, size: int, inside: int) -> bytes:
    """The bytes of the records that begin in ``[start, stop)``."""
    file.seek(max(0, start - 1))
    data = file.read(stop - max(0, start - 1) + 1)
    first = 0 if start == 0 else None
    # The byte before the block decides whether a record begins with it; a quote there is on the other side.
    state = inside ^ int(start > 0 and data[:1] == b'"')
    base = max(0, start - 1)
    held = np.frombuffer(data, np.uint8)
    body, following = (held[: stop - base], int(held[stop - base])) if len(held) > stop - base else (held, -1)
    begins = boundaries(body, state, following) + base
    if first is None:
        begins = begins[begins >= start]
        if not len(begins) or begins[0] >= min(stop, size):
            return b""
        first = int(begins[0])
    if len(begins) and begins[-1] == stop:
        return data[first - base : stop - base]
    # The last record goes on beyond the block: read until it ends.
    state ^= int(np.count_nonzero(body == 34) & 1)
    out, at = [body[first - base :].tobytes()], base + len(body)
    while at < size:
        file.seek(at)
        more = np.frombuffer(file.read(min(_READ_ON, size - at) + 1), np.uint8)
        n = min(_READ_ON, size - at)
        found = boundaries(more[:n], state, int(more[n]) if len(more) > n else -1)
        # A line feed right at the stop belongs to the record before it.
        if len(found):
            out.append(more[: int(found[0])].tobytes())
            break
        state ^= int(np.count_nonzero(more[:n] == 34) & 1)
        out.append(more[:n].tobytes())
        at += n
    return b"".join(out)


def headers(files: DataFrame) -> DataFrame:
    """``uri, columns`` of ``files (uri, size)``: the names that the first records give."""
    schema = pa.schema([("uri", pa.string()), ("columns", pa.list_(pa.string()))])

    def run(batches):
        for b in batches:
            lists = []
            for uri, size in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                file = open_input(uri)
                lists.append(header(file, size)[0])
                file.close()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lists, pa.list_(pa.string()))], schema=schema)

    return files.select("uri", "size").mapInArrow(run, "uri string, columns array<string>")


def blocks(files: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``files (file_number, uri, name, size)`` cut into ``start, stop`` with ``inside``, the state at the start; a file with misplaced quotes is one block with ``whole``."""
    cuts = files.select("file_number", "uri", "name", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.floor((F.col("size") - 1) / block_bytes), F.lit(0)).cast("long"))).alias("block")).select(
        "*", (F.col("block") * block_bytes).alias("start"), F.least((F.col("block") + 1) * block_bytes, F.col("size")).alias("stop")
    )

    def count(batches):
        for b in batches:
            quotes, odd = [], ([], [])
            for uri, start, stop, size in zip(*(b.column(c).to_pylist() for c in ("uri", "start", "stop", "size")), strict=True):
                file = open_input(uri)
                file.seek(max(0, start - 1))
                data = np.frombuffer(file.read(min(stop + 1, size) - max(0, start - 1)), np.uint8).astype(np.int16)
                file.close()
                before, data = (int(data[0]), data[1:]) if start else (-1, data)
                if not start and bytes(data[:3].astype(np.uint8)) == _BOM:
                    data = data[3:]
                after, data = (int(data[-1]), data[:-1]) if stop < size else (-1, data)
                quotes.append(int(np.count_nonzero(data == 34)))
                for out, x in zip(odd, irregular(data, before, after), strict=True):
                    out.append(x)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(quotes, pa.int64()), *(pa.array(x, pa.bool_()) for x in odd)], names=[*b.schema.names, "quotes", "odd_outside", "odd_inside"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cuts.schema)
    counted = _spread(cuts).mapInArrow(count, f"{kinds}, quotes long, odd_outside boolean, odd_inside boolean")
    before = Window.partitionBy("file_number").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    stated = counted.withColumn("inside", F.pmod(F.coalesce(F.sum("quotes").over(before), F.lit(0)), F.lit(2)).cast("int"))
    odd = F.max(F.when(F.col("inside") == 0, F.col("odd_outside")).otherwise(F.col("odd_inside"))).over(Window.partitionBy("file_number"))
    known = stated.withColumn("whole", odd).filter("not whole or block = 0").withColumn("stop", F.when(F.col("whole"), F.col("size")).otherwise(F.col("stop")))
    return known.drop("quotes", "odd_outside", "odd_inside")


def _spread(cuts: DataFrame) -> DataFrame:
    """A task for each block, or thereabouts."""
    return cuts.repartition(max(1, cuts.count()))


def read_csv(files: DataFrame, columns: list[str], block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The named columns as strings, null where a file has none of the name, with ``file_number``, ``name`` and ``start``, the byte at which the row's block begins."""
    schema = pa.schema([*[(c, pa.string()) for c in columns], ("file_number", pa.int64()), ("name", pa.string()), ("start", pa.int64())])

    def batch(rows, places, number, name, start):
        data = [[r[k] if k is not None and k < len(r) else None for r in rows] for k in places]
        n = len(rows)
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in data), pa.array([number] * n, pa.int64()), pa.array([name] * n, pa.string()), pa.array([start] * n, pa.int64())], schema=schema)

    def run(batches):
        for b in batches:
            for number, uri, name, size, start, stop, inside, whole in zip(*(b.column(c).to_pylist() for c in ("file_number", "uri", "name", "size", "start", "stop", "inside", "whole")), strict=True):
                file = open_input(uri)
                names, lead = header(file, size)
                places = [names.index(c) if c in names else None for c in columns]
                if whole:
                    found = _records(_stream(_Raw(file), size))
                else:
                    data = cut(file, start, stop, size, inside)
                    found = _records(io.StringIO(data.removeprefix(_BOM if not start else b"").decode("utf-8", "replace"), newline=""))
                if whole or start <= lead < stop:
                    next(found, None)
                held = []
                for r in found:
                    held.append(r)
                    if len(held) == _BATCH_ROWS:
                        yield batch(held, places, number, name, start)
                        held = []
                if held:
                    yield batch(held, places, number, name, start)
                file.close()

    kinds = ", ".join(f"`{c}` string" for c in columns)
    return _spread(blocks(files, block_bytes)).mapInArrow(run, f"{kinds}, file_number long, name string, start long")

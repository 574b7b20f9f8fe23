"""The files of an input, listed by Spark on any store, numbered once.

A file's number is a hash of its URI as Spark spells it in ``_metadata``.  Rows
derive the number from the same column when they are read, so no two spellings
of a path ever meet, and neither listing nor rows are joined to be numbered.
Names are taken from the unescaped path.
"""

from __future__ import annotations

import os
import re
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store

#: Input bytes whose rows go to one output file, about.
FILE_BYTES = 128 << 20


def literal(path: str) -> str:
    """A path as Spark's readers take it: without glob characters in effect."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", os.path.expanduser(path) if path.startswith("~") else path)


def number_of(uri: Column) -> Column:
    return F.xxhash64(uri)


def plain_path(uri: Column) -> Column:
    """The path that a URI of Spark's metadata spells with escapes."""
    return F.url_decode(F.regexp_replace(uri, r"\+", "%2B"))


def part_at(start: Column) -> Column:
    """The output part for rows of an input file that begin at a byte."""
    return F.floor(start / FILE_BYTES).cast("int")


@dataclass(frozen=True)
class Inputs:
    """``files``: ``file_number, uri, name, size, modified``, a row for each file; ``name`` is the path below ``root``, the folder."""

    kind: str
    root: str
    path: str
    files: DataFrame


def listed(spark: SparkSession, path: str, pattern: str) -> Inputs:
    """The files below a path whose names match a pattern, or the file at the path."""
    kind = pattern.rpartition(".")[2]
    whole = store.qualified(spark, os.path.expanduser(path) if path.startswith("~") else path).rstrip("/")
    root = whole if store.is_folder(spark, whole) else whole.rpartition("/")[0]
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(literal(path))
    uri = F.col("_metadata.file_path")
    files = found.select(
        number_of(uri).alias("file_number"), uri.alias("uri"), F.substring(F.regexp_replace(plain_path(uri), "^([a-z][a-z0-9+.-]*:)/+(?=/)", "$1"), len(root) + 2, 1 << 30).alias("name"),
        F.col("length").alias("size"), F.unix_micros("modificationTime").alias("modified"),
    )
    return Inputs(kind, root, whole, files)


def find_inputs(spark: SparkSession, path: str) -> Inputs:
    """The Parquet or CSV files at a path; both kinds or none is an error."""
    try:
        kinds = {k: listed(spark, path, f"*.{k}") for k in ("parquet", "csv")}
        counts = {k: x.files.agg(F.count("*"), F.count_distinct("file_number")).first() for k, x in kinds.items()}
    except AnalysisException as e:
        raise ValueError(f"{path} holds no Parquet or CSV files") from e
    have = [k for k, (n, _) in counts.items() if n]
    if len(have) != 1:
        raise ValueError(f"{path} holds both Parquet and CSV files" if have else f"{path} holds no Parquet or CSV files")
    if counts[have[0]][0] != counts[have[0]][1]:
        raise ValueError(f"two files below {path} have one number; rename one of them")
    return kinds[have[0]]


def fingerprint(inputs: Inputs) -> str:
    """A digest of names, sizes and times of the files, whatever their order."""
    return _combined(inputs.files, F.struct("name", "size", "modified"))


def _combined(rows: DataFrame, marks: Column) -> str:
    both = [F.xxhash64(marks, F.lit(k)).cast("decimal(38,0)") for k in (1, 2)]
    n, *sums = rows.agg(F.count("*"), *[F.coalesce(F.sum(x), F.lit(0).cast("decimal(38,0)")) for x in both]).first()
    return "".join(f"{int(x) % (1 << 64):016x}" for x in (*sums, n))


def checksum(inputs: Inputs) -> str:
    """A digest of the names and bytes of the files, whatever their order."""

    def run(batches):
        import hashlib

        import pyarrow as pa

        for b in batches:
            digests = []
            for uri in b.column(1).to_pylist():
                h, file = hashlib.sha256(), open_input(uri)
                while block := file.read(1 << 20):
                    h.update(block)
                file.close()
                digests.append(h.hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(digests, pa.string())], names=["name", "digest"])

    digests = inputs.files.select("name", "uri").mapInArrow(run, "name string, digest string")
    return _combined(digests, F.struct("name", "digest"))


def open_input(uri: str):
    """A seekable binary file at a URI of Spark's metadata, inside a task."""
    from urllib.parse import quote

    from pyarrow import fs

    # Spark leaves letters beyond ASCII as they are.
    place, path = fs.FileSystem.from_uri(quote(uri, safe="!#$%&'()*+,/:;=?@[]~"))
    return place.open_input_file(path)

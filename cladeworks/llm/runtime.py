"""Shared plumbing: tables in the shared folder, size-checked broadcasts, files on any store."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

#: The word pattern of the contracts and its separators, as Java and DuckDB regular expressions.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which all machines of a cluster see.

    Where the setting is absent, a temporary folder serves in local mode only.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = f"{tempfile.gettempdir()}/checkpoints"
    return f"{root.rstrip('/')}/cladeworks-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again.

    This cuts the lineage: a lost executor costs the tasks at hand, not the
    jobs before, and every later use sees the same rows.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    if _HELD:
        _HELD[-1].append(out)
    return out


_HELD: list[list[DataFrame]] = []


@contextmanager
def scratch() -> Iterator[list[DataFrame]]:
    """Tables that ``materialize`` writes inside are removed at the end, but for those put into the list that this gives."""
    _HELD.append([])
    keep: list[DataFrame] = []
    try:
        yield keep
    finally:
        tables = _HELD.pop()
        discard(*[t for t in tables if not any(t is k for k in keep)])
        if _HELD:
            _HELD[-1].extend(t for t in tables if any(t is k for k in keep))


def discard(*tables: DataFrame) -> None:
    """Remove tables that ``materialize`` wrote and that no later step reads."""
    for df in tables:
        spark, path = df.sparkSession, df.stored_at
        target = spark._jvm.org.apache.hadoop.fs.Path(path.rpartition("/")[0])
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


#: Rows that are broadcast at most.
MOST_BROADCAST = 250_000


def broadcast_if_small(df: DataFrame, max_rows: int = MOST_BROADCAST, max_bytes: int = 32 << 20) -> DataFrame:
    """Mark a materialised table of narrow rows for broadcasting if it has at most ``max_rows`` rows and ``max_bytes`` of values.

    The driver builds the hash table: about 100 bytes a row besides values of
    variable size, and three times that while it grows.  The limits keep it far below
    the smallest driver, however large the input.  The join of a larger table is
    shuffled, also where its compressed file looks small to Spark.
    """
    fixed = sum(8 for t in df.schema if not isinstance(t.dataType, (StringType, BinaryType)))
    size = sum((F.coalesce(F.octet_length(t.name), F.lit(0)) + 16 for t in df.schema if isinstance(t.dataType, (StringType, BinaryType))), F.lit(fixed + 16))
    rows, taken = df.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    return F.broadcast(df) if rows <= max_rows and taken <= max_bytes else shuffled(df)


def shuffled(df: DataFrame) -> DataFrame:
    """Mark a side of a join that is to be shuffled.

    Spark takes a stored table to be as large as its compressed file, and an
    exploded one as large as what it is made from.  Left to itself it collects
    tables on the driver that are many times larger than its threshold.
    """
    return df.hint("merge")


def parts_for(df: DataFrame, size: Column, each: int = 128 << 20) -> int:
    """Partitions of about ``each`` bytes for rows of ``size`` bytes, not fewer than the session's shuffle partitions."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, least, (df.agg(F.sum(size)).first()[0] or 0) // each + 1)


def open_output(uri: str):
    """A binary output stream at a URI or path of any store that pyarrow knows."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    return store.open_output_stream(path, compression=None)


def open_input(uri: str):
    """A seekable binary input file at a URI or path."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    return store.open_input_file(path)


def attempt_name() -> str:
    """A file name that no other attempt of any task uses."""
    from pyspark import TaskContext

    context = TaskContext.get()
    return f"part-{context.partitionId():05d}-{context.taskAttemptId()}-{uuid.uuid4().hex[:8]}"


def row_ids(partition: int, first: int, n: int):
    """64-bit row identifiers that are unique in a job: the partition, then the row within it."""
    import numpy as np

    return (np.int64(partition) << np.int64(40)) + np.arange(first, first + n, dtype=np.int64)

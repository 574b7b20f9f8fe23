"""Tables kept between runs, and file operations on any store that Spark reaches."""

from __future__ import annotations

import tempfile
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import __version__


def _at(spark: SparkSession, path: str):
    """(file system, path) as Hadoop's objects."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its store, as Spark writes it, without any escapes."""
    fs, p = _at(spark, path)
    return fs.makeQualified(p).toString()


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _at(spark, path)
    return fs.exists(p)


def is_folder(spark: SparkSession, path: str) -> bool:
    fs, p = _at(spark, path)
    return fs.exists(p) and fs.getFileStatus(p).isDirectory()


def delete(spark: SparkSession, path: str) -> bool:
    fs, p = _at(spark, path)
    return fs.delete(p, True)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder; none if it is absent."""
    fs, p = _at(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def move(spark: SparkSession, source: str, target: str) -> None:
    """Rename a folder that Spark has written, with a success marker of its own; what lies at the target goes."""
    fs, a = _at(spark, source)
    b = _at(spark, target)[1]
    fs.create(_at(spark, f"{source}/_SUCCESS")[1], True).close()
    fs.mkdirs(b.getParent())
    if fs.exists(b):
        fs.delete(b, True)
    if not fs.rename(a, b):
        raise OSError(f"cannot move {source} to {target}")


def _plain(fs):
    """A local file system without the checksum files beside its own, which others who write there do not keep."""
    return fs.getRawFileSystem() if fs.getScheme() == "file" else fs


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = _at(spark, path)
    fs = _plain(fs)
    if not fs.exists(p):
        raise FileNotFoundError(path)
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file whole: readers see all of it or none."""
    fs, p = _at(spark, path)
    fs = _plain(fs)
    fresh = _at(spark, f"{path}.partial")[1]
    fs.mkdirs(p.getParent())
    stream = fs.create(fresh, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    if fs.exists(p):
        fs.delete(p, False)
    if not fs.rename(fresh, p):
        raise OSError(f"cannot write {path}")


def shared_folder(spark: SparkSession) -> str:
    """A new folder that all machines see, below ``spark.checkpoint.dir``; a temporary one serves in local mode where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = f"{tempfile.gettempdir()}/checkpoints"
    return f"{root.rstrip('/')}/cladeworks-{uuid.uuid4().hex}"


def keeper(spark: SparkSession) -> Callable[[str, DataFrame], DataFrame]:
    """A function that writes a table into one new shared folder under a name and gives it read again."""
    folder = shared_folder(spark)

    def keep(name: str, df: DataFrame) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    return keep


def few(rows: DataFrame, most: int) -> DataFrame:
    """Mark a stored table for broadcasting if it has at most ``most`` rows.  Else its joins are shuffled, and with them all rows of the other side."""
    return F.broadcast(rows) if rows.count() <= most else rows


def namespace(command: str, fingerprint: str) -> str:
    """A folder name that changes with the command, the version and the input."""
    return f"{command}_v{__version__}_{fingerprint[:16]}"


class TableCache:
    """Named Parquet tables below ``base/namespace``.

    Spark's success marker tells a whole table from a broken one, and its time
    how old the table is.
    """

    def __init__(self, spark: SparkSession, base: str, space: str, max_age: int | None = None):
        self.spark, self.base, self.folder, self.max_age = spark, base, f"{base.rstrip('/')}/{space}", max_age

    def fresh(self, name: str) -> bool:
        fs, marker = _at(self.spark, f"{self.folder}/{name}/_SUCCESS")
        if not fs.exists(marker):
            return False
        age = time.time() - fs.getFileStatus(marker).getModificationTime() / 1000
        return self.max_age is None or age <= self.max_age

    def table(self, name: str, compute: Callable[[], DataFrame], refresh: bool = False, by: str | None = None) -> DataFrame:
        """The stored table, computed and stored first if it is absent, broken, too old or to be refreshed; ``by`` names a column to partition it by."""
        path = f"{self.folder}/{name}"
        if refresh or not self.fresh(name):
            writer = compute().write.mode("overwrite")
            (writer.partitionBy(by) if by else writer).parquet(path)
        return self.spark.read.parquet(path)

    def used(self) -> bool:
        return bool(children(self.spark, self.folder))

    def stats(self) -> dict:
        fs, p = _at(self.spark, self.folder)
        size = fs.getContentSummary(p).getLength() if fs.exists(p) else 0
        return {"namespace": self.folder, "entry_count": len(children(self.spark, self.folder)), "total_size_bytes": size, "tables": children(self.spark, self.folder)}

    def clear(self) -> int:
        """Remove the namespace; returns how many tables went."""
        n = len(children(self.spark, self.folder))
        delete(self.spark, self.folder)
        return n


def clear_all(spark: SparkSession, base: str) -> int:
    """Remove the tables of every namespace; returns how many went."""
    gone = 0
    for space in children(spark, base):
        if "_v" in space:
            gone += len(children(spark, f"{base}/{space}"))
            delete(spark, f"{base}/{space}")
    return gone

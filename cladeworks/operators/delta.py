"""Groups and outcomes kept up to date by the files that changed.

Every input file has a mark, a hash of its name, size and time.  For each mark
the groups of that file alone are stored: how many entries a group has there,
and the spelling of the first.  Both merge: counts add up, and of the first spellings the
first counts.  An update scans the files whose mark is new, forgets those that
went, and resolves only the groups that such a file has or had; the outcomes of
all others are taken over.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import store
from ..sources.files import Inputs, literal
from .grouping import NAMES, with_group_key

PARTIAL = "group_key string, names struct<" + ", ".join(f"`{c}`: string" for c in NAMES) + ">, first string, n bigint"


def partial_groups(entries: DataFrame, by: str) -> DataFrame:
    """The groups of each ``by`` of ``entries``: ``by, group_key, names, first, n``."""
    names = F.struct(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in NAMES])
    first = F.min(F.struct(F.col("uuid").alias("first"), names.alias("names")))
    return with_group_key(entries).groupBy(by, "group_key").agg(first.alias("x"), F.count("*").alias("n")).select(by, "group_key", "x.names", "x.first", "n")


def merged(partials: DataFrame) -> DataFrame:
    """The groups of all files: as ``group_entries`` over all their entries."""
    first = F.min(F.struct("first", "names"))
    return partials.groupBy("group_key").agg(first.alias("x"), F.sum("n").alias("group_count")).select("group_key", "x.names.*", "group_count")


@dataclass(frozen=True)
class Update:
    groups: DataFrame
    final: DataFrame
    #: Names of the files that were scanned, and how many groups were resolved.
    scanned: list[str]
    resolved: int


class GroupStore:
    """Partial groups below ``folder/partials/mark=M``, and outcomes below ``folder/final``; ``folder/state`` names what is valid."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _state(self) -> dict[str, str]:
        """``mark: file name`` of the stored partials that count, under ``final`` the name of the outcomes."""
        import json

        try:
            return json.loads(store.read_text(self.spark, f"{self.folder}/state"))
        except FileNotFoundError:
            return {}

    def _partials(self, marks) -> DataFrame:
        paths = [literal(f"{self.folder}/partials/{m}") for m in sorted(marks)]
        return self.spark.read.schema(PARTIAL).parquet(*paths) if paths else self.spark.createDataFrame([], PARTIAL)

    def update(self, inputs: Inputs, read: Callable[[Inputs], DataFrame], resolve: Callable[[DataFrame], DataFrame]) -> Update:
        """Bring the store up to ``inputs``.

        ``read`` gives the entries of the files that it gets, with
        ``file_number``; ``resolve`` gives one row for each group that it gets.
        The new state is written last, so an update that stops changes nothing.
        """
        import json

        marked = inputs.files.withColumn("mark", F.xxhash64("name", "size", "modified").cast("string"))
        current = {r["mark"]: r["name"] for r in marked.select("mark", "name").toLocalIterator()}
        state = self._state()
        last, known = state.pop("final", None), set(state)
        fresh, gone = set(current) - known, known - set(current)
        if fresh:
            new = marked.filter(F.col("mark").isin(sorted(fresh)))
            rows = partial_groups(read(replace(inputs, files=new.drop("mark"))), "file_number")
            numbers = {r["file_number"]: r["mark"] for r in new.select("file_number", "mark").collect()}
            staging = f"{self.folder}/staging-{uuid.uuid4().hex}"
            rows.write.partitionBy("file_number").parquet(staging)
            written = {int(x.partition("=")[2]): x for x in store.children(self.spark, staging) if x.startswith("file_number=")}
            for number, mark in numbers.items():
                if number in written:
                    store.move(self.spark, f"{staging}/{written[number]}", f"{self.folder}/partials/{mark}")
                else:  # a file without entries
                    self.spark.createDataFrame([], PARTIAL).write.mode("overwrite").parquet(f"{self.folder}/partials/{mark}")
            store.delete(self.spark, staging)
        groups = merged(self._partials(current))
        touched = self._partials(fresh | gone).select("group_key").distinct()
        due = groups.join(touched, "group_key", "left_semi") if last else groups
        name = f"final-{uuid.uuid4().hex}"
        outcome = resolve(due)
        outcome.write.parquet(f"{self.folder}/{name}/resolved")
        resolved = self.spark.read.schema(outcome.schema).parquet(f"{self.folder}/{name}/resolved")
        if last:
            kept = self.spark.read.schema(outcome.schema).parquet(f"{literal(self.folder)}/{last}/*").join(touched, "group_key", "left_anti")
            kept.write.parquet(f"{self.folder}/{name}/kept")
        store.write_text(self.spark, f"{self.folder}/state", json.dumps({**current, "final": name}))
        final = self.spark.read.schema(outcome.schema).parquet(f"{literal(self.folder)}/{name}/*")
        for old in [*(f"partials/{m}" for m in gone), *([last] if last else [])]:
            store.delete(self.spark, f"{self.folder}/{old}")
        return Update(groups, final, sorted(current[m] for m in fresh), resolved.count())

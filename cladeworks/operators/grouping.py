"""Grouping of entries by normalised lineage, and statistics over entries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import RANKS
from ..functions.names import group_key

NAMES = ("scientific_name", *RANKS)


def with_group_key(entries: DataFrame) -> DataFrame:
    return entries.withColumn("group_key", group_key())


def group_entries(entries: DataFrame, order: str = "uuid") -> DataFrame:
    """One row per lineage: the spelling of the first entry by ``order`` and the number of entries.

    Every entry derives its group key by itself, so no list of members is
    gathered, however large a group is.
    """
    names = F.struct(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in NAMES])
    first = F.min_by(names, F.struct(order, *NAMES)).alias("names")
    return with_group_key(entries).groupBy("group_key").agg(first, F.count("*").alias("group_count")).select("group_key", "names.*", "group_count")


def dataset_statistics(entries: DataFrame) -> DataFrame:
    """One row: number of entries and of groups, and of missing values in ten columns with their percentage."""
    columns = ("scientific_name", "common_name", *RANKS, "source_id")
    missing = lambda c: F.sum(F.when(F.coalesce(F.col(c), F.lit("")) == "", 1).otherwise(0)).cast("long")
    total = with_group_key(entries).agg(F.count("*").alias("entry_count"), F.count_distinct("group_key").alias("group_count"), *[missing(c).alias(f"missing_{c}") for c in columns])
    return total.select("*", *[F.round(100 * F.col(f"missing_{c}") / F.nullif(F.col("entry_count"), F.lit(0)), 1).alias(f"missing_{c}_percent") for c in columns])


def entries_by_source(entries: DataFrame) -> DataFrame:
    return entries.groupBy("source_dataset").agg(F.count("*").alias("entries")).orderBy(F.desc("entries"), "source_dataset")

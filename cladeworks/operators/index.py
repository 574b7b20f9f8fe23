"""Stored chains of attempts, found by ``uuid``.

Two tables are stored: the group of every ``uuid``, and the attempts of every
group.  Both lie in folders by a hash of their key, sorted by it, with a bloom
filter.  Looking up a few identifiers reads the folders of their
hashes alone, which Spark prunes while it plans, and in them the row groups
that can hold them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .grouping import with_group_key

#: Rows of a folder, about.
BUCKET_ROWS = 1_000_000
#: A table of fewer folders is written by about so many tasks, a file for each folder and task.
WRITERS = 32
MEMBERS, CHAINS = "members", "chains"


def buckets_for(rows: int) -> int:
    return rows // BUCKET_ROWS + 1


def bucket(key: str | Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _store(rows: DataFrame, key: str, folder: str, buckets: int) -> None:
    files = max(1, WRITERS // buckets)
    dealt = rows.withColumn("bucket", bucket(key, buckets)).repartition(buckets * files, "bucket", F.pmod(F.hash(key), F.lit(files))).sortWithinPartitions("bucket", key)
    dealt.write.mode("overwrite").option(f"parquet.bloom.filter.enabled#{key}", "true").partitionBy("bucket").parquet(folder)


def store(folder: str, entries: DataFrame, steps: DataFrame, rows: int) -> None:
    """Store the groups of ``entries`` and their attempts ``steps`` below a folder; ``rows`` is the number of entries, about."""
    n = buckets_for(rows)
    _store(with_group_key(entries).select("uuid", "group_key").distinct(), "uuid", f"{folder}/{MEMBERS}-{n}", n)
    _store(steps, "group_key", f"{folder}/{CHAINS}-{n}", n)


def _within(table: DataFrame, key: str, keys: list[str], buckets: int) -> DataFrame:
    """The rows with one of ``keys``, a short list."""
    spark = table.sparkSession
    wanted = spark.createDataFrame([(k,) for k in keys], f"{key} string")
    places = sorted({r[0] for r in wanted.select(bucket(key, buckets)).collect()})
    return table.filter(F.col("bucket").isin(places) & F.col(key).isin(keys)).drop("bucket")


def attempts_of(members: DataFrame, chains: DataFrame, uuids: list[str], buckets: int) -> DataFrame:
    """``uuid`` and the attempts of its groups, for a short list of identifiers; only the folders of their hashes are read."""
    mine = _within(members, "uuid", uuids, buckets)
    keys = sorted({r["group_key"] for r in mine.select("group_key").distinct().collect()})
    return mine.join(_within(chains, "group_key", keys, buckets), "group_key")


def attempts_of_many(members: DataFrame, chains: DataFrame, wanted: DataFrame, buckets: int) -> DataFrame:
    """The same for a table of ``uuid``; both joins are by folder and key."""
    asked = wanted.select("uuid").distinct().withColumn("bucket", bucket("uuid", buckets))
    mine = members.join(asked, ["bucket", "uuid"]).select("uuid", "group_key").withColumn("bucket", bucket("group_key", buckets))
    return mine.join(chains, ["bucket", "group_key"]).drop("bucket")

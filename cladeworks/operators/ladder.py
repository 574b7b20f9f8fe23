"""The fixed ladder of look-ups of a group: its terms, most specific first, each at every source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import SOURCES
from ..functions.names import most_specific_rank, most_specific_term, term_rank, terms, valid_names


def initial_plan(groups: DataFrame) -> DataFrame:
    """``query_term, query_rank, source_id`` of each group's first look-up; an empty term if no name is valid."""
    return groups.withColumns({"query_term": F.coalesce(most_specific_term(), F.lit("")), "query_rank": most_specific_rank(), "source_id": F.lit(SOURCES[0])})


def source_at(place: Column) -> Column:
    """The source at a place in the order of preference."""
    return F.get(F.array(*[F.lit(s) for s in SOURCES]), place.cast("int"))


def rungs(groups: DataFrame) -> DataFrame:
    """One row per group and rung.  A group without valid names has one rung with an empty term and no rank."""
    asked = groups.withColumn("_names", valid_names()).select("*", F.posexplode_outer(terms(F.col("_names"))).alias("_at", "_term"))
    places = F.when(F.col("_term").isNull(), F.array(F.lit(0))).otherwise(F.array(*[F.lit(k) for k in range(len(SOURCES))]))
    climbed = asked.select("*", F.explode(places).alias("_source"))
    return climbed.withColumns({
        "rung": F.coalesce(F.col("_at") * len(SOURCES), F.lit(0)) + F.col("_source"), "source_id": source_at(F.col("_source")),
        "query_term": F.coalesce("_term", F.lit("")), "query_rank": term_rank(F.col("_term"), F.col("_names")),
    }).withColumn("is_retry", F.col("rung") > 0).drop("_names", "_at", "_term", "_source")


def lookups(groups: DataFrame) -> DataFrame:
    """The different ``(term, source_id)`` that groups ask for: each of their terms at each source."""
    asked = groups.select(F.explode(terms(valid_names())).alias("term")).distinct()
    return asked.select("term", F.explode(F.array(*[F.lit(s) for s in SOURCES])).alias("source_id"))

"""Vernacular names for resolved rows.

All joins of rows are left joins on sides that are unique by construction
(``min_by`` over the numeric taxon identifier or the row order), so the number
of rows never changes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import INVALID, RANKS
from ..functions.names import title_case

FINE_FIRST = tuple(reversed(RANKS))
#: Ranks in the parent-path key, coarsest first.  ``class`` takes no part in it.
PATH_KEY = tuple(r for r in RANKS if r not in ("class", "species"))


def normalize_ranks(df: DataFrame) -> DataFrame:
    """Rank columns as strings, invalid words as null."""
    text = lambda c: F.col(c).cast("string")
    return df.withColumns({c: F.when(~F.lower(text(c)).isin(*INVALID), text(c)) for c in RANKS if c in df.columns})


def prioritize_vernacular(names: DataFrame, order=None) -> DataFrame:
    """One title-cased name per taxon: the first English one, else the first of another language."""
    position = order if order is not None else F.monotonically_increasing_id()
    rows = names.filter("language is not null").withColumn("_at", F.struct(F.when(F.col("language") == "en", 1).otherwise(2).alias("p"), position.alias("o")))
    best = rows.groupBy("taxonID").agg(F.min_by(F.struct("vernacularName"), "_at").alias("x"))
    return best.select("taxonID", title_case(F.col("x.vernacularName")).alias("vernacularName"))


def _numeric(c: str):
    return F.struct(F.coalesce(F.try_cast(F.col(c), "bigint") if hasattr(F, "try_cast") else F.col(c).try_cast("bigint"), F.lit(2**62)), F.col(c))


def unique_taxa(taxa: DataFrame, keys: list[str], rank: str) -> DataFrame:
    """The least taxon identifier per key, of the rank if the table knows ranks."""
    if "taxonRank" in taxa.columns:
        taxa = taxa.filter(F.col("taxonRank") == rank)
    text = taxa.withColumn("taxonID", F.col("taxonID").cast("string"))
    return text.groupBy(*keys).agg(F.min_by("taxonID", _numeric("taxonID")).alias(f"taxonID_{rank}"))


def _spread(c: str):
    """A join key for names of which many may be null: null rows spread over tasks, and match nothing."""
    return F.coalesce(F.col(c), F.concat(F.lit("\0"), F.spark_partition_id().cast("string")))


def join_single_rank(rows: DataFrame, taxa: DataFrame, rank: str) -> DataFrame:
    """Add ``taxonID_<rank>`` by name and parent path; null names match nothing."""
    if rank not in rows.columns:
        return rows
    parents = [c for c in PATH_KEY if RANKS.index(c) < RANKS.index(rank) and c in rows.columns and c in taxa.columns]
    side = unique_taxa(taxa, ["canonicalName", *parents], rank).withColumnsRenamed({"canonicalName": "_name", **{c: f"_{c}" for c in parents}})
    same = F.col("_key") == F.col("_name")
    for c in parents:
        same = same & (F.col(c) == F.col(f"_{c}"))
    return rows.withColumn("_key", _spread(rank)).join(side, same, "left").select(*rows.columns, f"taxonID_{rank}")


def merge_taxon_ids(rows: DataFrame, taxa: DataFrame) -> DataFrame:
    """Normalised ranks with the identifiers of species and genus."""
    out = normalize_ranks(rows)
    for rank in ("species", "genus"):
        out = join_single_rank(out, taxa, rank)
    return out


def named_taxa(taxa: DataFrame, vernacular: DataFrame) -> DataFrame:
    """``rank, name, id`` of every name that has, at a rank, a taxon with a vernacular name; the least taxon of a name counts."""
    rank = F.col("taxonRank") if "taxonRank" in taxa.columns else F.explode(F.array(*[F.lit(r) for r in RANKS]))
    by_name = taxa.select(rank.alias("rank"), F.col("canonicalName").alias("name"), F.col("taxonID").cast("string").alias("taxonID")).filter(F.col("rank").isin(*RANKS) & F.col("name").isNotNull())
    least = by_name.groupBy("rank", "name").agg(F.min_by("taxonID", _numeric("taxonID")).alias("id"))
    known = vernacular.filter("vernacularName is not null").select(F.col("taxonID").cast("string").alias("id")).distinct()
    return least.join(known, "id", "left_semi")


def _lineage_key(ranks) -> Column:
    return F.md5(F.concat_ws("\x1f", *[F.coalesce(F.concat(F.lit("+"), c), F.lit("-")) for c in ranks]))


def add_common_names(rows: DataFrame, taxa: DataFrame, vernacular: DataFrame, climb: bool = True) -> DataFrame:
    """The whole enrichment in one look-up of names by rank.

    An identifier by name goes before one by parent path, and a path matches
    no name that the rank does not have, so paths decide nothing here.  A row asks under the names of its
    ranks.  Climbing asks under all of them: each different lineage becomes a
    row a rank, one join finds those that have a vernacular name, the finest is kept, and rows meet their lineage
    once.  Without it a row asks under its finest name alone.
    """
    named = named_taxa(taxa, vernacular)
    lookup = vernacular.groupBy(F.col("taxonID").cast("string").alias("id")).agg(F.min("vernacularName").alias("common_name"))
    rows = normalize_ranks(rows).drop("common_name", "common_name_rank", *[f"taxonID_{r}" for r in RANKS])
    present = [r for r in FINE_FIRST if r in rows.columns]
    if not present:
        return rows.withColumns({"common_name": F.lit(None).cast("string"), "common_name_rank": F.lit(None).cast("string")})
    asks = lambda r, k: F.when(F.col(r).isNotNull(), F.struct(F.lit(k).alias("fine"), F.lit(r).alias("rank"), F.col(r).alias("name")))
    every = [asks(r, k) for k, r in enumerate(present)]
    if not climb:
        # A generator gives the finest name once; as an expression it would be copied to wherever it is used.
        asking = rows.withColumn("_ask", F.explode_outer(F.slice(F.array_compact(F.array(*every)), 1, 1)))
        side = named.join(lookup, "id").select("rank", "name", F.col("common_name").alias("_found"))
        key = F.coalesce("_ask.name", F.concat(F.lit("\0"), F.spark_partition_id().cast("string")))
        joined = asking.withColumn("_key", key).join(side, (F.col("_key") == F.col("name")) & (F.col("_ask.rank") == F.col("rank")), "left")
        return joined.select(*rows.columns, F.col("_found").alias("common_name"), F.when(F.col("_found").isNotNull(), F.col("_ask.rank")).alias("common_name_rank"))
    keyed = rows.withColumn("_key", _lineage_key([F.col(r) for r in present]))
    asked = keyed.select("_key", *present).distinct().select("_key", F.explode(F.array_compact(F.array(*every))).alias("ask")).select("_key", "ask.*")
    finest = asked.join(named, ["rank", "name"]).groupBy("_key").agg(F.min_by(F.struct("rank", "id"), "fine").alias("x"))
    found = finest.select("_key", F.col("x.rank").alias("common_name_rank"), F.col("x.id").alias("id")).join(lookup, "id").drop("id")
    return keyed.join(found, "_key", "left").select(*rows.columns, "common_name", "common_name_rank")

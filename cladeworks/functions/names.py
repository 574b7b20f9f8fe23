"""Column functions on names and ranks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import INVALID, KINGDOMS, QUERY_ORDER, RANKS, WHITE_SPACE


def strip(c: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.btrim(c, F.lit(WHITE_SPACE))


def valid(c: Column) -> Column:
    """Whether a name says something once stripped; never null."""
    return ~F.lower(strip(F.coalesce(c, F.lit("")))).isin(*INVALID)


def has_taxonomic_data() -> Column:
    """Whether any rank or the scientific name is more than an invalid word; blanks are not stripped here."""
    some = F.lit(False)
    for c in (*RANKS, "scientific_name"):
        some = some | ~F.lower(F.coalesce(F.col(c), F.lit(""))).isin(*INVALID)
    return some


def most_specific_rank() -> Column:
    return F.coalesce(*[F.when(valid(F.col(c)), F.lit(c)) for c in QUERY_ORDER])


def most_specific_term() -> Column:
    return F.coalesce(*[F.when(valid(F.col(c)), strip(F.col(c))) for c in QUERY_ORDER])


def normalized(c: Column) -> Column:
    """Stripped and lower-cased; empty for null."""
    return F.lower(strip(F.coalesce(c, F.lit(""))))


def group_key() -> Column:
    """SHA-256 of the normalised names, joined by ``|``.

    Never null, and declared so: else a join on it pushes a copy of it as a
    null check below the grouping, which then can't be shared between joins.
    """
    return F.coalesce(F.sha2(F.concat_ws("|", *[normalized(F.col(c)) for c in QUERY_ORDER]), 256), F.lit(""))


def canonical_kingdom(c: Column) -> Column:
    """The canonical name of a kingdom or a synonym of one; any other name as it is, stripped; null if invalid."""
    s = strip(c)
    known = F.create_map(*[F.lit(x) for pair in KINGDOMS.items() for x in pair])
    return F.when(valid(c), F.coalesce(F.try_element_at(known, F.lower(s)), s))


def title_case(c: Column) -> Column:
    """Lower case with the first letter of every run of letters and digits in upper case."""
    parts = F.split(F.lower(c), r"(?<=[^\p{L}\p{N}])")
    return F.array_join(F.transform(parts, lambda t: F.concat(F.upper(F.substring(t, 1, 1)), F.substr(t, F.lit(2)))), "")


def lineage() -> Column:
    """The seven ranks as an array, kingdom first, null as empty."""
    return F.array(*[F.coalesce(F.col(c), F.lit("")) for c in RANKS])


def valid_names() -> Column:
    """The stripped names in query order, null where one is invalid."""
    return F.array(*[F.when(valid(F.col(c)), strip(F.col(c))) for c in QUERY_ORDER])


def terms(names: Column) -> Column:
    """The different names of ``valid_names``, each where it comes first."""
    return F.array_except(names, F.array(F.lit(None).cast("string")))


def term_rank(term: Column, names: Column) -> Column:
    """The first rank in query order that has this name among ``valid_names``; null if none has."""
    return F.get(F.array(*[F.lit(c) for c in QUERY_ORDER]), (F.array_position(names, term) - 1).cast("int"))


def term_rank_pairs() -> Column:
    """``array<struct<term, rank>>``: valid names in query order, each term once with its first rank."""
    names = valid_names()
    return F.transform(terms(names), lambda t: F.struct(t.alias("term"), term_rank(t, names).alias("rank")))

"""Queries over the driver's tables, each with the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import FORCED, INVALID, RANKS, STATUSES, SUCCESSFUL
from ..functions import lineages as L
from ..functions import names as N
from ..operators import common_names as C
from ..operators import grouping as G
from ..operators import climb, index, ladder, resolve
from ..operators.trace import trace_entry
from ..sources import store
from ..sources.backbone import accepted
from ..sources.entries import normalized_entries, source_of
from . import driver_views as V

_Q = {r: f'"{r}"' if r == "order" else r for r in ("scientific_name", *RANKS)}
_INVALID = ", ".join(f"'{x}'" for x in INVALID)


def _full(spark, d) -> DataFrame:
    return normalized_entries(V.entries(spark, d))


def _groups(spark, d) -> DataFrame:
    return G.group_entries(V.entries(spark, d))


def _answers(groups) -> DataFrame:
    return V.responses(ladder.lookups(groups))


#: Answers that are broadcast, of about 2 KB each.
_FEW = 20_000


def _stored(spark, d) -> tuple[DataFrame, DataFrame]:
    """Groups and the answers to their look-ups, stored, as several steps read them.

    Few terms are asked for by very many groups: joined by shuffle, all rungs of all groups would move, most to the tasks of a few terms.
    """
    keep = store.keeper(spark)
    groups = keep("groups", _groups(spark, d))
    return groups, store.few(keep("answers", _answers(groups)), _FEW)


def _ended(spark, d, without=()) -> DataFrame:
    return resolve.final_attempts(*_stored(spark, d), without)


def _final(spark, d) -> DataFrame:
    return resolve.force_failed(_ended(spark, d))


def scan_normalize(spark, d):
    return _full(spark, d).select("uuid", "source_dataset", *_Q)


def invalid_filter(spark, d):
    return _full(spark, d).withColumn("has_data", N.has_taxonomic_data()).groupBy("source_dataset").agg(F.count_if("has_data").alias("with_data"), F.count("*").alias("entries"))


def source_extract(spark, d):
    path = F.concat(F.when(F.col("uuid").cast("long") % 3 == 0, "/d/source=").otherwise("/d/"), "source_dataset", F.when(F.col("uuid").cast("long") % 2 == 0, "/x/f.parquet").otherwise("/f.parquet"))
    return _full(spark, d).select("uuid", source_of(path).alias("source"))


def most_specific_term(spark, d):
    return V.entries(spark, d).select("uuid", N.most_specific_rank().alias("most_specific_rank"), N.most_specific_term().alias("most_specific_term"))


def term_rank_pairs(spark, d):
    return _groups(spark, d).select("group_key", F.posexplode(N.term_rank_pairs())).select("group_key", F.col("pos").cast("long").alias("pair"), "col.term", "col.rank")


def group_key_sha256(spark, d):
    return V.entries(spark, d).select("uuid", N.group_key().alias("group_key"))


def group_entries(spark, d):
    return _groups(spark, d)


def dataset_statistics(spark, d):
    return G.dataset_statistics(_full(spark, d).withColumns({"common_name": F.lit(""), "source_id": F.col("uuid")}))


def dataset_stats_by_source(spark, d):
    return G.entries_by_source(V.entries(spark, d))


def canonical_kingdom(spark, d):
    return V.entries(spark, d).select("uuid", N.canonical_kingdom(F.col("kingdom")).alias("kingdom"))


def plan_initial(spark, d):
    return ladder.initial_plan(_groups(spark, d)).select("group_key", "query_term", "query_rank", "source_id")


def retry_ladder(spark, d):
    return ladder.rungs(_groups(spark, d)).select("group_key", F.col("rung").cast("long").alias("rung"), "query_term", "query_rank", "source_id", "is_retry")


def _paths(spark, d) -> DataFrame:
    """Entries with a path whose ranks repeat, skip and run out."""
    rows = V.entries(spark, d).withColumns({
        "path": F.concat_ws("|", F.lit("Old"), F.coalesce("kingdom", F.lit("X")), F.coalesce("phylum", F.lit("Y")), "family", "genus"),
        "path_ranks": F.lit("kingdom|kingdom|phylum|family|genus|species"), "E": F.array(*[F.when(N.valid(F.col(c)), N.strip(F.col(c))) for c in RANKS]),
    })
    return rows.withColumn("C", F.expr(L.extract("path", "path_ranks")))


def extract_classification(spark, d):
    return _paths(spark, d).select("uuid", *[F.col("C")[i].alias(f"c_{r}") for i, r in enumerate(RANKS)])


def compare_paths(spark, d):
    return _paths(spark, d).select("uuid", F.expr(L.agrees("E", "C", "1")).alias("to_phylum"), F.expr(L.agrees("E", "C", "6")).alias("whole"))


def filter_by_rank(spark, d):
    return _paths(spark, d).withColumn("cut", F.expr(L.cut("C", "4"))).select("uuid", F.col("cut")[4].alias("family"), F.col("cut")[5].alias("genus"))


def rank_of_term(spark, d):
    return _paths(spark, d).select("uuid", F.expr(L.rank_name(L.rank_of("genus", "C"))).alias("rank"), F.expr(L.rank_name(L.deepest("C"))).alias("deepest"))


def resolve_attempts(spark, d):
    without = ("strategy", "resolved", "failure_reason", "error", "metadata")
    return resolve.attempts(*_stored(spark, d), without).select("group_key", F.col("rung").cast("long").alias("rung"), "status")


_NOT_RESOLVED = ("resolved", "metadata")


def first_terminal_rung(spark, d):
    return _ended(spark, d, _NOT_RESOLVED).select("group_key", F.col("rung").cast("long").alias("rung"), "query_term", "source_id", "status")


def resolve_final(spark, d):
    return _final(spark, d).select("group_key", "status", "resolved").select("group_key", "status", *[F.coalesce(F.col("resolved")[i], F.lit("")).alias(r) for i, r in enumerate(RANKS)])


def force_failed_to_input(spark, d):
    return _final(spark, d).filter("status = 'FAILED_FORCED_INPUT'").select("group_key", F.col("metadata")["original_status"].alias("original_status"), "strategy")


def resolution_stats(spark, d):
    return resolve.statistics(_final(spark, d))


def successful_attempts(spark, d):
    return resolve.successful(_final(spark, d)).groupBy("status").agg(F.count("*").alias("groups"))


def attempts_chain(spark, d):
    return resolve.chains(_ended(spark, d, _NOT_RESOLVED)).select("group_key", F.col("rung").cast("long").alias("rung"), "query_term", "source_id", "status")


def attempt_keys(spark, d):
    groups, answers = _stored(spark, d)
    steps = resolve.with_attempt_keys(resolve.steps(groups, answers), answers)
    return steps.select("group_key", F.col("rung").cast("long").alias("rung"), "attempt_key", "previous_key")


def climb_rounds(spark, d):
    """The look-ups that the climb by its frontier makes, each with its round; the answers of a round are asked for after the one before."""
    found = climb.rounds(_groups(spark, d), V.responses, store.keeper(spark))
    return found.select("term", "source_id", F.col("round").cast("long").alias("round"), (F.size("response.results") > 0).alias("decides"))


def trace_many(spark, d):
    """The stored chains of every entry whose number is divisible by 50, through the index."""
    entries = V.entries(spark, d)
    folder, (groups, answers) = store.shared_folder(spark), _stored(spark, d)
    rows = groups.agg(F.coalesce(F.sum("group_count"), F.lit(0))).first()[0]
    index.store(folder, entries, resolve.chains(resolve.final_attempts(groups, answers, _NOT_RESOLVED)), rows)
    n = index.buckets_for(rows)
    members, chains = (spark.read.parquet(f"{folder}/{x}-{n}") for x in (index.MEMBERS, index.CHAINS))
    asked = entries.select("uuid").filter(F.col("uuid").cast("long") % 50 == 0)
    return index.attempts_of_many(members, chains, asked, n).select("uuid", F.col("rung").cast("long").alias("rung"), "query_term", "source_id", "status")


_OUT = ("uuid", "source_dataset", "resolution_status", *RANKS, "resolution_path", "final_query_term", "final_query_rank", "final_data_source_id")


def resolve_output_rows(spark, d):
    return resolve.output_rows(V.entries(spark, d), _final(spark, d)).select(*_OUT)


def resolve_unsolved(spark, d):
    return resolve.split(resolve.output_rows(V.entries(spark, d), _final(spark, d)))[1].select(*_OUT)


def forced_output(spark, d):
    return resolve.forced_rows(V.entries(spark, d)).select("uuid", "resolution_status", "resolution_path", "resolution_error", "resolution_failure_reason", *RANKS)


def trace_one(spark, d):
    return trace_entry(V.entries(spark, d), lambda groups: resolve.chains(resolve.final_attempts(groups, _answers(groups))), "6")


def normalize_taxonomic_columns(spark, d):
    return C.normalize_ranks(V.entries(spark, d)).select("uuid", *RANKS)


def _taxa(spark, d):
    return accepted(V.taxa(spark, d))


def join_single_rank_species(spark, d):
    return C.join_single_rank(C.normalize_ranks(V.entries(spark, d)), _taxa(spark, d), "species").select("uuid", "taxonID_species")


def merge_taxon_id(spark, d):
    return C.merge_taxon_ids(V.entries(spark, d), _taxa(spark, d)).select("uuid", "taxonID_species", "taxonID_genus")


def _vernacular(spark, d):
    return C.prioritize_vernacular(V.vernacular(spark, d), F.col("doc_id"))


def prioritize_vernacular(spark, d):
    return _vernacular(spark, d)


def common_names_on(spark, d):
    return C.add_common_names(V.entries(spark, d), _taxa(spark, d), _vernacular(spark, d), True).select("uuid", "common_name", "common_name_rank", "species", "genus")


def common_names_off(spark, d):
    return C.add_common_names(V.entries(spark, d), _taxa(spark, d), _vernacular(spark, d), False).select("uuid", "common_name", "common_name_rank")


def local_matcher(spark, d):
    """No SQL counterpart: an approximation of an external program."""
    from ..sources.verifier import match_locally

    groups = _groups(spark, d)
    asked = ladder.lookups(groups)
    taxa = V.taxa(spark, d).withColumn("source_id", F.lit(11))
    return match_locally(asked, taxa).select("term", "source_id", "response.matchType", F.size("response.results").alias("n"))


def _with(ctes: str, body: str) -> str:
    return f"WITH {ctes}\n{body}"


_E, _GR = V.ENTRIES_SQL, V.GROUPS_SQL
_COALESCED = ", ".join(f"coalesce({q}, '') AS {q}" for q in _Q.values())
_TERM = "coalesce(" + ", ".join(f"CASE WHEN {V.VALID(c)} THEN {V.STRIP(c)} END" for c in V._ORDER) + ")"
_RANK = "coalesce(" + ", ".join(f"CASE WHEN {V.VALID(c)} THEN '{c.strip(chr(34))}' END" for c in V._ORDER) + ")"
_MISSING = [("scientific_name", "scientific_name"), ("common_name", "NULL"), *[(r, _Q[r]) for r in RANKS], ("source_id", "uuid")]
_PATHS = (
    f"{_E},\npaths AS (SELECT uuid, genus, coalesce(kingdom, 'X') AS c_kingdom, coalesce(phylum, 'Y') AS c_phylum, family AS f, genus AS g, kingdom, phylum, class, \"order\", family, species FROM entries)"
)
# concat_ws skips null parts, so that without family and genus the path ends early.
_C_FAMILY, _C_GENUS = "coalesce(f, g)", "CASE WHEN f IS NOT NULL THEN g END"
_EXPECT = {r: f"CASE WHEN {V.VALID(_Q[r])} THEN {V.STRIP(_Q[r])} END" for r in RANKS}
_FOUND = {"kingdom": "c_kingdom", "phylum": "c_phylum", "class": "NULL", "order": "NULL", "family": _C_FAMILY, "genus": _C_GENUS, "species": "NULL"}
_HAS = "(" + " OR ".join(f"{V.VALID(_Q[r])}" for r in RANKS) + ")"
_AGREE = lambda ranks: f"{_HAS} AND " + " AND ".join(f"(({_EXPECT[r]}) IS NULL OR ({_EXPECT[r]}) IS NOT DISTINCT FROM ({_FOUND[r]}))" for r in ranks)
_SUCCESS = ", ".join(f"'{s}'" for s in SUCCESSFUL)
_OUT_RANKS = ", ".join(f"CASE WHEN final_status IN ({_SUCCESS}) THEN coalesce(resolved[{i + 1}], '') ELSE coalesce(k.{_Q[r]}, '') END AS {_Q[r]}" for i, r in enumerate(RANKS))
_ROWS = (
    f"SELECT uuid, source_dataset, final_status AS resolution_status, {_OUT_RANKS}, CASE WHEN final_status = '{FORCED}' THEN 'FORCED' WHEN final_status IN ({_SUCCESS}) THEN 'RESOLVED' ELSE 'UNSOLVED' END AS resolution_path,"
    " query_term AS final_query_term, query_rank AS final_query_rank, source_id AS final_data_source_id FROM keyed k JOIN forced f USING (group_key)"
)
_NORMAL = ", ".join(f"CASE WHEN lower({_Q[r]}) NOT IN ({_INVALID}) THEN {_Q[r]} END AS {_Q[r]}" for r in RANKS)
_BASE = "SELECT p_name AS species, split_part(p_name, ' ', 1) AS genus, p_brand AS family, p_type AS \"order\", p_partkey FROM part WHERE p_partkey % 10 <> 9"
_TAXA = f"{_E},\nnormal AS (SELECT uuid, {_NORMAL} FROM entries),\nbase AS ({_BASE})"
_SPECIES = "sp AS (SELECT species, genus, family, \"order\", min(p_partkey * 3) AS id FROM base GROUP BY ALL)"
_GENUS = "ge AS (SELECT genus, family, \"order\", min(p_partkey * 3 + 1) AS id FROM base GROUP BY ALL)"
_TITLE = "array_to_string(list_transform(v, lambda x, i: CASE WHEN i = 1 OR NOT regexp_matches(v[i - 1], '[\\pL\\pN]') THEN replace(upper(x), 'ẞ', 'SS') ELSE x END), '')"
_NAMES = f"""names AS (
  SELECT id, {_TITLE} AS name FROM (
    SELECT doc_id % 400 AS id, string_split(lower(arg_min(text, (CASE WHEN lang = 'en' THEN 0 ELSE 1 END) * 1000000000 + doc_id)), '') AS v FROM documents WHERE lang IS NOT NULL GROUP BY 1))"""
_IDS = f"""{_TAXA},
s1 AS (SELECT species, min(p_partkey * 3) AS id FROM base GROUP BY 1), g1 AS (SELECT genus, min(p_partkey * 3 + 1) AS id FROM base GROUP BY 1), f1 AS (SELECT family, min(p_partkey * 3 + 2) AS id FROM base GROUP BY 1),
{_NAMES},
j AS (SELECT n.*, s1.id AS sid, g1.id AS gid, f1.id AS fid FROM normal n LEFT JOIN s1 ON n.species = s1.species LEFT JOIN g1 ON n.genus = g1.genus LEFT JOIN f1 ON n.family = f1.family),
k AS (SELECT j.*, a.name AS sn, b.name AS gn, c.name AS fn FROM j LEFT JOIN names a ON sid = a.id LEFT JOIN names b ON gid = b.id LEFT JOIN names c ON fid = c.id)"""
_FINE = ", ".join(f"CASE WHEN {_Q[r]} IS NOT NULL THEN '{r}' END" for r in reversed(RANKS))

SQL = {
    "scan_normalize": _with(_E, f"SELECT uuid, source_dataset, {_COALESCED} FROM entries"),
    "invalid_filter": _with(_E, "SELECT source_dataset, count(*) FILTER (" + " OR ".join(f"lower(coalesce({q}, '')) NOT IN ({_INVALID})" for q in _Q.values()) + ") AS with_data, count(*) AS entries FROM entries GROUP BY 1"),
    "source_extract": _with(_E, "SELECT uuid, CASE WHEN uuid::BIGINT % 3 = 0 OR uuid::BIGINT % 2 = 1 THEN CASE WHEN uuid::BIGINT % 3 <> 0 OR TRUE THEN source_dataset END ELSE 'x' END AS source FROM entries"),
    "most_specific_term": _with(_E, f"SELECT uuid, {_RANK} AS most_specific_rank, {_TERM} AS most_specific_term FROM entries"),
    "term_rank_pairs": _with(V.LADDER_SQL, "SELECT group_key, rung // 3 AS pair, query_term AS term, query_rank AS rank FROM rungs WHERE rung % 3 = 0 AND query_term <> ''"),
    "group_key_sha256": _with(_E, "SELECT uuid, group_key FROM keyed"),
    "group_entries": _with(_GR, "SELECT * FROM groups"),
    "dataset_statistics": _with(_E, "SELECT count(*) AS entry_count, count(DISTINCT group_key) AS group_count, " + ", ".join(f"count(*) FILTER (coalesce({x}, '') = '') AS missing_{c}, round(100.0::DOUBLE * count(*) FILTER (coalesce({x}, '') = '') / count(*), 1) AS missing_{c}_percent" for c, x in _MISSING) + " FROM keyed"),
    "dataset_stats_by_source": _with(_E, "SELECT source_dataset, count(*) AS entries FROM entries GROUP BY 1"),
    "canonical_kingdom": _with(_E, f"SELECT uuid, CASE WHEN NOT {V.VALID('kingdom')} THEN NULL WHEN lower({V.STRIP('kingdom')}) = 'metazoa' THEN 'Animalia' ELSE {V.STRIP('kingdom')} END AS kingdom FROM entries"),
    "plan_initial": _with(_GR, f"SELECT group_key, coalesce({_TERM}, '') AS query_term, {_RANK} AS query_rank, 11 AS source_id FROM groups"),
    "retry_ladder": _with(V.LADDER_SQL, "SELECT group_key, rung, query_term, query_rank, source_id, rung > 0 AS is_retry FROM rungs"),
    "extract_classification": _with(_PATHS, "SELECT uuid, " + ", ".join(f"{_FOUND[r]} AS c_{r}" for r in RANKS) + " FROM paths"),
    "compare_paths": _with(_PATHS, f"SELECT uuid, {_AGREE(RANKS[:2])} AS to_phylum, {_AGREE(RANKS)} AS whole FROM paths"),
    "filter_by_rank": _with(_PATHS, f"SELECT uuid, {_C_FAMILY} AS family, NULL::VARCHAR AS genus FROM paths"),
    "rank_of_term": _with(_PATHS, f"SELECT uuid, CASE WHEN ({_C_GENUS}) = genus THEN 'genus' WHEN ({_C_FAMILY}) = genus THEN 'family' END AS rank, CASE WHEN ({_C_GENUS}) IS NOT NULL THEN 'genus' WHEN ({_C_FAMILY}) IS NOT NULL THEN 'family' ELSE 'phylum' END AS deepest FROM paths"),
    "resolve_attempts": _with(V.ATTEMPTS_SQL, "SELECT group_key, rung, status FROM tried"),
    "first_terminal_rung": _with(V.FINAL_SQL, "SELECT group_key, rung, query_term, source_id, first_status AS status FROM final"),
    "resolve_final": _with(V.RESOLVED_SQL, "SELECT group_key, final_status AS status, " + ", ".join(f"coalesce(resolved[{i + 1}], '') AS {_Q[r]}" for i, r in enumerate(RANKS)) + " FROM forced"),
    "force_failed_to_input": _with(V.RESOLVED_SQL, "SELECT group_key, first_status AS original_status, 'ForceFailedToInput' AS strategy FROM forced WHERE final_status = 'FAILED_FORCED_INPUT'"),
    "resolution_stats": _with(V.RESOLVED_SQL, "SELECT count(*) AS total_entry_groups_processed, sum(rung + 1)::BIGINT AS total_attempts_created, count(*) FILTER (rung > 0) AS entry_groups_with_retries, " + ", ".join(f"count(*) FILTER (final_status = '{s}') AS final_status_{s.lower()}" for s in STATUSES) + " FROM forced"),
    "successful_attempts": _with(V.RESOLVED_SQL, f"SELECT final_status AS status, count(*) AS groups FROM forced WHERE final_status IN ({_SUCCESS}) GROUP BY 1"),
    "attempts_chain": _with(V.FINAL_SQL, "SELECT group_key, rung, query_term, source_id, first_status AS status FROM climbed"),
    "attempt_keys": _with(V.KEYS_SQL, "SELECT group_key, rung, attempt_key, lag(attempt_key) OVER (PARTITION BY group_key ORDER BY rung) AS previous_key FROM keys"),
    "climb_rounds": _with(V.FINAL_SQL, "SELECT query_term AS term, source_id, min(rung) AS round, bool_and(status <> 'RETRY_SCHEDULED') AS decides FROM climbed WHERE query_term <> '' GROUP BY 1, 2"),
    "trace_many": _with(V.FINAL_SQL, "SELECT uuid, rung, query_term, source_id, first_status AS status FROM keyed JOIN climbed USING (group_key) WHERE uuid::BIGINT % 50 = 0"),
    "resolve_output_rows": _with(V.RESOLVED_SQL, _ROWS),
    "resolve_unsolved": _with(V.RESOLVED_SQL, f"{_ROWS} WHERE final_status NOT IN ({_SUCCESS})"),
    "forced_output": _with(_E, f"SELECT uuid, '{FORCED}' AS resolution_status, 'FORCED' AS resolution_path, 'Entry not mapped to any resolution attempt' AS resolution_error, 'Processing error or missing attempt' AS resolution_failure_reason, " + ", ".join(f"coalesce({_Q[r]}, '') AS {_Q[r]}" for r in RANKS) + " FROM entries"),
    "normalize_taxonomic_columns": _with(_TAXA, "SELECT * FROM normal"),
    "join_single_rank_species": _with(f"{_TAXA},\n{_SPECIES}", 'SELECT uuid, sp.id::VARCHAR AS "taxonID_species" FROM normal n LEFT JOIN sp ON n.species = sp.species AND n.genus = sp.genus AND n.family = sp.family AND n."order" = sp."order"'),
    "merge_taxon_id": _with(f"{_TAXA},\n{_SPECIES},\n{_GENUS}", 'SELECT uuid, sp.id::VARCHAR AS "taxonID_species", ge.id::VARCHAR AS "taxonID_genus" FROM normal n LEFT JOIN sp ON n.species = sp.species AND n.genus = sp.genus AND n.family = sp.family AND n."order" = sp."order" LEFT JOIN ge ON n.genus = ge.genus AND n.family = ge.family AND n."order" = ge."order"'),
    "prioritize_vernacular": _with(_NAMES, 'SELECT id::VARCHAR AS "taxonID", name AS "vernacularName" FROM names'),
    "common_names_on": _with(_IDS, "SELECT uuid, coalesce(sn, gn, fn) AS common_name, CASE WHEN sn IS NOT NULL THEN 'species' WHEN gn IS NOT NULL THEN 'genus' WHEN fn IS NOT NULL THEN 'family' END AS common_name_rank, species, genus FROM k"),
    "common_names_off": _with(_IDS, f"SELECT uuid, CASE coalesce({_FINE}) WHEN 'species' THEN sn WHEN 'genus' THEN gn WHEN 'family' THEN fn END AS common_name, CASE WHEN (CASE coalesce({_FINE}) WHEN 'species' THEN sn WHEN 'genus' THEN gn WHEN 'family' THEN fn END) IS NOT NULL THEN coalesce({_FINE}) END AS common_name_rank FROM k"),
}


def queries():
    functions = [globals()[name] for name in SQL] + [trace_one, local_matcher]
    return {f.__name__: f for f in functions}

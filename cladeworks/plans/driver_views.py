"""Taxonomic inputs as deterministic views over the star-schema tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import RESPONSE

#: Entries with few names: one in 97 has none, others have a kingdom and a phylum of one name, a phylum, a genus, or a kingdom and a phylum.
_NONE, _TWINS, _PHYLUM, _GENUS, _TWO = (f"k % {n} = 0" for n in (97, 73, 79, 83, 89))
#: Names of sparse entries end in 0 to 15 letters more, so that their look-ups get answers of every kind.
_LONGER = lambda c: f"concat({c}, repeat('x', CAST(k % 16 AS INT)))"
_SPARSE = " OR ".join((_NONE, _TWINS, _PHYLUM, _GENUS, _TWO))
#: Shared by both engines: columns over k (row key), r_name, n_name, p_size, p_type, p_brand, p_name.
ENTRY_COLUMNS = f"""
  CASE WHEN {_NONE} THEN NULL WHEN {_TWINS} THEN {_LONGER('n_name')} WHEN {_PHYLUM} OR {_GENUS} THEN NULL WHEN {_TWO} THEN r_name WHEN k % 11 = 0 THEN NULL WHEN k % 13 = 0 THEN 'Metazoa' WHEN k % 17 = 0 THEN 'unknown' ELSE r_name END AS kingdom,
  CASE WHEN {_NONE} THEN NULL WHEN {_TWINS} OR {_PHYLUM} THEN {_LONGER('n_name')} WHEN {_GENUS} THEN NULL WHEN {_TWO} THEN {_LONGER('n_name')} WHEN k % 7 = 0 THEN NULL ELSE n_name END AS phylum,
  CASE WHEN {_NONE} THEN '' WHEN {_SPARSE} THEN NULL ELSE concat('C', CAST(p_size % 5 AS VARCHAR(5))) END AS class,
  CASE WHEN {_SPARSE} THEN NULL WHEN k % 19 = 0 THEN 'N/A' ELSE p_type END AS "order",
  CASE WHEN {_SPARSE} THEN NULL ELSE p_brand END AS family,
  CASE WHEN {_NONE} OR {_TWINS} OR {_PHYLUM} THEN NULL WHEN {_GENUS} THEN {_LONGER("split_part(p_name, ' ', 1)")} WHEN {_TWO} THEN NULL WHEN k % 5 = 0 THEN upper(split_part(p_name, ' ', 1)) ELSE split_part(p_name, ' ', 1) END AS genus,
  CASE WHEN {_SPARSE} OR k % 3 = 0 THEN NULL WHEN k % 29 = 0 THEN concat('  ', p_name, ' ') ELSE p_name END AS species,
  CASE WHEN {_SPARSE} OR k % 2 = 1 THEN NULL ELSE p_name END AS scientific_name
"""
#: Which kind of answer a term gets at a source.
KIND = "(length(term) + ascii(term) + source_id) % 16"


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _entry_columns(rows: DataFrame) -> DataFrame:
    text = ENTRY_COLUMNS.replace('"order"', "`order`")
    return rows.selectExpr("uuid", "source_dataset", *[c.strip() for c in text.strip().split(",\n")])


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One entry per order."""
    part = _read(spark, sf_dir, "part")
    n = part.count()
    nation = _read(spark, sf_dir, "nation").join(F.broadcast(_read(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = (
        _read(spark, sf_dir, "orders").join(_read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")).join(part, F.col("p_partkey") == F.col("o_orderkey") % n)
    )
    return _entry_columns(rows.withColumns({"k": F.col("o_orderkey"), "uuid": F.col("o_orderkey").cast("string"), "source_dataset": F.col("o_orderpriority")}))


def many_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One entry per line item; identifiers are built from five columns."""
    supplier = _read(spark, sf_dir, "supplier").join(F.broadcast(_read(spark, sf_dir, "nation")), F.col("s_nationkey") == F.col("n_nationkey")).join(F.broadcast(_read(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = _read(spark, sf_dir, "lineitem").join(_read(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    key = F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")], F.date_format("l_shipdate", "yyyyMMdd"))
    return _entry_columns(rows.withColumns({"k": F.col("l_orderkey") * 8 + F.col("l_linenumber"), "uuid": key, "source_dataset": F.col("l_returnflag")}))


def _made(x: str) -> str:
    """A path of made-up names with a mark, down to the term."""
    return f"concat('K:{x}|P:{x}|C:{x}|O:{x}|F:{x}|G:{x}|', term)"


#: kind: (match type, arguments of the results after the source).
KINDS = {
    1: ("Exact", [{"canonical": "term", "status": "Accepted", "how": "Exact", "path": "concat('K|P|C|O|F|G|S:', term)"}]),
    2: ("Exact", [{"canonical": "term", "status": "Synonym", "how": "Exact", "path": _made("s")}, {"canonical": "term", "status": "Accepted", "how": "Exact", "path": _made("a"), "record": "r2"}]),
    3: ("Exact", [{"canonical": "term", "status": "Accepted", "how": "Exact", "path": "term"}, {"canonical": "term", "status": "Accepted", "how": "Exact", "path": "concat(term, '|', term)", "record": "r2"}]),
    4: ("Fuzzy", [{"canonical": "concat(term, 'x')", "status": "Accepted", "how": "Fuzzy", "path": _made("f")}]),
    5: ("PartialExact", [{"canonical": "concat(term, 'x')", "status": "Accepted", "how": "PartialExact", "path": _made("p")}]),
    6: ("Exact", [{"canonical": "term", "status": "Synonym", "how": "Exact", "path": _made("y")}]),
    7: ("Exact", [{"canonical": "'a'", "status": "Accepted", "how": "Exact", "path": _made("t")}, {"canonical": "'b'", "status": "Accepted", "how": "Exact", "path": _made("t"), "record": "r2"}]),
    8: ("Virus", [{"canonical": "term", "status": "Accepted", "how": "Virus", "path": _made("v")}]),
    9: ("Exact", [{"canonical": "term", "status": "Accepted", "how": "Exact", "path": "concat_ws('|', " + ", ".join(["term"] * 7) + ")"}]),
    10: ("Exact", [{"canonical": "term", "status": "Accepted", "how": "Exact", "path": _made("u")}, {"canonical": "term", "status": "Accepted", "how": "Exact", "path": _made("w"), "record": "r2", "name": "term"}]),
    11: ("Exact", [{"canonical": "'z'", "status": "Accepted", "how": "Exact", "path": _made("m")}, {"canonical": "'z'", "status": "Accepted", "how": "Exact", "path": _made("m"), "record": "r2"}]),
    12: ("Exact", [{"canonical": "'a'", "status": "Accepted", "how": "Exact", "path": "concat('Animalia|P:h|', term)"}, {"canonical": "'b'", "status": "Accepted", "how": "Exact", "path": "concat('AFRICA|P:g|', term)", "record": "r2"}]),
    13: ("PartialExact", [{"canonical": "term", "status": "Accepted", "how": "PartialExact", "path": "concat('|', term)"}]),
    14: ("Exact", [{"canonical": "term", "status": "Synonym", "how": "Exact", "path": _made("1"), "score": "0.1"}, {"canonical": "term", "status": "Synonym", "how": "Exact", "path": _made("2"), "score": "0.7"}]),
    15: ("Exact", [{"canonical": "term", "status": "Synonym", "how": None, "path": _made("q")}, {"canonical": "term", "status": "Accepted", "how": "Exact", "path": "term", "record": "r2"}]),
}
_PATH_RANKS = "kingdom|phylum|class|order|family|genus|species"


def _result(canonical: str, status: str, how: str | None, path: str, score: str = "0.0", record: str = "r1", name: str = "concat(term, ' L.')") -> str:
    kind = f"'{how}'" if how else "cast(null as string)"
    return (
        f"named_struct('dataSourceId', source_id, 'dataSourceTitleShort', 'S', 'recordId', '{record}', 'matchedName', {name}, 'matchedCanonicalSimple', {canonical}, 'currentRecordId', 'c1', 'currentName', 'now',"
        f" 'taxonomicStatus', '{status}', 'isSynonym', {'true' if status == 'Synonym' else 'false'}, 'classificationPath', {path}, 'classificationRanks', '{_PATH_RANKS}', 'editDistance', 1, 'matchType', {kind},"
        f" 'scoreDetails', named_struct('infraSpecificRankScore', cast({score} as double), 'parsingQualityScore', cast(1 as double)))"
    )


def _result_json(canonical: str, status: str, how: str | None, path: str, score: str = "0.0", record: str = "r1", name: str = "concat(term, ' L.')") -> str:
    """The canonical JSON of ``_result`` as an SQL string; the given names need no escapes."""
    shown = f'"{how}"' if how else "null"
    return (
        f"""'{{"classificationPath": "' || {path} || '", "classificationRanks": "{_PATH_RANKS}", "currentName": "now", "currentRecordId": "c1", "dataSourceId": ' || source_id || ', "dataSourceTitleShort": "S", "editDistance": 1,"""
        f""" "isSynonym": {'true' if status == 'Synonym' else 'false'}, "matchType": {shown}, "matchedCanonicalSimple": "' || {canonical} || '", "matchedName": "' || {name} || '", "recordId": "{record}","""
        f""" "scoreDetails": {{"infraSpecificRankScore": {score}, "parsingQualityScore": 1.0}}, "taxonomicStatus": "{status}"}}'"""
    )


def responses(lookups: DataFrame) -> DataFrame:
    """An answer of one of sixteen kinds for each ``(term, source_id)``; between them, and with the entries, every rule occurs that can: 1 to 5, 7, 8, 10, 12 to 20, 21, 22 as a break, 23 and 25."""
    cases = " ".join(f"when {k} then named_struct('name', term, 'matchType', '{m}', 'results', array({', '.join(_result(**r) for r in rs)}))" for k, (m, rs) in KINDS.items())
    none = "named_struct('name', term, 'matchType', 'NoMatch', 'results', filter(array(" + _result("term", "Accepted", "Exact", "''") + "), x -> false))"
    return lookups.withColumn("response", F.expr(f"case {KIND} {cases} else {none} end").cast(RESPONSE))


def taxa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A backbone of part names: species, genera and families with identifiers and status."""
    p = _read(spark, sf_dir, "part")
    base = p.selectExpr("p_name as species", "split_part(p_name, ' ', 1) as genus", "p_brand as family", "p_type as `order`", "p_partkey")
    level = lambda rank, k: base.selectExpr(f"cast(p_partkey * 3 + {k} as string) as taxonID", f"{rank} as canonicalName", f"'{rank}' as taxonRank", "case when p_partkey % 10 = 9 then 'doubtful' else 'accepted' end as taxonomicStatus", "`order`", "family", "genus")
    return level("species", 0).union(level("genus", 1)).union(level("family", 2))


def vernacular(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of taxa from the whole texts of documents."""
    return _read(spark, sf_dir, "documents").selectExpr("cast(doc_id % 400 as string) as taxonID", "text as vernacularName", "lang as language", "doc_id")


_V = "('unknown', 'null', 'none', '', 'n/a')"
#: The given names have no white space at their ends but blanks.
STRIP = lambda c: f"trim({c})"
VALID = lambda c: f"(lower({STRIP(f'coalesce({c}, {chr(39) * 2})')}) NOT IN {_V})"
_ORDER = ("species", "scientific_name", "genus", "family", '"order"', "class", "phylum", "kingdom")
_NORM = " || '|' || ".join(f"lower({STRIP(f'coalesce({c}, {chr(39) * 2})')})" for c in _ORDER)
NAMES = ("scientific_name", "kingdom", "phylum", "class", '"order"', "family", "genus", "species")

ENTRIES_SQL = f"""
entries AS (
  SELECT uuid, source_dataset, {ENTRY_COLUMNS}
  FROM (SELECT o_orderkey AS k, CAST(o_orderkey AS VARCHAR) AS uuid, o_orderpriority AS source_dataset, r_name, n_name, p_size, p_type, p_brand, p_name
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
        JOIN part ON p_partkey = o_orderkey % (SELECT count(*) FROM part))),
keyed AS (SELECT *, sha256({_NORM}) AS group_key FROM entries)"""
GROUPS_SQL = f"""{ENTRIES_SQL},
groups AS (
  SELECT group_key, count(*) AS group_count, {', '.join(f"arg_min(coalesce({c}, ''), uuid) AS {c}" for c in NAMES)}
  FROM keyed GROUP BY group_key)"""
_TERMS = "[" + ", ".join(f"CASE WHEN {VALID(c)} THEN {STRIP(c)} END" for c in _ORDER) + "]"
_RANKS = "[" + ", ".join(f"'{c.strip(chr(34))}'" for c in _ORDER) + "]"
LADDER_SQL = f"""{GROUPS_SQL},
asked AS (SELECT *, {_TERMS} AS terms FROM groups),
places AS (SELECT a.* EXCLUDE (terms), p AS place, terms[p] AS query_term, {_RANKS}[p] AS query_rank FROM asked a, range(1, 9) r(p) WHERE terms[p] IS NOT NULL),
pairs AS (SELECT * FROM places QUALIFY row_number() OVER (PARTITION BY group_key, query_term ORDER BY place) = 1),
numbered AS (SELECT * EXCLUDE (place), row_number() OVER (PARTITION BY group_key ORDER BY place) AS pair FROM pairs),
rungs AS MATERIALIZED (
  SELECT n.* EXCLUDE (query_term, query_rank, pair), CAST(3 * (pair - 1) + j - 1 AS INTEGER) AS rung, query_term, query_rank, [11, 1, 179][j] AS source_id FROM numbered n, range(1, 4) b(j)
  UNION ALL
  SELECT * EXCLUDE (terms), 0, '', NULL, 11 FROM asked WHERE len(list_filter(terms, lambda x: x IS NOT NULL)) = 0)"""
_ABOVE = " OR ".join(f"({VALID(c)} AND i > {k})" for k, c in enumerate(("kingdom", "phylum", "class", '"order"', "family", "genus", "species")))
_RANK_NAMES = ("kingdom", "phylum", "class", '"order"', "family", "genus", "species")
#: Whether a valid rank above the one asked for has another name than the term.
_OTHER_ABOVE = " OR ".join(f"({VALID(c)} AND i > {k} AND {STRIP(c)} <> query_term)" for k, c in enumerate(_RANK_NAMES))
#: Whether every valid rank is the term, and some rank is.
_ALL_TERM = "(" + " OR ".join(VALID(c) for c in _RANK_NAMES) + ") AND " + " AND ".join(f"(NOT {VALID(c)} OR {STRIP(c)} = query_term)" for c in _RANK_NAMES)
#: Whether the term is kingdom and phylum and no finer rank is valid.
_TWINS_ONLY = f"{VALID('kingdom')} AND {VALID('phylum')} AND {STRIP('kingdom')} = query_term AND {STRIP('phylum')} = query_term AND NOT (" + " OR ".join(VALID(c) for c in _RANK_NAMES[2:]) + ")"
_RAW_DATA = " AND ".join(f"coalesce({c}, '') IN {_V}" for c in NAMES)
ATTEMPTS_SQL = f"""{LADDER_SQL},
kinds AS (
  SELECT *, CASE WHEN query_term = '' THEN -1 ELSE {KIND.replace('term', 'query_term')} END AS kind,
    CASE query_rank WHEN 'kingdom' THEN 0 WHEN 'phylum' THEN 1 WHEN 'class' THEN 2 WHEN 'order' THEN 3 WHEN 'family' THEN 4 WHEN 'genus' THEN 5 WHEN 'species' THEN 6 END AS i
  FROM rungs),
tried AS MATERIALIZED (
  SELECT *, CASE
    WHEN {_RAW_DATA} THEN 'EMPTY_INPUT_TAXONOMY'
    WHEN kind = -1 THEN 'FAILED'
    WHEN kind = 0 THEN 'RETRY_SCHEDULED'
    WHEN kind = 9 AND source_id = 1 AND i IS NOT NULL AND NOT ({_OTHER_ABOVE}) THEN 'EXACT_MATCH_SECONDARY_SOURCE_ACCEPTED_PRUNED'
    WHEN source_id <> 11 THEN 'FORCE_ACCEPTED'
    WHEN kind = 9 AND rung < 3 AND {_ALL_TERM} THEN 'EXACT_MATCH_PRIMARY_SOURCE_ACCEPTED'
    WHEN kind IN (1, 9) THEN 'EXACT_MATCH_PRIMARY_SOURCE_ACCEPTED_SIMPLE'
    WHEN kind = 2 THEN 'EXACT_MATCH_PRIMARY_SOURCE_ACCEPTED_AMONG_SYNONYMS_SIMPLE'
    WHEN kind = 14 THEN 'MULTI_EXACT_MATCH_PRIMARY_SOURCE_SYNONYMS_INFRASPECIFIC_SCORE'
    WHEN kind = 4 AND i > 0 AND NOT ({_ABOVE}) THEN 'FUZZY_MATCH_PRIMARY_SOURCE_ACCEPTED'
    WHEN kind = 4 THEN 'SINGLE_FUZZY_MATCH_PRIMARY_SOURCE_ACCEPTED_SIMPLE'
    WHEN kind = 13 AND NOT {VALID('kingdom')} AND starts_with({STRIP("coalesce(phylum, '')")}, query_term) THEN 'PARTIAL_EXACT_MATCH_PRIMARY_SOURCE_ACCEPTED_DISAMBIGUATED'
    WHEN kind IN (5, 13) THEN 'PARTIAL_EXACT_MATCH_PRIMARY_SOURCE_SIMPLE'
    WHEN kind = 6 THEN 'EXACT_MATCH_PRIMARY_SOURCE_SYNONYM_SIMPLE'
    WHEN kind = 10 THEN 'EXACT_MATCH_PRIMARY_SOURCE_ACCEPTED_AUTHOR_DISAMBIGUATION'
    WHEN kind = 11 THEN 'EXACT_MATCH_PRIMARY_SOURCE_MULT_ACCEPTED'
    WHEN kind = 12 AND {STRIP("coalesce(kingdom, '')")} IN ('Metazoa', 'AFRICA') THEN 'MULTI_EXACT_MATCH_PRIMARY_SOURCE_ACCEPTED_HOMONYM'
    WHEN kind = 3 AND {_TWINS_ONLY} THEN 'EXACT_MATCH_PRIMARY_SOURCE_ACCEPTED_INNER_RANK_DISAMBIGUATION'
    WHEN kind = 3 AND i = 0 THEN 'EXACT_MATCH_PRIMARY_SOURCE_ACCEPTED_RANK_LEVEL_DISAMBIGUATION'
    WHEN (kind = 3 AND i = 1 AND NOT {VALID('kingdom')}) OR (kind = 15 AND i = 0) THEN 'EXACT_MATCH_PRIMARY_SOURCE_ACCEPTED_MULTI_RESULT_DISAMBIGUATION'
    WHEN kind = 3 AND i = 1 THEN 'EXACT_MATCH_PRIMARY_SOURCE_MULTI_ACCEPTED_TAXONOMIC_MATCH'
    WHEN kind IN (3, 7, 12) AND ({' OR '.join(VALID(c) for c in NAMES[1:])}) THEN 'FAILED'
    ELSE 'FORCE_ACCEPTED' END AS status
  FROM kinds)"""
FINAL_SQL = f"""{ATTEMPTS_SQL},
ended AS (
  SELECT *, coalesce(min(rung) FILTER (status <> 'RETRY_SCHEDULED') OVER g, max(rung) OVER g) AS last_rung FROM tried WINDOW g AS (PARTITION BY group_key)),
climbed AS MATERIALIZED (
  SELECT *, CASE WHEN rung = last_rung AND status = 'RETRY_SCHEDULED' THEN 'NO_MATCH_RETRIES_EXHAUSTED' ELSE status END AS first_status FROM ended WHERE rung <= last_rung),
final AS (SELECT * FROM climbed WHERE rung = last_rung)"""
#: The lineage of what a kind's rule picks; in letters the mark of its made-up names.
_PICK = {
    1: "['K','P','C','O','F','G','S:' || query_term]", 2: "a", 3: "CASE i WHEN 0 THEN [query_term] ELSE [query_term, query_term] END", 4: "f", 5: "p", 6: "y",
    9: "[" + ", ".join(["query_term"] * 7) + "]", 10: "w", 11: "m", 12: "CASE kingdom WHEN 'AFRICA' THEN ['AFRICA', 'P:g', query_term] ELSE ['Animalia', 'P:h', query_term] END", 13: "['', query_term]", 14: "2", 15: "[query_term]",
}
_PATHS = " ".join(f"WHEN {k} THEN " + (v if len(v) > 1 else "[" + ", ".join(f"'{r}:{v}'" for r in "KPCOFG") + ", query_term]") for k, v in _PICK.items())
RESOLVED_SQL = f"""{FINAL_SQL},
forced AS (
  SELECT *, CASE WHEN first_status IN ('FAILED', 'NO_MATCH_RETRIES_EXHAUSTED') THEN 'FAILED_FORCED_INPUT' ELSE first_status END AS final_status,
    CASE WHEN first_status = 'EMPTY_INPUT_TAXONOMY' THEN NULL
      WHEN first_status IN ('FAILED', 'NO_MATCH_RETRIES_EXHAUSTED', 'FORCE_ACCEPTED') THEN [kingdom, phylum, class, "order", family, genus, species]
      ELSE CASE kind {_PATHS} END END AS resolved
  FROM final)"""
_JSON = " ".join(f"""WHEN {k} THEN '{{"matchType": "{m}", "name": "' || term || '", "results": [' || {" || ', ' || ".join(_result_json(**r) for r in rs)} || ']}}'""" for k, (m, rs) in KINDS.items())
KEYS_SQL = f"""{FINAL_SQL},
said AS (
  SELECT group_key, rung, query_rank, term, source_id, CASE WHEN term = '' THEN '' ELSE CASE kind {_JSON} ELSE '{{"matchType": "NoMatch", "name": "' || term || '", "results": []}}' END END AS answer
  FROM (SELECT *, query_term AS term FROM climbed)),
keys AS (SELECT group_key, rung, sha256(group_key || '|' || term || '|' || coalesce(query_rank, '') || '|' || source_id || '|' || answer) AS attempt_key FROM said)"""

"""Fixed values of the domain; they must not change."""

RANKS = ("kingdom", "phylum", "class", "order", "family", "genus", "species")
QUERY_ORDER = ("species", "scientific_name", "genus", "family", "order", "class", "phylum", "kingdom")
#: Data sources in order of preference.
SOURCES = (11, 1, 179)
PRIMARY, SECONDARY = SOURCES[0], SOURCES[1]
#: The characters with Unicode's property White_Space.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
INVALID = ("unknown", "null", "none", "", "n/a")
#: Lower-cased kingdom names and synonyms to the canonical name.
KINGDOMS = {
    "animalia": "Animalia", "metazoa": "Animalia",
    "plantae": "Plantae", "viridiplantae": "Plantae", "archaeplastida": "Plantae",
    "fungi": "Fungi", "protista": "Protista", "chromista": "Chromista", "archaea": "Archaea", "bacteria": "Bacteria",
}
FORCED_INPUT = "FAILED_FORCED_INPUT"
FORCED = "FORCE_ACCEPTED"
EMPTY = "EMPTY_INPUT_TAXONOMY"
FAILED = "FAILED"
RETRY = "RETRY_SCHEDULED"
EXHAUSTED = "NO_MATCH_RETRIES_EXHAUSTED"
#: Statuses that count as successful.
SUCCESSFUL = (
    "EXACT_MATCH_PRIMARY_SOURCE_ACCEPTED", "EXACT_MATCH_PRIMARY_SOURCE_ACCEPTED_SIMPLE",
    "EXACT_MATCH_PRIMARY_SOURCE_ACCEPTED_AMONG_SYNONYMS_SIMPLE", "EXACT_MATCH_PRIMARY_SOURCE_ACCEPTED_AUTHOR_DISAMBIGUATION",
    "EXACT_MATCH_PRIMARY_SOURCE_ACCEPTED_RETRY", "EXACT_MATCH_PRIMARY_SOURCE_ACCEPTED_INNER_RANK_DISAMBIGUATION",
    "EXACT_MATCH_PRIMARY_SOURCE_ACCEPTED_RANK_LEVEL_DISAMBIGUATION", "EXACT_MATCH_PRIMARY_SOURCE_ACCEPTED_SYNONYM_DISAMBIGUATION",
    "EXACT_MATCH_PRIMARY_SOURCE_ACCEPTED_MULTI_RESULT_DISAMBIGUATION", "EXACT_MATCH_PRIMARY_SOURCE_ACCEPTED_RESULT_WITHIN_QUERY",
    "FUZZY_MATCH_PRIMARY_SOURCE_ACCEPTED", "EXACT_MATCH_PRIMARY_SOURCE_MULT_ACCEPTED", "PARTIAL_EXACT_MATCH_PRIMARY_SOURCE_SIMPLE",
    "SINGLE_FUZZY_MATCH_PRIMARY_SOURCE_ACCEPTED_SIMPLE", "MULTI_EXACT_MATCH_PRIMARY_SOURCE_SYNONYMS_INFRASPECIFIC_SCORE",
    "MULTI_EXACT_MATCH_PRIMARY_SOURCE_ACCEPTED_HOMONYM", "EXACT_MATCH_PRIMARY_SOURCE_SYNONYM_SIMPLE",
    "PARTIAL_EXACT_MATCH_PRIMARY_SOURCE_ACCEPTED_DISAMBIGUATED", "EXACT_MATCH_SECONDARY_SOURCE_ACCEPTED_PRUNED",
    "EXACT_MATCH_PRIMARY_SOURCE_MULTI_ACCEPTED_TAXONOMIC_MATCH", FORCED, FORCED_INPUT,
)
UNSUCCESSFUL = (EMPTY, FAILED, EXHAUSTED, "NO_MATCH_NONEMPTY_QUERY", "PROCESSING", "MULTIPLE_EXACT_MATCHES", RETRY)
STATUSES = SUCCESSFUL + UNSUCCESSFUL
STATS_FILE = "resolution_stats.json"
MANIFESTS = {"resolve": "cladeworks_resolve_manifest.json", "common-names": "cladeworks_common_names_manifest.json"}

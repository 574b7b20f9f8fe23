"""The cascade of resolution rules as column expressions.

Each rule says when it applies, which result of the answer it picks, and how
the lineage is cut; the first rule that applies decides.  The expressions are
staged: answers are parsed once, however many groups ask for them, results are
compared with a group's lineage once, then one CASE finds the rule and a second one builds the outcome.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import EMPTY, FAILED, FORCED, INVALID, PRIMARY, RANKS, RETRY, SECONDARY
from ..functions import lineages as L
from ..functions.names import lineage, most_specific_term, strip, valid


@dataclass(frozen=True)
class Rule:
    """``empty`` says what an empty lineage of the pick does: accept it, fail, or break off."""

    number: int
    strategy: str
    status: str
    when: str
    pick: str = "rs[0]"
    upto: str | None = None
    empty: str = "accept"
    metadata: dict[str, str] = field(default_factory=dict)
    reason: str | None = None


_BOTH_EXACT = f"forall(rs, r -> r.matchType <=> 'Exact' and r.dataSourceId <=> {PRIMARY}) and rs[0].matchedCanonicalSimple <> '' and rs[0].matchedCanonicalSimple = rs[1].matchedCanonicalSimple and rs[0].matchedCanonicalSimple = term"
_SAME_CANONICAL = "forall(acc, j -> rs[j].matchedCanonicalSimple <=> rs[acc[0]].matchedCanonicalSimple)"
_SEVERAL = "n >= 2 and M = 'Exact' and size(acc) >= 2"
#: Whether the input agrees with a result down to a rank; ``conflicts`` holds where each result first differs from it.
_AGREES = lambda j, upto: f"some_E and conflicts[{j}] > {upto}"

RULES = (
    Rule(1, "EmptyInputTaxonomy", EMPTY, "no_data", "null", reason="Query originated from input group with no usable taxonomic data."),
    Rule(2, "ExactMatchPrimarySourceAccepted", "EXACT_MATCH_PRIMARY_SOURCE_ACCEPTED", f"one and {_AGREES(0, 6)} and query_term = top_term"),
    Rule(3, "ExactMatchPrimarySourceAcceptedSimple", "EXACT_MATCH_PRIMARY_SOURCE_ACCEPTED_SIMPLE", "one", empty="fail", metadata={"matched_current_name": "p.currentName"}),
    Rule(4, "ExactMatchPrimarySourceAcceptedAmongSynonymsSimple", "EXACT_MATCH_PRIMARY_SOURCE_ACCEPTED_AMONG_SYNONYMS_SIMPLE",
         "pick4 is not null", "pick4", empty="break", metadata={"accepted_record_id": "p.recordId"}),
    Rule(5, "ExactMatchPrimarySourceAcceptedAuthorDisambiguation", "EXACT_MATCH_PRIMARY_SOURCE_ACCEPTED_AUTHOR_DISAMBIGUATION", "pick5 is not null", "pick5", empty="break",
         metadata={"matched_result_id": "p.recordId", "matched_full_name": "p.matchedName", "author_disambiguation": "'true'"}),
    Rule(6, "ExactMatchPrimarySourceAcceptedRetry", "EXACT_MATCH_PRIMARY_SOURCE_ACCEPTED_RETRY",
         f"is_retry and one and rs[0].matchedCanonicalSimple = query_term and {_AGREES(0, 'qr')}", upto="qr"),
    Rule(7, "ExactMatchPrimarySourceAcceptedInnerRankDisambiguation", "EXACT_MATCH_PRIMARY_SOURCE_ACCEPTED_INNER_RANK_DISAMBIGUATION",
         "both_accepted and kingdom_E is not null and (rs[0].its_kingdom <=> kingdom_E or rs[1].its_kingdom <=> kingdom_E) and some_E and (conflicts[0] > 6) <> (conflicts[1] > 6)",
         "if(conflicts[0] > 6, 0, 1)", metadata={"disambiguated_record_id": "p.recordId"}),
    Rule(8, "ExactMatchPrimarySourceAcceptedRankLevelDisambiguation", "EXACT_MATCH_PRIMARY_SOURCE_ACCEPTED_RANK_LEVEL_DISAMBIGUATION",
         f"both_accepted and {_AGREES(0, 'rk')} and {_AGREES(1, 'rk')} and (rs[0].asked <=> rk) <> (rs[1].asked <=> rk)", "if(rs[0].asked <=> rk, 0, 1)", "rk",
         metadata={"disambiguated_record_id": "p.recordId"}),
    Rule(9, "ExactMatchPrimarySourceAcceptedSynonymDisambiguation", "EXACT_MATCH_PRIMARY_SOURCE_ACCEPTED_SYNONYM_DISAMBIGUATION",
         f"both_exact and size(acc) = 1 and (rs[0].taxonomicStatus = 'Synonym' or rs[1].taxonomicStatus = 'Synonym') and {_AGREES('acc[0]', 'rk')}", "acc[0]", "rk",
         metadata={"accepted_record_id": "p.recordId", "synonym_record_id": "rs[if(rs[0].taxonomicStatus = 'Synonym', 0, 1)].recordId"}),
    Rule(10, "ExactMatchPrimarySourceAcceptedMultiResultDisambiguation", "EXACT_MATCH_PRIMARY_SOURCE_ACCEPTED_MULTI_RESULT_DISAMBIGUATION",
         "size(p10) > 0", "coalesce(try_element_at(filter(p10, j -> rs[j].scoreDetails.parsingQualityScore = 1), 1), p10[0])", "rk",
         metadata={"selected_record_id": "p.recordId", "candidate_count": "size(filter(acc, j -> rs[j].matchedCanonicalSimple = query_term))"}),
    Rule(11, "ExactMatchPrimarySourceAcceptedResultWithinQuery", "EXACT_MATCH_PRIMARY_SOURCE_ACCEPTED_RESULT_WITHIN_QUERY",
         f"n = 1 and M = 'Exact' and rs[0].taxonomicStatus = 'Accepted' and rs[0].dataSourceId = {PRIMARY} and rs[0].matchedCanonicalSimple <> '' and startswith(query_term, rs[0].matchedCanonicalSimple)"
         f" and query_term <> rs[0].matchedCanonicalSimple and {_AGREES(0, 'rs[0].own')} and {L.deepest('rs[0].C')} = rs[0].own",
         metadata={"matched_term": "p.matchedCanonicalSimple", "matched_rank": L.rank_name("p.own")}),
    Rule(12, "ExactMatchPrimarySourceMultiAccepted", "EXACT_MATCH_PRIMARY_SOURCE_MULT_ACCEPTED", "pick12 is not null", "pick12", empty="fail",
         metadata={"selected_result_id": "p.recordId", "selected_result_name": "p.matchedName", "selection_reason": "if(by_name12, 'exact_match_to_query_term', 'identical_classifications')",
                   "other_accepted_count": "size(acc) - 1", "canonical_name": "rs[acc[0]].matchedCanonicalSimple"}),
    Rule(13, "MultiExactMatchPrimarySourceSynonymsInfraspecificScore", "MULTI_EXACT_MATCH_PRIMARY_SOURCE_SYNONYMS_INFRASPECIFIC_SCORE", "pick13 is not null", "pick13", empty="break",
         metadata={"selected_synonym": "p.matchedName", "accepted_name": "p.currentName", "accepted_record_id": "p.currentRecordId", "infra_specific_rank_score": "p.scoreDetails.infraSpecificRankScore"}),
    Rule(14, "MultiExactMatchPrimarySourceAcceptedHomonym", "MULTI_EXACT_MATCH_PRIMARY_SOURCE_ACCEPTED_HOMONYM", "pick14 is not null", "pick14", empty="break",
         metadata={"selected_result_id": "p.recordId", "selected_result_name": "p.matchedName", "matched_kingdom": "kingdom_E"}),
    Rule(15, "ExactMatchPrimarySourceMultiAcceptedTaxonomicMatch", "EXACT_MATCH_PRIMARY_SOURCE_MULTI_ACCEPTED_TAXONOMIC_MATCH", "scores is not null", "if(tied = 1, acc[array_position(scores, top_score) - 1], null)", empty="tie",
         metadata={"match_count": "top_score", "total_results": "size(acc)", "selection_method": "if(tied = 1, 'taxonomic_hierarchy_match', 'taxonomic_hierarchy_match_tie')",
                   "selected_record_id": "p.recordId", "tied_results_count": "if(tied = 1, null, tied)"}),
    Rule(16, "FuzzyMatchPrimarySourceAccepted", "FUZZY_MATCH_PRIMARY_SOURCE_ACCEPTED",
         f"n = 1 and M = 'Fuzzy' and rs[0].taxonomicStatus = 'Accepted' and rs[0].dataSourceId = {PRIMARY} and qr > 0 and {_AGREES(0, 'qr - 1')}", metadata={"edit_distance": "p.editDistance"}),
    Rule(17, "SingleFuzzyMatchPrimarySourceAcceptedSimple", "SINGLE_FUZZY_MATCH_PRIMARY_SOURCE_ACCEPTED_SIMPLE",
         f"n = 1 and M = 'Fuzzy' and rs[0].dataSourceId = {PRIMARY} and rs[0].taxonomicStatus = 'Accepted'", empty="break",
         metadata={"fuzzy_matched_name": "p.matchedName", "edit_distance": "p.editDistance"}),
    Rule(18, "PartialExactMatchPrimarySourceAcceptedMultiResultDisambiguation", "PARTIAL_EXACT_MATCH_PRIMARY_SOURCE_ACCEPTED_DISAMBIGUATED",
         "size(p18) > 0", "coalesce(try_element_at(filter(p18, j -> rs[j].scoreDetails.parsingQualityScore = 1), 1), p18[0])", "p.own",
         metadata={"selected_record_id": "p.recordId", "matched_canonical": "p.matchedCanonicalSimple"}),
    Rule(19, "PartialExactMatchPrimarySourceSimple", "PARTIAL_EXACT_MATCH_PRIMARY_SOURCE_SIMPLE", f"n = 1 and M = 'PartialExact' and rs[0].dataSourceId = {PRIMARY}", empty="break",
         metadata={"matched_term": "p.matchedCanonicalSimple", "matched_level": L.rank_name("array_min(transform(raw, (x, i) -> if(x <> '' and contains(x, p.matchedCanonicalSimple), i, null)))"),
                   "matched_name": "p.matchedName", "current_name": "p.currentName", "taxonomic_status": "p.taxonomicStatus", "is_synonym": "p.isSynonym"}),
    Rule(20, "ExactMatchPrimarySourceSynonymSimple", "EXACT_MATCH_PRIMARY_SOURCE_SYNONYM_SIMPLE",
         f"n = 1 and M = 'Exact' and rs[0].dataSourceId = {PRIMARY} and rs[0].taxonomicStatus = 'Synonym' and rs[0].matchedCanonicalSimple <> ''"
         " and (startswith(query_term, rs[0].matchedCanonicalSimple) or startswith(raw[6], rs[0].matchedCanonicalSimple)) and rs[0].currentName <> '' and rs[0].classificationPath <> ''", empty="fail",
         metadata={"synonym_matched": "p.matchedName", "accepted_name": "p.currentName", "accepted_record_id": "p.currentRecordId"}),
    Rule(21, "NoMatchNonEmptyQuery", RETRY, f"{L.strip('query_term')} <> '' and (M is null or M = 'NoMatch' or n = 0)", "null"),
    Rule(22, "ExactMatchPrimarySourceAcceptedInnerRankMissingInResult", RETRY,
         "M is null or (one and rs[0].matchedCanonicalSimple = query_term and rk is not null and exists(sequence(0, 6), i -> i <= rk and E[i] is not null and rs[0].C[i] is null))", "null",
         empty="missing", metadata={"reason_for_retry": "'Missing inner rank in primary source result'"}),
    Rule(23, "ExactMatchSecondarySourceAcceptedPruned", "EXACT_MATCH_SECONDARY_SOURCE_ACCEPTED_PRUNED",
         f"is_retry and n = 1 and rs[0].matchType = 'Exact' and rs[0].taxonomicStatus = 'Accepted' and rs[0].dataSourceId = {SECONDARY} and rs[0].matchedCanonicalSimple = query_term"
         f" and not rs[0].bare and {_AGREES(0, 'rk')}",
         metadata={"secondary_source_id": "p.dataSourceId", "secondary_source_title": "p.dataSourceTitleShort"}),
    Rule(25, "ForceAcceptedLastResort", FORCED, "true", "null", empty="input", metadata={"reason": "'last_resort_fallback'", "note": "'Used original input data without resolution'"}),
)
#: A second registration of rule 11 stands between 23 and 25 and can never be reached.
_PARSED = ("dataSourceId", "dataSourceTitleShort", "recordId", "matchedName", "matchedCanonicalSimple", "currentRecordId", "currentName", "taxonomicStatus", "isSynonym", "classificationPath", "editDistance", "matchType", "scoreDetails")
#: Without a result of the primary source only rules 1, 21, 23 and 25 can apply, and of 23 all but the lineage is known: the rule of an answer that decides alone.
_SETTLED = (
    f"case when size(prim) > 0 then null when n = 0 or M = 'NoMatch' then if({L.strip('term')} <> '', 21, null)"
    f" when coalesce(n = 1 and rs[0].matchType = 'Exact' and rs[0].taxonomicStatus = 'Accepted' and rs[0].dataSourceId = {SECONDARY} and rs[0].matchedCanonicalSimple = term and not rs[0].bare, false) then null else 25 end"
)
_BROKEN = "Case execution failed: unexpected argument"
#: What ``prepared`` gives of an answer besides its look-up.
ANSWER = ("M", "n", "rs", "acc", "one", "both_exact", "both_accepted", "homonyms", "pick4", "pick5", "pick12", "by_name12", "pick13", "settled")
_OWN_COLUMNS = ("raw", "E", "some_E", "kingdom_E", "top_term", "no_data", "qr", "rk", "conflicts", "p10", "pick14", "scores", "top_score", "tied", "p18", "p")


def prepared(answers: DataFrame) -> DataFrame:
    """``term, source_id`` with all that the rules need of an answer alone.

    Many groups ask for the same name: its lineages are parsed once here and
    not for each of them.  ``rs`` are the results with their lineage ``C``,
    the ranks of their own name and of the term in it, and their kingdom;
    other columns point into it.  ``settled`` is the rule of an answer that
    decides whatever the lineage, unless that is empty; such an answer brings no results, as none is picked.
    """
    copied = ", ".join(f"r.{c}" for c in _PARSED)
    at = lambda condition: f"array_compact(transform(rs, (r, i) -> if({condition}, i, null)))"
    in_path = f"if(contains(r.classificationPath, '|'), {L.kingdom('substring_index(r.classificationPath, ' + chr(39) + '|' + chr(39) + ', 1)')}, null)"
    a = answers.select("term", "source_id", F.col("response.matchType").alias("M"), F.col("response").isNotNull().alias("_answered"),
        F.expr(f"transform(coalesce(response.results, array()), r -> struct({copied}, {L.extract('r.classificationPath', 'r.classificationRanks')} as C))").alias("rs"))
    # A look-up whose answer has no type counts as answered all the same.
    a = a.filter("_answered").withColumn("M", F.coalesce("M", F.lit(""))).drop("_answered")
    a = a.withColumn("rs", F.expr(
        f"transform(rs, r -> struct({copied}, r.C, {L.rank_of('r.matchedCanonicalSimple', 'r.C')} as own, {L.rank_of('term', 'r.C')} as asked, {L.kingdom('r.C[0]')} as its_kingdom, {in_path} as path_kingdom, not {L.some('r.C')} as bare))"
    ))
    a = a.withColumns({
        "n": F.size("rs"), "prim": F.expr(at(f"r.dataSourceId = {PRIMARY}")), "acc": F.expr(at(f"r.dataSourceId = {PRIMARY} and r.taxonomicStatus = 'Accepted'")),
        "one": F.expr(f"case when size(rs) = 1 then coalesce(rs[0].matchType = 'Exact' and rs[0].taxonomicStatus = 'Accepted' and rs[0].dataSourceId = {PRIMARY}, false) else false end"),
    })
    several = a.withColumns({
        "both_exact": F.expr(f"case when n = 2 then coalesce({_BOTH_EXACT}, false) else false end"),
        "_typed": F.expr("case when n > 1 then size(filter(prim, j -> rs[j].matchType is not null)) end"),
        "_typed_acc": F.expr("case when n > 1 then filter(acc, j -> rs[j].matchType is not null) end"),
        "_same": F.expr(f"case when {_SEVERAL} then {_SAME_CANONICAL} end"),
        "_named5": F.expr(f"case when {_SEVERAL} then try_element_at(filter(acc, j -> rs[j].matchedName = term), 1) end"),
        "_named12": F.expr(f"case when {_SEVERAL} then try_element_at(filter(acc, j -> {L.strip(chr(99) + 'oalesce(rs[j].currentName, ' + chr(39) * 2 + ')')} = {L.strip('term')}), 1) end"),
        "_paths": F.expr(f"case when {_SEVERAL} then size(array_distinct(transform(filter(acc, j -> rs[j].classificationPath <> ''), j -> rs[j].classificationPath))) end"),
        "homonyms": F.expr(f"coalesce({_SEVERAL} and size(array_distinct(transform(filter(acc, j -> contains(rs[j].classificationPath, '|')), j -> substring_index(rs[j].classificationPath, '|', 1)))) >= 2, false)"),
        "settled": F.expr(_SETTLED),
        "_best": F.expr("case when n >= 2 and M = 'Exact' and size(prim) >= 2 and forall(prim, j -> rs[j].taxonomicStatus <=> 'Synonym') and size(array_distinct(transform(prim, j -> struct(rs[j].currentName)))) = 1"
                        " then array_max(transform(prim, j -> rs[j].scoreDetails.infraSpecificRankScore)) end"),
    })
    return several.select(
        "term", "source_id", "M", "n", F.expr("if(settled is null, rs, null)").alias("rs"), F.expr("if(settled is null, acc, null)").alias("acc"), "one", "both_exact", F.expr("both_exact and size(acc) = 2").alias("both_accepted"), "homonyms",
        F.expr("case when M = 'Exact' and _typed > 1 and size(_typed_acc) = 1 then _typed_acc[0] end").alias("pick4"), F.expr("case when _same then _named5 end").alias("pick5"),
        F.expr("case when _same and (_named12 is not null or _paths = 1) then coalesce(_named12, acc[0]) end").alias("pick12"), F.expr("_named12 is not null").alias("by_name12"),
        F.expr("case when _best > -1 then filter(prim, j -> rs[j].scoreDetails.infraSpecificRankScore = _best)[0] end").alias("pick13"), "settled",
    )


def with_lineage(groups: DataFrame) -> DataFrame:
    """Add what the rules read of a group's names alone.

    Names are stripped and compared here, once a group: a group has up to 24
    rungs.  The join with answers keeps Spark from moving these expressions into those of the rules.
    """
    no_data = F.lit(True)
    for c in ("scientific_name", *RANKS):
        no_data = no_data & F.coalesce(F.col(c), F.lit("")).isin(*INVALID)
    rows = groups.withColumns({"E": F.array(*[F.when(valid(F.col(c)), strip(F.col(c))) for c in RANKS]), "top_term": most_specific_term(), "no_data": no_data})
    return rows.withColumns({"some_E": F.expr(L.some("E")), "kingdom_E": F.expr(L.kingdom("E[0]"))})


def staged(rungs: DataFrame) -> DataFrame:
    """Add the columns that the rules read to rows with ``query_term, query_rank, is_retry``, a group's names with their ``with_lineage``, and ``prepared`` answers (null without one)."""
    a = rungs.withColumns({"raw": lineage(), "n": F.coalesce("n", F.lit(0)), "qr": F.expr(L.rank_index("query_rank"))})
    # A term is a stripped valid name, so that it is in E if it is in the input's lineage at all.
    b = a.withColumns({
        "rk": F.expr("case when settled is not null then null " + " ".join(f"when E[{i}] = query_term then {i}" for i in reversed(range(7))) + " end"),
        "conflicts": F.expr(f"case when rs is null then null when n = 1 then array({L.conflict('E', 'rs[0].C')}) when n > 1 then transform(rs, r -> {L.conflict('E', 'r.C')}) end"),
    })
    c = b.withColumns({
        "p10": F.expr("case when rs is not null and n >= 1 and M = 'Exact' and some_E and rk is not null then filter(acc, j -> rs[j].matchedCanonicalSimple = query_term and conflicts[j] > rk and not rs[j].bare and rs[j].asked <=> rk) end"),
        "pick14": F.expr("case when homonyms and kingdom_E is not null then try_element_at(filter(acc, j -> rs[j].path_kingdom = kingdom_E), 1) end"),
        "scores": F.expr(f"case when rs is not null and {_SEVERAL} and some_E then transform(acc, j -> {L.score('E', 'rs[j].C', 'kingdom_E', 'rs[j].its_kingdom')}) end"),
        "p18": F.expr(f"case when rs is not null and n >= 1 and M = 'PartialExact' and some_E then filter(acc, j -> rs[j].matchedCanonicalSimple <> '' and rs[j].own > 0 and startswith({L.strip('raw[rs[j].own]')}, rs[j].matchedCanonicalSimple) and conflicts[j] > rs[j].own - 1) end"),
    })
    d = c.withColumn("top_score", F.array_max("scores"))
    return d.withColumn("tied", F.expr("size(filter(scores, x -> x = top_score))"))


def classify(rungs: DataFrame, without: tuple[str, ...] = ()) -> DataFrame:
    """Add ``rule`` and the outcome columns of each rung, but for those ``without``.  RETRY_SCHEDULED stands for climbing on.

    Spark takes no column out of the generator that ends this, so a query names those that it does not read.
    """
    rows = staged(rungs if "E" in rungs.columns else with_lineage(rungs))
    rule = F.expr("case when settled is not null then if(no_data, 1, settled) " + " ".join(f"when coalesce({r.when}, false) then {r.number}" for r in RULES) + " end")
    rows = rows.withColumn("rule", rule)
    default = ", ".join(str(r.number) for r in RULES if r.pick == "rs[0]")
    picks = " ".join(f"when {r.number} then rs[{r.pick}]" for r in RULES if r.pick not in ("null", "rs[0]"))
    rows = rows.withColumn("p", F.expr(f"case when rule in ({default}) then rs[0] else case rule {picks} end end"))
    cuts = " ".join(f"when {r.number} then {L.cut('p.C', r.upto)}" for r in RULES if r.upto)
    rows = rows.withColumns({
        "_lineage": F.expr(f"case rule {cuts} when 25 then transform(raw, x -> nullif(x, '')) else p.C end"),
        "_empty": F.expr("coalesce(p.bare, false)"),
    })
    numbers = lambda kind: ", ".join(str(r.number) for r in RULES if r.empty == kind)
    rows = rows.withColumns({
        "_broken": F.expr(f"(_empty and rule in ({numbers('break')})) or (rule = 22 and M is null) or (rule = 19 and p.matchedCanonicalSimple is null and exists(raw, x -> x <> ''))"),
        "_failed": F.expr(f"(_empty and rule in ({numbers('fail')})) or (rule = 15 and tied > 1)"),
    })
    status = " ".join(f"when {r.number} then '{r.status}'" for r in RULES)
    names = " ".join(f"when {r.number} then '{r.strategy}'" for r in RULES)
    entries = " ".join(f"when {r.number} then map({', '.join(f'{chr(39)}{k}{chr(39)}, cast({v} as string)' for k, v in r.metadata.items())})" for r in RULES if r.metadata)
    nothing = "map_from_arrays(cast(array() as array<string>), cast(array() as array<string>))"
    outcome = {
        "rule": F.col("rule"),
        "status": F.expr(f"case when _broken or _failed then '{FAILED}' else case rule {status} end end"),
        "strategy": F.expr(f"case when _broken then 'check_and_resolve' when _failed and rule <> 15 then concat(case rule {names} end, 'Strategy') else case rule {names} end end"),
        "resolved": F.expr("case when _broken or _failed or rule in (1, 21, 22) then null else _lineage end"),
        "failure_reason": F.expr(f"case when _broken then null when _failed and rule = 15 then concat('Tie between ', tied, ' results with equal taxonomic matches') when _failed then 'Classification extraction failed' when rule = 1 then '{RULES[0].reason}' end"),
        "error": F.expr(f"case when _broken then '{_BROKEN}' when _failed then case rule when 3 then 'Extracted empty path' when 12 then 'Extracted empty path from selected result' when 20 then 'Extracted empty classification for accepted name' end end"),
        "metadata": F.expr(f"case when _broken or (_failed and rule <> 15) then {nothing} else map_filter(coalesce(case rule {entries} end, {nothing}), (k, v) -> v is not null) end"),
    }
    inner = {*ANSWER, *_OWN_COLUMNS, *outcome, "_lineage", "_empty", "_broken", "_failed"}
    # A filter on the outcome must not be moved below it: there it would hold a copy of every stage above.  A generator stops it.
    return rows.select(*[c for c in rows.columns if c not in inner], F.inline(F.array(F.struct(*[x.alias(k) for k, x in outcome.items() if k not in without]))))


__all__ = ["RULES", "Rule", "classify", "prepared", "staged", "with_lineage"]

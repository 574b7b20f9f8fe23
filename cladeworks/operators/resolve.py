"""Resolution: the first decisive rung of each group's ladder, then the rules.

Only an answer without results lets a group climb on.  So a narrow table of
the terms that have results anywhere finds each group's rung before any rule
runs: most groups stop at their first term, and the others expand to one row a
term.  The wide answers join once, one row per group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import EXHAUSTED, FAILED, FORCED, FORCED_INPUT, RANKS, RETRY, SOURCES, STATUSES, SUCCESSFUL
from ..functions.canonical import canonical_json
from ..functions.names import term_rank, terms, valid_names
from .cascade import classify, prepared, with_lineage
from .grouping import NAMES, group_entries, with_group_key
from .ladder import rungs, source_at

_OUTCOME = ("status", "strategy", "resolved", "failure_reason", "error", "metadata", "query_term", "query_rank", "source_id", "rung")


def decides() -> Column:
    """Whether an answer ends a climb: it has results."""
    return (F.coalesce(F.size("response.results"), F.lit(0)) > 0) & ~F.coalesce(F.col("response.matchType") == "NoMatch", F.lit(False))


def _with_answers(asked: DataFrame, responses: DataFrame) -> DataFrame:
    return asked.join(prepared(responses).withColumnRenamed("term", "query_term"), ["query_term", "source_id"], "left")


def attempts(groups: DataFrame, responses: DataFrame, without: tuple[str, ...] = ()) -> DataFrame:
    """All rungs of all groups with their outcomes but for columns ``without``, also rungs that a climb would not reach."""
    return classify(_with_answers(rungs(with_lineage(groups)), responses), without)


def decisive_rungs(groups: DataFrame, responses: DataFrame) -> DataFrame:
    """One row per group: ``group_key``, its names and ``rung, query_term, query_rank, source_id, is_retry`` of the first rung that has results, else of the last.

    ``responses`` has ``term, source_id, response``.  Only their terms are joined here.
    """
    place = F.array_position(F.array(*[F.lit(s) for s in SOURCES]), F.col("source_id")) - 1
    known = responses.filter(decides() & F.col("source_id").isin(*SOURCES)).groupBy(F.col("term").alias("_term")).agg(F.min(place).cast("int").alias("_at")).filter("_at is not null")
    asked = groups.select("group_key", *NAMES, valid_names().alias("_names")).withColumn("_terms", terms(F.col("_names")))
    first = asked.join(known, F.get("_terms", F.lit(0)) == F.col("_term"), "left").drop("_term")
    hit = first.filter("_at is not null").withColumn("_rung", F.col("_at")).drop("_at")
    others = first.filter("_at is null").drop("_at").select("group_key", F.struct(*NAMES, "_names", "_terms").alias("_group"), F.posexplode_outer("_terms").alias("_k", "_asked"))
    later = others.join(known, F.col("_asked") == F.col("_term"), "left").groupBy("group_key").agg(
        F.first("_group").alias("_group"), F.min(F.col("_k") * len(SOURCES) + F.col("_at")).alias("_rung")
    )
    last = F.greatest(len(SOURCES) * F.size("_terms") - 1, F.lit(0))
    both = hit.unionByName(later.select("group_key", "_group.*", "_rung")).withColumn("rung", F.coalesce("_rung", last))
    term = _term_at(F.col("rung"))
    return both.select(
        "group_key", *NAMES, "rung", F.coalesce(term, F.lit("")).alias("query_term"), term_rank(term, F.col("_names")).alias("query_rank"),
        source_at(F.col("rung") % len(SOURCES)).alias("source_id"), (F.col("rung") > 0).alias("is_retry"),
    )


def _term_at(rung: Column) -> Column:
    return F.get("_terms", F.floor(rung / len(SOURCES)).cast("int"))


def final_attempts(groups: DataFrame, responses: DataFrame, without: tuple[str, ...] = ()) -> DataFrame:
    """One row per group: the outcome of its first decisive rung, or of its last one, exhausted; ``without`` may name ``resolved`` and ``metadata``."""
    rows = classify(_with_answers(with_lineage(decisive_rungs(groups, responses)), responses), without)
    lost = F.when(F.col("strategy") == "NoMatchNonEmptyQuery", "No match found after exhausting all retry combinations.").otherwise(
        "Retries exhausted after detecting primary source inconsistency (missing rank)."
    )
    none = F.col("status") == RETRY
    return rows.withColumns({"failure_reason": F.when(none, lost).otherwise(F.col("failure_reason")), "status": F.when(none, EXHAUSTED).otherwise(F.col("status"))}).select("group_key", *NAMES, *[c for c in _OUTCOME if c not in without])


def _climbed(last: DataFrame) -> DataFrame:
    """Groups with their last ``rung``, repeated for every rung ``_k`` up to it."""
    rows = last.withColumn("_names", valid_names()).withColumn("_terms", terms(F.col("_names")))
    return rows.withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("rung"))))


def _steps() -> list[Column]:
    """The look-up of each rung of ``_climbed``."""
    k = F.col("_k")
    term = _term_at(k)
    return ["group_key", k.alias("rung"), F.coalesce(term, F.lit("")).alias("query_term"), term_rank(term, F.col("_names")).alias("query_rank"), source_at(k % len(SOURCES)).alias("source_id")]


def steps(groups: DataFrame, responses: DataFrame) -> DataFrame:
    """The look-ups of ``chains`` without their outcomes, for which no rule has to run."""
    return _climbed(decisive_rungs(groups, responses)).select(*_steps())


def chains(final: DataFrame) -> DataFrame:
    """The rungs that a group has climbed, in order.

    A group's names and its last rung say which rungs those are, so nothing is joined.
    """
    ended = F.col("_k") == F.col("rung")
    return _climbed(final).select(
        *_steps(),
        F.when(ended, F.col("status")).otherwise(RETRY).alias("status"), F.when(ended, F.col("strategy")).otherwise("NoMatchNonEmptyQuery").alias("strategy"),
        F.when(ended, F.col("failure_reason")).alias("failure_reason"), F.when(ended, F.col("error")).alias("error"),
    )


def with_attempt_keys(steps: DataFrame, responses: DataFrame) -> DataFrame:
    """``chains`` or ``steps`` with ``attempt_key``, the digest of group, look-up and answer, and ``previous_key``, the one of the rung before.

    The answer counts as its canonical JSON, serialised once for each look-up
    and not once a group; without an answer it is empty.
    """
    said = responses.filter("response is not null").select(
        F.col("term").alias("query_term"), F.col("source_id").cast("int").alias("source_id"), canonical_json(F.col("response"), responses.schema["response"].dataType).alias("_said")
    )
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    key = F.sha2(F.concat_ws("|", "group_key", text("query_term"), text("query_rank"), text("source_id"), text("_said")), 256)
    keyed = steps.join(said, ["query_term", "source_id"], "left").withColumn("attempt_key", key).drop("_said")
    return keyed.withColumn("previous_key", F.lag("attempt_key").over(Window.partitionBy("group_key").orderBy("rung")))


def force_failed(final: DataFrame) -> DataFrame:
    """Failures fall back to their input and count as successful."""
    lost = F.col("status").isin(FAILED, EXHAUSTED)
    base = F.map_from_arrays(F.array(F.lit("original_status"), F.lit("force_failed_to_input")), F.array(F.col("status"), F.lit("true")))
    names = F.array(*[F.nullif(F.col(c), F.lit("")) for c in RANKS])
    return final.withColumns({
        "resolved": F.when(lost, names).otherwise(F.col("resolved")),
        "metadata": F.when(lost, F.map_concat(base, F.map_filter("metadata", lambda k, v: ~k.isin("original_status", "force_failed_to_input")))).otherwise(F.col("metadata")),
        "strategy": F.when(lost, "ForceFailedToInput").otherwise(F.col("strategy")),
        "status": F.when(lost, FORCED_INPUT).otherwise(F.col("status")),
    })


def _rows(entries: DataFrame, success, resolved) -> DataFrame:
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    ranks = [F.when(success, F.coalesce(F.get(resolved, F.lit(i)), F.lit(""))).otherwise(F.coalesce(F.col(c), F.lit(""))).alias(c) for i, c in enumerate(RANKS)]
    has = set(entries.columns)
    optional = [text(c) if c in has else F.lit("").alias(c) for c in ("scientific_name", "common_name", "source_dataset", "source_id")]
    path = F.when(F.col("_status") == FORCED, "FORCED").when(success, "RESOLVED").otherwise("UNSOLVED")
    kept = [c for c in ("file_number", "file_part") if c in has]
    return entries.select(
        "uuid", *optional, F.col("_status").alias("resolution_status"), *ranks, path.alias("resolution_path"),
        F.col("_error").alias("resolution_error"), F.col("_reason").alias("resolution_failure_reason"), F.col("_strategy").alias("resolution_strategy"),
        F.col("_term").alias("final_query_term"), F.col("_rank").alias("final_query_rank"), F.col("_source").alias("final_data_source_id"), F.col("_metadata_map").alias("metadata"), *kept,
    )


def output_rows(entries: DataFrame, final: DataFrame) -> DataFrame:
    """One row per entry with its group's resolution; groups are found by key, not by member.  The place of a row in its file stays if entries have it."""
    names = {"status": "_status", "error": "_error", "failure_reason": "_reason", "strategy": "_strategy", "query_term": "_term", "query_rank": "_rank", "source_id": "_source", "metadata": "_metadata_map", "resolved": "_resolved"}
    side = final.select("group_key", *[F.col(a).alias(b) for a, b in names.items()])
    joined = with_group_key(entries).join(side, "group_key", "left")
    absent = F.col("_status").isNull()
    joined = joined.withColumns({
        "_error": F.when(absent, "Entry not mapped to any resolution attempt").otherwise(F.col("_error")),
        "_reason": F.when(absent, "Processing error or missing attempt").otherwise(F.col("_reason")), "_status": F.coalesce("_status", F.lit(FAILED)),
    })
    return _rows(joined, F.col("_status").isin(*SUCCESSFUL), F.col("_resolved"))


def forced_rows(entries: DataFrame) -> DataFrame:
    """Entries as they are, marked as accepted by force."""
    none = F.lit(None)
    marked = entries.withColumns({
        "_status": F.lit(FORCED), "_error": F.lit("Entry not mapped to any resolution attempt"), "_reason": F.lit("Processing error or missing attempt"),
        "_strategy": none.cast("string"), "_term": none.cast("string"), "_rank": none.cast("string"), "_source": none.cast("int"), "_metadata_map": none.cast("map<string,string>"),
    })
    return _rows(marked, F.lit(False), F.array(F.lit("")))


def is_resolved() -> Column:
    return F.col("resolution_status").isin(*SUCCESSFUL)


def split(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(resolved, unsolved)."""
    return rows.filter(is_resolved()), rows.filter(~is_resolved())


def expand_metadata(rows: DataFrame, keys) -> DataFrame:
    """``meta_<key>`` columns in place of the map."""
    return rows.select(*[c for c in rows.columns if c != "metadata"], *[F.try_element_at("metadata", F.lit(k)).alias(f"meta_{k}") for k in keys])


def resolve(entries: DataFrame, responses: DataFrame, order: str = "uuid") -> DataFrame:
    """Entries to output rows."""
    final = force_failed(final_attempts(group_entries(entries, order), responses))
    return output_rows(entries, final)


def successful(final: DataFrame) -> DataFrame:
    return final.filter(F.col("status").isin(*SUCCESSFUL))


def statistics(final: DataFrame) -> DataFrame:
    """One row: groups, attempts, groups with retries, and a count for every status."""
    counts = [F.count_if(F.col("status") == s).alias(f"final_status_{s.lower()}") for s in STATUSES]
    return final.agg(F.count("*").alias("total_entry_groups_processed"), F.coalesce(F.sum(F.col("rung") + 1), F.lit(0)).cast("long").alias("total_attempts_created"), F.count_if(F.col("rung") > 0).alias("entry_groups_with_retries"), *counts)

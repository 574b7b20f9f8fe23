"""What happened to one entry, and digests of its input."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..constants import RANKS
from ..functions.names import most_specific_rank, most_specific_term
from .grouping import group_entries, with_group_key
from .ladder import initial_plan


def trace_entry(entries: DataFrame, attempts_of: Callable[[DataFrame], DataFrame], uuid: str) -> DataFrame:
    """One JSON row for each entry with this ``uuid``: the entry, its group with the first three members, the first look-up and every attempt.

    Empty if no entry has it.  Only the groups that hold the entry are formed and tried, by ``attempts_of(groups)``.
    The attempts carry the status before failures fall back to their input.
    """
    keyed = with_group_key(entries)
    mine = keyed.filter(F.col("uuid") == uuid)
    derived = mine.withColumns({"most_specific_term": most_specific_term(), "most_specific_rank": most_specific_rank()})
    entry = derived.select("group_key", F.struct(*[c for c in derived.columns if c != "group_key"]).alias("entry"))
    keys = mine.select("group_key").distinct()
    inside = keyed.join(keys, "group_key", "left_semi")
    groups = group_entries(inside)
    ranked = inside.select("group_key", "uuid", F.row_number().over(Window.partitionBy("group_key").orderBy("uuid")).alias("_at"))
    members = ranked.filter("_at <= 3").groupBy("group_key").agg(F.array_sort(F.collect_list("uuid")).alias("first_members"))
    group = initial_plan(groups).join(members, "group_key", "left")
    plan = group.select("group_key", F.struct("scientific_name", *RANKS, "group_count", "first_members").alias("group"), F.struct("query_term", "query_rank", "source_id").alias("query_plan"))
    steps = attempts_of(groups).groupBy("group_key").agg(F.array_sort(F.collect_list(F.struct("rung", "query_term", "query_rank", "source_id", "status", "strategy", "failure_reason", "error"))).alias("attempts"))
    whole = entry.join(plan, "group_key").join(steps, "group_key", "left")
    return whole.select(F.to_json(F.struct("group_key", "entry", "group", "query_plan", "attempts")).alias("trace"))


def group_members(entries: DataFrame, uuid: str) -> DataFrame:
    """``group_key, uuid`` of all entries that share a group with this one."""
    keyed = with_group_key(entries)
    return keyed.join(keyed.filter(F.col("uuid") == uuid).select("group_key").distinct(), "group_key", "left_semi").select("group_key", "uuid").orderBy("group_key", "uuid")


def as_text(trace: str) -> str:
    """A trace row for people: a section for each part, a line for each value."""
    body = json.loads(trace)
    lines = [f"Group {body['group_key']}"]
    for title in ("entry", "group", "query_plan"):
        lines += ["", title.replace("_", " ").capitalize(), *[f"  {k}: {v}" for k, v in (body.get(title) or {}).items()]]
    for step in body.get("attempts") or []:
        lines += ["", f"Attempt {step.get('rung', 0) + 1}", *[f"  {k}: {v}" for k, v in step.items() if k != "rung"]]
    return "\n".join(lines)


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()

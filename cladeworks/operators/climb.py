"""The climb up the ladder by its frontier: no look-up is made that no group needs.

All groups stand on the same rung in a round.  The frontier holds the groups
that no answer has decided so far, with their terms.  A round takes the
different look-ups of the frontier, leaves out those with an answer from an
earlier round, asks for the rest, and keeps the groups whose answer has no
results and who have a rung left.  Both the frontier and the answers are
written tables, so a round repeats nothing of the rounds before it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import QUERY_ORDER, SOURCES
from ..functions.names import terms, valid_names
from .resolve import decides

Keep = Callable[[str, DataFrame], DataFrame]


def rounds(groups: DataFrame, ask: Callable[[DataFrame], DataFrame], keep: Keep) -> DataFrame:
    """``round, term, source_id, response``: every look-up that a group came to, and the round that made it.

    ``ask`` takes new look-ups ``(term, source_id)`` and gives ``term,
    source_id, response``; ``keep`` writes a table under a name and gives it
    read again.  Groups without a valid name ask nothing.
    """
    asks = terms(valid_names())
    frontier = keep("frontier-0", groups.select("group_key", asks.alias("terms")).filter(F.size("terms") > 0))
    known = None
    for rung in range(len(QUERY_ORDER) * len(SOURCES)):
        source = SOURCES[rung % len(SOURCES)]
        standing = frontier.withColumn("term", F.get("terms", F.lit(rung // len(SOURCES))))
        wanted = standing.select("term", F.lit(source).cast("int").alias("source_id")).distinct()
        new = wanted.join(known, ["term", "source_id"], "left_anti") if known is not None else wanted
        answers = keep(f"answers-{rung}", ask(new).select(F.lit(rung).alias("round"), "term", F.col("source_id").cast("int").alias("source_id"), "response"))
        known = answers if known is None else known.unionByName(answers)
        decided = known.filter(decides() & (F.col("source_id") == source)).select("term").distinct()
        left = standing.join(decided, "term", "left_anti").filter(F.size("terms") * len(SOURCES) > rung + 1)
        frontier = keep(f"frontier-{rung + 1}", left.select("group_key", "terms"))
        if frontier.isEmpty():
            break
    return known


def answers(groups: DataFrame, ask: Callable[[DataFrame], DataFrame], keep: Keep) -> DataFrame:
    """``term, source_id, response`` of all look-ups of the climb; resolution with them equals resolution with every answer there is."""
    return rounds(groups, ask, keep).drop("round")

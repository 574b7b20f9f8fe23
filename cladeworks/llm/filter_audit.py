"""Audit of how filters interact, by a walk through all subsets of filters.

Each document gets one bit for each filter that it fails.  Documents are
counted by part and mask, so that what remains of a part is at most one cell
for each of the 32 masks.  A Gray-code walk visits all subsets of the filters
and toggles one filter at a time: every cell holds how many of the active
filters it fails, and joins or leaves the running survivors when that counter
leaves or reaches zero.  The survivors of the 32 states are stored; any order
of the filters is a path through the states, and each of its steps is the
difference of two of them.

Filter E (a text that a smaller ``doc_id`` has too) needs the whole table.
Rows are counted by text digest and identifier first; the smallest identifier
of each digest then is a minimum that is combined before the shuffle, and only
its rows pass E.  No row looks for its group, so a text that a third of all
rows share moves as little data as any other.

Null texts are empty; a null language is the empty part; a null ``doc_id`` is
no smaller than any and passes E itself; rows that share both identifier and
text pass or fail E together.  Repeated label rows of a document count as one
with the highest values.  Texts are read whole, whatever their length; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import SPACE, broadcast_if_small, materialize

FILTERS = "ABCDE"
MEASURES = ("n", "good", "toxic")


def own_failures() -> list[Column]:
    """Whether a row of ``text, words`` fails A, B, C and D, which look at the text alone; neither is null."""
    n = F.when(F.get("words", F.lit(0)) == "", 0).otherwise(F.size("words"))
    capitals = F.regexp_count("text", F.lit("[A-Z]"))
    return [n < 100, 100 * F.size(F.array_distinct("words")) < 80 * n, 100 * capitals > 10 * F.length("text"), F.col("text").rlike(r"[#$%&*|]")]


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, digest, part, mask, good, toxic, n``: rows counted; bit k of ``mask`` says that filter k of A to D is failed."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    # A stripped text splits into its words, or into one empty string.
    rows = rows.withColumn("words", F.split(F.btrim("text", F.lit(" \t\n\x0b\x0c\r")), f"{SPACE}+"))
    bits = F.lit(0)
    for k, fails in enumerate(own_failures()):
        bits = bits + F.when(fails, 1 << k).otherwise(0)
    counted = rows.select("doc_id", "part", F.sha2("text", 256).alias("digest"), bits.alias("mask")).groupBy("doc_id", "part", "digest").agg(F.first("mask").alias("mask"), F.count("*").alias("n"))
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("_id")).agg((F.max("quality") == 1).cast("int").alias("good"), (F.max("toxic") == 1).cast("int").alias("toxic"))
    marks = broadcast_if_small(materialize(marks.filter("_id is not null and (good = 1 or toxic = 1)"), "marks"))
    # Rows without an identifier match nothing; they are spread by their text.
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("\0"), "digest"))
    joined = counted.withColumn("_key", key).join(marks.withColumn("_key", F.col("_id").cast("string")), "_key", "left")
    return joined.select("doc_id", "digest", "part", "mask", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "toxic")], "n")


def cells(rows: DataFrame) -> DataFrame:
    """``part, mask`` with the bit of E too, and how many documents, good ones and toxic ones fail exactly these filters."""
    shown = F.struct("part", "mask", "good", "toxic", "n")
    # The rows of one identifier and one text are those of repeated rows in different parts.
    by_row = rows.filter("doc_id is not null").groupBy("digest", "doc_id").agg(F.collect_list(shown).alias("rows"))
    first = by_row.groupBy("digest").agg(F.min_by("rows", "doc_id").alias("rows")).select(F.inline("rows"))
    passing = first.unionByName(rows.filter("doc_id is null").select("part", "mask", "good", "toxic", "n"))
    sums = lambda df, sign: df.select("part", "mask", *[(sign * F.col("n") * (F.col(m) if m != "n" else 1)).alias(m) for m in MEASURES])
    bit = 1 << FILTERS.index("E")
    failing = sums(rows, 1).unionByName(sums(passing, -1)).withColumn("mask", F.col("mask") + bit)
    return failing.unionByName(sums(passing, 1)).groupBy("part", "mask").agg(*[F.sum(m).cast("long").alias(m) for m in MEASURES])


def walk(cells: dict[int, tuple[int, ...]], width: int = len(FILTERS)) -> list[tuple[int, ...]]:
    """Survivors, by measure, of every subset of active filters, from ``cells`` of failed filters."""
    masks, sizes = list(cells), list(cells.values())
    active = [0] * len(masks)
    alive = [sum(x) for x in zip(*sizes, strict=True)] if sizes else [0] * len(MEASURES)
    states: list[tuple[int, ...]] = [()] * (1 << width)
    state = 0
    states[0] = tuple(alive)
    for step in range(1, 1 << width):
        k = (step & -step).bit_length() - 1  # Gray code: the one filter that changes
        state ^= 1 << k
        on = 1 if state >> k & 1 else -1
        for c, mask in enumerate(masks):
            if mask >> k & 1:
                was, active[c] = active[c], active[c] + on
                if (was == 0) != (active[c] == 0):
                    for m, x in enumerate(sizes[c]):
                        alive[m] -= on * x
        states[state] = tuple(alive)
    return states


def steps(states: list[tuple[int, ...]], filters: str = FILTERS) -> list[tuple]:
    """A row for each order of the filters and each step, from the stored states."""
    width, every = len(filters), (1 << len(filters)) - 1
    n = [x[0] for x in states]
    fails = [n[0] - n[1 << k] for k in range(width)]
    alone = [n[every ^ (1 << k)] - n[every] for k in range(width)]
    shapley = [0] * width
    for k in range(width):
        for s in range(1 << width):
            if not s >> k & 1:
                size = s.bit_count()
                shapley[k] += factorial(size) * factorial(width - 1 - size) * (n[s] - n[s | 1 << k])
    rows = []
    for order in permutations(range(width)):
        state, name = 0, "".join(filters[k] for k in order)
        for step, k in enumerate(order, 1):
            before, state = states[state], state | 1 << k
            lost = [a - b for a, b in zip(before, states[state], strict=True)]
            rows.append((name, step, states[state][0], lost[0], fails[k] - lost[0], alone[k], lost[1], lost[2], shapley[k]))
    return rows


REPORT = ("filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part`` and ``REPORT``: what each filter does in each order, for every part of ``docs (doc_id, text, lang)``."""
    counted = cells(materialize(failures(docs, labels), "failures"))

    def report(part: pd.DataFrame) -> pd.DataFrame:
        table = {int(m): tuple(map(int, x)) for m, *x in part[["mask", *MEASURES]].itertuples(index=False)}
        out = pd.DataFrame(steps(walk(table)), columns=REPORT)
        out.insert(0, "part", part["part"].iloc[0])
        return out

    kinds = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in REPORT[2:])
    return counted.groupBy("part").applyInPandas(report, kinds)

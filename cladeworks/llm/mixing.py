"""Mixing sources to target weights with hash-threshold histograms.

Every row has a fixed position in [0, 2**60): the leading bits of an MD5 of
its identifier and its text's MD5, so that an identifier that many rows share does not
put them at one place.  A source's budget is a threshold on that position.  To find
it, the sizes are summed by source and hash bucket (a histogram, pre-summed
before its shuffle), the bucket in which the running sum passes the budget is
found, and only that bucket's rows enter the next, finer histogram, until the
boundary holds a single position.  No row is sorted.  The boundary position is
taken if that brings the sum nearer to the budget.  Thresholds of growing
budgets are nested: a smaller mix is a subset of a larger one.

A budget above the source's size takes every row once and a second time up to
the threshold, so that no row is taken more than twice.

Null identifiers count as the empty string, null texts have size 0 and count as
empty, rows equal in identifier and text share their position and so their
fate; a null source is a source of its own, last in order.  Texts count whole,
whatever their length; extra columns stay where rows are returned.  An empty
table gives an empty result.  Sources are names of collections: their table,
one row each, is ranked in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import WORD, broadcast_if_small, materialize, scratch

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST = 2.0
_BITS, _STEP = 60, 12


def word_count(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def position(identifier: Column, text: Column, seed: str = "") -> Column:
    """The first 60 bits of the MD5 of ``identifier`` as text, followed by ``seed`` and the MD5 of ``text``."""
    whole = F.concat(F.coalesce(identifier.cast("string"), F.lit("")), F.lit(seed), F.md5(F.coalesce(text.cast("string"), F.lit(""))))
    return F.conv(F.substring(F.md5(whole), 1, _BITS // 4), 16, 10).cast("long")


def targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Add ``target`` to ``(source, source_size)``.

    Weights repeat over the sources in code-point order, null last.  The
    targets share ``share`` times the total by weight; none exceeds ``most``
    times its source's size, and what is cut off is shared by weight again.
    With sources in the order of their cap over weight, those at their cap are
    the first ones, so one pass of running sums finds the common level.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    every = Window.partitionBy()
    before = Window.orderBy("_ratio", "_rank").rowsBetween(Window.unboundedPreceding, -1)
    return (
        sources.withColumn("_rank", rank).withColumn("_weight", weight).withColumn("_cap", most * F.col("source_size"))
        .withColumn("_ratio", F.col("_cap") / F.col("_weight"))
        .withColumn("_total", F.sum("source_size").over(every) * share).withColumn("_all", F.sum("_weight").over(every))
        .withColumn("_level", (F.col("_total") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / (F.col("_all") - F.coalesce(F.sum("_weight").over(before), F.lit(0.0))))
        .withColumn("_found", F.min(F.when(F.col("_ratio") > F.col("_level"), F.struct("_ratio", "_rank", "_level"))).over(every)["_level"])
        .withColumn("target", F.coalesce(F.least("_cap", F.col("_found") * F.col("_weight")), F.col("_cap")))
        .select("source", "source_size", "target")
    )


def thresholds(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """For ``budgets (source, budget)`` the position below which rows of ``rows (source, position, size)`` fill it: ``(source, threshold)``."""
    open_ = materialize(budgets.select("source", F.lit(0).cast("long").alias("low"), F.col("budget").cast("double").alias("rest")), "budgets")
    done, shift = [], _BITS
    while shift > 0:
        width, shift = shift, shift - _STEP
        b = broadcast_if_small(open_.select(F.col("source").alias("_s"), "low", "rest"), 100_000)
        inside = rows.join(b, F.col("source").eqNullSafe(F.col("_s")) & (F.shiftright("position", width) == F.shiftright("low", width)))
        histogram = inside.groupBy("source", F.shiftright("position", shift).alias("bucket")).agg(
            F.sum("size").alias("mass"), F.min("position").alias("first"), F.max("position").alias("last"), F.first("rest").alias("rest")
        )
        running = Window.partitionBy("source").orderBy("bucket")
        boundary = (
            histogram.withColumn("upto", F.sum("mass").over(running)).filter("upto > rest")
            .groupBy("source").agg(F.min_by(F.struct("bucket", "mass", "upto", "first", "last", "rest"), "bucket").alias("x")).select("source", "x.*")
        )
        found = materialize(boundary, f"boundary{shift}")
        left = F.col("rest") - (F.col("upto") - F.col("mass"))
        single = (F.col("first") == F.col("last")) if shift else F.lit(True)
        done.append(found.filter(single).select("source", (F.col("first") + F.when(2 * left >= F.col("mass"), 1).otherwise(0)).alias("threshold")))
        done.append(open_.join(found.select(F.col("source").alias("_s")), F.col("source").eqNullSafe(F.col("_s")), "left_anti").select("source", F.when(F.col("rest") > 0, F.col("low") + (1 << width) if width < _BITS else F.lit(1 << _BITS)).otherwise(F.col("low")).cast("long").alias("threshold")))
        open_ = materialize(found.filter(~single).select("source", F.shiftleft("bucket", shift).alias("low"), left.alias("rest")), f"open{shift}")
        if open_.isEmpty():
            break
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return materialize(out, "thresholds")


def _plan(rows: DataFrame, weights, share: float, most: float) -> DataFrame:
    """``(_s, source_size, target, whole, threshold)``, one row per source of ``rows (source, position, size)``."""
    if most > 2:
        raise ValueError("a row is taken twice at most")
    with scratch() as keep:
        plan = materialize(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most), "targets")
        whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
        budgets = plan.withColumn("whole", whole.cast("int")).withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size"))
        cut = thresholds(rows, budgets)
        joined = budgets.join(cut.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")))
        out = materialize(joined.select(F.col("source").alias("_s"), "source_size", "target", "whole", "threshold"), "plan")
        keep.append(out)
    return out


def _sizes(docs: DataFrame, seed: str) -> DataFrame:
    return materialize(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), position(F.col("doc_id"), F.col("text"), seed).alias("position")), "sizes")


def _times(place: Column) -> Column:
    return (F.col("whole") + F.when(place < F.col("threshold"), 1).otherwise(0)).cast("int")


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: str = "") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, source, size, source_size, target, taken`` and ``times``, how often the mix takes it."""
    rows = _sizes(docs, seed)
    side = broadcast_if_small(_plan(rows, weights, share, most), 100_000)
    times = _times(F.col("position"))
    return (
        rows.join(side, F.col("source").eqNullSafe(F.col("_s")))
        .select("doc_id", "source", "size", "source_size", "target", (times * F.col("size")).cast("long").alias("taken"), times.alias("times"))
    )


def mixed(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: str = "") -> DataFrame:
    """The rows of ``docs`` that the mix takes, those taken twice in two copies, with the columns of ``docs``.

    A row's position follows from its identifier and text, so it meets only the table of
    sources: texts are read and filtered where they lie, without a shuffle.
    A row without words has size 0 and goes with the rows around its position.
    """
    side = broadcast_if_small(_plan(_sizes(docs, seed), weights, share, most), 100_000)
    rows = docs.select(F.struct("*").alias("_row"), F.col("source").alias("_source"), position(F.col("doc_id"), F.col("text"), seed).alias("_position"))
    joined = rows.join(side, F.col("_source").eqNullSafe(F.col("_s"))).withColumn("_times", _times(F.col("_position")))
    return joined.filter("_times > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times")))).select("_row.*")

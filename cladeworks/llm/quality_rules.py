"""Quality rules as weak supervision, with DataFrame functions only.

Each rule looks at a text's measures and votes good, bad, or abstains.  The
votes of all documents are counted by pattern (at most 3 to the number of
rules, so the table that reaches the driver is bounded).  Expectation-
maximisation over those counts estimates the share of good documents and how
accurate each rule is on good and on bad ones, and the posterior probability
of "good" is again a column expression.  It replaces the demand that a
document pass every rule, from which the estimation starts: a document is
taken for good with probability ``START`` if no rule votes bad, else with
``1 - START``.  From there a rule whose bad votes the others do not bear out
loses its say, and one that they do decides alone.

Null texts have no words.  All counts cover the whole text, however long;
lines are split at ``\\n``.  The windows of a text are compared by the 64-bit hash of five words.
Repeated rows count each, null identifiers stay, extra columns are ignored, an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import SPACE, WORD, materialize

#: name: (measure, good when, bad when), over the columns of ``measures``.
RULES = {
    "word_length": ("word_chars / n_words", "m between 3 and 12", "m < 2 or m > 20"),
    "symbols": ("n_symbols / n_words", "m <= 0.05", "m > 0.1"),
    "symbol_share": ("n_symbols / word_chars", "m <= 0.01", "m > 0.05"),
    "repeated_lines": ("n_dup_lines / n_lines", "m <= 0.05", "m > 0.3"),
    "repeated_windows": ("n_repeat_words / n_words", "m <= 0.05", "m > 0.2"),
    "letters": ("n_letters / word_chars", "m >= 0.8", "m < 0.65"),
    "plain_words": ("n_plain / n_words", "m >= 0.9", "m < 0.7"),
    "length": ("n_words", "m >= 50", "m < 10"),
}
ITERATIONS = 40
START = 0.9
KEEP = 0.5
#: A word of letters alone, with punctuation around it at most.
PLAIN = r"(?<![^\x20\x09-\x0D])[\"'(\[\u00AB\u201C\u2018\u00BF\u00A1]?\p{L}[\p{L}\p{M}'\u2019-]*+[.,;:!?\"')\]\u00BB\u201D\u2019\u2026]*+(?![^\x20\x09-\x0D])"


def measures(text: Column) -> list[Column]:
    """Columns that hold the base measures of a text, in the order in which they build on each other."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, SPACE + "+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    return [
        words.alias("words"),
        lines.alias("lines"),
        (F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace(text, r"\P{L}+", "")).cast("long").alias("n_letters"),
        F.regexp_count(text, F.lit(PLAIN)).cast("long").alias("n_plain"),
    ]


def _repeated(width: int = 5) -> Column:
    """Words in windows of ``width`` words that occur twice or more, the first occurrence included."""
    n = F.size("windows")
    keyed = F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    again = F.filter(
        F.transform(
            F.sequence(F.lit(0), n - 1),
            lambda k: F.when(
                F.coalesce(F.get("keyed", k)["h"] == F.get("keyed", k - 1)["h"], F.lit(False))
                | F.coalesce(F.get("keyed", k)["h"] == F.get("keyed", k + 1)["h"], F.lit(False)),
                F.get("keyed", k)["i"],
            ),
        ),
        lambda i: i.isNotNull(),
    )
    del keyed
    return again


def measured(docs: DataFrame) -> DataFrame:
    """``doc_id`` with ``n_words, word_chars, n_symbols, n_letters, n_plain, n_lines, n_dup_lines, n_repeat_words, base_failed``."""
    first = docs.select("doc_id", *measures(F.col("text")))
    window = F.transform("words", lambda w, i: F.xxhash64(w, *[F.get("words", i + k) for k in range(1, 5)]))
    counted = first.select(
        "doc_id", "n_symbols", "n_letters", "n_plain",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("words") >= 5, F.slice(window, F.lit(1), F.greatest(F.size("words") - 4, F.lit(1)))).alias("windows"),
    )
    # Few texts repeat themselves: only theirs are sorted.
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    keyed = counted.withColumn("keyed", F.when(repeats, F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    marked = keyed.withColumn("again", F.when(F.col("keyed").isNotNull(), F.array_sort(_repeated()))).drop("windows", "keyed")
    covered = F.aggregate(
        "again",
        F.struct(F.lit(-5).alias("at"), F.lit(0).alias("n")),
        lambda s, i: F.struct(i.alias("at"), (s["n"] + F.least(F.lit(5), i - s["at"])).alias("n")),
        lambda s: s["n"],
    )
    out = marked.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("again")
    return out.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def votes(rules=None) -> list[Column]:
    """For each rule 1 (good), -1 (bad) or 0 (abstains)."""
    out = []
    for name, (measure, good, bad) in (rules or RULES).items():
        top, _, under = measure.partition(" / ")
        m = f"({top} / nullif({under}, 0))" if under else f"({top})"
        fill = lambda rule, m=m: rule.replace("m ", f"{m} ")
        out.append(F.expr(f"case when {fill(bad)} then -1 when {fill(good)} then 1 else 0 end").alias(f"vote_{name}"))
    return out


def fit(patterns: list[tuple[tuple[int, ...], int]], iterations: int = ITERATIONS, start: float = START) -> tuple[float, list[dict[int, float]]]:
    """Expectation-maximisation over (votes, count) pairs.

    Returns the log-odds of "good" and for each rule what a vote of 1 or -1
    adds to them; an abstention adds nothing.  For each class a rule's rate of
    good votes among its votes is estimated with one more vote either way, the
    share of good documents with one more of either kind.
    """
    patterns = sorted(patterns)
    width = len(patterns[0][0]) if patterns else 0
    sigmoid = lambda x: 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))
    good = [1 - start if -1 in votes else start for votes, _ in patterns]
    prior, weights = 0.0, [{1: 0.0, -1: 0.0} for _ in range(width)]
    total = sum(n for _, n in patterns)
    for _ in range(iterations):
        share = (sum(n * p for (_, n), p in zip(patterns, good, strict=True)) + 1) / (total + 2)
        prior = math.log(share / (1 - share))
        for j in range(width):
            up = {k: 1 + sum(n * (p if k else 1 - p) for (v, n), p in zip(patterns, good, strict=True) if v[j] > 0) for k in (True, False)}
            down = {k: 1 + sum(n * (p if k else 1 - p) for (v, n), p in zip(patterns, good, strict=True) if v[j] < 0) for k in (True, False)}
            of_good, of_bad = (up[k] / (up[k] + down[k]) for k in (True, False))
            weights[j] = {1: math.log(of_good / of_bad), -1: math.log((1 - of_good) / (1 - of_bad))}
        good = [sigmoid(prior + sum(weights[j].get(v, 0.0) for j, v in enumerate(votes))) for votes, _ in patterns]
    return prior, weights


def judge(docs: DataFrame, rules=None, keep: float = KEEP) -> DataFrame:
    """Measures, votes, ``probability`` that the document is good, and ``kept``."""
    rules = rules or RULES
    rows = materialize(measured(docs).select("*", *votes(rules)), "measures")
    names = [f"vote_{x}" for x in rules]
    # At most 3 ** len(rules) rows.
    counts = [(tuple(r[x] for x in names), r["count"]) for r in rows.groupBy(*names).count().collect()]
    prior, weights = fit(counts) if counts else (0.0, [{1: 0.0, -1: 0.0} for _ in names])
    score = F.lit(prior)
    for name, w in zip(names, weights, strict=True):
        score = score + F.when(F.col(name) > 0, w[1]).when(F.col(name) < 0, w[-1]).otherwise(0.0)
    rows = rows.withColumn("probability", 1 / (1 + F.exp(-score)))
    return rows.withColumn("kept", ~F.col("base_failed") & (F.col("probability") >= keep))

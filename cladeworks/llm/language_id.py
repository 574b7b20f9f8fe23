"""Language identification by sparse multinomial logistic regression.

Features are hashed character 1-, 2- and 3-grams of the lower-cased text, in
which ASCII characters other than letters count as blanks, weighted by TF-IDF
and scaled to unit length.  The document frequencies cover all labelled
training texts; the regression is fitted on a bounded sample of them
(``sample_rows``, shared equally by the labels), with follow-the-regularised-
leader updates under an elastic-net penalty, which leaves most weights zero.
A temperature, chosen on a part of the sample that the fit has not seen,
calibrates the probabilities.

A text that is null or has no letter is ``und`` with score 0.  Null labels are
not learnt from; every other label is learnt, however many there are: the
sample then holds ``_LEAST`` texts of each, those first by a hash, and only weights that are
not zero are kept.  Without any labelled text everything is ``und``.  Texts are
read whole, whatever their length; of equal probabilities the label first by
code point wins.  Repeated rows count each, a null identifier is the empty
string, extra columns are ignored, an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import pickle

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import discard, materialize

DIM = 1 << 15
SAMPLE_ROWS = 4_000
#: Texts of fewer n-grams than this are counted by sorting, longer ones by histograms; both give the same counts.
_SHORT = 3_000
UNKNOWN = "und"
#: Texts of each label in the sample, at least, if it has as many.
_LEAST = 8
#: Texts drawn of each label beyond what its sample takes, so that the draw cannot run short: with 64 expected, fewer than 8 have a probability of 1e-18.
_SPARE = 56
_LETTER = regex.compile(r"\p{L}")
_BLANK = {c: " " for c in range(128) if not chr(c).isalpha()}


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Indices and counts of the hashed n-grams of a text."""
    codes = np.frombuffer(f" {text.lower().translate(_BLANK)} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    shift = np.uint32(17)
    one = codes * np.uint32(0x9E3779B1)
    two = (one[:-1] ^ np.uint32(0x85EBCA6B)) * np.uint32(31) + one[1:] * np.uint32(0xC2B2AE35)
    three = two[:-1] * np.uint32(0x165667B1) + one[2:] * np.uint32(0xD3A2646D)
    grams = np.concatenate([one >> shift, (two * np.uint32(0x27D4EB2F)) >> shift, ((three ^ (three >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> shift])
    if len(grams) < _SHORT:
        at, counts = np.unique(grams, return_counts=True)
        return at.astype(np.int64), counts
    counts = np.bincount(grams, minlength=DIM)
    at = np.flatnonzero(counts)
    return at, counts[at]


class Model:
    """Labels, document frequencies, temperature, and for each feature its labels and weights that are not zero."""

    def __init__(self, labels: list[str], idf: np.ndarray, weights: np.ndarray, bias: np.ndarray, temperature: float):
        self.labels, self.idf, self.bias, self.temperature = labels, idf.astype(np.float32), bias.astype(np.float32), temperature
        feature, label = np.nonzero(weights)
        self.label, self.weight = label.astype(np.int32), weights[feature, label].astype(np.float32)
        self.start = np.searchsorted(feature, np.arange(DIM + 1))

    def logits(self, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
        x = counts * self.idf[at]
        first, n = self.start[at], self.start[at + 1] - self.start[at]
        place = np.repeat(first - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        sums = np.bincount(self.label[place], self.weight[place] * np.repeat(x, n), len(self.labels))
        return sums / max(1e-12, float(np.sqrt(x @ x))) + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.labels or text is None or not _LETTER.search(text):
            return UNKNOWN, 0.0
        z = self.logits(*features(text)) / self.temperature
        p = np.exp(z - z.max())
        k = int(p.argmax())
        return self.labels[k], float(p[k] / p.sum())


def fit_ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.01, epochs: int = 4, seed: int = 7):
    """FTRL-proximal over sparse rows ``(indices, values, class)``; returns weights and bias.

    Only features that the rows have hold any state.
    """
    active = np.unique(np.concatenate([at for at, _, _ in rows]))
    bias = len(active)
    z, n = (np.zeros((bias + 1, classes), np.float32) for _ in range(2))
    rows = [(np.append(np.searchsorted(active, at), bias), np.append(x, 1.0).astype(np.float32), label) for at, x, label in rows]

    def weights(at):
        zz = z[at]
        return np.where(np.abs(zz) <= l1, 0.0, -(zz - np.sign(zz) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2))

    order, random = np.arange(len(rows)), np.random.default_rng(seed)
    for _ in range(epochs):
        random.shuffle(order)
        for i in order:
            at, x, label = rows[i]
            w = weights(at)
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[label] -= 1
            g = x[:, None] * p
            old = n[at]
            new = old + g * g
            z[at] += g - (np.sqrt(new) - np.sqrt(old)) / alpha * w
            n[at] = new
    w = np.zeros((DIM, classes), np.float32)
    w[active] = weights(np.arange(bias))
    return w, weights(np.array([bias]))[0]


def best_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature with the least log loss, from a grid."""
    grid = np.exp(np.linspace(np.log(0.05), np.log(5), 60))
    if not len(labels):
        return 1.0

    def loss(t):
        s = logits / t
        s = s - s.max(1, keepdims=True)
        return float(np.mean(np.log(np.exp(s).sum(1)) - s[np.arange(len(labels)), labels]))

    return float(min(grid, key=loss))


_STATS = "feature int, df long, label string, indices binary, counts binary"
_STATS_SCHEMA = pa.schema([("feature", pa.int32()), ("df", pa.int64()), ("label", pa.string()), ("indices", pa.binary()), ("counts", pa.binary())])


def _statistics(batches):
    total, sample = np.zeros(DIM + 1, np.int64), []
    for batch in batches:
        for text, label, chosen in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if not _LETTER.search(text):
                continue
            at, counts = features(text)
            total[at] += 1
            total[DIM] += 1
            if chosen:
                sample.append((label, at.astype("<u2").tobytes(), counts.astype("<u4").tobytes()))
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at]), pa.nulls(len(at), pa.string()), pa.nulls(len(at), pa.binary()), pa.nulls(len(at), pa.binary())], schema=_STATS_SCHEMA)
    if sample:
        label, indices, counts = zip(*sample, strict=True)
        k = len(label)
        yield pa.RecordBatch.from_arrays([pa.nulls(k, pa.int32()), pa.nulls(k, pa.int64()), pa.array(label), pa.array(indices, pa.binary()), pa.array(counts, pa.binary())], schema=_STATS_SCHEMA)


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept out of training: crc32 of its identifier as text, modulo 4, is 2."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 4 == 2


def train(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on the texts and labels of ``docs (doc_id, text, lang)`` that are not held out."""
    every = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    open_ = every.filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = open_.groupBy("lang").count().collect()  # a row for each label, which the model holds anyway
    if not counts:
        return Model([], np.zeros(DIM), np.zeros((DIM, 1)), np.zeros(1), 1.0)
    each = max(_LEAST, sample_rows // len(counts))
    share = F.broadcast(docs.sparkSession.createDataFrame([(r["lang"], min(1.0, (each + _SPARE) / r["count"])) for r in counts], "label string, share double"))
    point = F.pmod(F.xxhash64(F.lit("sample"), F.coalesce("doc_id", F.lit("")), "text"), F.lit(1 << 30)) / float(1 << 30)
    chosen = open_.join(share, F.col("lang") == F.col("label")).select("text", "lang", (point < F.col("share")).alias("chosen"))
    stats = materialize(chosen.mapInArrow(_statistics, _STATS), "statistics")
    # At most DIM + 1 rows.
    df = np.zeros(DIM + 1)
    for r in stats.filter("feature is not null").groupBy("feature").agg(F.sum("df").alias("df")).collect():
        df[r["feature"]] = r["df"]
    idf = np.log((1 + df[DIM]) / (1 + df[:DIM])) + 1
    # ``sample_rows`` rows, or _LEAST for each label; equal texts of a label count once, so that copies cannot add to them.
    drawn = stats.filter("label is not null").select("label", "indices", "counts").distinct().withColumn("place", F.xxhash64("indices", "counts"))
    ranked = drawn.withColumn("rank", F.row_number().over(Window.partitionBy("label").orderBy("place", "indices", "counts"))).filter(F.col("rank") <= each)
    sample = sorted(ranked.collect(), key=lambda r: (r["place"], r["label"]))
    discard(stats)
    labels = sorted({r["label"] for r in sample})
    if not labels:
        return Model([], np.zeros(DIM), np.zeros((DIM, 1)), np.zeros(1), 1.0)
    number = {x: k for k, x in enumerate(labels)}
    rows, apart, seen = [], [], set()
    for k, r in enumerate(sample):
        at, c = np.frombuffer(r["indices"], "<u2").astype(np.int64), np.frombuffer(r["counts"], "<u4")
        x = c * idf[at]
        # The first text of a label is always fitted.
        (apart if k % 5 == 4 and r["label"] in seen else rows).append((at, x / max(1e-12, np.sqrt(x @ x)), number[r["label"]]))
        seen.add(r["label"])
    weights, bias = fit_ftrl(rows, len(labels))
    logits = np.array([x @ weights[at] + bias for at, x, _ in apart]).reshape(-1, len(labels))
    return Model(labels, idf, weights, bias, best_temperature(logits, np.array([k for *_, k in apart], int)))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for each row; reads ``doc_id`` and ``text`` only."""
    shipped = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))  # the weights that are not zero
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches):
        model = _unpickled(shipped.value)
        for batch in batches:
            said = [model.predict(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([x for x, _ in said], pa.string()), pa.array([x for _, x in said], pa.float64())], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string"), held_out(F.col("doc_id"))).mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Train on ``docs`` and predict for all of it."""
    return predict(docs, train(docs, sample_rows))


def accepted(docs: DataFrame, least: float = 0.5, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of ``docs`` whose text has a language, found with probability ``least`` or more; null texts and those without a letter go."""
    shipped = docs.sparkSession.sparkContext.broadcast(pickle.dumps(train(docs, sample_rows)))

    @F.pandas_udf("boolean")
    def fits(texts: pd.Series) -> pd.Series:
        model = _unpickled(shipped.value)
        return pd.Series([k != UNKNOWN and p >= least for k, p in map(model.predict, texts)], dtype=bool)

    return docs.filter(fits(F.col("text").cast("string")))


@functools.lru_cache(2)
def _unpickled(raw: bytes) -> Model:
    return pickle.loads(raw)

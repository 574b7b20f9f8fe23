"""Cross-tokenizer alignment with corpus-wide link counts.

Two tokenizers cut the same bytes, a blank and the text: A a byte-level BPE, B
a SentencePiece model, which adds the blank itself.  Where tokens of both end,
a group ends.  Two tokens whose byte ranges overlap are linked; as both tile
the bytes, each stretch between two neighbouring ends of either is one link.

A first pass over the texts counts links by id pair within each task.  The
distinct pairs, merged in a tree of groups, get a minimal perfect hash
function, shard by shard.  Every group of tasks then turns its pairs into a dense vector of counts
indexed by that function, and the vectors are summed up the tree.  The result
keeps each index's pair, so that a foreign pair cannot borrow a count.  A
second pass aligns the texts again and looks the counts up: in a broadcast
copy of the table up to ``TABLE_BYTES``, beyond that by pairs sent to the
shards, dealt by document, so that frequent pairs load no task.

A text that is null or empty, or whose tokens do not spell the blank and the
text, has no tokens: all its numbers are 0 and its digest is empty.  Texts are
read whole, whatever their length.  Each row is aligned for itself: repeated
rows count each, null identifiers give a row, extra columns are ignored, an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_bpe import encoder
from .chunks import slices
from .pair_table import Hash, PairTable, build, pack, shard_of
from .runtime import materialize, row_ids
from .sentence_pieces import BLANK, Pieces
from .words import string_buffer

SHARD_BITS = 6
#: Vectors that one group of a tree sums.
FAN = 32
#: Bytes up to which the table of pairs is broadcast; a pair takes 17 bytes, about.
TABLE_BYTES = 96 << 20
#: Bytes of pairs that one group looks up in one shard, about.
ASKED_BYTES = 64 << 20
_SLICE = 4 << 20
#: Different chunks of text whose ids a worker holds for each tokenizer, about 200 bytes each.
KNOWN_CHUNKS = 600_000
#: Pairs that a task holds unmerged.
_HELD_PAIRS = 4 << 20


class Vocabulary:
    """The bytes of each id."""

    def __init__(self, tokens: list[bytes]):
        self.width = np.array([len(t) for t in tokens], np.int64)
        self.start = np.cumsum(self.width) - self.width
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)

    def spell(self, ids: np.ndarray) -> np.ndarray:
        n = self.width[ids]
        return self.flat[np.repeat(self.start[ids] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))]


@dataclass
class Aligned:
    """The alignment of consecutive texts; ``*_at`` says how many tokens, groups and links come before each text."""

    a: np.ndarray
    b: np.ndarray
    a_at: np.ndarray
    b_at: np.ndarray
    #: Tokens of A and of B up to the end of each group.
    group_a: np.ndarray
    group_b: np.ndarray
    group_at: np.ndarray
    #: Positions in ``a`` and ``b`` of the two tokens of each link.
    link_a: np.ndarray
    link_b: np.ndarray
    link_at: np.ndarray


class Aligner:
    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = encoder(path_a, plain=True), Pieces(path_b)
        # Both passes meet the same chunks, so more of them are held than a single encoding needs.
        self.a.table.most = self.b.table.most = KNOWN_CHUNKS
        self.a.slice_bytes = self.b.slice_bytes = 2 * _SLICE
        back = {c: bytes((x,)) for x, c in self.a.alphabet.items()}
        names = sorted((i, t) for t, i in self.a.tokenizer.get_vocab().items())
        size = names[-1][0] + 1
        spelled = [b""] * size
        for i, t in names:
            spelled[i] = b"".join(back.get(c, c.encode()) for c in t)
        self.bytes_a = Vocabulary(spelled)
        kinds = self.b.wide
        self.bytes_b = Vocabulary([bytes((int(n[3:5], 16),)) if w == 1 and len(n) == 6 and n.startswith(b"<0x") else n.replace(BLANK, b" ") for n, w in zip(self.b.names, kinds, strict=True)])
        self.base = len(self.b.names)

    @staticmethod
    def _all(model, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ids, counts = [], []
        for _, part, bounds in model.encode(raw, offsets):
            ids.append(part[: bounds[-1]].astype(np.int64))
            counts.append(np.diff(bounds))
        return (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (ids, counts))

    def align(self, raw: np.ndarray, offsets: np.ndarray) -> Aligned:
        """The alignment of the texts in a buffer."""
        n_bytes = np.diff(offsets)
        full = np.flatnonzero(n_bytes > 0)
        padded = np.insert(raw, offsets[:-1][full], 32)
        at = offsets + np.concatenate([[0], np.cumsum(n_bytes > 0)])
        a, n_a = self._all(self.a, padded, at)
        b, n_b = self._all(self.b, raw, offsets)
        n_a, n_b = np.where(n_bytes > 0, n_a, 0), np.where(n_bytes > 0, n_b, 0)
        fits = self._spells(self.bytes_a, a, n_a, padded, at) & self._spells(self.bytes_b, b, n_b, padded, at)
        if not fits.all():
            a, b = a[np.repeat(fits, n_a)], b[np.repeat(fits, n_b)]
            n_a, n_b = n_a * fits, n_b * fits
        # A text that does not fit leaves a gap; the ends of the others are where their bytes lie.
        ends_a, ends_b = self._ends(self.bytes_a, a, n_a, at), self._ends(self.bytes_b, b, n_b, at)
        marks = np.zeros(len(padded) + 1, np.uint8)
        marks[ends_a] = 1
        marks[ends_b] |= 2
        ends = np.flatnonzero(marks)
        in_a, in_b = (marks[ends] & 1).astype(np.int64), (marks[ends] >> 1).astype(np.int64)
        upto_a, upto_b = np.cumsum(in_a), np.cumsum(in_b)
        both = np.flatnonzero(in_a & in_b)
        before = lambda where: np.searchsorted(where, at, "right")
        return Aligned(
            a, b, np.concatenate([[0], np.cumsum(n_a)]), np.concatenate([[0], np.cumsum(n_b)]),
            upto_a[both], upto_b[both], before(ends[both]), upto_a - in_a, upto_b - in_b, before(ends),
        )

    @staticmethod
    def _ends(vocabulary: Vocabulary, ids: np.ndarray, counts: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where each token ends in the padded buffer."""
        ends = np.cumsum(vocabulary.width[ids])
        first = np.cumsum(counts) - counts
        shift = at[:-1] - np.concatenate([[0], ends])[first]
        return ends + np.repeat(shift, counts)

    @staticmethod
    def _spells(vocabulary: Vocabulary, ids: np.ndarray, counts: np.ndarray, padded: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Whether the tokens of each text spell its padded bytes."""
        spelled = vocabulary.spell(ids)
        if np.array_equal(spelled, padded):
            ends = np.concatenate([[0], np.cumsum(vocabulary.width[ids])])
            if np.array_equal(ends[np.concatenate([[0], np.cumsum(counts)])], at):
                return np.ones(len(counts), bool)
        stop = np.concatenate([[0], np.cumsum(vocabulary.width[ids])])[np.concatenate([[0], np.cumsum(counts)])]
        return np.array([np.array_equal(spelled[s:e], padded[x:y]) for s, e, x, y in zip(stop[:-1], stop[1:], at[:-1], at[1:], strict=True)], bool)

    def keys(self, x: Aligned) -> np.ndarray:
        """The id pair of each link as one number."""
        return (x.a[x.link_a] * self.base + x.b[x.link_b]).astype(np.uint64)


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    """The worker's aligner for two files."""
    if (path_a, path_b) not in _ALIGNERS:
        _ALIGNERS[path_a, path_b] = Aligner(path_a, path_b)
    return _ALIGNERS[path_a, path_b]


def _aligned(model: Aligner, column) -> Iterator[tuple[int, Aligned]]:
    """``(first text, alignment)`` for slices of a column of texts."""
    raw, offsets = string_buffer(column)
    for i, j in slices(offsets, _SLICE):
        yield i, model.align(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])


def written(x: Aligned) -> tuple[np.ndarray, np.ndarray]:
    """The groups as text, ``a,a|b;a|b,b;``, and where each text's part of it starts."""
    cut_a, cut_b = np.concatenate([[0], x.group_a]), np.concatenate([[0], x.group_b])
    group_of_a, group_of_b = np.repeat(np.arange(len(x.group_a)), np.diff(cut_a)), np.repeat(np.arange(len(x.group_b)), np.diff(cut_b))
    place_a, place_b = np.arange(len(x.a)) + cut_b[group_of_a], np.arange(len(x.b)) + cut_a[group_of_b + 1]
    ids, after = np.zeros(len(x.a) + len(x.b), np.int64), np.full(len(x.a) + len(x.b), ord(","), np.uint8)
    ids[place_a], ids[place_b] = x.a, x.b
    after[place_a[x.group_a - 1]], after[place_b[x.group_b - 1]] = ord("|"), ord(";")
    digits = 1 + np.searchsorted(10 ** np.arange(1, 10), ids, "right")
    start = np.concatenate([[0], np.cumsum(digits + 1)])
    out = np.empty(int(start[-1]), np.uint8)
    out[start[1:] - 1] = after
    for k in range(int(digits.max(initial=0))):
        have = np.flatnonzero(digits > k)
        out[start[have + 1] - 2 - k] = 48 + ids[have] // 10**k % 10
    return out, start[x.a_at + x.b_at]


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


_PARTIAL = "task long, shard int, keys binary, counts binary"


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if len(keys) == 1:
        return keys[0], counts[0]
    every, at = np.unique(np.concatenate(keys) if keys else np.zeros(0, np.uint64), return_inverse=True)
    return every, np.bincount(at, np.concatenate(counts) if counts else None, len(every)).astype(np.int64)


def _partials(docs: DataFrame, path_a: str, path_b: str, shard_bits: int) -> DataFrame:
    """The pairs that each task meets, with its counts of them, by shard."""
    schema = pa.schema([("task", pa.int64()), ("shard", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])

    def run(batches):
        from pyspark import TaskContext

        model, keys, counts, held = aligner(path_a, path_b), [], [], 0
        for batch in batches:
            for _, x in _aligned(model, batch.column(0)):
                k, n = np.unique(model.keys(x), return_counts=True)
                keys.append(k)
                counts.append(n)
                held += len(k)
                if held > _HELD_PAIRS:
                    k, n = _merged(keys, counts)
                    keys, counts, held = [k], [n], 0
        k, n = _merged(keys, counts)
        shard = shard_of(k, shard_bits)
        order = np.argsort(shard, kind="stable")
        k, n, cut = k[order].astype("<u8"), n[order].astype("<i8"), np.searchsorted(shard[order], np.arange((1 << shard_bits) + 1))
        rows = [(s, k[a:b].tobytes(), n[a:b].tobytes()) for s, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if b > a]
        if rows:
            s, k, n = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()] * len(s), pa.int64()), pa.array(s, pa.int32()), pa.array(k, pa.binary()), pa.array(n, pa.binary())], schema=schema)

    return _texts(docs).select("text").mapInArrow(run, _PARTIAL)


def _up(node: str = "node"):
    return F.floor(F.col(node) / FAN).cast("long").alias("node")


def _functions(partials: DataFrame, depth: int) -> DataFrame:
    """``shard, bits, sizes, keys``: each shard's hash function, and its pairs in their order under it."""

    def union(part: pd.DataFrame) -> pd.DataFrame:
        keys = np.unique(np.concatenate([np.frombuffer(k, "<u8") for k in part["keys"]]))
        return pd.DataFrame({"shard": part["shard"].iloc[:1], "node": part["node"].iloc[:1], "keys": [keys.tobytes()]})

    def function(part: pd.DataFrame) -> pd.DataFrame:
        keys = np.frombuffer(part["keys"].iloc[0], "<u8")
        bits, sizes = pack(build(keys))
        ordered = np.empty_like(keys)
        ordered[Hash([(bits, sizes)], 0).index(keys)] = keys
        return pd.DataFrame({"shard": part["shard"].iloc[:1], "bits": [bits], "sizes": [sizes], "keys": [ordered.tobytes()]})

    level = partials.select("shard", F.col("task").alias("node"), "keys")
    for _ in range(depth):
        level = level.select("shard", _up(), "keys").groupBy("shard", "node").applyInPandas(union, "shard int, node long, keys binary")
    return level.groupBy("shard").applyInPandas(function, "shard int, bits binary, sizes array<long>, keys binary")


def _vectors(partials: DataFrame, functions: DataFrame, depth: int, nodes: int) -> DataFrame:
    """``shard, counts``: the dense vectors of all groups of tasks, summed up a tree."""

    def dense(part: pd.DataFrame, function: pd.DataFrame) -> pd.DataFrame:
        if not len(part):
            return pd.DataFrame({"shard": pd.Series(dtype="int32"), "node": pd.Series(dtype="int64"), "counts": pd.Series(dtype=object)})
        place = Hash([(function["bits"].iloc[0], list(function["sizes"].iloc[0]))], 0)
        out = np.zeros(int(place.offset[-1]), np.int64)
        for k, n in zip(part["keys"], part["counts"], strict=True):
            out[place.index(np.frombuffer(k, "<u8"))] += np.frombuffer(n, "<i8")  # a task has a pair once
        return pd.DataFrame({"shard": part["shard"].iloc[:1], "node": part["node"].iloc[:1], "counts": [out.tobytes()]})

    def total(part: pd.DataFrame) -> pd.DataFrame:
        out = np.frombuffer(part["counts"].iloc[0], "<i8").copy()
        for n in part["counts"].iloc[1:]:
            out += np.frombuffer(n, "<i8")
        return pd.DataFrame({"shard": part["shard"].iloc[:1], "node": part["node"].iloc[:1], "counts": [out.tobytes()]})

    kinds = "shard int, node long, counts binary"
    spread = functions.select("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(nodes - 1).cast("long"))).alias("node"), "bits", "sizes")
    left = partials.select("shard", _up("task"), "keys", "counts").groupBy("shard", "node")
    level = left.cogroup(spread.groupBy("shard", "node")).applyInPandas(dense, kinds)
    for _ in range(depth - 1):
        level = level.select("shard", _up(), "counts").groupBy("shard", "node").applyInPandas(total, kinds)
    return level.select("shard", "counts")


def pair_table(docs: DataFrame, path_a: str, path_b: str, shard_bits: int = SHARD_BITS) -> DataFrame:
    """``shard, bits, sizes, keys, counts``: how many links of ``docs`` hold each id pair, under each shard's hash function.

    A key is ``id of A * number of pieces of B + id of B``.
    """
    partials = materialize(_partials(docs, path_a, path_b, shard_bits), "partials")
    last = partials.agg(F.max("task")).first()[0] or 0
    nodes, depth = last // FAN + 1, 1
    while FAN**depth <= last:
        depth += 1
    functions = materialize(_functions(partials, depth), "functions")
    return materialize(functions.join(_vectors(partials, functions, depth, nodes), "shard"), "pairs")


def pair_counts(table: DataFrame, pieces_of_b: int) -> DataFrame:
    """``a_id, b_id, links`` of a ``pair_table``, a row for each pair."""

    def run(batches):
        for batch in batches:
            for k, n in zip(batch.column("keys").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                k = np.frombuffer(k, "<u8").astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(k // pieces_of_b), pa.array(k % pieces_of_b), pa.array(np.frombuffer(n, "<i8"))], names=["a_id", "b_id", "links"])

    return table.select("keys", "counts").mapInArrow(run, "a_id long, b_id long, links long")


def _best(table: DataFrame, pieces_of_b: int) -> np.ndarray:
    """The highest count that each id of B has; as many numbers as B has ids."""
    out = np.zeros(pieces_of_b, np.int64)
    for r in pair_counts(table, pieces_of_b).groupBy("b_id").agg(F.max("links").alias("links")).collect():
        out[r["b_id"]] = r["links"]
    return out


REPORT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
_NUMBERS = ("n_a", "n_b", "n_groups", "n_links")


def _lines(x: Aligned) -> tuple[list[np.ndarray], list[str]]:
    """The four numbers and the digest of each text."""
    text, at = written(x)
    digests = [hashlib.sha256(text[s : e - 1]).hexdigest() if e > s else "" for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    return [np.diff(v) for v in (x.a_at, x.b_at, x.group_at, x.link_at)], digests


def _by_text(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(values)])[at])


def _with_broadcast(docs: DataFrame, table: DataFrame, best: np.ndarray, path_a: str, path_b: str, shard_bits: int) -> DataFrame:
    shards = {r["shard"]: (bytes(r["bits"]), list(r["sizes"]), bytes(r["keys"]), bytes(r["counts"])) for r in table.collect()}
    pairs = PairTable([shards.get(k, (b"", [], b"", b"")) for k in range(1 << shard_bits)], shard_bits)
    shipped = docs.sparkSession.sparkContext.broadcast(pickle.dumps((pairs, best)))
    schema = pa.schema([(c.split()[0], pa.string() if c.endswith("string") else pa.int64()) for c in REPORT.split(", ")])

    def run(batches):
        model, (pairs, best) = aligner(path_a, path_b), pickle.loads(shipped.value)
        for batch in batches:
            for i, x in _aligned(model, batch.column(1)):
                key, at = np.unique(model.keys(x), return_inverse=True)
                count = pairs.count(key)
                top = count == best[(key % np.uint64(model.base)).astype(np.int64)]
                numbers, digests = _lines(x)
                sums = [_by_text(top[at].astype(np.int64), x.link_at), _by_text(count[at], x.link_at)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, len(digests)), *map(pa.array, (*numbers, *sums)), pa.array(digests, pa.string())], schema=schema)

    return _texts(docs).mapInArrow(run, REPORT)


_ASKED = "row_id long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, asked array<struct<shard: int, keys: binary, times: binary>>"


def _with_shuffle(docs: DataFrame, table: DataFrame, best: np.ndarray, path_a: str, path_b: str, shard_bits: int) -> DataFrame:
    asked = pa.list_(pa.struct([("shard", pa.int32()), ("keys", pa.binary()), ("times", pa.binary())]))
    schema = pa.schema([*[(c, pa.int64()) for c in ("row_id", "doc_id", *_NUMBERS)], ("groups_sha256", pa.string()), ("asked", asked)])

    def run(batches):
        from pyspark import TaskContext

        model, task, seen = aligner(path_a, path_b), TaskContext.get().partitionId(), 0
        for batch in batches:
            for i, x in _aligned(model, batch.column(1)):
                numbers, digests = _lines(x)
                key, wanted = model.keys(x), []
                for s, e in zip(x.link_at[:-1], x.link_at[1:], strict=True):
                    k, n = np.unique(key[s:e], return_counts=True)
                    shard = shard_of(k, shard_bits)
                    wanted.append([{"shard": int(w), "keys": k[shard == w].astype("<u8").tobytes(), "times": n[shard == w].astype("<i8").tobytes()} for w in np.unique(shard)])
                ids = row_ids(task, seen, len(digests))
                seen += len(digests)
                yield pa.RecordBatch.from_arrays([pa.array(ids), batch.column(0).slice(i, len(digests)), *map(pa.array, numbers), pa.array(digests, pa.string()), pa.array(wanted, asked)], schema=schema)

    rows = materialize(_texts(docs).mapInArrow(run, _ASKED), "asked")
    lists = rows.select("row_id", F.inline("asked"))
    deals = (lists.agg(F.sum(2 * F.octet_length("keys"))).first()[0] or 0) // (ASKED_BYTES << shard_bits) + 1
    base, shipped = aligner(path_a, path_b).base, docs.sparkSession.sparkContext.broadcast(best)

    def look(part: pd.DataFrame, shard: pd.DataFrame) -> pd.DataFrame:
        if not len(part):
            return pd.DataFrame({"row_id": pd.Series(dtype="int64"), "n_best": pd.Series(dtype="int64"), "count_sum": pd.Series(dtype="int64")})
        row = shard.iloc[0]
        pairs, best, out = PairTable([(row["bits"], list(row["sizes"]), row["keys"], row["counts"])], 0), shipped.value, []
        for row_id, k, n in zip(part["row_id"], part["keys"], part["times"], strict=True):
            k, n = np.frombuffer(k, "<u8"), np.frombuffer(n, "<i8")
            count = pairs.count(k)
            out.append((row_id, int(n[count == best[(k % np.uint64(base)).astype(np.int64)]].sum()), int(n @ count)))
        return pd.DataFrame(out, columns=["row_id", "n_best", "count_sum"])

    dealt = lists.withColumn("deal", F.pmod(F.xxhash64("row_id"), F.lit(deals)))
    copies = table.withColumn("deal", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(deals - 1).cast("long"))))
    looked = dealt.groupBy("shard", "deal").cogroup(copies.groupBy("shard", "deal")).applyInPandas(look, "row_id long, n_best long, count_sum long")
    sums = looked.groupBy("row_id").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    joined = rows.drop("asked").join(sums, "row_id", "left")
    return joined.select("doc_id", *_NUMBERS, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_best", "count_sum")], "groups_sha256")


def report(docs: DataFrame, path_a: str, path_b: str, shard_bits: int = SHARD_BITS, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """Per row of ``docs (doc_id, text)`` its numbers of tokens, groups and links, how many links have their piece's highest count, the sum of its links' counts, and a digest of its groups."""
    table = pair_table(docs, path_a, path_b, shard_bits)
    size = table.agg(F.sum(2 * F.octet_length("keys") + F.octet_length("bits"))).first()[0] or 0
    best = _best(table, aligner(path_a, path_b).base)
    way = _with_broadcast if size <= table_bytes else _with_shuffle
    return way(docs, table, best, path_a, path_b, shard_bits)


def align(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """``doc_id, a_ids, b_ids, group_a, group_b``: the ids of both sides, and how many ids of each the groups up to each one hold."""
    lists = pa.list_(pa.int32())
    schema = pa.schema([("doc_id", pa.int64()), *[(c, lists) for c in ("a_ids", "b_ids", "group_a", "group_b")]])

    def run(batches):
        model = aligner(path_a, path_b)
        for batch in batches:
            for i, x in _aligned(model, batch.column(1)):
                n = len(x.a_at) - 1
                cut = lambda values, at: [values[s:e].astype(np.int32) for s, e in zip(at[:-1], at[1:], strict=True)]
                groups = [[g - first for g, first in zip(cut(ends, x.group_at), at, strict=False)] for ends, at in ((x.group_a, x.a_at), (x.group_b, x.b_at))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, n), *(pa.array(c, lists) for c in (cut(x.a, x.a_at), cut(x.b, x.b_at), *groups))], schema=schema)

    return _texts(docs).mapInArrow(run, "doc_id long, a_ids array<int>, b_ids array<int>, group_a array<int>, group_b array<int>")

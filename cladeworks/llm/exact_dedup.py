"""Exact deduplication with Patricia-trie owners.

Every scan partition inserts its normalised texts, as full byte strings, into
a compressed radix trie.  A terminal node owns all equal texts of the
partition, so a group of copies leaves the partition as one row however large
it is.  The owners are then dealt by length and content hash; each of those
partitions inserts the full byte strings into a second trie, whose terminal
nodes keep the best row and its identifier.  A trie that outgrows its budget
spills its heaviest subtree: in the first pass the owners below it go out
early and merge in the second, in the second only complete groups are in it.

Texts are equal when identical after deleting every white-space byte
(``[\\x20\\x09-\\x0D]``).  Of equal texts the row with the most code points in
the original text stays, then the smallest ``doc_id`` (null last), then the
first row read.  Null and empty texts are equal to each other.  Repeated rows
count as copies, texts are compared whole whatever their length, extra columns
are ignored, an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import SPACE, broadcast_if_small, materialize, row_ids, scratch
from .words import SPACE_BYTES

TRIE_BYTES = 64 << 20
_NO_DOC = 2**63 - 1


class PatriciaTrie:
    """A radix trie over byte strings; each node holds an edge label, children by first byte, and a value."""

    def __init__(self):
        self.root = [b"", {}, None]
        self.bytes = 0

    def node(self, key: bytes) -> list:
        """The terminal node of ``key``, made if absent."""
        node, at, n = self.root, 0, len(key)
        while at < n:
            child = node[1].get(key[at])
            if child is None:
                child = node[1][key[at]] = [key[at:], {}, None]
                self.bytes += n - at + 300
                return child
            label = child[0]
            if key.startswith(label, at):
                node, at = child, at + len(label)
                continue
            low, high = 1, min(len(label), n - at)
            while low < high:
                mid = (low + high + 1) // 2
                if key[at : at + mid] == label[:mid]:
                    low = mid
                else:
                    high = mid - 1
            fork = [label[:low], {label[low]: child}, None]
            child[0] = label[low:]
            node[1][key[at]] = fork
            self.bytes += 300
            node, at = fork, at + low
        return node

    @staticmethod
    def _weight(node: list) -> int:
        total, stack = 0, [node]
        while stack:
            x = stack.pop()
            total += len(x[0]) + 300
            stack.extend(x[1].values())
        return total

    def spill(self, share: float = 0.5):
        """Remove the heaviest subtree that holds at least about half of the trie; yield its (key, value) pairs."""
        prefix, node = b"", self.root
        while node[1]:
            weights = {b: self._weight(x) for b, x in node[1].items()}
            b = max(weights, key=weights.get)
            child = node[1][b]
            if weights[b] < share * self.bytes or not child[1] or child[2] is not None:
                break
            inner = max(self._weight(x) for x in child[1].values())
            if inner < share * self.bytes:
                break
            prefix, node = prefix + child[0], child
        victims = sorted(node[1], key=lambda b: -self._weight(node[1][b]))
        freed, goal = 0, share * self.bytes
        for b in victims:
            if freed >= goal:
                break
            child = node[1].pop(b)
            freed += self._weight(child)
            yield from self._items(prefix, child)
        self.bytes -= freed

    def items(self):
        yield from self._items(b"", self.root)

    @staticmethod
    def _items(prefix: bytes, node: list):
        stack = [(prefix, node)]
        while stack:
            prefix, x = stack.pop()
            key = prefix + x[0]
            if x[2] is not None:
                yield key, x[2]
            stack.extend((key, child) for child in x[1].values())


_LOCAL = "uid long, doc_id long, owner long, length long, hash long, text binary, best_chars long, best_doc long, best_uid long, n long"


def _local_owners(budget: int):
    schema = pa.schema([(c.split()[0], {"long": pa.int64(), "binary": pa.binary()}[c.split()[1]]) for c in _LOCAL.split(", ")])

    def owner_batches(items):
        import xxhash

        rows, size = [], 0
        for key, (owner, chars, doc, uid, n) in items:
            h = xxhash.xxh3_64_intdigest(key)
            rows.append((None, None, owner, len(key), h - (1 << 64) if h >> 63 else h, key, -chars, doc, uid, n))
            size += len(key)
            if size > 8 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    def run(batches):
        from pyspark import TaskContext

        partition, seen, owners = TaskContext.get().partitionId(), 0, 0
        trie = PatriciaTrie()
        for batch in batches:
            n = batch.num_rows
            uid = row_ids(partition, seen, n)
            seen += n
            docs = batch.column(0)
            doc = docs.fill_null(_NO_DOC).to_numpy(zero_copy_only=False).tolist()
            text = batch.column(1)
            chars = pc.utf8_length(text.fill_null("")).to_pylist()
            own = np.empty(n, np.int64)
            for i, raw in enumerate(text.cast(pa.binary())):
                key = (raw.as_py() or b"").translate(None, SPACE_BYTES)
                node = trie.node(key)
                rank = (-chars[i], doc[i], int(uid[i]))
                value = node[2]
                if value is None:
                    node[2] = [(partition << 40) + owners, *rank, 1]
                    own[i] = node[2][0]
                    owners += 1
                else:
                    own[i] = value[0]
                    value[4] += 1
                    if rank < tuple(value[1:4]):
                        value[1:4] = rank
                if trie.bytes > budget:
                    yield from owner_batches(trie.spill())
            nothing = pa.nulls(n, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(uid), docs.cast(pa.int64()), pa.array(own), nothing, nothing, pa.nulls(n, pa.binary()), nothing, nothing, nothing, nothing], schema=schema
            )
        yield from owner_batches(trie.items())

    return run


_MERGED = "owner long, keep_id long, keep_uid long, group_size long, text_sha256 string"


def _merge_owners(budget: int):
    schema = pa.schema([("owner", pa.int64()), ("keep_id", pa.int64()), ("keep_uid", pa.int64()), ("group_size", pa.int64()), ("text_sha256", pa.string())])

    def batches_of(items):
        columns = [[], [], [], [], []]
        for key, (rank, n, owners) in items:
            digest = hashlib.sha256(key).hexdigest()
            for owner in owners:
                for c, x in zip(columns, (owner, None if rank[1] == _NO_DOC else rank[1], rank[2], n, digest), strict=True):
                    c.append(x)
            if len(columns[0]) >= 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, schema, strict=True)], schema=schema)
                columns = [[], [], [], [], []]
        if columns[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, schema, strict=True)], schema=schema)

    def run(batches):
        trie, group = PatriciaTrie(), None
        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                owner, length, h, text, chars, doc, uid, n = r
                if (length, h) != group:
                    group = (length, h)
                    if trie.bytes > budget:
                        yield from batches_of(trie.spill())
                node, rank = trie.node(text), (-chars, doc, uid)
                if node[2] is None:
                    node[2] = [rank, n, [owner]]
                else:
                    node[2][0] = min(node[2][0], rank)
                    node[2][1] += n
                    node[2][2].append(owner)
        yield from batches_of(trie.items())

    return run


def exact_groups(docs: DataFrame, trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``."""
    local = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_local_owners(trie_bytes), _LOCAL), "owners")
    owners = local.filter("uid is null").select("owner", "length", "hash", "text", "best_chars", "best_doc", "best_uid", "n")
    merged = owners.repartition("length", "hash").sortWithinPartitions("length", "hash").mapInArrow(_merge_owners(trie_bytes), _MERGED)
    members = local.filter("uid is not null").select("uid", "doc_id", "owner")
    # Both sides are plain tables, so that a hot owner's rows can be split by adaptive execution.
    return members.join(materialize(merged, "merged"), "owner").select(
        "doc_id", "keep_id", "group_size", (F.col("uid") == F.col("keep_uid")).alias("kept"), "text_sha256", "uid"
    )


def deduplicate(docs: DataFrame, trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns, whatever their names.

    Rows are dropped by ``doc_id``; where several rows share one or have none, the text
    decides as well.  Of their equal texts the longest original stays, then the
    first by code points, then the first row as JSON, so that reruns agree.
    """
    with scratch() as keep:
        groups = materialize(exact_groups(docs, trie_bytes), "groups")
        keep.append(groups)
    shared = materialize(groups.groupBy("doc_id").count().filter("count > 1 or doc_id is null").select(F.col("doc_id").alias("shared_id")), "shared_ids")
    dropped = materialize(groups.filter("not kept").select(F.col("doc_id").alias("dropped_id")), "dropped_ids")
    # Input columns move as one struct, so that none can meet a name used here.
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"))
    if shared.isEmpty():
        return rows.join(broadcast_if_small(dropped), F.col("id") == F.col("dropped_id"), "left_anti").select("row.*")
    is_shared, is_dropped = F.col("id").eqNullSafe(F.col("shared_id")), F.col("id").eqNullSafe(F.col("dropped_id"))
    plain = rows.join(shared, is_shared, "left_anti").join(dropped, is_dropped, "left_anti").select("row")
    text = F.coalesce(F.col("row.text").cast("string"), F.lit(""))
    digest = F.sha2(F.regexp_replace(text, SPACE, ""), 256)
    first = F.min_by("row", F.struct(-F.length(text), text, F.to_json("row")))
    kept = groups.filter("kept").select(F.col("doc_id").alias("kept_id"), F.col("text_sha256").alias("kept_digest")).distinct()
    several = (
        rows.join(shared, is_shared, "left_semi").withColumn("digest", digest).join(kept, F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("digest") == F.col("kept_digest")), "left_semi")
        .groupBy("id", "digest").agg(first.alias("row")).select("row")
    )
    return plain.unionByName(several).select("row.*")

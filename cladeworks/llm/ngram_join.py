"""Size-aware heavy-light Jaccard join on word shingles.

Documents become sets of 64-bit shingle hashes; equal sets form a class with
one representative.  Two sets of sizes s <= t link when their overlap is at
least ``need(s, t)``.

*Small sets* (up to a boundary that the size histogram and the two costs
choose) enumerate, for every partner size, their subsets of exactly
``need(s, t)`` shingles: a shared subset is a link.

*Large sets* scan inverted lists.  Shingles are ordered by hash, frequent ones
last, and each set enters the lists of its first
``n - ceil(J n) + 1`` shingles, which two linked sets must share one of.  The
frequent shingles come from counts that every partition makes of the shingles
it sees twice or more; a different choice changes the cost but no
result.  At most ``MAX_FREQUENT`` of them, the most frequent, are broadcast.

Only classes of linked documents are asked for, so lists are not expanded into
pairs at once.  First each list ties its sets to one pivot; a list of more than
``HOT_LIST`` sets is dealt to several tasks and its parts are tied after.  Two linked sets
share so many of their first shingles that counting common lists rejects nearly
all others.  The ties that pass are verified on whole texts, and sets that they
connect get one label.  Then only pairs of different labels are looked
at, with the same count: short lists give pairs whose counts are summed, lists of more than
``LONG_LIST`` sets are cut into blocks of bounded size, and each task compares
two blocks by one matrix product.  A first pass over the blocks takes only the
``NEAREST`` candidates of each set in each list, and its best one of all short lists; these are
verified and connected.  A second pass takes every pair whose sets are still
apart, and all of those are verified.  No pair is given up for cost.

Null and empty texts and texts without words have no shingles and link with
nothing.  Rows whose ``doc_id`` is null have no component.  Repeated rows are
equal sets.  Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .runtime import MOST_BROADCAST, broadcast_if_small, materialize, scratch, shuffled
from .words import mix64, shingle_sets

WIDTH = 5
PERCENT = 75
FREQUENT = 8
MAX_FREQUENT = 1_000_000
LONG_LIST = 64
BLOCK = 512
MAX_SMALL = 12
NEAREST = 1
_LOCAL_FREQUENT = 2
#: Shingles whose repetitions a task counts at once.
_HELD_SHINGLES = 4_000_000
_POSTINGS_A_TASK = 1_500_000
#: Postings that a task holds before it hands them on.
_HELD_POSTINGS = 250_000
#: A list of more sets than this is dealt to several tasks by set; each ties its sets, then the parts are tied.
HOT_LIST = 1_000_000
_SLICE_ROWS = 512
_SUBSET, _SAME = np.uint32(1 << 31), np.uint32(1 << 30)
_SIZE = np.uint32((1 << 30) - 1)


def need(s, t, percent: int = PERCENT):
    """Least overlap of linked sets of these sizes: 100 * overlap >= percent * union."""
    return -(-percent * (s + t) // (100 + percent))


def prefix(n, percent: int = PERCENT):
    """Number of first shingles of a set of n, of which a linked set has at least one among its own."""
    return n + (-percent * n // 100) + 1


def _key(shingles: np.ndarray) -> tuple[int, int]:
    a, b = np.frombuffer(hashlib.blake2b(shingles.tobytes(), digest_size=16).digest(), "<i8")
    return int(a), int(b)


def _each_set(batch, width):
    """Yield ``(row, shingles)``, a slice of the batch at a time."""
    texts = batch.column(1)
    for at in range(0, batch.num_rows, _SLICE_ROWS):
        for k, shingles in enumerate(shingle_sets(texts.slice(at, _SLICE_ROWS), width)):
            yield at + k, shingles


_SETS = "doc_id long, n long, k1 long, k2 long, shingle long, df long"
_SETS_SCHEMA = pa.schema([(x.split()[0], pa.int64()) for x in _SETS.split(", ")])


def _sets(width: int):
    def frequent(held):
        """The shingles that ``held`` has twice or more, with their counts; it is sorted in place, as a worker's memory is short."""
        held.sort()
        again = np.flatnonzero(held[1:] == held[:-1])
        at, more = _runs(held[again])
        u, c = held[again[at]], more + 1
        u, c = u[c >= _LOCAL_FREQUENT], c[c >= _LOCAL_FREQUENT]
        nothing = pa.nulls(len(u), pa.int64())
        return pa.RecordBatch.from_arrays([nothing, nothing, nothing, nothing, pa.array(u.view(np.int64)), pa.array(c.astype(np.int64))], schema=_SETS_SCHEMA)

    def run(batches):
        seen, held, size = set(), np.empty(_HELD_SHINGLES, np.uint64), 0
        for batch in batches:
            rows = []
            for _, shingles in _each_set(batch, width):
                key = _key(shingles)
                rows.append((len(shingles), *key))
                if len(shingles) and key not in seen:
                    seen.add(key)
                    if size + len(shingles) > len(held):
                        if size:
                            yield frequent(held[:size])
                        held, size = held if len(held) >= len(shingles) else np.empty(len(shingles), np.uint64), 0
                    held[size : size + len(shingles)] = shingles
                    size += len(shingles)
            n, k1, k2 = (pa.array(x, pa.int64()) for x in (zip(*rows, strict=True) if rows else ((), (), ())))
            nothing = pa.nulls(len(rows), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), n, k1, k2, nothing, nothing], schema=_SETS_SCHEMA)
            del batch  # before the next one comes
        if size:
            yield frequent(held[:size])

    return run


def frequent_shingles(sets: DataFrame, least: int = FREQUENT, most: int = MAX_FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the shingles with the highest counts, above ``least`` and ``most`` of them at most, and their counts."""
    counts = materialize(sets.filter("shingle is not null").groupBy("shingle").agg(F.sum("df").alias("df")).filter(F.col("df") > least), "frequent")
    by_power = {r["p"]: r["count"] for r in counts.groupBy(F.floor(F.log2("df")).alias("p")).count().collect()}
    total, floor = 0, 0
    for p in sorted(by_power, reverse=True):
        total += by_power[p]
        if total > most:
            floor = 2 ** (p + 1)
            break
    rows = counts.filter(F.col("df") >= floor).select("shingle", "df").toArrow()
    shingle, df = rows.column(0).to_numpy().astype(np.int64).view(np.uint64), rows.column(1).to_numpy().astype(np.int64)
    order = np.argsort(shingle)
    return shingle[order], df[order]


def subset_signatures(n: int, percent: int = PERCENT) -> list[tuple[int, int, int]]:
    """``(smaller size, larger size, subset size)`` of all partner sizes of a small set of n; equal sets are classes already."""
    sizes = [(s, n) for s in range(1, n) if need(s, n, percent) <= s]
    if need(n, n, percent) < n:
        sizes.append((n, n))
    t = n + 1
    while need(n, t, percent) <= n:
        sizes.append((n, t))
        t += 1
    return [(s, t, need(s, t, percent)) for s, t in sizes]


def boundary(histogram: dict[int, int], list_cost: float, percent: int = PERCENT, most: int = MAX_SMALL) -> int:
    """The size up to which enumerating subsets costs less than scanning lists."""
    best, x = None, 0
    for limit in range(most + 1):
        cost = 0.0
        for n, count in histogram.items():
            if n <= limit:
                cost += count * sum(comb(n, k) for _, _, k in subset_signatures(n, percent))
            if n > limit or need(n, limit + 1, percent) <= n:
                cost += count * prefix(n, percent) * list_cost
        if best is None or cost < best:
            best, x = cost, limit
    return x


def _member(sorted_values: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which of ``x`` are in ``sorted_values``, their places there)."""
    if not len(sorted_values):
        return np.zeros(len(x), bool), np.zeros(len(x), np.int64)
    at = np.minimum(np.searchsorted(sorted_values, x), len(sorted_values) - 1)
    return sorted_values[at] == x, at


def _collapsed(token: np.ndarray, key: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The entries of one task's subset lists with its connected sets made one.

    Sets of one size that share a subset link.  Each is tied to the least of
    them by a list of two of their own, and then every list needs one set of each
    connected part: a set elsewhere that links with the others of the part links
    with that one.  So a subset that very many sets share, as those of a
    template do, has a few entries from each task.
    """
    subset = (size & _SUBSET) > 0
    if not subset.any():
        return token, key, size
    t, k, z = token[subset], key[subset], size[subset]
    keys, at = np.unique(k, return_inverse=True)
    same = np.flatnonzero(z & _SAME)
    order = same[np.lexsort((at[same], t[same]))]
    first, length = _runs(t[order])
    u, v = at[order], np.repeat(at[order][first], length)
    edges = np.unique(np.stack([u, v], 1)[u != v], axis=0)
    if not len(edges):
        return token, key, size
    label = np.arange(len(keys))
    while True:  # the least label runs along the edges, and by jumps, until nothing changes
        least = label.copy()
        np.minimum.at(least, edges[:, 0], label[edges[:, 1]])
        np.minimum.at(least, edges[:, 1], label[edges[:, 0]])
        least = least[least]
        if np.array_equal(least, label):
            break
        label = least
    n = np.zeros(len(keys), np.uint32)
    n[at] = z & _SIZE
    order = np.lexsort((at, label[at], z, t))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (t[order][1:] != t[order][:-1]) | (z[order][1:] != z[order][:-1]) | (label[at][order][1:] != label[at][order][:-1])
    kept = order[fresh]
    of_tie = mix64(keys[edges[:, 0]].view(np.uint64) ^ mix64(keys[edges[:, 1]].view(np.uint64)))
    tied = [np.repeat(of_tie, 2), keys[edges].reshape(-1), np.repeat(n[edges[:, 0]] | _SUBSET | _SAME, 2)]
    return tuple(np.concatenate([x[~subset], y, w]) for x, y, w in zip((token, key, size), (t[kept], k[kept], z[kept]), tied, strict=True))


def _postings(width: int, percent: int, small: int, buckets: int, frequent, hot: tuple[np.ndarray, np.ndarray]):
    """Blobs of postings by bucket.  ``hot`` holds sorted tokens and how many buckets of its own each has, after the others."""
    hot_tokens, hot_parts = hot
    hot_first = buckets + np.cumsum(hot_parts) - hot_parts

    def flush(parts):
        token, key, size = _collapsed(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        bucket = ((token >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
        apart, at = _member(hot_tokens, token)
        if apart.any():
            part = mix64(key[apart].view(np.uint64)) % hot_parts[at[apart]].astype(np.uint64)
            bucket[apart] = hot_first[at[apart]].astype(np.uint64) + part
        order = np.argsort(bucket, kind="stable")
        token, key, size, bucket = token[order], key[order], size[order], bucket[order]
        at = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, int)
        stop = np.append(at[1:], len(bucket))
        blobs = [token[a:b].tobytes() + key[a:b].tobytes() + size[a:b].tobytes() for a, b in zip(at.tolist(), stop.tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(bucket[at].astype(np.int64)), pa.array(blobs, pa.binary())], names=["bucket", "blob"])

    def run(batches):
        heavy = np.frombuffer(frequent.value, np.uint64)
        seen, parts, held = set(), [], 0
        for batch in batches:
            for _, shingles in _each_set(batch, width):
                n = len(shingles)
                key = _key(shingles)
                if not n or key in seen:
                    continue
                seen.add(key)
                if n <= small:
                    token, size = [], []
                    for s, t, k in subset_signatures(n, percent):
                        for subset in combinations(shingles.tolist(), k):
                            token.append(hash((s, t, subset)) & (2**64 - 1))
                            size.append(n | int(_SUBSET) | (int(_SAME) if s == t else 0))
                    if token:
                        parts.append((mix64(np.array(token, np.uint64)), np.full(len(token), key[0], np.int64), np.array(size, np.uint32)))
                        held += len(token)
                if n > small or need(n, small + 1, percent) <= n:
                    if len(heavy):
                        common = heavy[np.minimum(np.searchsorted(heavy, shingles), len(heavy) - 1)] == shingles
                        ordered = np.concatenate([shingles[~common], shingles[common]])
                    else:
                        ordered = shingles
                    first = ordered[: prefix(n, percent)]
                    parts.append((first, np.full(len(first), key[0], np.int64), np.full(len(first), n, np.uint32)))
                    held += len(first)
                if held > _HELD_POSTINGS:
                    yield flush(parts)
                    parts, held = [], 0
            del batch
        if parts:
            yield flush(parts)

    return run


_LISTS = "gid long, key long, n long, subset boolean, size long, pivot long"
_LISTS_SCHEMA = pa.schema([("gid", pa.int64()), ("key", pa.int64()), ("n", pa.int64()), ("subset", pa.bool_()), ("size", pa.int64()), ("pivot", pa.int64())])


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, lengths) of the runs of equal values."""
    at = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)
    return at, np.diff(np.append(at, len(x)))


def _lists(percent: int, hot_tokens: np.ndarray):
    """Lists of two sets or more, each set tied to a pivot; parts of hot lists are kept whole."""

    def run(batches):
        token, key, size = [], [], []
        for batch in batches:
            for blob in batch.column(1):
                raw = blob.as_py()
                m = len(raw) // 20
                token.append(np.frombuffer(raw, np.uint64, m))
                key.append(np.frombuffer(raw, np.int64, m, 8 * m))
                size.append(np.frombuffer(raw, np.uint32, m, 16 * m))
        if not token:
            return
        token, key, size = (np.concatenate(x) for x in (token, key, size))
        order = np.argsort(token, kind="stable")
        at, length = _runs(token[order])
        order = order[np.repeat((length > 1) | _member(hot_tokens, token[order][at])[0], length)]
        token, key, size = token[order], key[order], size[order]
        n = (size & _SIZE).astype(np.int64)
        order = np.lexsort((key, n, token))
        token, key, size, n = token[order], key[order], size[order], n[order]
        fresh = np.ones(len(token), bool)
        fresh[1:] = (token[1:] != token[:-1]) | (key[1:] != key[:-1]) | (n[1:] != n[:-1])
        token, key, size, n = token[fresh], key[fresh], size[fresh], n[fresh]
        at, length = _runs(token)
        keep = np.repeat((length > 1) | _member(hot_tokens, token[at])[0], length)
        token, key, size, n = token[keep], key[keep], size[keep], n[keep]
        if not len(token):
            return
        at, length = _runs(token)
        group = np.repeat(np.arange(len(at)), length)
        subset, same = (size & _SUBSET) > 0, (size & _SAME) > 0
        # The set with the least key is the pivot of all sets that it can link with; others take their neighbour by size.
        least = np.minimum.reduceat(key, at)[group]
        where = np.flatnonzero(key == least)
        of_pivot = np.zeros(len(at), np.int64)
        of_pivot[group[where]] = n[where]
        low, high = np.minimum(n, of_pivot[group]), np.maximum(n, of_pivot[group])
        pivot, known = least.copy(), (need(low, high, percent) <= low) & (key != least)
        before = np.concatenate([[0], np.arange(len(n) - 1)])
        by_size = ~known & (key != least) & (group[before] == group) & (before != np.arange(len(n))) & (need(n[before], n, percent) <= n[before])
        pivot[by_size], known = key[before][by_size], known | by_size
        # Subsets of two sizes: each side is tied to the least key of the other side.
        first_n, last_n = n[at][group], n[at + length - 1][group]
        two = subset & ~same
        if two.any():
            none = np.int64(2**63 - 1)
            left = np.minimum.reduceat(np.where(n == first_n, key, none), at)[group]
            right = np.minimum.reduceat(np.where(n != first_n, key, none), at)[group]
            pivot = np.where(two, np.where(n == first_n, right, left), pivot)
            known = np.where(two, first_n != last_n, known)
        yield pa.RecordBatch.from_arrays(
            [pa.array(token.view(np.int64)), pa.array(key), pa.array(n), pa.array(subset), pa.array(length[group]), pa.array(pivot, mask=~known)], schema=_LISTS_SCHEMA
        )

    return run


def _joined_parts(lists: DataFrame, hot_tokens: np.ndarray) -> DataFrame:
    """``lists`` with the parts of hot lists made one: their sizes are summed, and the pivots of parts tied to each other.

    A part's pivot is its least key; with partners of other sizes tied as in
    one list, pivots of one size are tied in a chain, and so are neighbours by size.
    """
    hot = [int(x) for x in hot_tokens.view(np.int64)]
    if not hot:
        return lists
    named = F.broadcast(lists.sparkSession.createDataFrame([(x,) for x in hot], "hot long"))
    cold = lists.join(named, F.col("gid") == F.col("hot"), "left_anti")
    inside = materialize(lists.join(named, F.col("gid") == F.col("hot"), "left_semi"), "hot_lists")
    sizes = F.broadcast(inside.groupBy(F.col("gid").alias("hot")).agg(F.count("*").alias("whole")))
    whole = inside.join(sizes, F.col("gid") == F.col("hot")).select("gid", "key", "n", "subset", F.col("whole").alias("size"), "pivot")
    # Of each size the least key in the whole list: a row for each size of each hot list, so that windows hold no more.
    least = materialize(inside.groupBy("gid", "n").agg(F.min("key").alias("key")), "hot_sizes")
    before = Window.partitionBy("gid").orderBy("n")
    ties = least.select("gid", "key", "n", F.lit(False).alias("subset"), F.lit(0).cast("long").alias("size"), F.lag("key").over(before).alias("pivot"))
    first = broadcast_if_small(least.select(F.col("gid").alias("g"), F.col("n").alias("m"), F.col("key").alias("first")))
    same = inside.filter("pivot is null or key < pivot").join(first, (F.col("gid") == F.col("g")) & (F.col("n") == F.col("m")))
    chained = same.filter("key != first").select("gid", "key", "n", F.lit(False).alias("subset"), F.lit(0).cast("long").alias("size"), F.col("first").alias("pivot"))
    return cold.unionByName(whole).unionByName(ties.filter("pivot is not null").unionByName(chained))


_LINKS = "a long, b long"
_LINKS_SCHEMA = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _verify(width: int, percent: int):
    def run(batches):
        group, pivots = None, []
        for batch in batches:
            found_a, found_b = [], []
            a, salt, role, expected = (batch.column(k).to_pylist() for k in range(4))
            texts = batch.column(4)
            for at in range(0, batch.num_rows, _SLICE_ROWS):
                for k, shingles in enumerate(shingle_sets(texts.slice(at, _SLICE_ROWS), width), at):
                    if (a[k], salt[k]) != group:
                        group, pivots = (a[k], salt[k]), []
                    if _key(shingles)[0] != expected[k]:
                        continue
                    if role[k] == 0:
                        pivots.append((expected[k], shingles))
                        continue
                    for pivot_key, pivot in pivots:
                        s, t = sorted((len(pivot), len(shingles)))
                        if need(s, t, percent) <= s and _overlap(pivot, shingles) >= need(s, t, percent):
                            found_a.append(pivot_key)
                            found_b.append(expected[k])
            yield pa.RecordBatch.from_arrays([pa.array(found_a, pa.int64()), pa.array(found_b, pa.int64())], schema=_LINKS_SCHEMA)

    return run


def _overlap(x: np.ndarray, y: np.ndarray) -> int:
    if len(x) > len(y):
        x, y = y, x
    return int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum()) if len(y) else 0


def verified(docs: DataFrame, pairs: DataFrame, classes: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """Of ``pairs (a, b)`` of set keys those that link.

    Whole texts of the sets at hand go to their pivot; a pivot with many
    partners is repeated for parts of them.
    """
    keys = pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct()
    ids = materialize(shuffled(keys).join(classes.select(F.col("k1").alias("key"), F.col("rep")), "key").select("key", F.col("rep").alias("_doc")), "candidates")
    texts = materialize(docs.join(broadcast_if_small(ids), docs["doc_id"] == F.col("_doc")).select("key", docs["text"].cast("string").alias("text")), "texts")
    # At most a row for each 400 pairs.
    parts = materialize(pairs.groupBy("a").agg(F.ceil(F.count("*") / 400).cast("int").alias("parts")).filter("parts > 1"), "parts")
    salted = pairs.join(broadcast_if_small(parts), "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), F.coalesce("parts", F.lit(1))).cast("int").alias("salt"))
    salted = materialize(salted, "salted")
    members = salted.join(shuffled(texts), F.col("b") == F.col("key")).select("a", "salt", F.lit(1).alias("role"), "key", "text")
    heads = salted.select("a", "salt").distinct().join(shuffled(texts), F.col("a") == F.col("key")).select("a", "salt", F.lit(0).alias("role"), "key", "text")
    rows = heads.unionByName(members).repartition("a", "salt").sortWithinPartitions("a", "salt", "role")
    return materialize(rows.mapInArrow(_verify(width, percent), _LINKS), "links")


_PAIRS = "a long, b long, n_a long, n_b long, lists long"
_PAIRS_SCHEMA = pa.schema([(x.split()[0], pa.int64()) for x in _PAIRS.split(", ")])


def _short_pairs(percent: int):
    """Pairs of different labels in short lists, with the number of lists of this task that hold both."""

    def run(batches):
        columns = [[], [], [], []]
        for batch in batches:
            for held, c in zip(columns, batch.columns, strict=True):
                held.append(c.to_numpy(zero_copy_only=False))
        if not columns[0]:
            return
        gid, key, n, label = (np.concatenate(x) for x in columns)
        order = np.lexsort((key, n, gid))
        gid, key, n, label = gid[order], key[order], n[order], label[order]
        at = np.arange(len(gid))
        out_a, out_b, out_na, out_nb = [], [], [], []
        for d in range(1, LONG_LIST):
            at = at[at + d < len(gid)]
            at = at[(gid[at] == gid[at + d]) & (need(n[at], n[at + d], percent) <= n[at])]
            if not len(at):
                break
            hit = at[label[at] != label[at + d]]
            swap = key[hit] > key[hit + d]
            x, y = np.where(swap, hit + d, hit), np.where(swap, hit, hit + d)
            for held, v in zip((out_a, out_b, out_na, out_nb), (key[x], key[y], n[x], n[y]), strict=True):
                held.append(v)
        if not out_a:
            return
        a, b, na, nb = (np.concatenate(x) for x in (out_a, out_b, out_na, out_nb))
        order = np.lexsort((b, a))
        a, b, na, nb = a[order], b[order], na[order], nb[order]
        first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else np.zeros(0, int)
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in (a[first], b[first], na[first], nb[first], np.diff(np.append(first, len(a))))], schema=_PAIRS_SCHEMA)

    return run


def _enough(lists, n_a, n_b, percent: int, greatest):
    """Whether sets that share this many of their first shingles can link: past the nearer prefix end, what is left of that set counts whole."""
    rest = greatest(n_a - prefix(n_a, percent), n_b - prefix(n_b, percent))
    return lists + rest >= need(n_a, n_b, percent)


def _nearest(score: np.ndarray, ok: np.ndarray, nearest: int) -> np.ndarray:
    """Of ``ok`` the entries that are among the largest of their row."""
    score = np.where(ok, score, -1.0)
    top = np.argsort(-score, axis=1, kind="stable")[:, :nearest]
    out = np.zeros_like(ok)
    np.put_along_axis(out, top, True, axis=1)
    return out & ok


def _block_pairs(percent: int, nearest: int | None):
    """Pairs of different labels of two blocks of one long list, each pair in the first long list that holds both.

    With ``nearest`` only so many for each set outside the list's major label, from every list.
    """

    def compare(rows):
        left = [r for r in rows if r["side"] == 0]
        right = [r for r in rows if r["side"] == 1] or left
        within = right is left
        tokens = [np.array(r["tokens"], np.int64) for r in (left if within else left + right)]
        if not left or not right:
            return []
        flat = np.concatenate(tokens)
        vocabulary, inverse, counts = np.unique(flat, return_inverse=True, return_counts=True)
        column = np.where(counts > 1, np.cumsum(counts > 1) - 1, -1)[inverse]
        owner = np.repeat(np.arange(len(tokens)), [len(t) for t in tokens])
        table = np.zeros((len(tokens), max(1, int((counts > 1).sum()))), np.float32)
        del vocabulary
        table[owner[column >= 0], column[column >= 0]] = 1
        x, y = table[: len(left)], table if within else table[len(left) :]
        common = np.rint(x @ y.T).astype(np.int64)
        nl, nr = (np.array([r["n"] for r in side], np.int64)[:, None] for side in (left, right))
        nr = nr.T
        ll, lr = np.array([r["label"] for r in left])[:, None], np.array([r["label"] for r in right])[None, :]
        low, high = np.minimum(nl, nr), np.maximum(nl, nr)
        ok = (ll != lr) & (need(low, high, percent) <= low) & _enough(common, nl, nr, percent, np.maximum)
        if nearest:
            # Counts that differ little say little; each list takes others of them, so that its choices add to those of the rest.
            kl, kr = (np.array([r["key"] for r in side], np.int64).view(np.uint64) for side in (left, right))
            mixed = mix64(mix64(kl)[:, None] ^ mix64(kr)[None, :] ^ np.uint64(rows[0]["gid"] & (2**64 - 1)))
            score = common * (1 + (mixed >> np.uint64(11)) / 2.0**53 / 4)
            rows_of = _nearest(score, ok, nearest)
            ok = rows_of if rows[0]["cell"].split(",")[1] == "m" else rows_of | _nearest(score.T, ok.T, nearest).T
        if within:
            ok &= np.triu(np.ones_like(ok), 1)
        out = []
        gid = rows[0]["gid"]
        for i, j in zip(*np.nonzero(ok), strict=True):
            p, q = left[i], right[j]
            if nearest or gid == min(set(p["long"]) & set(q["long"])):
                if p["key"] > q["key"]:
                    p, q = q, p
                out.append((p["key"], q["key"], p["n"], q["n"], int(common[i, j])))
        return out

    def run(batches):
        cell, rows, found = None, [], []
        for batch in batches:
            for r in batch.to_pylist():
                if (r["gid"], r["cell"]) != cell:
                    if rows:
                        found += compare(rows)
                    cell, rows = (r["gid"], r["cell"]), []
                rows.append(r)
        if rows:
            found += compare(rows)
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], schema=_PAIRS_SCHEMA)

    return run


def _long_pairs(tokens: DataFrame, long: DataFrame, percent: int, nearest: int | None = None) -> DataFrame:
    """Candidates among ``long``, the rows with labels of lists of more than LONG_LIST sets; with ``nearest`` the first of each set."""
    by_label = long.groupBy("gid", "label").count()
    plan = by_label.groupBy("gid").agg(F.count("*").alias("labels"), F.max_by("label", F.struct("count", "label")).alias("major"), F.max("count").alias("most"), F.sum("count").alias("total")).filter("labels > 1")
    plan = materialize(plan.select("gid", "major", F.ceil((F.col("total") - F.col("most")) / BLOCK).cast("int").alias("others"), F.ceil(F.col("most") / BLOCK).cast("int").alias("majors")), "plan")
    rows = materialize(long.join(broadcast_if_small(plan), "gid"), "long")
    out = F.col("label") != F.col("major")
    blocks = rows.withColumn("block", F.pmod(F.xxhash64("key"), F.when(out, F.col("others")).otherwise(F.col("majors"))).cast("int"))
    # Cells: two blocks of minor labels, or one of those and a block of the major label.
    count = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    cell = lambda i, kind, j, side: F.struct(F.concat_ws(",", i, F.lit(kind), j).alias("cell"), F.lit(side).alias("side"))
    minor = F.concat(
        F.transform(F.filter(count("others"), lambda j: j >= F.col("block")), lambda j: cell(F.col("block"), "o", j, 0)),
        F.transform(F.filter(count("others"), lambda i: i < F.col("block")), lambda i: cell(i, "o", F.col("block"), 1)),
        F.transform(count("majors"), lambda j: cell(F.col("block"), "m", j, 0)),
    )
    major = F.transform(count("others"), lambda i: cell(i, "m", F.col("block"), 1))
    # The blocks have few bytes in their file, and their rows become one for each block of their list.
    full = shuffled(blocks).join(tokens.select("key", "tokens", "long"), "key").withColumn("at", F.explode(F.when(out, minor).otherwise(major)))
    full = full.select("gid", "at.cell", "at.side", "key", "n", "label", "tokens", "long").repartition("gid", "cell").sortWithinPartitions("gid", "cell")
    return full.mapInArrow(_block_pairs(percent, nearest), _PAIRS).dropDuplicates(["a", "b"])


def _likely(lists: str, n_a: str, n_b: str, percent: int):
    """``_enough`` as a column."""
    rest = lambda n: F.ceil(F.lit(percent) * F.col(n) / 100) - 1
    least = F.ceil(F.lit(percent) * (F.col(n_a) + F.col(n_b)) / (100 + percent))
    return F.col(lists) + F.greatest(rest(n_a), rest(n_b)) >= least


def _likely_ties(ties: DataFrame, tokens: DataFrame, percent: int) -> DataFrame:
    """Ties by a shared subset, and those whose sets share enough lists."""
    side = lambda c: tokens.select(F.col("key").alias(c), F.col("n").alias(f"n_{c}"), F.col("tokens").alias(f"t_{c}"))
    open_ = ties.filter("not sure").join(shuffled(side("a")), "a").join(shuffled(side("b")), "b").withColumn("lists", F.size(F.array_intersect("t_a", "t_b")))
    return ties.filter("sure").select("a", "b").union(open_.filter(_likely("lists", "n_a", "n_b", percent)).select("a", "b"))


def _labels(components: DataFrame) -> DataFrame:
    """The component of each set that is in one, by the set's key."""
    return materialize(components.select(F.col("id").alias("key"), F.col("component").alias("label")), "labels")


def connected(links: DataFrame) -> DataFrame:
    """``(id, component)``: the least id that is reachable over ``links (a, b)``, for every id in a link.

    Alternates large and small stars, each a minimum by node and a join, until
    nothing changes; every round is a table in the shared folder.
    """
    edges = materialize(links.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    mark, n = None, edges.count()
    while True:
        # A round has at most two rows a link in one table of minima and one in the other.
        sized = F.broadcast if 2 * n <= MOST_BROADCAST else shuffled
        both = edges.union(edges.select("v", "u")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(sized(least), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        tops = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(sized(tops), "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        edges = materialize(small, "stars")
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == mark:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())
        mark, n = now, now[0]


def jaccard_components(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for each row of ``docs (doc_id, text)``."""
    with scratch() as keep:
        sets, of_class = _components_of_sets(docs, width, percent)
        keep += [sets, of_class]
    rows = sets.filter("n is not null").select("doc_id", "n", "k1", "k2")
    return rows.join(shuffled(of_class), ["k1", "k2", "n"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.when(F.col("doc_id").isNotNull(), F.col("component"))).otherwise(F.col("doc_id")).alias("component_id")
    )


def _components_of_sets(docs: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The table of ``_sets`` and ``k1, k2, n, component`` of every class of equal sets."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sets = materialize(docs.mapInArrow(_sets(width), _SETS), "sets")
    rows = sets.filter("n is not null").select("doc_id", "n", "k1", "k2")
    classes = materialize(rows.filter("n > 0 and doc_id is not null").groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("rep")), "classes")
    # A few rows: sizes above MAX_SMALL are one.
    sizes = rows.groupBy(F.least(F.col("n"), F.lit(2 * MAX_SMALL)).alias("n")).agg(F.count("*").alias("count"), F.sum("n").alias("all")).collect()
    heavy, df = frequent_shingles(sets)
    hot = heavy[df > HOT_LIST], -(-df[df > HOT_LIST] // HOT_LIST)
    small = boundary({r["n"]: r["count"] for r in sizes if r["n"]}, 4.0, percent)
    postings = sum(r["all"] for r in sizes) * (100 - percent) // 100
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), postings // _POSTINGS_A_TASK + 1)
    shipped = spark.sparkContext.broadcast(heavy.tobytes())  # 8 bytes for each of MAX_FREQUENT at most
    blobs = docs.mapInArrow(_postings(width, percent, small, buckets, shipped, hot), "bucket long, blob binary")
    parts = materialize(blobs.repartition(buckets + int(hot[1].sum()), "bucket").mapInArrow(_lists(percent, hot[0]), _LISTS), "lists")
    tied_parts = _joined_parts(parts, hot[0])
    # Rows of size 0 only tie the parts of a hot list.
    lists = tied_parts.filter("size > 0")

    tokens = lists.filter("not subset").groupBy("key").agg(F.first("n").alias("n"), F.collect_list("gid").alias("tokens"), F.collect_list(F.when(F.col("size") > LONG_LIST, F.col("gid"))).alias("long"))
    tokens = materialize(tokens, "tokens")
    ties = tied_parts.filter("pivot is not null").groupBy(F.least("key", "pivot").alias("a"), F.greatest("key", "pivot").alias("b")).agg(F.max("subset").alias("sure"))
    ties = materialize(ties, "ties")
    first = verified(docs, materialize(_likely_ties(ties, tokens, percent), "likely_ties"), classes, width, percent)
    tied = connected(first)
    labels = _labels(tied)

    labelled = lists.filter("not subset").join(broadcast_if_small(labels), "key", "left").select("gid", "key", "n", F.coalesce(F.col("label"), F.col("key")).alias("label"), "size")
    pairs = labelled.filter(F.col("size") <= LONG_LIST).select("gid", "key", "n", "label").repartition(buckets, "gid").mapInArrow(_short_pairs(percent), _PAIRS)
    counted = pairs.groupBy("a", "b").agg(F.first("n_a").alias("n_a"), F.first("n_b").alias("n_b"), F.sum("lists").alias("lists"))
    untied = ties.select("a", "b")
    short = materialize(counted.filter(_likely("lists", "n_a", "n_b", percent)).select("a", "b", "lists").join(shuffled(untied), ["a", "b"], "left_anti"), "short")
    # The best candidates first: a set that they attach to a label is not compared with all the others of it.
    either = short.select(F.col("a").alias("x"), "a", "b", "lists").union(short.select("b", "a", "b", "lists"))
    best = either.groupBy("x").agg(F.max_by(F.struct("a", "b"), F.struct("lists", "a", "b")).alias("p")).select("p.a", "p.b")
    listed = materialize(labelled.filter(F.col("size") > LONG_LIST), "long_lists")
    near = _long_pairs(tokens, listed, percent, NEAREST).select("a", "b").join(shuffled(untied), ["a", "b"], "left_anti")
    best = materialize(best.union(near).distinct(), "best")
    second = verified(docs, best, classes, width, percent)
    tied = connected(tied.toDF("a", "b").union(second))
    labels = _labels(tied)

    again = listed.drop("label").join(broadcast_if_small(labels), "key", "left").withColumn("label", F.coalesce(F.col("label"), F.col("key")))
    side = lambda c: labels.select(F.col("key").alias(c), F.col("label").alias(f"label_{c}"))
    apart = ~F.coalesce(F.col("label_a") == F.col("label_b"), F.lit(False))
    open_ = short.join(broadcast_if_small(side("a")), "a", "left").join(broadcast_if_small(side("b")), "b", "left").filter(apart).select("a", "b")
    long = _long_pairs(tokens, materialize(again, "relabelled"), percent).select("a", "b")
    rest = open_.union(long).distinct().join(shuffled(untied.union(best)), ["a", "b"], "left_anti")
    third = verified(docs, materialize(rest, "rest"), classes, width, percent)

    components = connected(tied.toDF("a", "b").union(third))
    of_set = materialize(classes.join(shuffled(components), F.col("k1") == F.col("id"), "left").select("k1", "k2", "n", "rep", "component"), "of_set")
    least = materialize(of_set.filter("component is not null").groupBy(F.col("component").alias("c")).agg(F.min("rep").alias("least")), "least")
    of_class = of_set.join(broadcast_if_small(least), F.col("component") == F.col("c"), "left").select("k1", "k2", "n", F.coalesce("least", "rep").alias("component"))
    return sets, materialize(of_class, "components")


def one_of_each(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns, whatever their names: of each component the document with the smallest identifier.

    Rows that share an identifier stay or go together: they go if all of them
    lie in components with a smaller one.  Rows without an identifier stay.
    """
    found = jaccard_components(docs, width, percent).groupBy("doc_id").agg(F.bool_and(F.col("component_id") != F.col("doc_id")).alias("goes"))
    dropped = materialize(found.filter("goes").select(F.col("doc_id").alias("dropped_id")), "dropped")
    # Input columns move as one struct, so that none can meet a name used here.
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"))
    return rows.join(broadcast_if_small(dropped), F.col("id") == F.col("dropped_id"), "left_anti").select("row.*")

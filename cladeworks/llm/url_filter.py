"""URL filters over a sorted digest array.

An index holds rules ``host-suffix/path-prefix`` with a verdict.  Its file is
a sorted array of 64-bit xxhash keys, the offsets of the full strings, and the
strings.  Executors get the file once each, map it into memory and probe it
with vectorised binary search: a URL's probe keys are its host and those parent
domains that are as long as some rule's host, each with as many characters of the path as that rule's path has,
so that a URL has as many keys as there are such pairs of lengths, however long it is.
Every digest hit is confirmed against the stored string, and neighbours with
the same digest are compared too, so collisions cannot decide.

Of the rules that fit the one with the longest text decides, then the one with
the longest host.  A URL without a fitting rule is looked up in a second
index of the same kind, the block list (``blocked_hosts.txt`` unless another is
given), and allowed if that has nothing.  Null URLs and those without ``://`` have an empty host and path and are allowed.
URLs are read whole, whatever their length; each row is judged for itself, so
repeated rows are judged alike; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
import pkgutil
import tempfile

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The rules of the contract: (rule, verdict).
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))


def read_hosts(text: str) -> tuple[str, ...]:
    """The hosts of a block list, one a line, as rules; blank lines and those with ``#`` in front do not count."""
    return tuple(f"{x}/" for x in map(str.strip, text.splitlines()) if x and not x.startswith("#"))


def block_list(spark: SparkSession, path: str, most: int = 5_000_000) -> tuple[str, ...]:
    """A block list of one host a line from any store; one of more than ``most`` hosts is refused, as every executor holds it."""
    lines = spark.read.text(path)
    if (n := lines.count()) > most:
        raise ValueError(f"{path} has {n} lines; at most {most} fit into an index that executors map")
    return read_hosts("\n".join(r["value"] for r in lines.collect()))


#: Hosts, with their subdomains, that the shipped block list names.
BLOCKED_HOSTS = read_hosts(pkgutil.get_data(__package__, "blocked_hosts.txt").decode())
_MAGIC = b"UDA1"


def write_index(path: str, entries) -> str:
    """Write ``(rule, verdict)`` entries as a sorted digest array; the later of two equal rules counts."""
    import xxhash

    rules = {rule.encode(): verdict.encode() for rule, verdict in entries}
    rows = sorted((xxhash.xxh64_intdigest(r), r, v) for r, v in rules.items())
    strings = [r + b"\0" + v for _, r, v in rows]
    offsets = np.cumsum([0, *map(len, strings)]).astype("<u8")
    lengths = sorted({(len(r.partition(b"/")[0]), len(r) - len(r.partition(b"/")[0])) for r in rules})
    with open(path, "wb") as f:
        f.write(_MAGIC.ljust(8, b"\0"))
        f.write(np.array([len(rows), len(lengths)], "<u8").tobytes())
        f.write(np.array([h for h, _, _ in rows], "<u8").tobytes())
        f.write(offsets.tobytes())
        f.write(np.array(lengths, "<u8").tobytes())
        f.write(b"".join(strings))
    return path


class DigestIndex:
    """A memory-mapped index.  ``lengths`` are those of the rules' hosts and paths, in bytes."""

    def __init__(self, path: str):
        data = np.memmap(path, np.uint8, "r")
        if bytes(data[:4]) != _MAGIC:
            raise ValueError(f"{path} is no digest index")
        n, m = (int(x) for x in data[8:24].view("<u8"))
        at = 24
        self.keys, at = data[at : at + 8 * n].view("<u8"), at + 8 * n
        self.offsets, at = data[at : at + 8 * (n + 1)].view("<u8"), at + 8 * (n + 1)
        self.lengths, at = data[at : at + 16 * m].view("<u8").reshape(-1, 2).tolist(), at + 16 * m
        self.strings = data[at:]

    def find(self, probes: list[bytes]) -> list[str | None]:
        """The verdict of each probe string that is stored, else None."""
        import xxhash

        out: list[str | None] = [None] * len(probes)
        if not len(self.keys) or not probes:
            return out
        digests = np.fromiter((xxhash.xxh64_intdigest(p) for p in probes), np.uint64, len(probes))
        at = np.searchsorted(self.keys, digests)
        hit = np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] == digests)
        for i in hit.tolist():
            k = int(at[i])
            while k < len(self.keys) and self.keys[k] == digests[i]:
                stored, _, verdict = self.strings[int(self.offsets[k]) : int(self.offsets[k + 1])].tobytes().rpartition(b"\0")
                if stored == probes[i]:
                    out[i] = verdict.decode()
                    break
                k += 1
        return out

    def longest(self, hosts: list[str], paths: list[str]) -> tuple[list[str | None], list[str | None]]:
        """For each host and path the longest stored rule that fits, and its verdict."""
        probes, owner = [], []
        for i, (host, path) in enumerate(zip(hosts, paths, strict=True)):
            raw, path_raw = host.encode(), path.encode()
            for of_host, of_path in self.lengths:
                fits = len(raw) == of_host or (len(raw) > of_host and raw[-of_host - 1] == 46)
                if of_host and fits and of_path <= len(path_raw):
                    probes.append(raw[len(raw) - of_host :] + path_raw[:of_path])
                    owner.append((i, of_host))
        rules: list[str | None] = [None] * len(hosts)
        verdicts: list[str | None] = [None] * len(hosts)
        best = [(-1, -1)] * len(hosts)
        for (i, of_host), probe, verdict in zip(owner, probes, self.find(probes), strict=True):
            if verdict is not None:
                rank = (len(probe.decode(errors="replace")), of_host)
                if rank > best[i]:
                    best[i], rules[i], verdicts[i] = rank, probe.decode(), verdict
        return rules, verdicts


def host(url: Column) -> Column:
    """From the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z lower-cased; empty without ``://`` or for null."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


_OPEN: dict[str, DigestIndex] = {}
_SHIPPED: set[str] = set()


def _index(name: str) -> DigestIndex:
    from pyspark import SparkFiles

    if name not in _OPEN:
        _OPEN[name] = DigestIndex(SparkFiles.get(name))
    return _OPEN[name]


@functools.cache
def _driver_folder() -> tempfile.TemporaryDirectory:
    """Where the driver keeps the files that it hands out; removed when it ends."""
    return tempfile.TemporaryDirectory(prefix="url-index-")


def ship_index(spark: SparkSession, entries, label: str) -> str:
    """Write an index beside the driver and have Spark hand it to every executor, once an application; returns its name there."""
    entries = tuple(entries)
    name = f"{label}-{hashlib.sha256(repr((spark.sparkContext.applicationId, entries)).encode()).hexdigest()[:16]}.uda"
    if name not in _SHIPPED:
        spark.sparkContext.addFile(write_index(f"{_driver_folder().name}/{name}", entries))
        _SHIPPED.add(name)
    return name


def judge_urls(df: DataFrame, url: str = "url", rules=RULES, blocked=BLOCKED_HOSTS) -> DataFrame:
    """Add ``host, path, rule, verdict`` to ``df`` (columns of these names are replaced)."""
    spark = df.sparkSession
    allow_or_block = ship_index(spark, rules, "rules")
    block_list = ship_index(spark, [(x, "block") for x in blocked], "blocked")

    @F.pandas_udf("rule string, verdict string")
    def decide(hosts: pd.Series, paths: pd.Series) -> pd.DataFrame:
        hosts, paths = hosts.tolist(), paths.tolist()
        rule, verdict = _index(allow_or_block).longest(hosts, paths)
        open_ = [i for i, v in enumerate(verdict) if v is None]
        _, other = _index(block_list).longest([hosts[i] for i in open_], [paths[i] or "/" for i in open_])
        for i, v in zip(open_, other, strict=True):
            verdict[i] = v or "allow"
        return pd.DataFrame({"rule": pd.Series(rule, dtype=object), "verdict": verdict})

    own = [c for c in df.columns if c not in ("host", "path", "rule", "verdict")]
    # Input columns move as one struct, so that none can meet a name used here.
    parts = df.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("row"), host(F.col(url)).alias("host"), path(F.col(url)).alias("path"))
    return parts.withColumn("said", decide("host", "path")).select("row.*", "host", "path", "said.rule", "said.verdict")

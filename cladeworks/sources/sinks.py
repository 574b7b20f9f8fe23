"""Output names, manifests, and writers."""

from __future__ import annotations

import json
import os
import posixpath
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import __version__
from ..constants import MANIFESTS, STATS_FILE
from . import store
from .entries import PLACE
from .files import literal

STAGING, COMMIT = ".staging", ".commit.json"
#: Spark's CSV writer by the rules of quotes that every reader knows: nothing trimmed, quotes doubled.
CSV = {"header": True, "escape": '"', "quoteAll": True, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def output_name(name: str, outcome: str, kind: str) -> str:
    """The dataset for an outcome of an input file, sub-folders kept."""
    return f"{os.path.splitext(name)[0]}.{outcome}.{kind}"


def intended_for_resolve(names: list[str], kind: str, forced: bool = False) -> list[str]:
    outcomes = ("forced",) if forced else ("resolved", "unsolved")
    return [*[output_name(n, x, kind) for n in names for x in outcomes], *([] if forced else [STATS_FILE]), MANIFESTS["resolve"]]


def intended_for_common_names(names: list[str]) -> list[str]:
    return [*names, MANIFESTS["common-names"]]


def write_manifest(spark: SparkSession, folder: str, command: str, input_path: str, files: list[str], namespace: str | None = None) -> str:
    path = f"{folder}/{MANIFESTS[command]}"
    body = {"tool_version": __version__, "command": command, "created_at": datetime.now(timezone.utc).isoformat(), "input": str(input_path), "cache_namespace": namespace, "files": files}
    store.write_text(spark, path, json.dumps(body, indent=2))
    return path


def read_manifest(spark: SparkSession, folder: str, command: str) -> dict | None:
    """The manifest, or None if there is none or it is no JSON object."""
    try:
        body = json.loads(store.read_text(spark, f"{folder}/{MANIFESTS[command]}"))
    except (OSError, ValueError):
        return None
    return body if isinstance(body, dict) else None


def _inside(root: str, name: str) -> bool:
    """Whether a relative name stays below a folder, also by the links of a local one."""
    flat = posixpath.normpath(name)
    if flat in (".", "..") or flat.startswith(("../", "/")):
        return False
    if not root.startswith("file:"):
        return True
    local = os.path.realpath(root.removeprefix("file:"))
    target = os.path.realpath(os.path.join(local, flat))
    return target != local and target.startswith(f"{local}/")


def delete_listed(spark: SparkSession, folder: str, command: str) -> list[str]:
    """Delete what the manifest lists, and nothing outside the folder; returns what went.  A listed folder goes only if Spark's marker is in it."""
    body, root, gone = read_manifest(spark, folder, command), store.qualified(spark, folder), []
    for name in (body or {}).get("files") or []:
        if not isinstance(name, str) or not _inside(root, name):
            continue
        target = f"{folder}/{name}"
        if store.exists(spark, target) and (not store.is_folder(spark, target) or store.exists(spark, f"{target}/_SUCCESS")):
            store.delete(spark, target)
            gone.append(name)
    for left in (STAGING, COMMIT):
        store.delete(spark, f"{folder}/{left}")
    return gone


def already_run(spark: SparkSession, folder: str) -> bool:
    """Whether an earlier run left a manifest or resolved files."""
    if any(store.exists(spark, f"{folder}/{m}") for m in MANIFESTS.values()):
        return True
    return any(".resolved." in n or already_run(spark, f"{folder}/{n}") for n in store.children(spark, folder) if store.is_folder(spark, f"{folder}/{n}") or ".resolved." in n)


def _flat(rows: DataFrame, kind: str) -> DataFrame:
    return rows.withColumn("metadata", F.to_json("metadata")) if kind == "csv" and "metadata" in rows.columns else rows


def write(rows: DataFrame, path: str, kind: str, mode: str = "errorifexists") -> None:
    writer = _flat(rows, kind).write.mode(mode)
    (writer.options(**CSV).csv if kind == "csv" else writer.parquet)(path)


def _rows_in(spark: SparkSession, path: str, kind: str) -> int:
    reader = spark.read.options(header=True, escape='"', multiLine=True).csv if kind == "csv" else spark.read.parquet
    return reader(literal(path)).count()


def write_by_file(rows: DataFrame, folder: str, files: DataFrame, name_of: Callable[[str, str], str], expected: int, kind: str = "parquet", texts: dict[str, str] | None = None) -> list[str]:
    """Write rows with ``PLACE`` and ``outcome`` in one job and commit them; returns the datasets that it made.

    Spark partitions the output by file and outcome below a staging folder.
    If that does not hold the ``expected`` number of rows, nothing is
    committed and an error tells.  Else a commit log lists every dataset to be
    renamed, under the name that ``name_of(name, outcome)`` gives for the names in
    ``files (file_number, name)``, and small ``texts`` by name; ``finish`` does as it says.
    """
    spark, staging = rows.sparkSession, f"{folder}/{STAGING}"
    dealt = rows.repartition("outcome", *PLACE).drop("file_part")
    writer = _flat(dealt, kind).write.mode("overwrite").partitionBy("file_number", "outcome")
    (writer.options(**CSV).csv if kind == "csv" else writer.parquet)(staging)
    parts = [(int(f.partition("=")[2]), f, x) for f in store.children(spark, staging) if f.startswith("file_number=") for x in store.children(spark, f"{staging}/{f}")]
    written = _rows_in(spark, staging, kind) if parts else 0
    if written != expected:
        raise RuntimeError(f"{written} of {expected} rows were written below {staging}; nothing was committed")
    names = {r["file_number"]: r["name"] for r in files.select("file_number", "name").toLocalIterator()}
    moves = [[f"{STAGING}/{f}/{x}", name_of(names[k], x.removeprefix("outcome="))] for k, f, x in parts]
    store.write_text(spark, f"{folder}/{COMMIT}", json.dumps({"moves": moves, "texts": texts or {}}))
    return finish(spark, folder)


def unfinished(spark: SparkSession, folder: str) -> bool:
    """Whether a run has written everything but stopped before all of it had its place."""
    return store.exists(spark, f"{folder}/{COMMIT}")


def finish(spark: SparkSession, folder: str) -> list[str]:
    """Do what the commit log says and has not been done; a second call after a stop goes on where the first one was."""
    log = json.loads(store.read_text(spark, f"{folder}/{COMMIT}"))
    for source, target in log["moves"]:
        if store.exists(spark, f"{folder}/{source}"):
            store.move(spark, f"{folder}/{source}", f"{folder}/{target}")
    for name, text in log["texts"].items():
        store.write_text(spark, f"{folder}/{name}", text)
    store.delete(spark, f"{folder}/{STAGING}")
    store.delete(spark, f"{folder}/{COMMIT}")
    return [target for _, target in log["moves"]]


def statistics_text(stats: DataFrame) -> str:
    return json.dumps(stats.first().asDict(), indent=2)

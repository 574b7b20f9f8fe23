"""Entry tables: CSV or Parquet files, or folders of either."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import OPTIONAL, REQUIRED
from . import csv_scan
from .files import Inputs, find_inputs, literal, number_of, open_input, part_at, plain_path

#: Columns that say where a row comes from: the number of its file, and the part of the output that its place in the file gives.
PLACE = ("file_number", "file_part")


def _footers(files: DataFrame) -> DataFrame:
    """``uri, columns``: names and types of each Parquet file, as ``name type``."""

    def run(batches):
        import pyarrow.parquet as pq

        for b in batches:
            lists = []
            for uri in b.column(0).to_pylist():
                file = open_input(uri)
                schema = pq.read_schema(file)
                lists.append([f"{f.name} {f.type}" for f in schema])
                file.close()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lists, pa.list_(pa.string()))], names=["uri", "columns"])

    return files.select("uri").mapInArrow(run, "uri string, columns array<string>")


def columns_of(inputs: Inputs) -> DataFrame:
    """``uri, columns`` of every file: its names, with types if it is Parquet; footers and first lines are read by tasks."""
    return csv_scan.headers(inputs.files) if inputs.kind == "csv" else _footers(inputs.files)


def _known(columns: Column) -> Column:
    """The columns that entries have, in order."""
    named = F.transform(columns, lambda x: F.struct(F.split_part(x, F.lit(" "), F.lit(1)).alias("name"), x.alias("typed")))
    return F.array_sort(F.transform(F.filter(named, lambda x: x["name"].isin(*REQUIRED, *OPTIONAL)), lambda x: x["typed"]))


def _kinds(inputs: Inputs) -> list[tuple[str, ...]]:
    """The different sets of known columns; a missing required one is an error that names the first files."""
    described = columns_of(inputs).withColumn("known", _known(F.col("columns")))
    names = F.transform("known", lambda x: F.split_part(x, F.lit(" "), F.lit(1)))
    lacking = described.withColumn("missing", F.array_except(F.array(*[F.lit(c) for c in REQUIRED]), names)).filter(F.size("missing") > 0)
    if bad := lacking.select("uri", "missing").orderBy("uri").limit(10).collect():
        raise ValueError(f"required columns are missing: { {r['uri']: list(r['missing']) for r in bad} }")
    return [tuple(r["known"]) for r in described.select("known").distinct().collect()]


def validate(inputs: Inputs) -> DataFrame:
    """``uri, missing`` of each file that lacks required columns."""
    described = columns_of(inputs).withColumn("known", F.transform(_known(F.col("columns")), lambda x: F.split_part(x, F.lit(" "), F.lit(1))))
    return described.select("uri", F.array_except(F.array(*[F.lit(c) for c in REQUIRED]), "known").alias("missing")).filter(F.size("missing") > 0)


def source_of(path: Column) -> Column:
    """``X`` of a path part ``source=X``, else the name of the parent folder, else ``unknown``."""
    named = F.regexp_extract(path, r"(?:^|/)source=([^/]*)/", 1)
    parent = F.regexp_extract(path, r"([^/]+)/[^/]*$", 1)
    return F.coalesce(F.nullif(named, F.lit("")), F.nullif(parent, F.lit("")), F.lit("unknown"))


def _parquet(spark: SparkSession, inputs: Inputs, kinds: list[tuple[str, ...]]) -> DataFrame:
    def read(paths: list[str], kind: tuple[str, ...]) -> DataFrame:
        df = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(*map(literal, paths))
        have = {x.split(" ")[0] for x in kind}
        known = [(F.col(f"`{c}`") if c in have else F.lit(None)).cast("string").alias(c) for c in (*REQUIRED, *OPTIONAL)]
        uri = F.col("_metadata.file_path")
        return df.select(*known, number_of(uri).alias("file_number"), part_at(F.col("_metadata.file_block_start")).alias("file_part"), source_of(plain_path(uri)).alias("source_dataset"))

    if len(kinds) == 1:
        return read([inputs.path], kinds[0])
    # Files of different columns or types are read apart; Spark's readers take their paths one by one.
    described = columns_of(inputs).withColumn("known", _known(F.col("columns")))
    parts = []
    for kind in kinds:
        mine = described.filter(F.col("known") == F.array(*[F.lit(c) for c in kind])).select(plain_path(F.col("uri")).alias("path")).collect()
        parts.append(read([r["path"] for r in mine], kind))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def read_raw(spark: SparkSession, inputs: Inputs) -> DataFrame:
    """Known columns as strings, extra columns ignored, with ``source_dataset`` and where each row comes from (``PLACE``)."""
    kinds = _kinds(inputs)
    if inputs.kind == "parquet":
        return _parquet(spark, inputs, kinds)
    names = [*REQUIRED, *OPTIONAL]
    rows = csv_scan.read_csv(inputs.files, names)
    path = F.concat(F.lit(f"{inputs.root}/"), "name")
    return rows.select(*[F.col(f"`{c}`") for c in names], "file_number", part_at(F.col("start")).alias("file_part"), source_of(path).alias("source_dataset"))


def normalized_entries(raw: DataFrame) -> DataFrame:
    """Null names as empty; rows without ``uuid`` go."""
    names = [c for c in raw.columns if c not in ("uuid", *PLACE)]
    return raw.filter(F.coalesce("uuid", F.lit("")) != "").withColumns({c: F.coalesce(c, F.lit("")) for c in names})


def read_entries(spark: SparkSession, path: str) -> DataFrame:
    return normalized_entries(read_raw(spark, find_inputs(spark, path))).drop(*PLACE)


def count_entries(spark: SparkSession, path: str) -> int:
    return read_raw(spark, find_inputs(spark, path)).count()

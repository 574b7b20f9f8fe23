"""The taxonomic backbone: tab-separated taxa and vernacular names, from a local folder or archive."""

from __future__ import annotations

import re
import shutil
import zipfile
from dataclasses import replace
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import Inputs, listed, literal, number_of, part_at

TAXA, NAMES = "Taxon.tsv", "VernacularName.tsv"
_TAXON_COLUMNS = ("taxonID", "canonicalName", "taxonRank", "taxonomicStatus", "kingdom", "phylum", "class", "order", "family", "genus")


#: A path up to the end of a resolved dataset's name.
RESOLVED = r"^(.*?\.resolved\.parquet)(?:/|$)"
#: Bytes that a whole archive of the public backbone has at least.
WHOLE_ARCHIVE = 900_000_000


def unpack(archive: str, folder: str, least_bytes: int = 0) -> tuple[str, str]:
    """Paths of both tables in ``folder``, taken from ``archive`` where they are absent.

    Members are found without regard to case or folder and copied in pieces.
    A broken archive, or one of fewer than ``least_bytes``, is removed and
    reported.  Nothing is downloaded.
    """
    out = Path(folder)
    out.mkdir(parents=True, exist_ok=True)
    wanted = {n: out / n for n in (TAXA, NAMES) if not (out / n).exists()}
    if wanted:
        if Path(archive).stat().st_size < least_bytes:
            Path(archive).unlink()
            raise ValueError(f"{archive} was too small to be whole; fetch it again")
        try:
            with zipfile.ZipFile(archive) as z:
                members = {m.rsplit("/", 1)[-1].lower(): m for m in z.namelist()}
                for name, target in wanted.items():
                    if name.lower() not in members:
                        raise FileNotFoundError(f"{archive} has no {name}")
                    partial = target.with_suffix(".partial")
                    with z.open(members[name.lower()]) as source, open(partial, "wb") as sink:
                        shutil.copyfileobj(source, sink, 1 << 20)
                    partial.rename(target)
        except zipfile.BadZipFile:
            Path(archive).unlink(missing_ok=True)
            raise
    return str(out / TAXA), str(out / NAMES)


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as strings, quotes kept, empty fields null."""
    return spark.read.csv(path, sep="\t", header=True, quote="", inferSchema=False)


def read_taxa(spark: SparkSession, path: str) -> DataFrame:
    df = read_tsv(spark, path)
    return accepted(df.select(*[c for c in _TAXON_COLUMNS if c in df.columns]))


def accepted(taxa: DataFrame) -> DataFrame:
    return taxa.filter("taxonomicStatus = 'accepted' and canonicalName is not null")


def read_vernacular(spark: SparkSession, path: str) -> DataFrame:
    return read_tsv(spark, path).select("taxonID", "vernacularName", "language")


def annotations(spark: SparkSession, path: str) -> Inputs:
    """The resolved datasets below a folder, each numbered and named as one, however many files it has."""
    found = listed(spark, path, "*.parquet")
    if re.match(RESOLVED, f"{found.root}/"):
        raise ValueError(f"{path} lies inside a resolved dataset")
    dataset = F.regexp_extract("name", RESOLVED, 1)
    files = found.files.withColumn("name", dataset).filter("name <> ''").groupBy("name").agg(F.min(_dataset_number(F.col("uri"))).alias("file_number"), F.sum("size").alias("size"))
    return replace(found, files=files)


def _dataset_number(uri: Column) -> Column:
    return number_of(F.regexp_extract(uri, RESOLVED, 1))


def read_annotations(spark: SparkSession, inputs: Inputs) -> DataFrame:
    """Resolved datasets as one table, with the place of each row."""
    uri = F.col("_metadata.file_path")
    rows = spark.read.options(recursiveFileLookup=True, pathGlobFilter="*.parquet", mergeSchema=True).parquet(literal(inputs.path))
    return rows.filter(uri.rlike(RESOLVED)).withColumns({"file_number": _dataset_number(uri), "file_part": part_at(F.col("_metadata.file_block_start"))})

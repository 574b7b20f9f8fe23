"""Schemas of the tables that the engine reads and writes."""

from __future__ import annotations

from pyspark.sql import types as T

from .constants import RANKS

REQUIRED = ("uuid", "scientific_name", *RANKS)
OPTIONAL = ("common_name", "source_id")
ENTRY = T.StructType([T.StructField(c, T.StringType()) for c in (*REQUIRED, *OPTIONAL, "source_dataset")])

#: The part of a verifier's answer that resolution reads, under the names of its JSON.
RESULT = (
    "struct<dataSourceId: int, dataSourceTitleShort: string, recordId: string, matchedName: string, matchedCanonicalSimple: string,"
    " currentRecordId: string, currentName: string, taxonomicStatus: string, isSynonym: boolean, classificationPath: string,"
    " classificationRanks: string, editDistance: int, matchType: string,"
    " scoreDetails: struct<infraSpecificRankScore: double, parsingQualityScore: double>>"
)
RESPONSE = f"struct<name: string, matchType: string, results: array<{RESULT}>>"

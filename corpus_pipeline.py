"""A corpus pipeline over ``documents``: language, exact and near copies, mixture, tokens.

Rows without text or without a letter leave in the first stage.  Null
identifiers, repeated rows, ties and an empty table are the operators' matter:
rows without an identifier stay in every filtering stage unless their text has a copy, of equal copies
the smallest identifier stays, and an empty table stays empty.  Extra columns
are dropped, texts are processed whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cladeworks.llm import exact_dedup, language_id, mixing, ngram_join, sentence_pieces
from cladeworks.llm.queries import tokenizer_path
from cladeworks.llm.runtime import discard, materialize, scratch, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters in a language that the model finds with probability 0.5 or more stay."""
    return language_id.accepted(docs).select(*COLUMNS)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one document stays."""
    return exact_dedup.deduplicate(docs).select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that link at a Jaccard similarity of 0.75 the one with the smallest identifier stays."""
    return ngram_join.one_of_each(docs).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, once or twice."""
    return mixing.mixed(docs).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids and their digests for each document of the mix."""
    return sentence_pieces.digests(docs, tokenizer_path("piece_bpe_32k.model"))


STAGES = [("language", language), ("exact_copies", exact_copies), ("near_copies", near_copies), ("mixture", mixture), ("tokens", tokens)]
#: Language identification and tokenization are no SQL; tests/llm/test_pipeline.py holds the stages against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other; each one's table replaces that of the stage before."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        with scratch() as keep:
            after = materialize(stage(spark, docs, sf_dir), name)
            keep.append(after)
        if k:
            discard(docs)
        docs = after
    return STAGES[-1][1](spark, docs, sf_dir)

"""Resolution of arriving entries against a stored response table."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.resolve import resolve


def resolve_stream(entries: DataFrame, responses: DataFrame, folder: str, checkpoint: str):
    """Start a query that resolves each micro-batch of entries and appends the rows to ``folder``.

    A group's outcome depends on its names and the answers alone, so batches
    give the rows that one run over all entries gives, but for the spelling
    of a lineage's first entry, which is each batch's own.
    """

    def batch(df: DataFrame, number: int) -> None:
        resolve(df, responses).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return entries.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()

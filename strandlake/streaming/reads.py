"""Mapping a stream of reads: each micro-batch is joined with the stored postings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..functions import kmer
from ..plans.index import Index
from ..plans.tables import drop


def map_stream(index: Index, reads: DataFrame, path: str, checkpoint: str, read: str = "read_ix", seq: str = "seq", code=kmer.strict, trigger: dict | None = None) -> StreamingQuery:
    """Write the hits of each micro-batch of the streaming ``reads`` below ``path``, one folder per batch, so that a batch that runs again replaces its own."""

    def batch(df: DataFrame, number: int) -> None:
        hits, _, found = index.mapped(df, read, seq, code)
        hits.write.mode("overwrite").parquet(f"{path}/batch={number}")
        drop(found)

    return reads.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

"""Streaming ingestion: new documents become postings and fingerprints of the index as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import index


def postings_stream(documents: DataFrame, high: int = 2) -> DataFrame:
    """A stream of (phrase, doc_id) of a stream of (doc_id, text): stateless, so it runs batch by batch."""
    return index.phrase_postings(documents, high)


def ingest(documents: DataFrame, folder: str, phrases: DataFrame, checkpoint: str) -> StreamingQuery:
    """Append the postings and the fingerprints of each batch; a batch that is run again replaces its own files."""

    def write(batch: DataFrame, number: int) -> None:
        postings = index.phrase_postings(batch).persist()
        postings.write.mode("overwrite").parquet(f"{folder}/postings/batch={number}")
        index.document_fingerprints(postings, phrases).write.mode("overwrite").parquet(f"{folder}/fingerprints/batch={number}")
        postings.unpersist()

    return documents.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def status_counts(log: DataFrame, key: str = "status") -> DataFrame:
    """Running counts of a progress log's lines by status."""
    return log.groupBy(key).agg(F.count("*").alias("n"))

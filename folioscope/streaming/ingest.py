"""Incremental ingestion: term counts kept up to date as documents arrive. An extension of the batch engine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from folioscope.operators import chunks as C


def term_counts(documents: DataFrame, least: int = 1) -> DataFrame:
    """(token, n_documents, n_occurrences) of a stream (or table) of documents(doc_id, text)."""
    found = C.token_occurrences(C.document_chunks(documents), least)
    return found.groupBy("token").agg(F.approx_count_distinct("doc_id").alias("n_documents"), F.sum(F.size("positions")).alias("n_occurrences"))


def windowed_votes(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """(window, key, n) of events(ts, key) in tumbling windows; later ones than the watermark are dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "key").agg(F.count("*").alias("n"))


def keep_counts(documents: DataFrame, path: str, checkpoint: str, least: int = 1) -> StreamingQuery:
    """Write the counts of each batch of new documents under path, by batch: their sums are the counts so far.

    A batch that runs again replaces its own folder, so restarts count nothing twice.
    """

    def write(batch: DataFrame, number: int) -> None:
        found = C.token_occurrences(C.document_chunks(batch), least)
        counts = found.groupBy("token").agg(F.count_distinct("doc_id").alias("n_documents"), F.sum(F.size("positions")).alias("n_occurrences"))
        counts.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return documents.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

"""Documents that arrive as files: a stream that processes new ones and appends to the store, and request limits."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.store import Store, flatten
from ..plans.pipeline import process, stored_fields
from ..schema import EngineOptions


def text_stream(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, text): each text file under path once, as it arrives."""
    files = spark.readStream.format("text").option("wholetext", True).load(path)
    return files.select(F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("text"))


def store_batch(store: Store, processed: DataFrame, key: str | None = None) -> bool:
    """Append one batch of processed documents: finished ones with their fields, failed ones with their error. Nothing that
    is stored already is read or written; a document that comes again replaces its older row. key: a batch of one key counts once."""
    fine = F.col("status") == "success"
    now = F.current_timestamp()
    documents = processed.select(
        F.col("doc_id").alias("id"), F.col("doc_id").alias("filename"), F.when(fine, "completed").otherwise("failed").alias("status"), now.alias("upload_timestamp"),
        F.when(fine, now).alias("processed_timestamp"), F.when(fine, F.col("classification.document_type")).alias("document_type"), F.when(fine, F.col("text")).alias("text_content"),
        F.when(fine, F.col("classification.confidence")).alias("confidence"), "error",
    )
    results = processed.where(fine).select(F.col("doc_id").alias("id"), stored_fields("fields").alias("fields"))
    return store.append(key, documents=documents, extractions=flatten(results))


def run(stream: DataFrame, store: Store, checkpoint: str, options: EngineOptions = EngineOptions(), compact_every: int = 100) -> StreamingQuery:
    """Process all that has arrived and stop; started again, it goes on where it was. Appended folders are merged now and then."""

    def batch(df: DataFrame, number: int) -> None:
        processed = process(df, options).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            store_batch(store, processed, f"{checkpoint}#{number}")
        finally:
            processed.unpersist()
        if number % compact_every == compact_every - 1:
            store.compact()

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def request_counts(requests: DataFrame, client: str = "user_id", ts: str = "ts", late: str = "1 minute") -> DataFrame:
    """Requests of each client by minute, of a stream or a table, with a watermark for late ones."""
    marked = requests.withWatermark(ts, late) if requests.isStreaming else requests
    return marked.groupBy(F.window(ts, "1 minute").alias("minute"), client).agg(F.count("*").alias("requests"))

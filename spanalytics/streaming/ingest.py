"""A stream of span files into a store, with a notification row for each micro-batch.

Lateness is unlimited: batches are appended, and reads take the last version of each span.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans import api
from ..schema import split_valid
from ..sources import native, otlp
from ..sources.store import SpanStore
from .notices import announce

def refresh(store: SpanStore, views: str) -> None:
    """Recomputes the overview and the trace list over all spans and writes them as tables below ``views``."""
    for name, df in (api.overview(store) | {"traces": api.list_traces(store)}).items():
        df.write.mode("overwrite").parquet(f"{views}/{name}")


def start(spark: SparkSession, source: str, store: SpanStore, notices: str, checkpoint: str, kind: str = "native", files_per_batch: int = 100, views: str | None = None) -> StreamingQuery:
    """Runs over the files of ``source`` that have come so far, and stops. kind: native JSON lines, or otlp payloads (a file each).
    views: where to refresh the batch views after each micro-batch.

    A notice tells that the stream is ready, and one of each batch. A batch that is run again after a failure overwrites its notice and appends rows with the same batch number and
    keys, which the store reads as one version.
    """
    if kind == "native":
        stream = spark.readStream.schema(native.RAW).option("maxFilesPerTrigger", files_per_batch).json(source)
    else:
        stream = spark.readStream.format("text").option("wholetext", True).option("maxFilesPerTrigger", files_per_batch).load(source).withColumnRenamed("value", "payload")

    def take(rows: DataFrame, batch: int) -> None:
        good = split_valid(native.rows(rows))[0] if kind == "native" else otlp.parse(rows)[0]
        announce(spark, notices, "ingest", store.save(good, batch + 1), batch=batch)
        if views:
            refresh(store, views)

    announce(spark, notices, "ready")
    return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def trace_counts(stream: DataFrame, watermark: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Spans and errors per service and event-time window, for dashboards that can't wait for a batch view."""
    at = stream.withColumn("at", F.timestamp_millis(F.col("start_ms").cast("long"))).withWatermark("at", watermark)
    return at.groupBy(F.window("at", window), "service").agg(F.count("*").alias("spans"), F.count_if(F.col("status") == "error").alias("errors"))

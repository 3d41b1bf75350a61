"""A span store on Parquet: appends, and reads the last version of each span."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..schema import COLUMNS, SPAN
from .adapters import latest

STORED = T.StructType([*SPAN.fields, T.StructField("ingested_at", T.TimestampType()), T.StructField("batch", T.LongType()), T.StructField("place", T.LongType())])
KEY = ["trace_id", "span_id"]


class SpanStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.create()

    def create(self) -> None:
        """Makes an empty table if there is none."""
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        if not at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            self.spark.createDataFrame([], STORED).write.parquet(self.path)

    def raw(self) -> DataFrame:
        return self.spark.read.schema(STORED).parquet(self.path)

    def save(self, spans: DataFrame, batch: int | None = None) -> dict[str, int]:
        """Appends a batch and acknowledges it: rows and distinct traces. An empty batch writes nothing.

        Of rows that repeat a key, the one saved later, or later in the batch, counts. A batch's number only tells it from others:
        the caller's, or a random one, so that writers need not know of each other. A batch that a stream runs again
        has the same places, and is acknowledged with the same numbers.
        """
        n = batch if batch is not None else -(uuid.uuid4().int >> 65) - 1
        rows = spans.select(*COLUMNS, F.current_timestamp().alias("ingested_at"), F.lit(n).cast("long").alias("batch"), F.monotonically_increasing_id().alias("place"))
        if rows.isEmpty():
            return {"accepted": 0, "traces": 0}
        rows.write.mode("append").parquet(self.path)
        return self.raw().filter(F.col("batch") == n).agg(F.count_distinct("place").alias("accepted"), F.count_distinct("trace_id").alias("traces")).first().asDict()

    def spans(self) -> DataFrame:
        """The last version of each span, with the time when its first came."""
        raw = self.raw()
        last = latest(raw.withColumnRenamed("ingested_at", "saved_at"), KEY, ["saved_at", "batch", "place"])
        first = raw.groupBy(*KEY).agg(F.min("ingested_at").alias("ingested_at"))
        return last.join(first, KEY).select(*COLUMNS, "ingested_at")

    def recent(self, limit: int = 3000) -> DataFrame:
        """The newest spans by start; the limit is clamped to 1..10000."""
        return self.spans().orderBy(F.desc("start_ms"), "trace_id", "span_id").limit(max(1, min(limit, 10_000)))

    def trace(self, trace_id: str) -> DataFrame:
        """A trace's spans in list order; the id's filter reaches the scan."""
        return self.spans().filter(F.col("trace_id") == trace_id).orderBy("start_ms", F.desc("duration_ms"), "span_id")

    def truncate(self) -> None:
        self.spark.createDataFrame([], STORED).write.mode("overwrite").parquet(self.path)

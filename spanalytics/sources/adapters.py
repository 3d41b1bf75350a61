"""Spans derived from event tables, and keyed rows with repeated keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

WEEK_MS = 604_800_000


def from_events(events: DataFrame) -> DataFrame:
    """A span for each event: a trace is one user's week, a span's parent one of the spans before it.

    Durations are whole milliseconds, so sums are exact in any order.
    """
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    e = events.select("event_id", "user_id", "event_type", "value", ms.alias("ms"), F.regexp_extract("props", "([0-9]+)", 1).cast("long").alias("k"))
    e = e.withColumn("trace_id", F.concat_ws("-", F.col("user_id").cast("string"), F.floor(F.col("ms") / WEEK_MS).cast("string")))
    rn = F.row_number().over(W.partitionBy("trace_id").orderBy("ms", "event_id"))
    k = F.col("k")
    parent = F.when(F.col("rn") == 1, None).when(k % 50 == 0, "missing").otherwise(F.concat(F.lit("s"), F.greatest(F.lit(1), F.col("rn") - 1 - k % 3).cast("string")))
    return e.withColumn("rn", rn).select(
        "trace_id", F.concat(F.lit("s"), F.col("rn").cast("string")).alias("span_id"), parent.alias("parent_span_id"), F.concat(F.lit("svc-"), (k % 7).cast("string")).alias("service"),
        F.col("event_type").alias("operation"), F.col("ms").cast("double").alias("start_ms"), (F.round(F.col("value") * 100).cast("long") * 36000).cast("double").alias("duration_ms"),
        F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "view", "unset").otherwise("ok").alias("status"),
    )


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_events(spark.read.parquet(f"{sf_dir}/events.parquet"))


def latest(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    """The last row of each key by an order, by aggregation: no window holds a key's rows."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("row")).select(*key, *(F.col("row")[c].alias(c) for c in rest))

"""Spans as JSON lines, in the native field names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..schema import BATCH, COLUMNS, split_valid

RAW = "traceId string, spanId string, parentSpanId string, service string, operation string, startMs double, durationMs double, status string, attributes variant"


def rows(raw: DataFrame) -> DataFrame:
    """Raw native rows as span columns; absent attributes become an empty map, an empty parent id none."""
    attrs = F.expr("coalesce(try_variant_get(attributes, '$', 'map<string,variant>'), cast(map() as map<string,variant>))")
    return raw.select(
        F.col("traceId").alias("trace_id"), F.col("spanId").alias("span_id"), F.nullif(F.col("parentSpanId"), F.lit("")).alias("parent_span_id"), "service", "operation",
        F.col("startMs").alias("start_ms"), F.col("durationMs").alias("duration_ms"), "status", attrs.alias("attributes"),
    ).select(COLUMNS)


def read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected) spans of JSON-lines files."""
    return split_valid(rows(spark.read.schema(RAW).json(path)))


def batch(spark: SparkSession, spans: list[dict]) -> DataFrame:
    """A request's batch of native spans: 1 to 5000 of them, all valid; ValueError otherwise."""
    import json

    if not 1 <= len(spans) <= BATCH:
        raise ValueError(f"a batch has 1 to {BATCH} spans")
    text = spark.createDataFrame([(json.dumps(s),) for s in spans], "value string")
    good, bad = split_valid(rows(text.select(F.from_json("value", RAW).alias("s")).select("s.*")))
    broken = bad.select("violations").first()
    if broken:
        raise ValueError(f"invalid span: {', '.join(broken['violations'])}")
    return good

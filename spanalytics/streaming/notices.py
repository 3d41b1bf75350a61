"""Notices of what happened to a store, as rows of a Parquet table that readers can follow."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession, functions as F

#: The events.
EVENTS = ("ready", "ingest", "scenario", "reset")
NOTICE = "event string, span_count long, trace_count long, scenario string, batch long"


def announce(spark: SparkSession, folder: str, event: str, ack: dict | None = None, scenario: str | None = None, batch: int | None = None) -> None:
    """Writes one notice. That of a stream's batch replaces the one of an earlier attempt; others get a place of their own."""
    if event not in EVENTS:
        raise ValueError(f"no event {event}")
    ack = ack or {}
    row = spark.createDataFrame([(event, ack.get("accepted"), ack.get("traces"), scenario, batch)], NOTICE).withColumn("at", F.current_timestamp())
    row.write.mode("overwrite").parquet(f"{folder}/{event}-{uuid.uuid4().hex if batch is None else batch}")


def read(spark: SparkSession, folder: str):
    """All notices (event, span_count, trace_count, scenario, batch, at)."""
    return spark.read.schema(f"{NOTICE}, at timestamp").parquet(f"{folder}/*")

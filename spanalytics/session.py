"""Session settings that the engine relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: UTC for timestamps, LAST_WIN for merged attribute maps, shared partitionings, AQE for partition sizes and skewed joins.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    # tables that are dealt by trace stay so for joins on (trace, span): one exchange serves windows, joins and aggregations
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    "spark.sql.adaptive.enabled": "true",
    # batches for Python by bytes, as payloads can be large
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def build(app: str = "spanalytics", **more: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    for k, v in (SETTINGS | more).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def prepare(spark: SparkSession) -> SparkSession:
    """Applies the settings that can change at run time to a session made elsewhere."""
    for k, v in SETTINGS.items():
        if k != "spark.sql.adaptive.skewJoin.enabled":
            spark.conf.set(k, v)
    return spark

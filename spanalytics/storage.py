"""Tables in the folder that the driver and the executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder where it is unset and one machine runs all, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark, "_shared_dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        found = spark._shared_dir = "file://" + tempfile.mkdtemp(prefix="spans-")
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return re.sub("^file:/+", "file:///", fs.makeQualified(path).toString())


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Writes a table and reads it again: cuts the lineage, and lost executors cost nothing."""
    path = new_path(df.sparkSession, name) + "/data"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

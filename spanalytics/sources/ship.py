"""Sends this package to the executors' Python workers."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Once a context; Spark's file server does the sending."""
    sc = spark.sparkContext
    if not getattr(sc, "_spans_shipped", False):
        package = Path(__file__).resolve().parent.parent
        to = Path(tempfile.mkdtemp(prefix="spans-code-")) / "spans_code.zip"
        with zipfile.ZipFile(to, "w") as z:
            for p in sorted(package.rglob("*.py")):
                z.write(p, p.relative_to(package.parent))
        sc.addPyFile(str(to))
        sc._spans_shipped = True

"""The span table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

STATUSES = ("ok", "error", "unset")
#: The longest ids, names and batches.
MOST = {"trace_id": 128, "span_id": 128, "parent_span_id": 128, "service": 120, "operation": 240}
BATCH = 5000

SPAN = T.StructType([
    T.StructField("trace_id", T.StringType(), False), T.StructField("span_id", T.StringType(), False), T.StructField("parent_span_id", T.StringType()),
    T.StructField("service", T.StringType(), False), T.StructField("operation", T.StringType(), False),
    T.StructField("start_ms", T.DoubleType(), False), T.StructField("duration_ms", T.DoubleType(), False), T.StructField("status", T.StringType(), False),
    T.StructField("attributes", T.MapType(T.StringType(), T.VariantType())),
])
COLUMNS = [f.name for f in SPAN]


def violations() -> Column:
    """Names of the rules that a row breaks: sizes of ids and names, finite times from 0 on, a known status."""
    c = F.col
    rules = {}
    for name, most in MOST.items():
        size = F.length(c(name))
        rules[name] = (c(name).isNotNull() & ~size.between(1, most)) if name == "parent_span_id" else (c(name).isNull() | ~size.between(1, most))
    for name in ("start_ms", "duration_ms"):
        rules[name] = c(name).isNull() | F.isnan(name) | (c(name) < 0) | (c(name) == float("inf"))
    rules["status"] = c("status").isNull() | ~c("status").isin(*STATUSES)
    return F.array_compact(F.array(*(F.when(broken, F.lit(name)) for name, broken in rules.items())))


def split_valid(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows with the rules that they break)."""
    checked = rows.withColumn("violations", violations())
    return checked.filter(F.size("violations") == 0).drop("violations"), checked.filter(F.size("violations") > 0)

"""Rounding and texts against exact decimal arithmetic."""

import random
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from spanalytics.functions import labels
from spanalytics.functions.numbers import fixed_text, grouped_text, js_round, nanos_to_ms, number_text


@pytest.mark.parametrize("digits", [1, 2, 4, 6])
def test_js_round(spark, digits):
    r = random.Random(digits)
    values = [0.125, 0.375, 1.005, 1.115, 2.5, 0.05, 0.25, 0.0, 1e9 + 0.5] + [r.uniform(0, 10 ** r.randrange(1, 9)) for _ in range(1500)] + [r.randrange(10**6) / 2 ** (digits + 1) for _ in range(500)]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", js_round(F.col("v"), digits).alias("r")).collect()
    assert all(x.r == float(Decimal(x.v).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP)) for x in got)


def test_texts(spark):
    row = spark.range(1).select(
        number_text(js_round(F.lit(33.0), 1)).alias("a"), number_text(js_round(F.lit(20646.16), 1)).alias("b"), grouped_text(F.lit(1234567.84)).alias("c"), fixed_text(F.lit(12.0)).alias("d"),
        nanos_to_ms(F.lit("1789960000125000500")).alias("e"), nanos_to_ms(F.lit("-1")).alias("f"), labels.interpolate("{a} of {b}", {"a": F.lit(1)}).alias("g"), number_text(js_round(F.lit(1e7), 1)).alias("h"),
    ).first()
    assert (row.a, row.b, row.c, row.d, row.f, row.g, row.h) == ("33", "20646.2", "1,234,567.8", "12.0", None, "1 of {b}", "10000000")
    assert row.e == pytest.approx(1789960000125.0005)


def test_buckets(spark):
    rows = spark.createDataFrame([(65.0, 0.08, 0.0, 0.049), (35.0, 0.03, 0.0, -1.0), (34.9, 0.0, 1800.0, 1.0), (0.0, 0.0, 699.0, 0.05)], "s double, e double, p double, d double")
    got = rows.select(labels.confidence(F.col("s")).alias("c"), labels.severity(F.col("e"), F.col("p")).alias("v"), labels.delta_class(F.col("d"), True).alias("k")).collect()
    assert [tuple(r) for r in got] == [("high", "critical", "neutral"), ("medium", "degraded", "good"), ("low", "critical", "bad"), ("low", "healthy", "bad")]


def test_evidence_round_trip(spark):
    rows = spark.createDataFrame([(8, 24, 0.33, 2318.93, 20646.16), (0, 5, 0.0, 10.0, 0.0)], "errors long, calls long, error_rate double, p95_ms double, self_time_ms double")
    parsed = rows.select(F.explode(labels.evidence()).alias("line")).select("line", labels.parse_evidence(F.col("line")).alias("p")).select("line", "p.*").collect()
    assert [(r.kind, r.errors, r.calls, r.value) for r in parsed] == [("error", 8, 24, 33.0), ("p95", None, None, 2318.9), ("self", None, None, 20646.2), ("none", None, None, None)]

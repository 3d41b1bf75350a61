"""Spans of one or many traces: parents, self time, depth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.numbers import js_round
from ..storage import materialize

KEY = ["trace_id", "span_id"]


def first_order() -> Column:
    """Order of spans in a list: start, longer first, then ids; smallest is first."""
    return F.struct("start_ms", (-F.col("duration_ms")).alias("longer"), "trace_id", "span_id")


def with_end(spans: DataFrame) -> DataFrame:
    return spans.withColumn("end_ms", F.col("start_ms") + F.col("duration_ms"))


def parents(spans: DataFrame) -> DataFrame:
    """Each span with its parent's columns (p_...), null for roots and orphans. Parent ids are looked up in the same trace."""
    p = spans.select("trace_id", F.col("span_id").alias("parent_span_id"), *(F.col(c).alias(f"p_{c}") for c in ("service", "start_ms", "duration_ms")), F.lit(True).alias("p_found"))
    return spans.join(p, ["trace_id", "parent_span_id"], "left")


def orphans(spans: DataFrame) -> DataFrame:
    """Spans that name a parent that isn't there."""
    known = spans.select("trace_id", F.col("span_id").alias("parent_span_id"))
    return spans.filter("parent_span_id is not null").join(known, ["trace_id", "parent_span_id"], "left_anti").select(spans.columns)


def clipped(spans: DataFrame) -> DataFrame:
    """Intervals of direct children, clipped to their parent; empty ones are dropped."""
    both = parents(spans).filter("p_found")
    s = F.greatest("start_ms", "p_start_ms")
    e = F.least(F.col("start_ms") + F.col("duration_ms"), F.col("p_start_ms") + F.col("p_duration_ms"))
    return both.select("trace_id", "parent_span_id", "span_id", s.alias("s"), e.alias("e")).filter("e > s")


def covered(spans: DataFrame) -> DataFrame:
    """Length of the union of the children's intervals of each parent. Touching intervals merge."""
    before = W.partitionBy("trace_id", "parent_span_id").orderBy("s", "e", "span_id").rowsBetween(W.unboundedPreceding, -1)
    reach = F.coalesce(F.max("e").over(before), F.col("s"))
    part = F.greatest(F.lit(0.0), F.col("e") - F.greatest("s", "reach"))
    return clipped(spans).withColumn("reach", reach).groupBy("trace_id", "parent_span_id").agg(F.sum(part).alias("covered_ms"))


def self_time(spans: DataFrame) -> DataFrame:
    """Spans with end_ms and self_time_ms: the duration that no direct child covers, never below 0."""
    c = covered(spans).withColumnRenamed("parent_span_id", "span_id")
    own = js_round(F.greatest(F.lit(0.0), F.col("duration_ms") - F.coalesce("covered_ms", F.lit(0.0))), 2)
    return with_end(spans).join(c, KEY, "left").withColumn("self_time_ms", own).drop("covered_ms")


def depth(spans: DataFrame) -> DataFrame:
    """Spans with depth: 0 for roots and orphans, else one more than the parent's; null on a cycle or below one.

    Pointer doubling: each round replaces a span's pointer by its ancestor's, so the rounds are the logarithm of the
    longest chain. Rounds are written out, as a plan that doubles in size each round would be worse.
    """
    state = parents(spans).select(*KEY, F.when(F.col("p_found"), F.col("parent_span_id")).alias("up"), F.when(F.col("p_found"), 1).otherwise(0).alias("depth"))
    state = materialize(state.dropDuplicates(KEY), "depth")
    most = state.groupBy("trace_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    for _ in range(int(most).bit_length() + 1):
        if state.filter("up is not null").isEmpty():
            break
        a = state.select("trace_id", F.col("span_id").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("more"))
        done, open_ = state.filter("up is null"), state.filter("up is not null")
        moved = open_.join(a, ["trace_id", "up"]).select(*KEY, F.col("up2").alias("up"), (F.col("depth") + F.col("more")).alias("depth"))
        state = materialize(done.unionByName(moved), "depth")
    settled = state.select(*KEY, F.when(F.col("up").isNull(), F.col("depth")).alias("depth"))
    return spans.join(settled, KEY, "left")


def root(prefix: str = "") -> Column:
    """Aggregate: the first span without parent, else the first span, as a struct of service, operation and status."""
    order = F.struct(F.col("parent_span_id").isNotNull().alias("has"), "start_ms", (-F.col("duration_ms")).alias("longer"), "span_id")
    return F.min_by(F.struct("service", "operation", "status"), order)


def peak_concurrency(spans: DataFrame, slice_ms: float = 60_000.0) -> DataFrame:
    """Most spans open at once in each trace; at one instant ends come before starts.

    Running sums are taken in slices of time, and then over the slices' totals, so that a trace that holds much of the
    table is spread over many tasks.
    """
    ends = F.explode(F.array(F.struct(F.col("start_ms").alias("at"), F.lit(1).alias("delta")), F.struct((F.col("start_ms") + F.col("duration_ms")).alias("at"), F.lit(-1).alias("delta"))))
    e = spans.select("trace_id", ends.alias("x")).select("trace_id", "x.at", "x.delta")
    # steps at one instant and of one sign are summed first: their order among themselves can't matter
    e = e.groupBy("trace_id", "at", "delta").agg(F.sum("delta").alias("step"))
    running = F.sum("step").over(W.partitionBy("trace_id", "slice").orderBy("at", "delta").rowsBetween(W.unboundedPreceding, 0))
    slices = e.withColumn("slice", F.floor(F.col("at") / slice_ms)).withColumn("open", running).groupBy("trace_id", "slice").agg(F.sum("step").alias("total"), F.max("open").alias("top"))
    before = F.coalesce(F.sum("total").over(W.partitionBy("trace_id").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return slices.withColumn("open", before + F.col("top")).groupBy("trace_id").agg(F.greatest(F.lit(0), F.max("open")).cast("long").alias("peak"))

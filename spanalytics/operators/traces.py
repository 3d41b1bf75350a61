"""Traces: summaries, search, timelines, diagnostics, comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions import labels
from ..functions.numbers import fixed_text, js_round
from . import graph, spans as S


def summaries(spans: DataFrame) -> DataFrame:
    """One row a trace."""
    r, end = S.root(), F.max(F.col("start_ms") + F.col("duration_ms"))
    out = spans.groupBy("trace_id").agg(F.min("start_ms").alias("started_at_ms"), js_round(end - F.min("start_ms"), 2).alias("duration_ms"), F.count("*").alias("span_count"), F.count_if(F.col("status") == "error").alias("error_count"), r.alias("root"))
    return out.select("trace_id", "started_at_ms", "duration_ms", "span_count", "error_count", F.col("root.service").alias("root_service"), F.col("root.operation").alias("root_operation"))


def newest(rows: DataFrame, limit: int = 80) -> DataFrame:
    if not 1 <= limit <= 200:
        raise ValueError("limit must lie in 1..200")
    return rows.orderBy(F.desc("started_at_ms"), "trace_id").limit(limit)


def status(spans: DataFrame) -> DataFrame:
    """A trace's scalars: error if any span is, else its root's status."""
    end = F.max(F.col("start_ms") + F.col("duration_ms"))
    out = spans.groupBy("trace_id").agg(F.min("start_ms").alias("started_at_ms"), end.alias("ended_at_ms"), js_round(end - F.min("start_ms"), 2).alias("duration_ms"), F.bool_or(F.col("status") == "error").alias("bad"), S.root().alias("root"))
    return out.select("trace_id", "started_at_ms", "ended_at_ms", "duration_ms", F.when(F.col("bad"), "error").otherwise(F.col("root.status")).alias("status"))


def search(rows: DataFrame, text: str = "", errors_only: bool = False) -> DataFrame:
    """Summaries whose id, root service or root operation holds the text, whatever the case."""
    q = text.strip().lower()
    hit = F.lit(q == "")
    for c in ("trace_id", "root_service", "root_operation"):
        hit = hit | F.contains(F.lower(c), F.lit(q))
    return rows.filter(hit & ((F.col("error_count") > 0) if errors_only else F.lit(True)))


def one_trace(spans: DataFrame) -> DataFrame:
    """The spans, if they are of exactly one trace; raises ValueError otherwise."""
    n = spans.agg(F.count_distinct("trace_id")).first()[0]
    if n != 1:
        raise ValueError("a trace is needed" if n == 0 else "spans of more than one trace")
    return spans


def bounds(spans: DataFrame) -> DataFrame:
    end = F.max(F.col("start_ms") + F.col("duration_ms"))
    return spans.groupBy("trace_id").agg(F.min("start_ms").alias("t0"), F.greatest(F.lit(1.0), js_round(end - F.min("start_ms"), 2)).alias("length"))


def timeline(spans: DataFrame) -> DataFrame:
    """Offset and width of each span in percent of its trace, and the indent of its depth."""
    rows = S.depth(spans).join(bounds(spans), "trace_id")
    return rows.select(
        "trace_id", "span_id", "depth", ((F.col("start_ms") - F.col("t0")) / F.col("length") * 100).alias("left_pct"),
        F.greatest(F.lit(1.25), F.col("duration_ms") / F.col("length") * 100).alias("width_pct"), (10 + F.least("depth", F.lit(5)) * 12).alias("indent_px"),
    )


def replay(spans: DataFrame, steps: list[int]) -> DataFrame:
    """Spans passed and active when a replay stands at each percentage; both ends of a span count."""
    rows = spans.join(bounds(spans), "trace_id").withColumn("progress", F.explode(F.array(*map(F.lit, steps))))
    head = F.col("t0") + F.col("length") * F.col("progress") / 100
    end = F.col("start_ms") + F.col("duration_ms")
    return rows.groupBy("trace_id", "progress").agg(F.count_if(F.col("start_ms") <= head).alias("passed"), F.count_if((F.col("start_ms") <= head) & (head <= end)).alias("active"))


def diagnostics(analyzed: DataFrame) -> DataFrame:
    """Slowest span, span of the longest self time, errors, services and peak of each trace."""
    first = [F.col("start_ms"), (-F.col("duration_ms")).alias("longer"), F.col("span_id")]
    slow = F.min_by("span_id", F.struct((-F.col("duration_ms")).alias("slow"), *first))
    leader = F.min_by("span_id", F.struct((-F.col("self_time_ms")).alias("own"), *first))
    rows = analyzed.groupBy("trace_id").agg(slow.alias("slowest_span"), leader.alias("self_time_leader"), F.count_if(F.col("status") == "error").alias("errors"), F.count_distinct("service").alias("services"))
    return rows.join(S.peak_concurrency(analyzed), "trace_id")


def trend(rows: DataFrame, most: int = 18) -> DataFrame:
    """Durations of the newest traces, oldest first."""
    recent = rows.orderBy(F.desc("started_at_ms"), "trace_id").limit(most)
    order = W.orderBy("started_at_ms", F.desc("trace_id"))
    return recent.select((F.row_number().over(order) - 1).alias("i"), "trace_id", "duration_ms")


def sparkline(points: DataFrame) -> DataFrame:
    """An SVG path of at most a few points: x over 120, y from 32 up by 28; empty below two points."""
    whole = W.partitionBy()
    lo, hi, n = F.min("duration_ms").over(whole), F.greatest(F.lit(1.0), F.max("duration_ms").over(whole)), F.count("*").over(whole)
    span = F.greatest(F.lit(1.0), hi - lo)
    x, y = F.col("i") / (n - 1) * 120, 32 - (F.col("duration_ms") - lo) / span * 28
    part = F.concat(F.when(F.col("i") == 0, "M").otherwise("L"), fixed_text(x), F.lit(" "), fixed_text(y))
    p = points.select("i", n.alias("n"), F.when(n > 1, part).alias("part"))
    return p.agg(F.when(F.max("n") > 1, F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "part"))), lambda s: s["part"]), " ")).otherwise("").alias("path"))


def compare_services(base: DataFrame, other: DataFrame, most: int = 7) -> DataFrame:
    """Services of two traces side by side (their metrics tables), largest change of p95 first; a missing one counts 0."""
    a = base.select("service", F.col("p95_ms").alias("base_p95"), F.col("error_rate").alias("base_error"))
    b = other.select("service", F.col("p95_ms").alias("compare_p95"), F.col("error_rate").alias("compare_error"))
    rows = a.join(b, "service", "full_outer").fillna(0.0)
    d = F.col("compare_p95") - F.col("base_p95")
    return rows.withColumns({"p95_delta": d, "class": labels.delta_class(d, True)}).orderBy(F.desc(F.abs(d)), "service").limit(most)


def compare_traces(spans: DataFrame, base: str, other: str) -> DataFrame:
    """Change of the duration and of the number of spans, and both statuses."""
    s = status(spans.filter(F.col("trace_id").isin(base, other))).join(summaries(spans.filter(F.col("trace_id").isin(base, other))).select("trace_id", "span_count"), "trace_id")
    pick = lambda t, c: F.max(F.when(F.col("trace_id") == t, F.col(c)))
    out = s.agg((pick(other, "duration_ms") - pick(base, "duration_ms")).alias("duration_delta"), (pick(other, "span_count") - pick(base, "span_count")).alias("span_delta"), F.upper(pick(base, "status")).alias("base_status"), F.upper(pick(other, "status")).alias("compare_status"))
    return out.withColumn("class", labels.delta_class(F.col("duration_delta"), True))


def alternatives(rows: DataFrame, base: str) -> DataFrame:
    """The other traces, newest first."""
    return rows.filter(F.col("trace_id") != base).orderBy(F.desc("started_at_ms"), "trace_id")


def trace_services(spans: DataFrame, trace_id: str) -> DataFrame:
    return graph.services(S.self_time(spans.filter(F.col("trace_id") == trace_id)))

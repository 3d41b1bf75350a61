"""The incident report as Markdown text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numbers import fixed_text, grouped_text, time_text
from ..operators import graph, spans as S, traces


def service_table(nodes: DataFrame, most: int = 7) -> DataFrame:
    """The first services' rows of the report, numbered."""
    from pyspark.sql import Window as W

    top = nodes.orderBy(F.desc("p95_ms"), "first_seen").limit(most)
    row = F.concat(F.lit("| "), F.col("service"), F.lit(" | "), grouped_text(F.col("p95_ms")), F.lit(" ms | "), grouped_text(F.col("error_rate") * 100), F.lit("% | "), grouped_text(F.col("self_time_ms")), F.lit(" ms |"))
    return top.select(F.row_number().over(W.orderBy(F.desc("p95_ms"), "first_seen")).alias("i"), row.alias("line"))


def report(spans: DataFrame, trace_id: str | None = None, title: str = "Incident report", generated_at: Column | None = None) -> DataFrame:
    """One row with the report: time (now, if none is given), totals, the selected trace, the leading hypothesis' evidence, and seven
    services."""
    nodes = graph.service_table(S.self_time(spans))
    hyp = graph.ranked(graph.hypotheses(nodes)).filter("rank = 1").select(F.col("service").alias("leading"), "evidence")
    total = graph.totals(spans)
    table = service_table(nodes).agg(F.array_sort(F.collect_list(F.struct("i", "line"))).alias("rows"))
    one = total.join(F.broadcast(table)).join(F.broadcast(hyp), how="left")
    lines = [
        F.lit(f"# {title}"), F.lit(""), F.lit("## Summary"), F.lit(""), F.concat(F.lit("- Generated at: "), time_text(generated_at if generated_at is not None else F.current_timestamp())), F.concat(F.lit("- Traces: "), F.format_number("traces", 0)), F.concat(F.lit("- Services: "), F.format_number("services", 0)),
        F.concat(F.lit("- Error rate: "), fixed_text(F.col("error_rate") * 100), F.lit("%")), F.concat(F.lit("- Leading service: "), F.coalesce("leading", F.lit("—"))),
    ]
    parts = [F.array(*lines)]
    if trace_id is not None:
        t = traces.status(spans.filter(F.col("trace_id") == trace_id)).select(F.col("trace_id").alias("tid"), F.col("duration_ms").alias("tdur"), F.upper("status").alias("tstatus"))
        n = spans.filter(F.col("trace_id") == trace_id).agg(F.count("*").alias("tspans"))
        one = one.join(F.broadcast(t), how="left").join(F.broadcast(n))
        parts.append(F.when(F.col("tid").isNotNull(), F.array(F.lit(""), F.lit("## Selected trace"), F.lit(""), F.concat(F.lit("- Trace ID: "), F.col("tid")), F.concat(F.lit("- Duration: "), grouped_text(F.col("tdur")), F.lit(" ms")), F.concat(F.lit("- Status: "), F.col("tstatus")), F.concat(F.lit("- Spans: "), F.format_number("tspans", 0)))).otherwise(F.array().cast("array<string>")))
    parts.append(F.when(F.col("leading").isNotNull(), F.concat(F.array(F.lit(""), F.lit("## Evidence"), F.lit("")), F.transform("evidence", lambda x: F.concat(F.lit("- "), x)))).otherwise(F.array().cast("array<string>")))
    parts.append(F.concat(F.array(F.lit(""), F.lit("## Services"), F.lit(""), F.lit("| Service | p95 | Error rate | Self time |"), F.lit("| --- | ---: | ---: | ---: |")), F.transform("rows", lambda r: r["line"])))
    return one.select(F.array_join(F.concat(*parts), "\n").alias("report"))


def write(df: DataFrame, path: str) -> None:
    """Writes the report's one row as a text file."""
    df.select("report").coalesce(1).write.mode("overwrite").text(path)

"""Entry points over a store; bad arguments raise ValueError, a missing trace LookupError."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import graph, spans as S, traces as T
from ..sources import native, otlp, scenarios
from ..sources.store import SpanStore
from ..streaming.notices import announce


def health(spark: SparkSession) -> dict:
    return {"ok": spark.sql("SELECT 1").first()[0] == 1, "service": "spanalytics", "time": spark.sql("SELECT cast(current_timestamp() AS string)").first()[0]}


def ingest_spans(store: SpanStore, spans: list[dict]) -> dict:
    return store.save(native.batch(store.spark, spans))


def ingest_otlp(store: SpanStore, payload: str) -> dict:
    rows = store.spark.createDataFrame([(payload,)], "payload string")
    try:
        otlp.decode(payload)
    except otlp.Rejected as e:
        raise ValueError(str(e)) from e
    store.save(otlp.parse(rows, strict=True)[0])
    return {"partialSuccess": {}}


def analyze_window(spans: DataFrame) -> dict[str, DataFrame]:
    """Services, edges and hypotheses of any set of spans."""
    nodes = graph.service_table(S.self_time(spans))
    return {"services": graph.ordered_services(nodes), "edges": graph.ordered_edges(graph.edges(spans)), "hypotheses": graph.ranked(graph.hypotheses(nodes))}


def analyze_trace(spans: DataFrame) -> dict[str, DataFrame]:
    """A trace's scalars and spans with self time and depth, and the window's analysis of it."""
    one = T.one_trace(spans)
    rows = S.depth(S.self_time(one)).orderBy("start_ms", F.desc("duration_ms"), "span_id")
    return {"trace": T.status(one), "spans": rows} | analyze_window(one)


def overview(store: SpanStore, limit: int | None = None) -> dict[str, DataFrame]:
    """Totals and the window's analysis; over all spans unless a limit asks for the newest only."""
    spans = store.spans() if limit is None else store.recent(limit)
    return {"totals": graph.totals(spans)} | analyze_window(spans)


def list_traces(store: SpanStore, limit: int = 80) -> DataFrame:
    return T.newest(T.summaries(store.spans()), limit)


def get_trace(store: SpanStore, trace_id: str) -> dict[str, DataFrame]:
    if not 1 <= len(trace_id) <= 128:
        raise ValueError("a trace id has 1 to 128 characters")
    spans = store.trace(trace_id)
    if spans.isEmpty():
        raise LookupError(f"no trace {trace_id}")
    return analyze_trace(spans)


def run_scenario(store: SpanStore, scenario: str, traces: int = 24, base_ms: int = 1_700_000_000_000, notices: str | None = None) -> dict:
    ack = store.save(scenarios.generate(store.spark, scenario, traces, base_ms))
    if notices:
        announce(store.spark, notices, "scenario", ack, scenario=scenario)
    return {"scenario": scenario, "spans": ack["accepted"], "traces": ack["traces"]}


def clear(store: SpanStore, notices: str | None = None) -> None:
    store.truncate()
    if notices:
        announce(store.spark, notices, "reset")

"""The query catalogue: each operator over the spans derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import schema
from ..functions import labels
from ..functions.numbers import fixed_text, grouped_text, js_round, nanos_to_ms, number_text, time_text
from ..operators import graph as G, spans as S, traces as T
from ..session import prepare
from ..sources import native, otlp, scenarios
from ..sources.adapters import latest, spans as span_view
from ..storage import materialize
from . import api, report as R

QUERIES = {}


def query(f):
    """Registers f(spans) under its name."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return f(span_view(prepare(spark), sf_dir))

    QUERIES[f.__name__] = run
    return f


def table_query(f):
    """Registers f(spark, sf_dir) under its name."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return f(prepare(spark), sf_dir)

    QUERIES[f.__name__] = run
    return f


def _nodes(s: DataFrame) -> DataFrame:
    return G.service_table(S.self_time(s))


def _pick(s: DataFrame, nth: int) -> str:
    """The nth trace id by (spans descending, id): one present at every scale."""
    rows = s.groupBy("trace_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "trace_id").limit(nth + 1).collect()
    return rows[-1]["trace_id"]


@query
def spans_view(s):
    return s


@query
def span_decoded(s):
    return S.with_end(s).select("trace_id", "span_id", F.coalesce("parent_span_id", F.lit("")).alias("parent"), "start_ms", "end_ms", (F.col("status") == "error").alias("is_error"))


@query
def recent_spans(s):
    return s.orderBy(F.desc("start_ms"), "trace_id", "span_id").limit(3000).select("trace_id", "span_id", "start_ms")


@query
def trace_spans(s):
    return s.filter(F.col("trace_id") == _pick(s, 0)).orderBy("start_ms", F.desc("duration_ms"), "span_id")


@table_query
def span_dedup_upsert(spark, d):
    rows = spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_linestatus")
    first = rows.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_shipdate").alias("first_shipdate"), F.count("*").alias("versions"))
    last = latest(rows, ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice"])
    return last.join(first, ["l_orderkey", "l_linenumber"])


@query
def ingest_ack(s):
    return s.agg(F.count("*").alias("accepted"), F.count_distinct("trace_id").alias("traces"))


@query
def ingest_batches(s):
    """Acknowledgement of each batch of at most 5000 spans, a batch being a week's slice by hash."""
    b = F.floor(F.col("start_ms") / 604800000).cast("long")
    return s.groupBy(b.alias("batch")).agg(F.count("*").alias("accepted"), F.count_distinct("trace_id").alias("traces"), (F.count("*") > schema.BATCH).alias("too_large"))


@query
def invalid_span_split(s):
    broken = s.withColumns({"duration_ms": F.when(F.col("duration_ms") > 1e9, -F.col("duration_ms")).otherwise(F.col("duration_ms")), "status": F.when(F.col("operation") == "signup", F.lit("new")).otherwise(F.col("status"))})
    good, bad = schema.split_valid(broken)
    tag = lambda x, v: x.select("trace_id", "span_id", v.alias("violations"))
    return tag(good, F.lit("")).union(tag(bad, F.array_join("violations", ",")))


@query
def parent_child_pairs(s):
    return S.parents(s).filter("p_found").select("trace_id", "span_id", "parent_span_id", "service", F.col("p_service").alias("parent_service"))


@query
def children_per_parent(s):
    return S.parents(s).filter("p_found").groupBy("trace_id", F.col("parent_span_id").alias("span_id")).agg(F.count("*").alias("children"))


@query
def orphan_spans(s):
    return S.orphans(s).select("trace_id", "span_id", "parent_span_id")


@query
def root_spans(s):
    return s.groupBy("trace_id").agg(S.root().alias("r")).select("trace_id", F.col("r.service").alias("service"), F.col("r.operation").alias("operation"), F.col("r.status").alias("status"))


@query
def child_intervals_clipped(s):
    return S.clipped(s)


@query
def interval_union_covered(s):
    return S.covered(s)


@query
def self_time(s):
    return S.self_time(s).select("trace_id", "span_id", "duration_ms", "end_ms", "self_time_ms")


@query
def span_depth(s):
    return S.depth(s).select("trace_id", "span_id", "depth")


@query
def service_metrics(s):
    return G.services(S.self_time(s)).select(G.SERVICE_COLUMNS)


@query
def service_order(s):
    return G.placed(_nodes(s), F.desc("p95_ms"), "first_seen").select("place", "service", "p95_ms")


@query
def service_p95(s):
    return G.ranked_values(materialize(s.groupBy("service", "duration_ms").agg(F.count("*").alias("n")), "durations"), {"p95": 0.95, "p50": 0.5})


@query
def service_edges(s):
    return G.edges(s).drop("first_seen")


@query
def service_edges_ordered(s):
    return G.placed(G.edges(s), F.desc("calls"), "first_seen").drop("first_seen")


@query
def hypotheses_top5(s):
    return G.ranked(G.hypotheses(_nodes(s))).select("rank", "service", "score", "confidence")


@query
def hypotheses_rest(s):
    return G.ranked(G.hypotheses(_nodes(s)), 1).filter("rank <= 4").select(F.lpad(F.col("rank").cast("string"), 2, "0").alias("label"), "service", "score")


@query
def hypothesis_evidence(s):
    return G.ranked(G.hypotheses(_nodes(s))).select("rank", "service", F.array_join("evidence", " / ").alias("evidence"))


@query
def hypothesis_calm(s):
    return G.calm(G.hypotheses(_nodes(s)))


@query
def evidence_parsed(s):
    lines = G.ranked(G.hypotheses(_nodes(s))).select("rank", F.posexplode("evidence").alias("i", "line"))
    p = labels.parse_evidence(F.col("line"))
    return lines.select("rank", "i", p["kind"].alias("kind"), p["errors"].alias("errors"), p["calls"].alias("calls"), p["value"].alias("value"))


@query
def trace_summaries(s):
    return T.summaries(s)


@query
def trace_list_top80(s):
    return T.newest(T.summaries(s), 80)


@query
def trace_status(s):
    return T.status(s)


@query
def overview_totals(s):
    return G.totals(s)


@query
def overview_empty(s):
    return G.totals(s.filter("duration_ms < 0"))


@query
def slo_health(s):
    return G.health(G.totals(s), _nodes(s))


@query
def latency_trend(s):
    return T.trend(T.summaries(s)).select("i", "trace_id", "duration_ms")


@query
def sparkline(s):
    return T.sparkline(T.trend(T.summaries(s)))


@query
def peak_concurrency(s):
    return S.peak_concurrency(s)


@query
def trace_diagnostics(s):
    return T.diagnostics(S.self_time(s))


@query
def timeline_geometry(s):
    return T.timeline(s).withColumns({"left_pct": F.round("left_pct", 6), "width_pct": F.round("width_pct", 6)})


@query
def replay_active_spans(s):
    return T.replay(s, [0, 25, 50, 75, 100])


@query
def trace_search(s):
    return T.search(T.summaries(s), " SVC-3 ").select("trace_id", "root_service", "root_operation")


@query
def errors_only(s):
    return T.search(T.summaries(s), "", True).select("trace_id", "error_count")


@query
def service_inbound_outbound(s):
    return G.inspector(G.edges(s), "svc-2")


@query
def service_lookup(s):
    nodes = _nodes(s)
    return G.lookup(nodes, G.hypotheses(nodes), "svc-2")


@query
def trace_compare_services(s):
    return T.compare_services(T.trace_services(s, _pick(s, 0)), T.trace_services(s, _pick(s, 1)))


@query
def trace_compare_summary(s):
    return T.compare_traces(s, _pick(s, 0), _pick(s, 1))


@query
def trace_alternatives(s):
    return T.alternatives(T.summaries(s), _pick(s, 0)).select("trace_id", "started_at_ms", labels.short_id(F.col("trace_id")).alias("short_id"))


@query
def service_union(s):
    two = s.filter(F.col("trace_id").isin(_pick(s, 0), _pick(s, 1)))
    return two.select("service").distinct()


@query
def service_layout(s):
    nodes = _nodes(s)
    return G.layout(nodes, G.hypotheses(nodes)).withColumns({"x": F.round("x", 6), "y": F.round("y", 6)})


@query
def edge_flags(s):
    return G.edges(s).select("source", "target", (F.col("errors") > 0).alias("animated"))


@query
def number_formats(s):
    d = F.col("duration_ms") / 7
    return s.select("trace_id", "span_id", js_round(d, 2).alias("r2"), js_round(d, 4).alias("r4"), number_text(js_round(d, 1)).alias("text"), grouped_text(d).alias("grouped"), fixed_text(d).alias("fixed"))


@query
def incident_report(s):
    return R.report(s, _pick(s, 0), generated_at=F.lit("2024-01-02 13:04:05").cast("timestamp"))


@query
def trace_analysis(s):
    """The whole analysis of one trace: its spans with self time and depth, beside the trace's scalars and services."""
    got = api.analyze_trace(s.filter(F.col("trace_id") == _pick(s, 0)))
    services = got["services"].agg(F.count("*").alias("services"), F.max("p95_ms").alias("top_p95_ms"))
    calls = got["edges"].agg(F.coalesce(F.sum("calls"), F.lit(0)).alias("calls_between"))
    rows = got["spans"].select("trace_id", "span_id", "end_ms", "self_time_ms", "depth").join(F.broadcast(got["trace"].select("trace_id", F.col("status").alias("trace_status"), F.col("duration_ms").alias("trace_ms"))), "trace_id")
    return rows.join(F.broadcast(services)).join(F.broadcast(calls))


@query
def label_texts(s):
    """Texts and numbers of single values: nanoseconds, status codes, templates, times of day."""
    code = F.element_at(F.array(*map(F.lit, ("1", "2", "STATUS_CODE_OK", "STATUS_CODE_ERROR", "0", "x"))), (1 + F.floor(F.col("start_ms") / 1000) % 6).cast("int"))
    nanos = F.concat(F.format_string("%.0f", F.col("start_ms")), F.lit("123456"))
    told = labels.interpolate("{service} took {ms} ms, {rest}", {"service": F.col("service"), "ms": F.format_string("%.0f", F.col("duration_ms"))})
    return s.select("trace_id", "span_id", nanos_to_ms(nanos).alias("ms"), nanos_to_ms(F.concat(F.lit("-"), nanos)).alias("none"), labels.status_code(code).alias("status_name"), told.alias("told"), time_text(F.timestamp_millis(F.col("start_ms").cast("long"))).alias("time_of_day"))


@table_query
def otlp_parse(spark, d):
    """Every trace as an OTLP payload, parsed back into spans."""
    s = span_view(spark, d)
    nanos = lambda ms: F.concat(F.format_string("%.0f", ms), F.lit("000000"))
    pair = lambda k, t, v: F.struct(F.lit(k).alias("key"), F.struct(v.alias(t)).alias("value"))
    code = F.when(F.col("status") == "error", "STATUS_CODE_ERROR").when(F.col("status") == "ok", "1").otherwise("STATUS_CODE_UNSET")
    span = F.struct(
        F.col("trace_id").alias("traceId"), F.col("span_id").alias("spanId"), F.coalesce("parent_span_id", F.lit("")).alias("parentSpanId"), F.col("operation").alias("name"),
        nanos(F.col("start_ms")).alias("startTimeUnixNano"), nanos(F.col("start_ms") + F.col("duration_ms")).alias("endTimeUnixNano"), F.struct(code.alias("code")).alias("status"),
        F.array(pair("row", "stringValue", F.col("span_id"))).alias("attributes"),
    )
    # payloads of at most 5000 spans: about half as many in each block of a trace's service
    size = s.groupBy("trace_id", "service").agg(F.ceil(F.count("*") * 2 / schema.BATCH).alias("blocks"))
    block = F.pmod(F.xxhash64("span_id"), "blocks").alias("block")
    scope = s.join(size, ["trace_id", "service"]).groupBy("trace_id", "service", block).agg(F.collect_list(span).alias("spans"))
    payload = F.struct(F.array(F.struct(F.struct(F.array(pair("service.name", "stringValue", F.col("service"))).alias("attributes")).alias("resource"), F.array(F.struct(F.struct(F.lit("replay").alias("name")).alias("scope"), F.col("spans"))).alias("scopeSpans"))).alias("resourceSpans"))
    good, _ = otlp.parse(scope.select(F.to_json(payload).alias("payload")), strict=True)
    return good.select("trace_id", "span_id", "parent_span_id", "service", "operation", "start_ms", "duration_ms", "status", F.expr("try_variant_get(attributes['row'], '$', 'string')").alias("row_attribute"))


@table_query
def otlp_forms(spark, d):
    """Every span as a payload of its own: legacy groups, numeric status codes, all kinds of values, precedence of attributes."""
    s = span_view(spark, d)
    m = (F.col("start_ms") / 1000).cast("long")
    whole, kind = (m % 1000).cast("string"), m % 8
    ms, end = F.format_string("%.0f", F.col("start_ms")), F.format_string("%.0f", F.col("start_ms") + F.col("duration_ms"))
    forms = [F.concat(F.lit('{"stringValue":"'), whole, F.lit('","intValue":7}')), F.concat(F.lit('{"intValue":"0x'), F.lower(F.hex(m % 1000)), F.lit('"}')), F.concat(F.lit('{"intValue":"1_'), whole, F.lit('"}')), F.concat(F.lit('{"intValue":'), whole, F.lit("}")), F.concat(F.lit('{"doubleValue":'), whole, F.lit(".5}")), F.lit('{"boolValue":true,"stringValue":5}'),
        F.concat(F.lit('{"arrayValue":{"values":[{"intValue":"'), whole, F.lit('"},{},{"stringValue":"a"}]}}')), F.concat(F.lit('{"kvlistValue":{"values":[{"key":"n","value":{"intValue":'), whole, F.lit('}},{"key":"l","value":{"arrayValue":{"values":[{"boolValue":false}]}}}]}}'))]
    value = F.element_at(F.array(*forms), (kind + 1).cast("int"))
    legacy = m % 2 == 1
    code = F.when(F.col("status") == "error", F.when(legacy, "2.0").otherwise('"STATUS_CODE_ERROR"')).when(F.col("status") == "ok", F.when(legacy, "1").otherwise('"1"')).otherwise(F.when(legacy, "true").otherwise('"2.0"'))
    parent = F.coalesce(F.concat(F.lit('"parentSpanId":"'), F.col("parent_span_id"), F.lit('",')), F.lit(""))
    span = F.concat(F.lit('{"traceId":"'), F.col("trace_id"), F.lit('","spanId":"'), F.col("span_id"), F.lit('",'), parent, F.lit('"name":"'), F.col("operation"), F.lit('","startTimeUnixNano":"'), ms, F.lit('000000","endTimeUnixNano":"'), end, F.lit('000000","status":{"code":'), code, F.lit('},"attributes":[{"key":"v","value":'), value, F.lit('},{"key":"zone","value":{"stringValue":"span"}},{"key":"otel.scope.name","value":{"stringValue":"span"}}]}'))
    group = F.when(legacy, '"instrumentationLibrarySpans":[{"instrumentationLibrary":{"name":"old"},"spans":[').otherwise('"scopeSpans":[{"scope":{"name":"new"},"spans":[')
    resource = F.concat(F.lit('{"resourceSpans":[{"resource":{"attributes":[{"key":"zone","value":{"stringValue":"resource"}},{"key":"env","value":{"stringValue":"resource"}},{"key":"service.name","value":{"stringValue":"'), F.col("service"), F.lit('"}}]},'))
    good, _ = otlp.parse(s.select(F.concat(resource, group, span, F.lit("]}]}]}")).alias("payload")), strict=True)
    text = lambda k: F.expr(f"try_variant_get(attributes['{k}'], '$', 'string')").alias(k.replace(".", "_"))
    return good.select("trace_id", "span_id", "parent_span_id", "service", "operation", "start_ms", "duration_ms", "status", text("v"), text("zone"), text("env"), text("otel.scope.name"), F.schema_of_variant(F.expr("attributes['v']")).alias("kind"))


@table_query
def native_json(spark, d):
    """Every span as native JSON and back, through the rules of the native source."""
    s = span_view(spark, d)
    raw = s.select(F.col("trace_id").alias("traceId"), F.col("span_id").alias("spanId"), F.col("parent_span_id").alias("parentSpanId"), "service", "operation", F.col("start_ms").alias("startMs"), F.col("duration_ms").alias("durationMs"), "status")
    back = raw.select(F.from_json(F.to_json(F.struct("*")), native.RAW).alias("s")).select("s.*")
    return schema.split_valid(native.rows(back))[0].drop("attributes")


def _scenario(name):
    def run(spark, d):
        s = scenarios.generate(prepare(spark), name)
        return G.ordered_services(G.services(S.self_time(s)))

    QUERIES["scenario_" + name.replace("-", "_")] = run


for _name in scenarios.SCENARIOS:
    _scenario(_name)


@table_query
def stream_ingest(spark, d):
    """The spans as JSON files, streamed into a store; returns the sum of the notices and the spans stored."""
    from ..sources.store import SpanStore
    from ..storage import new_path
    from ..streaming import ingest, notices

    base = new_path(spark, "stream")
    s = span_view(spark, d)
    s.select(F.col("trace_id").alias("traceId"), F.col("span_id").alias("spanId"), F.col("parent_span_id").alias("parentSpanId"), "service", "operation", F.col("start_ms").alias("startMs"), F.col("duration_ms").alias("durationMs"), "status").write.json(f"{base}/in")
    store = SpanStore(spark, f"{base}/store")
    ingest.start(spark, f"{base}/in", store, f"{base}/notices", f"{base}/checkpoint").awaitTermination()
    return notices.read(spark, f"{base}/notices").agg(F.sum("span_count").alias("accepted"), F.lit(store.spans().count()).cast("long").alias("stored"))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: events to spans, self time, service metrics, ranked hypotheses."""
    return G.ranked(G.hypotheses(_nodes(span_view(prepare(spark), sf_dir))))

"""DuckDB SQL for the queries, written apart from the DataFrame plans."""

from __future__ import annotations

#: The evidence sentences, as patterns.
ERROR_SENTENCE = "^([0-9]+)/([0-9]+) spans ended in error [(]([0-9.]+)%[)][.]$"
P95_SENTENCE = "^p95 latency reached ([0-9.]+) ms[.]$"
SELF_SENTENCE = "^([0-9.]+) ms were spent inside the service after removing overlapping child calls[.]$"


def jr(x: str, d: int) -> str:
    """toFixed's rounding: printf rounds the exact value but sends exact ties to even."""
    return f"(CASE WHEN fmod(({x}) * {2 ** (d + 1)}e0, 2e0) = 1 THEN (floor(({x}) * {10**d}e0) + 1) / {10**d}e0 ELSE CAST(printf('%.{d}f', CAST({x} AS DOUBLE)) AS DOUBLE) END)"


def text1(x: str) -> str:
    return f"regexp_replace(printf('%.1f', {x}), '\\.0$', '')"


def grouped(x: str) -> str:
    """Thousands separators, at most one decimal."""
    r = jr(x, 1)
    return f"regexp_replace(format('{{:,.1f}}', {r}), '\\.0$', '')"


def order(a: str = "") -> str:
    return f"({{'a': {a}start_ms, 'b': -{a}duration_ms, 'c': {a}trace_id, 'd': {a}span_id}})"


SPANS = """
e0 AS (SELECT event_id, user_id, event_type, value, epoch_us(ts) // 1000 AS ms, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events),
e1 AS (SELECT *, user_id || '-' || CAST(floor(ms / 604800000) AS BIGINT) AS trace_id, row_number() OVER (PARTITION BY user_id, CAST(floor(ms / 604800000) AS BIGINT) ORDER BY ms, event_id) AS rn FROM e0),
s AS (SELECT trace_id, 's' || rn AS span_id, CASE WHEN rn = 1 THEN NULL WHEN k % 50 = 0 THEN 'missing' ELSE 's' || greatest(1, rn - 1 - k % 3) END AS parent_span_id, 'svc-' || (k % 7) AS service,
    event_type AS operation, CAST(ms AS DOUBLE) AS start_ms, CAST(CAST(round(value * 100) AS BIGINT) * 36000 AS DOUBLE) AS duration_ms,
    CASE event_type WHEN 'error' THEN 'error' WHEN 'view' THEN 'unset' ELSE 'ok' END AS status FROM e1)"""

PAIRS = """,
pc AS (SELECT c.*, p.service AS p_service, greatest(c.start_ms, p.start_ms) AS cs, least(c.start_ms + c.duration_ms, p.start_ms + p.duration_ms) AS ce FROM s c JOIN s p ON p.trace_id = c.trace_id AND p.span_id = c.parent_span_id)"""

SELF = PAIRS + f""",
iv AS (SELECT trace_id, parent_span_id, span_id, cs, ce, max(ce) OVER (PARTITION BY trace_id, parent_span_id ORDER BY cs, ce, span_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM pc WHERE ce > cs),
cov AS (SELECT trace_id, parent_span_id, sum(CASE WHEN reach IS NULL OR cs > reach THEN ce - cs WHEN ce > reach THEN ce - reach ELSE 0e0 END) AS covered_ms FROM iv GROUP BY ALL),
a AS (SELECT s.*, s.start_ms + s.duration_ms AS end_ms, {jr("greatest(0e0, s.duration_ms - coalesce(cov.covered_ms, 0e0))", 2)} AS self_time_ms FROM s LEFT JOIN cov ON cov.trace_id = s.trace_id AND cov.parent_span_id = s.span_id)"""

METRICS = SELF + f""",
m0 AS (SELECT service, count(*) AS calls, count(*) FILTER (status = 'error') AS errors, sum(duration_ms) AS total, quantile_disc(duration_ms, 0.95) AS p95, sum(self_time_ms) AS own, min({order()}) AS first_seen FROM a GROUP BY service),
m AS (SELECT service, calls, errors, {jr("errors / calls", 2)} AS error_rate, {jr("total / calls", 2)} AS average_ms, {jr("p95", 2)} AS p95_ms, {jr("own", 2)} AS self_time_ms, first_seen FROM m0)"""

HYP = METRICS + f""",
h0 AS (SELECT *, error_rate * 55 + p95_ms / greatest(1e0, (SELECT max(p95_ms) FROM m)) * 30 + self_time_ms / greatest(1e0, (SELECT max(self_time_ms) FROM m)) * 15 AS raw FROM m),
h1 AS (SELECT *, {jr("raw", 1)} AS score, CASE WHEN raw >= 65 THEN 'high' WHEN raw >= 35 THEN 'medium' ELSE 'low' END AS confidence, list_filter([
    CASE WHEN errors > 0 THEN errors || '/' || calls || ' spans ended in error (' || {text1(jr("error_rate * 100", 1))} || '%).' END,
    CASE WHEN p95_ms >= 500 THEN 'p95 latency reached ' || {text1(jr("p95_ms", 1))} || ' ms.' END,
    CASE WHEN self_time_ms > 0 THEN {text1(jr("self_time_ms", 1))} || ' ms were spent inside the service after removing overlapping child calls.' END], lambda x: x IS NOT NULL) AS said FROM h0),
h AS (SELECT *, CASE WHEN len(said) > 0 THEN said ELSE ['No strong error or latency signal was detected.'] END AS evidence, CAST(row_number() OVER (ORDER BY score DESC, p95_ms DESC, first_seen) AS INTEGER) AS rank FROM h1 QUALIFY rank <= 5)"""

ROOT = "{'a': parent_span_id IS NOT NULL, 'b': start_ms, 'c': -duration_ms, 'd': span_id}"

SUMMARY = f""",
t AS (SELECT trace_id, min(start_ms) AS started_at_ms, max(start_ms + duration_ms) AS ended_at_ms, {jr("max(start_ms + duration_ms) - min(start_ms)", 2)} AS duration_ms, count(*) AS span_count, count(*) FILTER (status = 'error') AS error_count,
    arg_min(service, {ROOT}) AS root_service, arg_min(operation, {ROOT}) AS root_operation, CASE WHEN bool_or(status = 'error') THEN 'error' ELSE arg_min(status, {ROOT}) END AS trace_status FROM s GROUP BY trace_id)"""

PICK = """,
pk AS (SELECT trace_id, row_number() OVER (ORDER BY count(*) DESC, trace_id) AS nth FROM s GROUP BY trace_id QUALIFY nth <= 2)"""

EDGES = PAIRS + f""",
ed AS (SELECT p_service AS source, service AS target, count(*) AS calls, count(*) FILTER (status = 'error') AS errors, {jr("sum(duration_ms) / count(*)", 2)} AS average_ms, min({order()}) AS first_seen FROM pc WHERE p_service <> service GROUP BY p_service, service)"""

#: The spans of the largest trace alone.
ONE_TRACE = SPANS.replace("\ns AS (", "\nevery AS (") + """,
s AS (SELECT * FROM every WHERE trace_id = (SELECT trace_id FROM every GROUP BY trace_id ORDER BY count(*) DESC, trace_id LIMIT 1))"""

PEAK = """,
ev AS (SELECT trace_id, start_ms AS moment, 1 AS delta FROM s UNION ALL SELECT trace_id, start_ms + duration_ms, -1 FROM s),
run AS (SELECT trace_id, sum(delta) OVER (PARTITION BY trace_id ORDER BY moment, delta ROWS UNBOUNDED PRECEDING) AS open FROM ev),
peak AS (SELECT trace_id, CAST(greatest(0, max(open)) AS BIGINT) AS peak FROM run GROUP BY trace_id)"""

DEPTH = """,
d AS (SELECT c.trace_id, c.span_id, 0 AS depth FROM s c LEFT JOIN s p ON p.trace_id = c.trace_id AND p.span_id = c.parent_span_id WHERE p.span_id IS NULL
    UNION ALL SELECT s.trace_id, s.span_id, d.depth + 1 FROM d JOIN s ON s.trace_id = d.trace_id AND s.parent_span_id = d.span_id)"""

BOUNDS = f""",
b AS (SELECT trace_id, min(start_ms) AS t0, greatest(1e0, {jr("max(start_ms + duration_ms) - min(start_ms)", 2)}) AS len FROM s GROUP BY trace_id)"""

TREND = SUMMARY + """,
tr0 AS (SELECT * FROM t ORDER BY started_at_ms DESC, trace_id LIMIT 18),
tr AS (SELECT CAST(row_number() OVER (ORDER BY started_at_ms, trace_id DESC) - 1 AS INTEGER) AS i, trace_id, duration_ms FROM tr0)"""


def trace_metrics(name: str, nth: int) -> str:
    return f", {name} AS (SELECT service, {jr('quantile_disc(duration_ms, 0.95)', 2)} AS p95, {jr('count(*) FILTER (status = $$error$$) / count(*)', 2)} AS err FROM s WHERE trace_id = (SELECT trace_id FROM pk WHERE nth = {nth}) GROUP BY service)"


def _q(select: str, *parts: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' * recursive}{SPANS}{''.join(parts)} {select}"


SQL = {
    "spans_view": _q("SELECT * FROM s"),
    "span_decoded": _q("SELECT trace_id, span_id, coalesce(parent_span_id, '') AS parent, start_ms, start_ms + duration_ms AS end_ms, status = 'error' AS is_error FROM s"),
    "recent_spans": _q("SELECT trace_id, span_id, start_ms FROM s ORDER BY start_ms DESC, trace_id, span_id LIMIT 3000"),
    "trace_spans": _q("SELECT * FROM s WHERE trace_id = (SELECT trace_id FROM pk WHERE nth = 1)", PICK),
    "span_dedup_upsert": """
        SELECT l_orderkey, l_linenumber, l_shipdate, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_linestatus,
            min(l_shipdate) OVER (PARTITION BY l_orderkey, l_linenumber) AS first_shipdate, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS versions
        FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) = 1""",
    "ingest_ack": _q("SELECT count(*) AS accepted, count(DISTINCT trace_id) AS traces FROM s"),
    "ingest_batches": _q("SELECT CAST(floor(start_ms / 604800000) AS BIGINT) AS batch, count(*) AS accepted, count(DISTINCT trace_id) AS traces, count(*) > 5000 AS too_large FROM s GROUP BY 1"),
    "invalid_span_split": _q("SELECT trace_id, span_id, concat_ws(',', CASE WHEN duration_ms > 1e9 THEN 'duration_ms' END, CASE WHEN operation = 'signup' THEN 'status' END) AS violations FROM s"),
    "parent_child_pairs": _q("SELECT trace_id, span_id, parent_span_id, service, p_service AS parent_service FROM pc", PAIRS),
    "children_per_parent": _q("SELECT trace_id, parent_span_id AS span_id, count(*) AS children FROM pc GROUP BY ALL", PAIRS),
    "orphan_spans": _q("SELECT trace_id, span_id, parent_span_id FROM s c WHERE parent_span_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM s p WHERE p.trace_id = c.trace_id AND p.span_id = c.parent_span_id)"),
    "root_spans": _q("SELECT trace_id, service, operation, status FROM s QUALIFY row_number() OVER (PARTITION BY trace_id ORDER BY parent_span_id IS NOT NULL, start_ms, duration_ms DESC, span_id) = 1"),
    "child_intervals_clipped": _q("SELECT trace_id, parent_span_id, span_id, cs AS s, ce AS e FROM pc WHERE ce > cs", PAIRS),
    "interval_union_covered": _q("SELECT trace_id, parent_span_id, covered_ms FROM cov", SELF),
    "self_time": _q("SELECT trace_id, span_id, duration_ms, end_ms, self_time_ms FROM a", SELF),
    "span_depth": _q("SELECT * FROM d", DEPTH, recursive=True),
    "service_metrics": _q("SELECT * EXCLUDE (first_seen) FROM m", METRICS),
    "service_order": _q("SELECT CAST(row_number() OVER (ORDER BY p95_ms DESC, first_seen) AS INTEGER) AS place, service, p95_ms FROM m", METRICS),
    "service_p95": _q("SELECT service, quantile_disc(duration_ms, 0.95) AS p95, quantile_disc(duration_ms, 0.5) AS p50 FROM s GROUP BY service"),
    "service_edges": _q("SELECT * EXCLUDE (first_seen) FROM ed", EDGES),
    "service_edges_ordered": _q("SELECT * EXCLUDE (first_seen), CAST(row_number() OVER (ORDER BY calls DESC, first_seen) AS INTEGER) AS place FROM ed", EDGES),
    "hypotheses_top5": _q("SELECT rank, service, score, confidence FROM h", HYP),
    "hypotheses_rest": _q("SELECT lpad(CAST(rank AS VARCHAR), 2, '0') AS label, service, score FROM h WHERE rank BETWEEN 2 AND 4", HYP),
    "hypothesis_evidence": _q("SELECT rank, service, array_to_string(evidence, ' / ') AS evidence FROM h", HYP),
    "hypothesis_calm": _q("SELECT service, confidence = 'low' AND len(list_filter(evidence, lambda x: contains(x, 'error'))) = 0 AS calm FROM h WHERE rank = 1", HYP),
    "evidence_parsed": _q(f"""SELECT rank, i, CASE WHEN regexp_matches(line, '{ERROR_SENTENCE}') THEN 'error' WHEN regexp_matches(line, '{P95_SENTENCE}') THEN 'p95' WHEN regexp_matches(line, '{SELF_SENTENCE}') THEN 'self'
            WHEN line = 'No strong error or latency signal was detected.' THEN 'none' ELSE 'text' END AS kind,
            CAST(nullif(regexp_extract(line, '{ERROR_SENTENCE}', 1), '') AS BIGINT) AS errors, CAST(nullif(regexp_extract(line, '{ERROR_SENTENCE}', 2), '') AS BIGINT) AS calls,
            CAST(nullif(regexp_extract(line, '{ERROR_SENTENCE}', 3) || regexp_extract(line, '{P95_SENTENCE}', 1) || regexp_extract(line, '{SELF_SENTENCE}', 1), '') AS DOUBLE) AS value
        FROM (SELECT rank, unnest(evidence) AS line, CAST(unnest(range(0, len(evidence))) AS INTEGER) AS i FROM h)""", HYP),
    "trace_summaries": _q("SELECT * EXCLUDE (ended_at_ms, trace_status) FROM t", SUMMARY),
    "trace_list_top80": _q("SELECT * EXCLUDE (ended_at_ms, trace_status) FROM t ORDER BY started_at_ms DESC, trace_id LIMIT 80", SUMMARY),
    "trace_status": _q("SELECT trace_id, started_at_ms, ended_at_ms, duration_ms, trace_status AS status FROM t", SUMMARY),
    "overview_totals": _q(f"SELECT count(*) AS spans, count(DISTINCT trace_id) AS traces, count(DISTINCT service) AS services, count(*) FILTER (status = 'error') AS errors, {jr('count(*) FILTER (status = $$error$$) / count(*)', 4)} AS error_rate FROM s"),
    "overview_empty": "SELECT CAST(0 AS BIGINT) AS spans, CAST(0 AS BIGINT) AS traces, CAST(0 AS BIGINT) AS services, CAST(0 AS BIGINT) AS errors, 0e0 AS error_rate",
    "slo_health": _q(f"""SELECT n AS spans, error_rate, top_p95_ms, greatest(0e0, 100 - error_rate * 100) AS availability, error_rate / 0.01e0 AS budget_burn,
            CASE WHEN error_rate >= 0.08e0 OR top_p95_ms >= 1800 THEN 'critical' WHEN error_rate >= 0.03e0 OR top_p95_ms >= 700 THEN 'degraded' ELSE 'healthy' END AS severity
        FROM (SELECT count(*) AS n, {jr('count(*) FILTER (status = $$error$$) / count(*)', 4)} AS error_rate FROM s), (SELECT max(p95_ms) AS top_p95_ms FROM m)""", METRICS),
    "latency_trend": _q("SELECT * FROM tr", TREND),
    "sparkline": _q(f"""SELECT coalesce(string_agg(part, ' ' ORDER BY i), '') AS path FROM (SELECT i, CASE WHEN i = 0 THEN 'M' ELSE 'L' END || printf('%.1f', {jr('i / (n - 1) * 120e0', 1)}) || ' ' || printf('%.1f', {jr('32 - (duration_ms - lo) / greatest(1e0, hi - lo) * 28', 1)}) AS part
        FROM tr, (SELECT count(*) AS n, min(duration_ms) AS lo, greatest(1e0, max(duration_ms)) AS hi FROM tr) WHERE n > 1)""", TREND),
    "peak_concurrency": _q("SELECT * FROM peak", PEAK),
    "trace_diagnostics": _q("""SELECT trace_id, slowest_span, self_time_leader, errors, services, peak FROM (SELECT trace_id,
            arg_min(span_id, {'z': -duration_ms, 'a': start_ms, 'b': -duration_ms, 'c': span_id}) AS slowest_span, arg_min(span_id, {'z': -self_time_ms, 'a': start_ms, 'b': -duration_ms, 'c': span_id}) AS self_time_leader,
            count(*) FILTER (status = 'error') AS errors, count(DISTINCT service) AS services FROM a GROUP BY trace_id) JOIN peak USING (trace_id)""", SELF, PEAK),
    "timeline_geometry": _q("""SELECT trace_id, span_id, depth, round((start_ms - t0) / len * 100, 6) AS left_pct, round(greatest(1.25e0, duration_ms / len * 100), 6) AS width_pct, 10 + least(depth, 5) * 12 AS indent_px
        FROM s JOIN b USING (trace_id) JOIN d USING (trace_id, span_id)""", DEPTH, BOUNDS, recursive=True),
    "replay_active_spans": _q("""SELECT trace_id, progress, count(*) FILTER (start_ms <= head) AS passed, count(*) FILTER (start_ms <= head AND head <= start_ms + duration_ms) AS active
        FROM (SELECT s.*, p.progress, t0 + len * p.progress / 100 AS head FROM s JOIN b USING (trace_id), (SELECT unnest([0, 25, 50, 75, 100]) AS progress) p) GROUP BY ALL""", BOUNDS),
    "trace_search": _q("SELECT trace_id, root_service, root_operation FROM t WHERE contains(lower(trace_id), 'svc-3') OR contains(lower(root_service), 'svc-3') OR contains(lower(root_operation), 'svc-3')", SUMMARY),
    "errors_only": _q("SELECT trace_id, error_count FROM t WHERE error_count > 0", SUMMARY),
    "service_inbound_outbound": _q("SELECT CASE WHEN target = 'svc-2' THEN 'inbound' ELSE 'outbound' END AS direction, * EXCLUDE (first_seen) FROM ed WHERE 'svc-2' IN (source, target)", EDGES),
    "service_lookup": _q("SELECT m.* EXCLUDE (first_seen), h.score, h.confidence FROM m LEFT JOIN h ON h.service = m.service WHERE m.service = 'svc-2'", HYP),
    "trace_compare_services": _q("""SELECT service, coalesce(x.p95, 0e0) AS base_p95, coalesce(x.err, 0e0) AS base_error, coalesce(y.p95, 0e0) AS compare_p95, coalesce(y.err, 0e0) AS compare_error,
            coalesce(y.p95, 0e0) - coalesce(x.p95, 0e0) AS p95_delta, CASE WHEN abs(coalesce(y.p95, 0e0) - coalesce(x.p95, 0e0)) < 0.05e0 THEN 'neutral' WHEN coalesce(y.p95, 0e0) <= coalesce(x.p95, 0e0) THEN 'good' ELSE 'bad' END AS class
        FROM x FULL JOIN y USING (service) ORDER BY abs(p95_delta) DESC, service LIMIT 7""", PICK, trace_metrics("x", 1), trace_metrics("y", 2)),
    "trace_compare_summary": _q("""SELECT y.duration_ms - x.duration_ms AS duration_delta, y.span_count - x.span_count AS span_delta, upper(x.trace_status) AS base_status, upper(y.trace_status) AS compare_status,
            CASE WHEN abs(y.duration_ms - x.duration_ms) < 0.05e0 THEN 'neutral' WHEN y.duration_ms <= x.duration_ms THEN 'good' ELSE 'bad' END AS class
        FROM t x, t y WHERE x.trace_id = (SELECT trace_id FROM pk WHERE nth = 1) AND y.trace_id = (SELECT trace_id FROM pk WHERE nth = 2)""", SUMMARY, PICK),
    "trace_alternatives": _q("SELECT trace_id, started_at_ms, left(trace_id, 8) AS short_id FROM t WHERE trace_id <> (SELECT trace_id FROM pk WHERE nth = 1)", SUMMARY, PICK),
    "service_union": _q("SELECT DISTINCT service FROM s WHERE trace_id IN (SELECT trace_id FROM pk)", PICK),
    "service_layout": _q("""SELECT service, i, round(r + 80 + r * cos(a), 6) AS x, round(r + 80 + r * sin(a), 6) AS y, errors > 0 AS has_errors, service = (SELECT service FROM h WHERE rank = 1) AS suspect
        FROM (SELECT *, greatest(170e0, n * 34e0) AS r, 2 * pi() * i / n - pi() / 2 AS a FROM (SELECT *, CAST(row_number() OVER (ORDER BY p95_ms DESC, first_seen) - 1 AS INTEGER) AS i, count(*) OVER () AS n FROM m))""", HYP),
    "edge_flags": _q("SELECT source, target, errors > 0 AS animated FROM ed", EDGES),
    "number_formats": _q(f"SELECT trace_id, span_id, {jr('duration_ms / 7', 2)} AS r2, {jr('duration_ms / 7', 4)} AS r4, {text1(jr('duration_ms / 7', 1))} AS text, {grouped('duration_ms / 7')} AS grouped, printf('%.1f', {jr('duration_ms / 7', 1)}) AS fixed FROM s"),
    "incident_report": _q(f"""SELECT concat_ws(chr(10), '# Incident report', '', '## Summary', '', '- Generated at: 01:04:05 PM', '- Traces: ' || format('{{:,}}', n_traces), '- Services: ' || format('{{:,}}', n_services), '- Error rate: ' || printf('%.1f', {jr('error_rate * 100', 1)}) || '%',
            '- Leading service: ' || lead_service, '', '## Selected trace', '', '- Trace ID: ' || tid, '- Duration: ' || {grouped('tdur')} || ' ms', '- Status: ' || upper(tstatus), '- Spans: ' || format('{{:,}}', tspans),
            '', '## Evidence', '', array_to_string(list_transform(evidence, lambda x: '- ' || x), chr(10)), '', '## Services', '', '| Service | p95 | Error rate | Self time |', '| --- | ---: | ---: | ---: |', lines) AS report
        FROM (SELECT count(DISTINCT trace_id) AS n_traces, count(DISTINCT service) AS n_services, {jr('count(*) FILTER (status = $$error$$) / count(*)', 4)} AS error_rate FROM s),
            (SELECT service AS lead_service, evidence FROM h WHERE rank = 1), (SELECT trace_id AS tid, duration_ms AS tdur, trace_status AS tstatus, span_count AS tspans FROM t WHERE trace_id = (SELECT trace_id FROM pk WHERE nth = 1)),
            (SELECT string_agg('| ' || service || ' | ' || {grouped('p95_ms')} || ' ms | ' || {grouped('error_rate * 100')} || '% | ' || {grouped('self_time_ms')} || ' ms |', chr(10) ORDER BY p95_ms DESC, first_seen) AS lines FROM (SELECT * FROM m ORDER BY p95_ms DESC, first_seen LIMIT 7))""", HYP, SUMMARY, PICK),
    "otlp_parse": _q("SELECT *, span_id AS row_attribute FROM s"),
    "otlp_forms": _q("""SELECT trace_id, span_id, parent_span_id, service, operation, start_ms, duration_ms, status,
            CASE m % 8 WHEN 0 THEN w WHEN 1 THEN w WHEN 2 THEN '1_' || w WHEN 3 THEN w WHEN 4 THEN w || '.5' WHEN 5 THEN 'true' WHEN 6 THEN '[' || w || ',"a"]' ELSE '{"n":' || w || ',"l":"[false]"}' END AS v,
            'span' AS zone, 'resource' AS env, CASE WHEN m % 2 = 1 THEN 'old' ELSE 'new' END AS otel_scope_name,
            CASE m % 8 WHEN 1 THEN 'BIGINT' WHEN 3 THEN 'BIGINT' WHEN 4 THEN 'DECIMAL(' || length(w) + 1 || ',1)' WHEN 5 THEN 'BOOLEAN' ELSE 'STRING' END AS kind
        FROM (SELECT *, CAST(floor(start_ms / 1000) AS BIGINT) AS m, CAST(CAST(floor(start_ms / 1000) AS BIGINT) % 1000 AS VARCHAR) AS w FROM s)"""),
    "label_texts": _q("""SELECT trace_id, span_id, start_ms + 123456 / 1e6 AS ms, CAST(NULL AS DOUBLE) AS none,
            CASE CAST(floor(start_ms / 1000) AS BIGINT) % 6 WHEN 0 THEN 'ok' WHEN 1 THEN 'error' WHEN 2 THEN 'ok' WHEN 3 THEN 'error' ELSE 'unset' END AS status_name,
            service || ' took ' || CAST(CAST(duration_ms AS BIGINT) AS VARCHAR) || ' ms, {rest}' AS told, strftime(make_timestamp(CAST(start_ms AS BIGINT) * 1000), '%I:%M:%S %p') AS time_of_day FROM s"""),
    "trace_analysis": f"""WITH RECURSIVE {ONE_TRACE}{SELF}{DEPTH}{SUMMARY} SELECT a.trace_id, a.span_id, a.end_ms, a.self_time_ms, d.depth, t.trace_status, t.duration_ms AS trace_ms,
            (SELECT count(DISTINCT service) FROM a) AS services, (SELECT max(p) FROM (SELECT quantile_disc(duration_ms, 0.95) AS p FROM a GROUP BY service)) AS top_p95_ms, (SELECT count(*) FROM pc WHERE p_service <> service) AS calls_between
        FROM a JOIN d USING (trace_id, span_id) JOIN t USING (trace_id)""",
    "native_json": _q("SELECT * FROM s"),
    "stream_ingest": "SELECT CAST(count(*) AS BIGINT) AS accepted, CAST(count(*) AS BIGINT) AS stored FROM events",
}


#: Seeds and shares of the scenarios; calls with their place among a trace's draws (from 0; after a fault's own draw, those
#: from 5 on are one later), parent, offset, and the usual duration and spread.
SCENARIOS = {"stable": (11, 0), "payment-timeout": (29, 3), "database-lock": (47, 4), "cache-degradation": (71, 2)}
CALLS = [
    ("root", 0, "edge-gateway", "POST /checkout", None, 0, 640, 120), ("payment", 1, "payment", "authorize", "root", 250, 260, 70), ("db", 2, "postgres", "SELECT account FOR UPDATE", "payment", 282, 62, 24),
    ("redis", 3, "redis", "GET product:batch", "catalog", 88, 18, 10), ("catalog", 4, "catalog", "load-products", "root", 72, 145, 35), ("auth", 5, "auth", "verify-session", "root", 18, 42, 14), ("cart", 6, "cart", "price-cart", "root", 94, 128, 42),
]
#: Durations of faulty traces, as SQL over f (the fault's own draw); and the calls that fail.
FAULTS = {
    "payment-timeout": ((2250, 220), {"payment": "f", "root": "f + 170"}, ("payment", "root")),
    "database-lock": ((1650, 180), {"db": "f", "payment": "f + 120", "root": "(f + 120) + 190"}, ("db", "payment", "root")),
    "cache-degradation": ((720, 130), {"redis": "f", "catalog": "f + 150", "root": "(f + 150) + 390"}, ("redis",)),
}


def scenario_spans(name: str, traces: int = 24, base_ms: int = 1_700_000_000_000) -> str:
    """Text of the table s for a scenario: draws by recursion, then a row for each call of each trace."""
    seed, every = SCENARIOS[name]
    bad = f"i % {every} = 0" if every else "false"
    draw = lambda usual, spread, x: f"greatest(1e0, {usual}e0 + ({x} / 4294967295e0 - 0.5e0) * {spread}e0)"
    (usual, spread), waits, failed = FAULTS.get(name, ((1, 0), {}, ()))
    calls = ", ".join(f"('{c}', {k}, '{v}', '{o}', {repr(p) if p else 'NULL'}, {at}e0, {u}, {w})" for c, k, v, o, p, at, u, w in CALLS)
    long = " ".join(f"WHEN bad AND name = '{c}' THEN {x}" for c, x in waits.items()) or "WHEN false THEN 0"
    wrong = ", ".join(f"'{c}'" for c in failed) or "''"
    return f"""lcg(k, x) AS (SELECT CAST(0 AS BIGINT), CAST({seed} AS BIGINT) UNION ALL SELECT k + 1, (1664525 * x + 1013904223) % 4294967296 FROM lcg WHERE k < {traces * 8}),
tr AS (SELECT i, {bad} AS bad, i * 7 + {f"((i + {every} - 1) // {every})" if every else "0"} AS before FROM (SELECT unnest(range(0, {traces})) AS i)),
ca AS (SELECT * FROM (VALUES {calls}) v(name, k, service, operation, parent, start_at, usual, spread)),
dr AS (SELECT tr.*, ca.*, l.x, {draw(usual, spread, "f0.x")} AS f FROM tr CROSS JOIN ca JOIN lcg l ON l.k = before + 1 + ca.k + CASE WHEN bad AND ca.k >= 5 THEN 1 ELSE 0 END JOIN lcg f0 ON f0.k = before + 6),
s AS (SELECT '{name}-' || lpad(CAST(i AS VARCHAR), 4, '0') AS trace_id, trace_id || '-' || name AS span_id, trace_id || '-' || parent AS parent_span_id, service, operation, {base_ms}e0 - ({traces} - i) * 1350 + start_at AS start_ms,
    CASE {long} ELSE greatest(1e0, usual + (x / 4294967295e0 - 0.5e0) * spread) END AS duration_ms, CASE WHEN bad AND name IN ({wrong}) THEN 'error' ELSE 'ok' END AS status FROM dr)"""


for _name in SCENARIOS:
    SQL["scenario_" + _name.replace("-", "_")] = f"WITH RECURSIVE {scenario_spans(_name)}{METRICS} SELECT * EXCLUDE (first_seen) FROM m"

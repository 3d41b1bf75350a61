"""OTLP, native JSON, the store and the stream."""

import json

import pytest
from pyspark.sql import functions as F

from spanalytics import schema
from spanalytics.plans import api, queries
from spanalytics.sources import native, otlp, scenarios
from spanalytics.sources.store import SpanStore
from spanalytics.streaming import ingest, notices


def attr(key, **value):
    return {"key": key, "value": value}


def payload(spans, scope="scopeSpans", service=None, name=None):
    return {"resourceSpans": [{"resource": {"attributes": [service or attr("service.name", stringValue="checkout"), attr("deployment.environment", stringValue="prod")]}, scope: [{("scope" if scope == "scopeSpans" else "instrumentationLibrary"): {"name": name or "http.instrumentation"}, "spans": spans}]}]}


def span(**more):
    return {"traceId": "abc123", "spanId": "span1", "parentSpanId": "", "name": "POST /checkout", "startTimeUnixNano": "1789960000000000000", "endTimeUnixNano": "1789960000125000000", "status": {"code": "STATUS_CODE_ERROR"}, "attributes": [attr("http.status_code", intValue="503")]} | more


def test_otlp_standard():
    (s,) = otlp.decode(json.dumps(payload([span()])))
    assert (s["parent_span_id"], s["duration_ms"], s["status"], s["service"]) == (None, 125.0, "error", "checkout")
    assert s["attributes"] == {"service.name": "checkout", "deployment.environment": "prod", "http.status_code": 503, "otel.scope.name": "http.instrumentation"}


def test_otlp_legacy_and_nested():
    nested = attr("flags", arrayValue={"values": [{"stringValue": "a"}, {"boolValue": True}]})
    (s,) = otlp.decode(json.dumps(payload([span(parentSpanId="p", startTimeUnixNano="1000000", endTimeUnixNano="3500000", status={"code": 1}, attributes=[attr("retry.count", intValue=2), nested])], "instrumentationLibrarySpans", name="legacy-lib")))
    assert (s["duration_ms"], s["status"], s["parent_span_id"]) == (2.5, "ok", "p")
    assert s["attributes"]["retry.count"] == 2 and s["attributes"]["flags"] == '["a",true]'


@pytest.mark.parametrize(
    "value, want",
    [
        ({"intValue": ""}, 0), ({"intValue": "x"}, "x"), ({"doubleValue": 1.5}, 1.5), ({"bytesValue": "aGk="}, "aGk="), ({}, None), ({"stringValue": 5, "boolValue": False}, False),
        ({"intValue": "0x10"}, 16), ({"intValue": "1_0"}, "1_0"), ({"intValue": " 12 "}, 12), ({"intValue": "1e3"}, 1000), ({"intValue": "-0x1"}, "-0x1"), ({"intValue": "Infinity"}, "Infinity"), ({"intValue": "nan"}, "nan"), ({"intValue": 10**400}, "1" + "0" * 400), ({"stringValue": "\ud800"}, "\ufffd"),
        ({"kvlistValue": {"values": [{"key": "a", "value": {"arrayValue": {"values": [{"intValue": 1}, {}]}}}]}}, '{"a":"[1]"}'),
    ],
)
def test_any_value(value, want):
    assert otlp.any_value(value) == want


@pytest.mark.parametrize("bad", [{"startTimeUnixNano": "x"}, {"endTimeUnixNano": "1"}, {"startTimeUnixNano": None}])
def test_otlp_rejects_bad_times(bad):
    with pytest.raises(otlp.Rejected):
        otlp.decode(json.dumps(payload([span(), span(**bad)])))


def test_otlp_skips_and_defaults():
    got = otlp.decode(json.dumps(payload([span(spanId="", startTimeUnixNano="x"), span(name=" ")], service=attr("service.name", intValue=3))))
    assert [(s["service"], s["operation"]) for s in got] == [("unknown-service", "unnamed-span")]
    for text in ("[]", "", '{"resourceSpans": []}', "5"):
        with pytest.raises(otlp.Rejected):
            otlp.decode(text)
    assert otlp.millis(str(2**64 - 1)) == pytest.approx((2**64 - 1) / 1e6)


@pytest.mark.parametrize("code, want", [(2, "error"), (2.0, "error"), ("2", "error"), ("2.0", "unset"), (1, "ok"), (True, "unset"), (None, "unset"), ([2], "unset"), ("STATUS_CODE_OK", "ok")])
def test_otlp_status(code, want):
    assert otlp.decode(json.dumps(payload([span(status={"code": code})])))[0]["status"] == want


def test_otlp_deep_and_odd_payloads(spark):
    deep = json.dumps(payload([span()])).replace('"503"}', '"503"}, "arrayValue": ' + "[" * 100_000 + "]" * 100_000)
    nested = attr("x", arrayValue={"values": []})
    for _ in range(3000):
        nested = attr("x", arrayValue={"values": [nested["value"]]})
    with pytest.raises(otlp.Rejected, match="deep"):
        otlp.decode(deep)
    texts = [deep, json.dumps(payload([span()])), json.dumps(payload([span(name="a\ud800", attributes=[attr("k\udfff", stringValue="\ud83d")])]))]
    good, bad = otlp.parse(spark.createDataFrame([(t,) for t in texts], "payload string"))
    assert sorted(r.operation for r in good.collect()) == ["POST /checkout", "a\ufffd"] and bad.count() == 1
    try:
        deepest = json.dumps(payload([span(attributes=[nested])]))
    except RecursionError:
        return
    with pytest.raises(otlp.Rejected, match="deep"):
        otlp.decode(deepest)


def test_otlp_batches_are_bounded(spark, monkeypatch):
    rows = spark.createDataFrame([(json.dumps(payload([span(spanId=f"{i}-{j}") for j in range(900)])),) for i in range(12)], "payload string").coalesce(1)
    good, bad = otlp.parse(rows)
    assert good.count() == 12 * 900 == good.select("span_id").distinct().count() and bad.isEmpty()


def test_otlp_table(spark):
    rows = spark.createDataFrame([(json.dumps(payload([span(), span(spanId="s2")])),), ("nope",), (None,)], "payload string")
    good, bad = otlp.parse(rows)
    assert good.columns == schema.COLUMNS and good.count() == 2 and bad.count() == 2
    assert good.select(F.expr("variant_get(attributes['http.status_code'], '$', 'int')")).first()[0] == 503
    with pytest.raises(Exception, match="not JSON"):
        otlp.parse(rows, strict=True)[0].collect()


def one(**more):
    return {"traceId": "t", "spanId": "a", "parentSpanId": None, "service": "x", "operation": "o", "startMs": 1, "durationMs": 2.5, "status": "ok", "attributes": {"k": 1, "b": True}} | more


@pytest.mark.parametrize("bad", [{"traceId": ""}, {"service": "x" * 121}, {"durationMs": -1}, {"status": "no"}, {"startMs": None}])
def test_native_rules(spark, bad):
    assert native.batch(spark, [one()]).first().parent_span_id is None
    with pytest.raises(ValueError, match="invalid span"):
        native.batch(spark, [one(), one(**bad)])


def test_native_batch_size(spark):
    for n in (0, schema.BATCH + 1):
        with pytest.raises(ValueError):
            native.batch(spark, [one()] * n)


def test_store_and_api(spark, tmp_path):
    store = SpanStore(spark, str(tmp_path / "spans"))
    assert api.ingest_spans(store, [one(), one(spanId="b", parentSpanId="a")]) == {"accepted": 2, "traces": 1}
    first = store.spans().filter("span_id = 'a'").first().ingested_at
    assert api.ingest_spans(store, [one(durationMs=9), one(durationMs=7)]) == {"accepted": 2, "traces": 1}
    row = store.spans().filter("span_id = 'a'").first()
    assert (row.duration_ms, row.ingested_at, store.spans().count()) == (7.0, first, 2)
    assert store.save(store.spans().drop("ingested_at").filter("false")) == {"accepted": 0, "traces": 0}
    assert api.ingest_otlp(store, json.dumps(payload([span()]))) == {"partialSuccess": {}}
    with pytest.raises(ValueError):
        api.ingest_otlp(store, "{}")
    assert api.run_scenario(store, "stable", 4) == {"scenario": "stable", "spans": 28, "traces": 4}
    with pytest.raises(ValueError):
        api.run_scenario(store, "stable", 3)
    view = api.overview(store)
    assert view["totals"].first().traces == 6 and api.list_traces(store).count() == 6
    trace = api.get_trace(store, "t")
    assert [(r.span_id, r.depth) for r in trace["spans"].collect()] == [("a", 0), ("b", 1)]
    with pytest.raises(LookupError):
        api.get_trace(store, "none")
    assert store.recent(0).count() == 1
    api.clear(store)
    assert store.spans().isEmpty() and api.health(spark)["ok"]


def test_otlp_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/1.json").write_text(json.dumps(payload([span(), span(spanId="s2")]), indent=1))
    (tmp_path / "in/2.json").write_text("broken")
    store = SpanStore(spark, str(tmp_path / "spans"))
    ingest.start(spark, str(tmp_path / "in"), store, str(tmp_path / "notices"), str(tmp_path / "checkpoint"), "otlp").awaitTermination()
    assert store.spans().count() == 2


def test_event_time_counts(spark, tmp_path):
    store = SpanStore(spark, str(tmp_path / "spans"))
    api.ingest_spans(store, [one(startMs=t, spanId=str(t)) for t in (0, 1000, 400_000)])
    stream = spark.readStream.schema(store.raw().schema).parquet(store.path)
    q = ingest.trace_counts(stream).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.spans for r in spark.table("counts").collect()) == [1, 2]


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    store = SpanStore(spark, str(tmp_path / "spans"))
    run = lambda: ingest.start(spark, str(tmp_path / "in"), store, str(tmp_path / "notices"), str(tmp_path / "checkpoint"), views=str(tmp_path / "views")).awaitTermination()
    (tmp_path / "in/1.json").write_text("\n".join(json.dumps(x) for x in (one(), one(spanId="b"), one(spanId="c", status="no"))))
    run()
    (tmp_path / "in/2.json").write_text(json.dumps(one(durationMs=50)))
    run()
    assert store.spans().count() == 2 and store.spans().filter("span_id = 'a'").first().duration_ms == 50
    assert spark.read.parquet(str(tmp_path / "views/totals")).first().spans == 2
    assert spark.read.parquet(str(tmp_path / "views/traces")).first().duration_ms == 50.0
    got = notices.read(spark, str(tmp_path / "notices"))
    assert [(r.event, r.span_count, r.trace_count) for r in got.filter("batch is not null").orderBy("batch").collect()] == [("ingest", 2, 1), ("ingest", 1, 1)]
    assert got.filter("event = 'ready'").count() == 2


def test_stream_query_reads_all_notices(spark, tmp_path):
    """The notices lie in a folder each: one that the stream is ready, one of each batch."""
    rows = [(i, f"2024-01-0{1 + i % 3} 10:00:00", i % 4, "view", i / 2, f"{{k:{i}}}") for i in range(40)]
    df = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string")
    df.withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(str(tmp_path / "events.parquet"))
    assert [tuple(r) for r in queries.QUERIES["stream_ingest"](spark, str(tmp_path)).collect()] == [(40, 40)]


def test_notices(spark, tmp_path):
    store, at = SpanStore(spark, str(tmp_path / "s")), str(tmp_path / "notices")
    api.run_scenario(store, "stable", 4, notices=at)
    api.clear(store, notices=at)
    got = {r.event: r for r in notices.read(spark, at).collect()}
    assert (got["scenario"].scenario, got["scenario"].span_count, got["scenario"].trace_count) == ("stable", 28, 4) and got["reset"].span_count is None
    with pytest.raises(ValueError):
        notices.announce(spark, at, "other")


def test_writers_that_do_not_know_of_each_other(spark, tmp_path):
    """The later save counts, whatever the batches' numbers."""
    one_, two = (SpanStore(spark, str(tmp_path / "w")) for _ in range(2))
    rows = lambda ms: scenarios.generate(spark, "stable", 4).withColumn("duration_ms", F.lit(float(ms)))
    one_.save(rows(1), 50)
    two.save(rows(2))
    one_.save(rows(3), 7)
    assert {r.duration_ms for r in two.spans().collect()} == {3.0} and two.raw().select("batch").distinct().count() == 3


def test_repeated_batch_is_acknowledged_alike(spark, tmp_path):
    store = SpanStore(spark, str(tmp_path / "again"))
    rows = scenarios.generate(spark, "stable", 4)
    first = store.save(rows, 7)
    assert first == {"accepted": 28, "traces": 4} and store.save(rows, 7) == first and store.spans().count() == 28

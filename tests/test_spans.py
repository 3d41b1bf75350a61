"""Span, graph and trace operators on small fixtures."""

import random

import pytest
from pyspark.sql import functions as F

from spanalytics.operators import graph as G, spans as S, traces as T
from spanalytics.plans import report as R
from spanalytics.sources import scenarios

DDL = "trace_id string, span_id string, parent_span_id string, service string, operation string, start_ms double, duration_ms double, status string"


def table(spark, *rows):
    return spark.createDataFrame([(r[0], r[1], r[2], r[3], "op", float(r[4]), float(r[5]), r[6] if len(r) > 6 else "ok") for r in rows], DDL)


OVERLAP = (("t", "root", None, "gateway", 0, 100), ("t", "a", "root", "catalog", 20, 40), ("t", "b", "root", "payment", 50, 40))
RANKING = (("t", "root", None, "gateway", 0, 1300, "error"), ("t", "payment", "root", "payment", 100, 1150, "error"), ("t", "db", "payment", "postgres", 120, 80))


def column(df, key, value):
    return {r[key]: r[value] for r in df.collect()}


def test_overlapping_children_count_once(spark):
    assert column(S.self_time(table(spark, *OVERLAP)), "span_id", "self_time_ms") == {"root": 30.0, "a": 40.0, "b": 40.0}


def test_edges_and_ranking(spark):
    t = table(spark, *RANKING)
    assert {(r.source, r.target) for r in G.edges(t).collect()} == {("gateway", "payment"), ("payment", "postgres")}
    h = [(r.service, r.score, r.confidence) for r in G.ranked(G.hypotheses(G.services(S.self_time(t)))).orderBy("rank").collect()]
    assert h == [("payment", 96.5, "high"), ("gateway", 87.1, "high"), ("postgres", 3.0, "low")]


@pytest.mark.parametrize(
    "children, own",
    [
        ([(-50, 60)], 90.0),  # starts before its parent
        ([(90, 60)], 90.0),  # ends after it
        ([(10, 10), (20, 10)], 80.0),  # touch
        ([(50, 0)], 100.0),  # empty
        ([(10, 50), (20, 10)], 50.0),  # one inside the other
        ([(-10, 200)], 0.0),
        ([(200, 10)], 100.0),  # outside
    ],
)
def test_clipping(spark, children, own):
    t = table(spark, ("t", "p", None, "x", 0, 100), *(("t", f"c{i}", "p", "y", s, d) for i, (s, d) in enumerate(children)))
    assert column(S.self_time(t), "span_id", "self_time_ms")["p"] == own


def test_grandchildren_do_not_count(spark):
    t = table(spark, ("t", "p", None, "x", 0, 100), ("t", "c", "p", "y", 0, 10), ("t", "g", "c", "z", 50, 40))
    assert column(S.self_time(t), "span_id", "self_time_ms")["p"] == 90.0


def test_depth_orphans_and_cycles(spark):
    chain = [("t", f"s{i}", f"s{i - 1}" if i else None, "x", i, 1) for i in range(40)]
    t = table(spark, *chain, ("t", "o", "gone", "x", 0, 1), ("u", "s1", None, "x", 0, 1), ("c", "a", "b", "x", 0, 1), ("c", "b", "a", "x", 0, 1), ("c", "self", "self", "x", 0, 5), ("c", "under", "a", "x", 0, 1))
    d = {(r.trace_id, r.span_id): r.depth for r in S.depth(t).collect()}
    assert all(d["t", f"s{i}"] == i for i in range(40))
    assert d["t", "o"] == 0 and d["u", "s1"] == 0
    assert [d["c", x] for x in ("a", "b", "self", "under")] == [None] * 4
    assert column(S.self_time(t).filter("trace_id = 'c'"), "span_id", "self_time_ms")["self"] == 0.0
    assert [r.span_id for r in S.orphans(t).collect()] == ["o"]


def test_peak(spark):
    t = table(spark, ("t", "a", None, "x", 0, 10), ("t", "b", None, "x", 10, 10), ("t", "c", None, "x", 12, 0), ("u", "z", None, "x", 5, 0))
    assert column(S.peak_concurrency(t), "trace_id", "peak") == {"t": 1, "u": 0}


def test_properties(spark):
    r = random.Random(5)
    rows = [("t%d" % (i % 5), f"s{i}", f"s{r.randrange(0, i) // 5 * 5 + i % 5}" if i >= 5 else None, f"v{r.randrange(4)}", r.randrange(1000), r.randrange(300), r.choice(["ok", "error", "unset"])) for i in range(200)]
    t, shuffled = table(spark, *rows), table(spark, *r.sample(rows, len(rows)))
    own = S.self_time(t)
    assert own.filter("self_time_ms < 0 or self_time_ms > duration_ms").isEmpty()
    total = {(x.trace_id, x.parent_span_id): x.n for x in S.clipped(t).groupBy("trace_id", "parent_span_id").agg(F.sum(F.col("e") - F.col("s")).alias("n")).collect()}
    assert all(x.covered_ms <= total[x.trace_id, x.parent_span_id] for x in S.covered(t).collect())
    assert G.edges(t).agg(F.sum("calls")).first()[0] <= len(rows)
    both = [[x.asDict() for x in G.ordered_services(G.services(S.self_time(y))).collect()] for y in (t, shuffled)]
    assert both[0] == both[1]


@pytest.mark.parametrize("n", [1, 19, 20, 21, 40])
def test_nearest_rank(spark, n):
    t = table(spark, *(("t", f"s{i}", None, "x", 0, i + 1) for i in range(n)))
    assert G.services(S.self_time(t)).first().p95_ms == -(-95 * n // 100)


def test_empty(spark):
    t = table(spark, ("t", "a", None, "x", 0, 1)).filter("false")
    assert G.totals(t).first().asDict() == {"spans": 0, "traces": 0, "services": 0, "errors": 0, "error_rate": 0.0}
    nodes = G.services(S.self_time(t))
    assert G.health(G.totals(t), nodes).first().severity == "healthy"
    assert G.hypotheses(nodes).isEmpty() and S.depth(t).isEmpty() and T.sparkline(T.trend(T.summaries(t))).first().path == ""
    assert "Leading service: —" in R.report(t).first().report
    with pytest.raises(ValueError):
        T.one_trace(t)


def test_roots_and_status(spark):
    t = table(spark, ("a", "x", None, "late", 5, 1), ("a", "y", None, "early", 1, 1, "unset"), ("b", "o", "gone", "orphan", 0, 1), ("b", "e", "gone", "second", 1, 1, "error"))
    assert column(T.summaries(t), "trace_id", "root_service") == {"a": "early", "b": "orphan"}
    assert column(T.status(t), "trace_id", "status") == {"a": "unset", "b": "error"}


def test_arrow_in_service_name(spark):
    t = table(spark, ("t", "p", None, "a->b", 0, 10), ("t", "c", "p", "c->d", 0, 5))
    assert [(r.source, r.target) for r in G.edges(t).collect()] == [("a->b", "c->d")]


def test_limits(spark):
    with pytest.raises(ValueError):
        T.newest(table(spark, ("t", "a", None, "x", 0, 1)), 201)


#: service: errors, error rate, average, p95, self time over 24 traces
GOLDEN = {
    "stable": {"edge-gateway": (0, 0.0, 634.74, 673.06, 4354.67), "payment": (0, 0.0, 259.2, 293.28, 4738.83), "redis": (0, 0.0, 18.07, 21.6, 433.6)},
    "payment-timeout": {"edge-gateway": (8, 0.33, 1226.91, 2488.93, 3094.71), "payment": (8, 0.33, 923.12, 2318.93, 20646.16)},
    "database-lock": {"postgres": (6, 0.25, 465.24, 1697.56, 11165.85), "payment": (6, 0.25, 639.19, 1817.56, 4174.61)},
    "cache-degradation": {"redis": (12, 0.5, 368.25, 758.1, 8838.04), "catalog": (0, 0.0, 508.17, 908.1, 3358.13)},
}
TOP = {"stable": ("edge-gateway", 43.8, "medium"), "payment-timeout": ("payment", 61.1, "medium"), "database-lock": ("postgres", 54.1, "medium"), "cache-degradation": ("redis", 60.0, "medium")}


@pytest.mark.parametrize("name", GOLDEN)
def test_scenarios(spark, name):
    t = scenarios.generate(spark, name)
    nodes = G.services(S.self_time(t))
    got = {r.service: (r.errors, r.error_rate, r.average_ms, r.p95_ms, r.self_time_ms) for r in nodes.collect()}
    for service, want in GOLDEN[name].items():
        assert got[service] == pytest.approx(want, abs=0.011)
    top = G.ranked(G.hypotheses(nodes)).orderBy("rank").first()
    assert (top.service, top.score, top.confidence) == TOP[name]
    assert t.count() == 168 and {r.calls for r in nodes.collect()} == {24}
    assert {r.calls for r in G.edges(t).collect()} == {24} and G.edges(t).count() == 6


def test_peak_concurrency_in_slices(spark):
    r = random.Random(4)
    rows = [(f"t{r.randrange(3)}", str(i), float(r.randrange(-50, 200)), float(r.choice([0, 0, 1, 5, 40, 150]))) for i in range(300)]
    df = spark.createDataFrame(rows, "trace_id string, span_id string, start_ms double, duration_ms double")
    want = {}
    for t in {x[0] for x in rows}:
        open_ = best = 0
        for _, delta in sorted([(s, 1) for k, _, s, _ in rows if k == t] + [(s + d, -1) for k, _, s, d in rows if k == t]):
            open_ += delta
            best = max(best, open_)
        want[t] = best
    for width in (1.0, 7.5, 60_000.0):
        assert {x.trace_id: x.peak for x in S.peak_concurrency(df, width).collect()} == want

"""The service graph, hypotheses and the overview's totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import labels
from ..functions.numbers import js_round
from ..storage import materialize
from . import spans as S

SERVICE_COLUMNS = ["service", "calls", "errors", "error_rate", "average_ms", "p95_ms", "self_time_ms"]


#: Classes of durations for each doubling.
CLASSES = 16


def ranked_values(counts: DataFrame, shares: dict[str, float]) -> DataFrame:
    """(service, a column for each share): the value at rank ceil(share * n) of each service, never interpolated.

    counts: a written table (service, duration_ms, n). A running sum over classes of durations tells the class that holds the
    rank, and one over that class's values the value, so neither a buffer nor a window holds all values of a service.
    """
    classed = counts.select("service", "duration_ms", "n", F.floor(F.log2(F.col("duration_ms") + 1) * CLASSES).alias("class"))
    per = classed.groupBy("service", "class").agg(F.sum("n").alias("held"))
    one = W.partitionBy("service")
    per = per.select("service", "class", "held", F.sum("held").over(one).alias("all"), F.sum("held").over(one.orderBy("class")).alias("upto"))
    wanted = F.explode(F.array(*(F.struct(F.lit(name).alias("name"), F.ceil(F.lit(p) * F.col("all")).alias("rank")) for name, p in shares.items())))
    wanted = per.select("service", "class", "upto", (F.col("upto") - F.col("held")).alias("before"), wanted.alias("w"))
    wanted = wanted.filter((F.col("before") < F.col("w.rank")) & (F.col("w.rank") <= F.col("upto"))).select("service", "class", "w.name", (F.col("w.rank") - F.col("before")).alias("rank"))
    running = F.sum("n").over(W.partitionBy("service", "class", "name").orderBy("duration_ms"))
    near = classed.join(wanted, ["service", "class"]).withColumn("upto", running).filter(F.col("upto") >= F.col("rank"))
    return near.groupBy("service").agg(*(F.min(F.when(F.col("name") == name, F.col("duration_ms"))).alias(name) for name in shares))


def services(analyzed: DataFrame) -> DataFrame:
    """Metrics of each service, from spans with self_time_ms; first_seen orders ties.

    The spans are read once, into a table of the durations of each service, which the metrics and ranks are taken from.
    """
    d, n = F.col("duration_ms"), F.col("n")
    counts = analyzed.groupBy("service", "duration_ms").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "error").alias("bad"), F.sum("self_time_ms").alias("own"), F.min(S.first_order()).alias("first_seen"))
    counts = materialize(counts, "durations")
    sums = counts.groupBy("service").agg(
        F.sum(n).alias("calls"), F.sum("bad").alias("errors"), js_round(F.sum("bad") / F.sum(n), 2).alias("error_rate"), js_round(F.sum(d * n) / F.sum(n), 2).alias("average_ms"),
        js_round(F.sum("own"), 2).alias("self_time_ms"), F.min("first_seen").alias("first_seen"),
    )
    ranks = ranked_values(counts, {"p95": 0.95}).select("service", js_round(F.col("p95"), 2).alias("p95_ms"))
    return sums.join(ranks, "service").select(*SERVICE_COLUMNS, "first_seen")


def service_table(analyzed: DataFrame) -> DataFrame:
    """The services' metrics as a small written table, for plans that use them several times."""
    return materialize(services(analyzed), "services")


def ordered_services(nodes: DataFrame) -> DataFrame:
    return nodes.orderBy(F.desc("p95_ms"), "first_seen").select(SERVICE_COLUMNS)


def placed(rows: DataFrame, *order) -> DataFrame:
    """Rows of the graph, one a service or edge, with their place in an order from 1 on."""
    return rows.withColumn("place", F.row_number().over(W.orderBy(*order)))


def edges(spans: DataFrame) -> DataFrame:
    """Calls from the parent's service to another service. The key is the pair, so any name is safe."""
    both = S.parents(spans).filter("p_found and p_service <> service")
    return both.groupBy(F.col("p_service").alias("source"), F.col("service").alias("target")).agg(
        F.count("*").alias("calls"), F.count_if(F.col("status") == "error").alias("errors"), js_round(F.sum("duration_ms") / F.count("*"), 2).alias("average_ms"), F.min(S.first_order()).alias("first_seen"),
    )


def ordered_edges(e: DataFrame) -> DataFrame:
    return e.orderBy(F.desc("calls"), "first_seen").drop("first_seen")


def hypotheses(nodes: DataFrame, most: int = 5) -> DataFrame:
    """Services by evidence score; rounded metrics go in, the unrounded score decides the confidence.

    The maxima are one row, aggregated apart and broadcast, so no window holds all services in one task.
    """
    top = nodes.agg(F.greatest(F.lit(1.0), F.max("p95_ms")).alias("max_p95"), F.greatest(F.lit(1.0), F.max("self_time_ms")).alias("max_self"))
    raw = F.col("error_rate") * 55 + F.col("p95_ms") / F.col("max_p95") * 30 + F.col("self_time_ms") / F.col("max_self") * 15
    scored = nodes.join(F.broadcast(top)).withColumn("raw", raw).withColumns({"score": js_round(F.col("raw"), 1), "confidence": labels.confidence(F.col("raw")), "evidence": labels.evidence()})
    return scored.orderBy(F.desc("score"), F.desc("p95_ms"), "first_seen").limit(most)


def ranked(hyp: DataFrame, skip: int = 0) -> DataFrame:
    """Numbers the few hypotheses 1, 2, ...; at most ``most`` of them reach the window."""
    out = hyp.withColumn("rank", F.row_number().over(W.orderBy(F.desc("score"), F.desc("p95_ms"), "first_seen")))
    return out.filter(F.col("rank") > skip).select("rank", "service", "score", "confidence", "evidence")


def calm(hyp: DataFrame) -> DataFrame:
    """Whether the leading hypothesis is no alarm: low confidence, and no evidence of errors."""
    first = ranked(hyp).filter("rank = 1")
    return first.select("service", ((F.col("confidence") == "low") & ~F.exists("evidence", lambda x: x.contains("error"))).alias("calm"))


def totals(spans: DataFrame) -> DataFrame:
    """One row; zeros for an empty table."""
    n, bad = F.count("*"), F.count_if(F.col("status") == "error")
    return spans.agg(n.alias("spans"), F.count_distinct("trace_id").alias("traces"), F.count_distinct("service").alias("services"), bad.alias("errors"), F.when(n == 0, 0.0).otherwise(js_round(bad / n, 4)).alias("error_rate"))


def health(total: DataFrame, nodes: DataFrame) -> DataFrame:
    """Availability, error-budget burn and severity: one row from two one-row tables."""
    top = nodes.agg(F.coalesce(F.max("p95_ms"), F.lit(0.0)).alias("top_p95_ms"))
    return total.join(F.broadcast(top)).select(
        "spans", "error_rate", "top_p95_ms", F.greatest(F.lit(0.0), 100 - F.col("error_rate") * 100).alias("availability"),
        (F.col("error_rate") / labels.SLO_ERRORS).alias("budget_burn"), labels.severity(F.col("error_rate"), F.col("top_p95_ms")).alias("severity"),
    )


def inspector(e: DataFrame, service: str) -> DataFrame:
    """Edges into and out of a service."""
    both = e.filter((F.col("target") == service) | (F.col("source") == service))
    return both.select(F.when(F.col("target") == service, "inbound").otherwise("outbound").alias("direction"), "source", "target", "calls", "errors", "average_ms")


def lookup(nodes: DataFrame, hyp: DataFrame, service: str) -> DataFrame:
    """A service's metrics, with its hypothesis if it is among the leading ones."""
    h = hyp.select("service", "score", "confidence")
    return nodes.filter(F.col("service") == service).select(SERVICE_COLUMNS).join(h, "service", "left")


def layout(nodes: DataFrame, hyp: DataFrame) -> DataFrame:
    """Places services on a circle in their order, and marks errors and the suspect."""
    n = nodes.agg(F.count("*").alias("n"))
    # one row a service: the window is as small as the graph
    at = nodes.withColumn("i", F.row_number().over(W.orderBy(F.desc("p95_ms"), "first_seen")) - 1).join(F.broadcast(n))
    radius = F.greatest(F.lit(170.0), F.col("n") * 34.0)
    angle = F.lit(2 * 3.141592653589793) * F.col("i") / F.col("n") - 3.141592653589793 / 2
    top = hyp.orderBy(F.desc("score"), F.desc("p95_ms"), "first_seen").limit(1).select(F.col("service").alias("suspect_name"))
    return at.join(F.broadcast(top), how="left").select(
        "service", "i", (radius + 80 + radius * F.cos(angle)).alias("x"), (radius + 80 + radius * F.sin(angle)).alias("y"),
        (F.col("errors") > 0).alias("has_errors"), F.col("service").eqNullSafe(F.col("suspect_name")).alias("suspect"),
    )

"""Buckets, evidence sentences and small texts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .numbers import js_round, number_text

#: Thresholds of the buckets, and the evidence sentences.
HIGH, MEDIUM = 65, 35
CRITICAL, DEGRADED = (0.08, 1800), (0.03, 700)
SLOW_MS = 500
SLO_ERRORS = 0.01
NO_SIGNAL = "No strong error or latency signal was detected."
ERROR_SENTENCE = r"^(\d+)/(\d+) spans ended in error \(([\d.]+)%\)\.$"
P95_SENTENCE = r"^p95 latency reached ([\d.]+) ms\.$"
SELF_SENTENCE = r"^([\d.]+) ms were spent inside the service after removing overlapping child calls\.$"


def confidence(score: Column) -> Column:
    return F.when(score >= HIGH, "high").when(score >= MEDIUM, "medium").otherwise("low")


def severity(error_rate: Column, top_p95: Column) -> Column:
    over = lambda x: (error_rate >= x[0]) | (top_p95 >= x[1])
    return F.when(over(CRITICAL), "critical").when(over(DEGRADED), "degraded").otherwise("healthy")


def evidence() -> Column:
    """Sentences for a row of service metrics; one that says so where there is no signal."""
    c = F.col
    said = F.array_compact(F.array(
        F.when(c("errors") > 0, F.concat(c("errors").cast("string"), F.lit("/"), c("calls").cast("string"), F.lit(" spans ended in error ("), number_text(js_round(c("error_rate") * 100, 1)), F.lit("%)."))),
        F.when(c("p95_ms") >= SLOW_MS, F.concat(F.lit("p95 latency reached "), number_text(js_round(c("p95_ms"), 1)), F.lit(" ms."))),
        F.when(c("self_time_ms") > 0, F.concat(number_text(js_round(c("self_time_ms"), 1)), F.lit(" ms were spent inside the service after removing overlapping child calls."))),
    ))
    return F.when(F.size(said) > 0, said).otherwise(F.array(F.lit(NO_SIGNAL)))


def parse_evidence(line: Column) -> Column:
    """The kind of a sentence and its numbers; kind ``text`` for any other line."""
    get = lambda p, i: F.regexp_extract(line, p, i)
    none = F.lit(None).cast("double")
    return F.struct(
        F.when(line.rlike(ERROR_SENTENCE), "error").when(line.rlike(P95_SENTENCE), "p95").when(line.rlike(SELF_SENTENCE), "self").when(line == NO_SIGNAL, "none").otherwise("text").alias("kind"),
        F.when(line.rlike(ERROR_SENTENCE), get(ERROR_SENTENCE, 1).cast("long")).alias("errors"),
        F.when(line.rlike(ERROR_SENTENCE), get(ERROR_SENTENCE, 2).cast("long")).alias("calls"),
        F.when(line.rlike(ERROR_SENTENCE), get(ERROR_SENTENCE, 3).cast("double")).when(line.rlike(P95_SENTENCE), get(P95_SENTENCE, 1).cast("double")).when(line.rlike(SELF_SENTENCE), get(SELF_SENTENCE, 1).cast("double")).otherwise(none).alias("value"),
    )


def delta_class(v: Column, invert: bool) -> Column:
    """How a change counts: below 0.05 neutral; else good if it falls (invert) or rises."""
    return F.when(F.abs(v) < 0.05, "neutral").when((v <= 0) if invert else (v > 0), "good").otherwise("bad")


def status_code(code: Column) -> Column:
    """Status of a code's text form."""
    return F.when(code.isin("2", "STATUS_CODE_ERROR"), "error").when(code.isin("1", "STATUS_CODE_OK"), "ok").otherwise("unset")


def short_id(c: Column, n: int = 8) -> Column:
    return F.substring(c, 1, n)


def interpolate(template: str, values: dict[str, Column]) -> Column:
    """Replaces {key}; a key without a value stays."""
    out = F.lit(template)
    for k, v in values.items():
        out = F.replace(out, F.lit("{" + k + "}"), v.cast("string"))
    return out

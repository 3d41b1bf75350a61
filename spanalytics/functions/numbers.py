"""Rounding and number text with the semantics of JavaScript's toFixed and Number."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def js_round(c: Column, digits: int) -> Column:
    """Rounds the exact binary value, exact ties up. For values from 0 up to 1e12.

    format_number rounds the exact value but sends ties to even; a tie is a value whose 2^(digits + 1)-fold is odd.
    """
    tie = (c * float(2 ** (digits + 1))) % 2.0 == 1.0
    up = (F.floor(c * float(10**digits)) + 1) / float(10**digits)
    return F.when(tie, up.cast("double")).otherwise(F.replace(F.format_number(c, digits), F.lit(","), F.lit("")).cast("double"))


def number_text(c: Column) -> Column:
    """Shortest text of a number with at most one decimal: 33, 33.3."""
    return F.regexp_replace(c.cast("decimal(38,1)").cast("string"), r"\.0$", "")


def grouped_text(c: Column, least: int = 0, most: int = 1) -> Column:
    """English number format with thousands separators and least..most decimals (most is 0 or 1)."""
    text = F.format_number(js_round(c, most), most)
    return text if least == most else F.regexp_replace(text, r"\.0$", "")


def fixed_text(c: Column, digits: int = 1) -> Column:
    """toFixed's text."""
    return F.replace(F.format_number(js_round(c, digits), digits), F.lit(","), F.lit(""))


def nanos_to_ms(c: Column) -> Column:
    """Unsigned 64-bit nanoseconds as text to milliseconds; null if the text isn't all digits.

    Whole milliseconds and the rest are added as doubles, as a double can't hold the nanoseconds.
    """
    whole = c.cast("decimal(38,0)")
    ms = F.floor(whole / F.lit(1_000_000).cast("decimal(38,0)")).cast("double") + (whole % 1_000_000).cast("double") / 1e6
    return F.when(c.rlike(r"^[0-9]+$"), ms)


def time_text(at: Column) -> Column:
    """English time of day of a timestamp, in the session's zone: 01:04:05 PM."""
    return F.date_format(at, "hh:mm:ss a")

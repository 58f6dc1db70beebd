"""Column helpers: times in seconds, safe rates, clamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def micros(c: str | Column) -> Column:
    return F.unix_micros(F.col(c) if isinstance(c, str) else c)


def seconds_between(later: str | Column, earlier: str | Column) -> Column:
    return (micros(later) - micros(earlier)) / 1e6


def hours_between(later: str | Column, earlier: str | Column) -> Column:
    return seconds_between(later, earlier) / 3600


def rate(part: Column, whole: Column) -> Column:
    """Null over an empty whole."""
    return F.when(whole > 0, part / whole)


def rate0(part: Column, whole: Column) -> Column:
    """0 over an empty whole."""
    return F.coalesce(rate(part, whole), F.lit(0.0))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def saturate(x: Column, full: float) -> Column:
    """100 at ``full`` and above."""
    return clamp(x / full * 100, 0.0, 100.0)


def r6(x: Column) -> Column:
    return F.round(x, 6)

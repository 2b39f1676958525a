"""Durations: float seconds on the wire, whole nanoseconds inside, double seconds in results."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NS = 1_000_000_000


def to_ns(seconds: Column) -> Column:
    """Truncated towards zero, so that later sums are exact and independent of order."""
    return (seconds.cast("double") * F.lit(1e9)).cast("bigint")


def to_seconds(ns: Column) -> Column:
    return ns.cast("double") / F.lit(1e9)

"""Histogram buckets as column expressions.

A duration's bucket is its number of started bucket widths.  With ``quantize`` numbers above
255 are floored to multiples of a power of two, so that 8 bits of them are kept (the reference
precision); ``below`` and ``above`` the range are classes of their own.  ``compat="ref"``
reproduces the reference's arithmetic for ranges that don't start at 0 (absolute bucket
numbers to which the lower bound is added again); the default adds the bound once.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.conf import HISTOGRAM_BITS, Histogram

BELOW, INSIDE, ABOVE = -1, 0, 1


def bucket(ns: Column, h: Histogram, quantize: bool = True, compat: str = "fixed") -> Column:
    """struct(class, id) of a duration in nanoseconds."""
    steps = _started(ns if compat == "ref" or h.low_ns == 0 else ns - F.lit(h.low_ns), h.width_ns)
    low, high = (h.least_id, h.most_id) if compat == "ref" or h.low_ns == 0 else (1, h.buckets)
    magnitude = h.unit_magnitude if compat == "ref" else 0
    bucket_id = quantized(steps, magnitude) if quantize else steps
    cls = F.when(steps < low, BELOW).when(steps > high, ABOVE).otherwise(INSIDE)
    return F.struct(cls.alias("cls"), F.when(cls == INSIDE, bucket_id).otherwise(F.lit(0)).cast("bigint").alias("id"))


def _started(ns: Column, width: int) -> Column:
    rest = F.pmod(ns, F.lit(width))
    return (F.floor((ns - rest) / F.lit(width)) + F.when(rest > 0, 1).otherwise(0)).cast("bigint")


def quantized(v: Column, magnitude: int = 0) -> Column:
    """``v`` floored so that its leading 8 bits remain."""
    width = HISTOGRAM_BITS + 1
    mask = (1 << width) - 1
    bits = F.length(F.bin(v.bitwiseOR(F.lit(mask << magnitude).cast("bigint"))))
    shift = F.greatest(bits - F.lit(width), F.lit(magnitude))
    step = F.pow(F.lit(2.0), shift).cast("bigint")
    return v - F.pmod(v, step)

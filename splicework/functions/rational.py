"""Exact rationals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import col

#: Euclid needs at most this many steps on 32-bit numbers.
STEPS = 48


def gcd(a, b) -> Column:
    """Greatest common divisor of two 32-bit whole numbers; 1 when both are zero."""
    start = F.struct(F.abs(col(a).cast("bigint")).alias("x"), F.abs(col(b).cast("bigint")).alias("y"))

    def step(s: Column, _: Column) -> Column:
        return F.when(s["y"] == 0, s).otherwise(F.struct(s["y"].alias("x"), (s["x"] % s["y"]).alias("y")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, step, lambda s: F.when(s["x"] == 0, F.lit(1).cast("bigint")).otherwise(s["x"]))


def reduced(num, den) -> Column:
    """``num/den`` in lowest terms as a struct."""
    num, den = col(num).cast("bigint"), col(den).cast("bigint")
    d = gcd(num, den)
    return F.struct(F.call_function("div", num, d).alias("num"), F.call_function("div", den, d).alias("den"))

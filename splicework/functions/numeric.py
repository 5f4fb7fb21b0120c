"""Whole-microsecond arithmetic. Every function takes and returns Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SECOND_US = 1_000_000


def col(value) -> Column:
    """A Column from a name, a Column or a plain number."""
    if isinstance(value, Column):
        return value
    return F.col(value) if isinstance(value, str) else F.lit(value)


def js_round(value) -> Column:
    """Halves go up, also below zero: -2.5 becomes -2 (Spark's own round gives -3)."""
    return F.floor(col(value).cast("double") + F.lit(0.5)).cast("bigint")


def js_round_ratio(numerator, denominator) -> Column:
    """``js_round(numerator / denominator)`` on integers, without leaving BIGINT."""
    n, d = col(numerator).cast("bigint"), col(denominator).cast("bigint")
    top = n * 2 + d
    return floor_div(top, d * 2)


def quotient(a, b) -> Column:
    """Integer division that truncates, staying in BIGINT."""
    return F.call_function("div", col(a).cast("bigint"), col(b).cast("bigint"))


def floor_div(a, b) -> Column:
    """Integer division that floors, for a positive divisor."""
    a, b = col(a).cast("bigint"), col(b).cast("bigint")
    return quotient(a - F.pmod(a, b), b)


def ceil_div(a, b) -> Column:
    return -floor_div(-col(a).cast("bigint"), b)


def seconds_to_micros(value) -> Column:
    return js_round(col(value) * SECOND_US)


def micros_to_seconds(value) -> Column:
    return col(value) / F.lit(float(SECOND_US))


def millis_to_micros(value) -> Column:
    return js_round(col(value) * 1000)


def micros_to_millis(value) -> Column:
    return col(value) / F.lit(1000.0)

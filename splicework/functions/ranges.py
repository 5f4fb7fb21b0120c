"""Half-open ranges ``[start, end)`` and the clip's two clocks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import col, js_round


def zero() -> Column:
    return F.lit(0).cast("bigint")


def range_length(start, end) -> Column:
    return F.greatest(zero(), col(end) - col(start))


def overlaps(a_start, a_end, b_start, b_end) -> Column:
    return (col(a_start) < col(b_end)) & (col(b_start) < col(a_end))


def intersection(a_start, a_end, b_start, b_end) -> Column:
    """The shared part as a struct, null when there is none."""
    start, end = F.greatest(col(a_start), col(b_start)), F.least(col(a_end), col(b_end))
    return F.when(start < end, F.struct(start.alias("start"), end.alias("end")))


def clamp(value, low, high) -> Column:
    return F.least(F.greatest(col(value), col(low)), col(high))


def contains(at, start, end) -> Column:
    return (col(at) >= col(start)) & (col(at) < col(end))


def source_length(source_in="source_in", source_out="source_out") -> Column:
    return range_length(source_in, source_out)


def output_length(source_in="source_in", source_out="source_out", speed="speed") -> Column:
    return js_round(source_length(source_in, source_out) / col(speed))


def output_to_source(at, start="start", source_in="source_in", speed="speed") -> Column:
    return col(source_in) + js_round((col(at) - col(start)) * col(speed))


def source_to_output(at, start="start", source_in="source_in", speed="speed") -> Column:
    return col(start) + js_round((col(at) - col(source_in)) / col(speed))

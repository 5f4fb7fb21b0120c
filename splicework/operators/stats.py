"""Exact order statistics per key, from how often each value occurs instead of from collected values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scan import scan, sum_before


def counted(df: DataFrame, keys: list[str], value: str, coarse: Column | None = None) -> DataFrame:
    """Each different value of each key with ``times``, ``before`` (rows of lesser values) and ``n``, all rows of the key.

    Equal values are counted before the shuffle, so a value that most rows have is one row.
    """
    step = coarse if coarse is not None else F.floor(F.col(value) * 64).cast("bigint")
    times = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("times"))
    sizes = times.groupBy(*keys).agg(F.sum("times").alias("n"))
    return scan(times, keys, [value], coarse=step, before=sum_before(F.col("times"))).join(sizes, keys)


def _holds(place: Column) -> Column:
    """Whether a counted value stands at a 0-based place among its key's sorted rows."""
    return (F.col("before") <= place) & (place < F.col("before") + F.col("times"))


def exact_median(df: DataFrame, keys: list[str], value: str, out: str, coarse: Column | None = None) -> DataFrame:
    """The middle value, or the mean of the two middle ones."""
    rows = counted(df.select(*keys, value), keys, value, coarse)
    middle = _holds(F.call_function("div", F.col("n") - 1, F.lit(2))) | _holds(F.call_function("div", F.col("n"), F.lit(2)))
    return rows.where(middle).groupBy(*keys).agg(((F.min(value) + F.max(value)) / 2).alias(out))


def percentile_lower(df: DataFrame, keys: list[str], value: str, fraction: float, out: str, coarse: Column | None = None) -> DataFrame:
    """The value at ``min(n-1, floor(n*fraction))`` of the sorted values; never interpolated."""
    rows = counted(df.select(*keys, value), keys, value, coarse)
    wanted = F.least(F.col("n") - 1, F.floor(F.col("n") * F.lit(fraction)))
    return rows.where(_holds(wanted)).select(*keys, F.col(value).alias(out))

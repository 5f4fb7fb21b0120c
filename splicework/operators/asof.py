"""As-of joins: the nearest row of another table along time, within a key.

Both sides are laid on one axis and scanned once, so the work is linear in the rows of both,
whatever the number of matches per key, and hot keys are split by the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.easing import between_keys
from .scan import first_known, last_known, next_known, scan, stacked

MINUTE_US = 60_000_000


def brackets(
    left: DataFrame, right: DataFrame, keys: list[str], at: str, t: str, values: list[str], tie: str | None = None, bucket: int = MINUTE_US, first: bool = False
) -> DataFrame:
    """Rows of ``left`` with ``before`` (last right row at or before ``at``) and ``after`` (first later one).

    With ``first``, also the first right row of the key, from the same pass; null keys have none. All are structs of ``t`` and ``values``; null where there is none. Rows of one instant are
    ordered by ``tie``.
    """
    kept = F.struct(*[F.col(c) for c in left.columns])
    row = F.struct(F.col(t).alias("t"), *values)
    tied = F.col(tie) if tie else F.lit(0)
    a = left.select(*keys, F.col(at).alias("__at"), F.lit(1).alias("__side"), F.lit(None).cast("bigint").alias("__tie"), kept.alias("__left"))
    b = right.select(*keys, F.col(t).alias("__at"), F.lit(0).alias("__side"), tied.cast("bigint").alias("__tie"), row.alias("__row"))
    both = stacked(a, b, keys)
    done = scan(
        both, keys, ["__at", "__side", "__tie"], coarse=F.floor(F.col("__at") / bucket).cast("bigint"),
        before=last_known(F.col("__row")), after=next_known(F.col("__row")), **({"__first": first_known(F.col("__row"))} if first else {}),
    )
    named = F.lit(True)
    for k in keys:
        named = named & F.col(k).isNotNull()
    opening = [F.when(named, F.coalesce("__first", "after")).alias("first")] if first else []
    return done.where("__side = 1").select("__left.*", "before", "after", *opening)


def asof_backward(left, right, keys, at, t, values, tie=None, fallback_first: bool = True) -> DataFrame:
    """Last right row at or before; the first one when ``at`` precedes them all."""
    found = brackets(left, right, keys, at, t, values, tie, first=fallback_first).drop("after")
    if not fallback_first:
        return found.withColumnRenamed("before", "match")
    return found.withColumn("match", F.coalesce("before", "first")).drop("before", "first")


def asof_within(left, right, keys, at, t, values, tolerance, tie=None) -> DataFrame:
    """As ``asof_backward``, but only if the matched row lies within the tolerance."""
    found = asof_backward(left, right, keys, at, t, values, tie)
    near = F.abs(F.col("match")["t"] - F.col(at)) <= tolerance
    return found.withColumn("match", F.when(near, F.col("match")))


def asof_interpolate(left: DataFrame, keys_table: DataFrame, keys: list[str], at: str, fields: list[str], t: str = "t", tie: str = "key_idx") -> DataFrame:
    """Value of every field at ``at``: held outside the keys, eased by the left key inside."""
    values = [*fields, "easing"]
    rows = brackets(left, keys_table, keys, at, t, values, tie, first=True)
    early = F.col(at) <= F.col("first")["t"]
    before, after = F.col("before"), F.col("after")

    def value(f: str) -> Column:
        inside = between_keys(F.col(at), before["t"], before[f], before["easing"], after["t"], after[f])
        return F.when(early, F.col("first")[f]).otherwise(inside)

    return rows.withColumns({f"at_{f}": value(f) for f in fields}).drop("before", "after", "first")


def asof_forward(left: DataFrame, right: DataFrame, keys: list[str], at: str, t: str, values: list[str]) -> DataFrame:
    """First right row at or after ``at``; the last one when there is none."""
    kept = F.struct(*[F.col(c) for c in left.columns])
    row = F.struct(F.col(t).alias("t"), *values)
    a = left.select(*keys, F.col(at).cast("double").alias("__at"), F.lit(0).alias("__side"), kept.alias("__left"))
    b = right.select(*keys, F.col(t).cast("double").alias("__at"), F.lit(1).alias("__side"), row.alias("__row"))
    done = scan(
        stacked(a, b, keys), keys, ["__at", "__side"],
        coarse=F.floor(F.col("__at") / MINUTE_US).cast("bigint"), ahead=next_known(F.col("__row")),
    )
    lasts = right.groupBy(*keys).agg(F.max_by(row, F.col(t)).alias("__last"))
    return (
        done.where("__side = 0").select("__left.*", "ahead").join(lasts, keys, "left")
        .withColumn("match", F.coalesce("ahead", "__last")).drop("ahead", "__last")
    )

"""Ordered work per key (running totals, neighbours, last known values) that survives hot keys.

A plain ``Window.partitionBy(key)`` puts a whole key into one task. Before it is used, the input
is looked at: when all files behind it together are small, no key can be large. Otherwise rows
are counted per key over a content-hashed sample. If some key is heavy, the rows of heavy keys
are cut into segments along their own order; each segment is scanned on its own, one summary row
per segment carries the state across, and the two are joined back. All other keys are one segment.

The sample is a pure function of the rows, so a retried task or a second branch of the plan
always sees the same heavy keys. A wrong guess costs time, never a result.

A count that finds no heavy key is kept with the key column, as metadata that goes along through
selections, joins and written tables. Later scans of what was made from the rows take it instead of
running everything behind their input once more; where it leaves no headroom they count again.

Segments need a value that never decreases along the order: either ``coarse``, or the dense
0-based index ``ordinal`` stored with the rows (the segment is then ``ordinal div n``).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import session

SEG = "__seg"
#: Metadata of a key column: the most rows that one of its values had where they were counted.
MOST = "splicework.most"
#: A count is trusted while rows may have become this many times as many since, by joins or lists taken apart.
HEADROOM = 1000


@dataclass(frozen=True)
class Scan:
    """One ordered computation; ``kind`` is a key of ``_KINDS``."""

    kind: str
    value: Column


def running_sum(value) -> Scan:
    """Sum of this row and everything before it."""
    return Scan("sum_to", value)


def sum_before(value) -> Scan:
    return Scan("sum_before", value)


def max_before(value) -> Scan:
    return Scan("max_before", value)


def min_before(value) -> Scan:
    return Scan("min_before", value)


def min_all(value) -> Scan:
    """Least value of the whole key."""
    return Scan("min_all", value)


def last_known(value) -> Scan:
    """Last non-null value at or before this row."""
    return Scan("last_to", value)


def first_known(value) -> Scan:
    """First non-null value at or before this row."""
    return Scan("first_to", value)


def last_before(value) -> Scan:
    """Last non-null value strictly before this row."""
    return Scan("last_before", value)


def next_known(value) -> Scan:
    """First non-null value at or after this row."""
    return Scan("next_from", value)


def previous(value) -> Scan:
    return Scan("lag", value)


def following(value) -> Scan:
    return Scan("lead", value)


def input_bytes(df: DataFrame) -> int:
    """Size of the files and tables a frame reads, before any operator."""
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    try:
        return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    except ValueError:  # an estimate with thousands of digits, as for checkpoints of joins
        return 1 << 62


def heavy_keys(df: DataFrame, keys: list[str], spread: list[str]) -> DataFrame:
    """Keys whose sampled count says they hold more rows than one task should take."""
    spark = df.sparkSession
    sample, limit = session.heavy_sample(spark), session.heavy_rows(spark)
    picked = df if sample <= 1 else df.where(F.pmod(F.xxhash64(*keys, *spread), F.lit(sample)) == 0)
    return (
        picked.groupBy(*[F.col(k).alias(f"__{k}") for k in keys])
        .agg(F.count(F.lit(1)).alias("__n"))
        .where(F.col("__n") * sample > limit)
        .select(*[f"__{k}" for k in keys], F.lit(True).alias("__heavy"))
    )


def marked(df: DataFrame, key: str, most: int | None) -> DataFrame:
    """``df`` with a count of rows per value kept with ``key``, or, for None, with none."""
    kept = {k: v for k, v in df.schema[key].metadata.items() if k != MOST}
    return df.withMetadata(key, kept if most is None else kept | {MOST: most})


def is_light(df: DataFrame, keys: list[str]) -> bool:
    """Whether a count kept with one of the keys rules heavy keys out."""
    counts = [f.metadata[MOST] for f in df.schema.fields if f.name in keys and MOST in f.metadata]
    return bool(counts) and min(counts) * HEADROOM <= session.heavy_rows(df.sparkSession)


def stacked(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Both sides on top of each other; a count kept with a key goes along only where either side has one."""
    both = a.unionByName(b, allowMissingColumns=True)
    if not (is_light(a, keys) and is_light(b, keys)):
        for f in both.schema.fields:
            both = marked(both, f.name, None) if f.name in keys and MOST in f.metadata else both
    return both


def _most(df: DataFrame, keys: list[str], spread: list[str]) -> int | None:
    """Rows of the largest key by a count over a sample; None where no count is needed to rule heavy keys out."""
    spark = df.sparkSession
    if input_bytes(df) <= session.small_bytes(spark) or is_light(df, keys):
        return None
    sample = session.heavy_sample(spark)
    picked = df if sample <= 1 else df.where(F.pmod(F.xxhash64(*keys, *spread), F.lit(sample)) == 0)
    return (picked.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).agg(F.max("__n")).first()[0] or 0) * sample


def has_heavy(df: DataFrame, keys: list[str], spread: list[str]) -> bool:
    """Whether ordered work on ``df`` has to be split. Small inputs and counted keys are settled without a job."""
    return (_most(df, keys, spread) or 0) > session.heavy_rows(df.sparkSession)


def scan(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    *,
    coarse: Column | None = None,
    ordinal: str | None = None,
    **wanted: Scan,
) -> DataFrame:
    """Add one column per ``wanted`` entry, computed along ``order`` within ``keys``."""
    spark = df.sparkSession
    if ordinal is not None:
        coarse = F.call_function("div", F.col(ordinal).cast("bigint"), F.lit(session.segment_rows(spark)))
    most = None if coarse is None else _most(df, keys, order)
    if most is not None:
        session.keep_places(spark, most * HEADROOM <= session.heavy_rows(spark))
    if most is None or most <= session.heavy_rows(spark):
        if most is not None and len(keys) == 1:
            df = marked(df, keys[0], max(most, 1))
        inside = W.partitionBy(*keys).orderBy(*order)
        return _finish(df.withColumns({f"__l_{n}": _local(spec, inside) for n, spec in wanted.items()}), wanted, carried=False)

    # Read three times below, so its lineage is cut once here.
    df = session.checkpoint(df)
    heavy = heavy_keys(df, keys, order)
    cut = (
        df.join(heavy, [df[k].eqNullSafe(heavy[f"__{k}"]) for k in keys], "left")
        .withColumn(SEG, F.when(F.col("__heavy"), coarse.cast("bigint")))
        .drop("__heavy", *[f"__{k}" for k in keys])
    )
    inside = W.partitionBy(*keys, SEG).orderBy(*order)
    local = cut.withColumns({f"__l_{n}": _local(spec, inside) for n, spec in wanted.items()})
    position = F.struct(*order)
    totals = cut.where(F.col(SEG).isNotNull()).groupBy(*keys, SEG).agg(
        *[_total(spec, position).alias(f"__t_{name}") for name, spec in wanted.items()]
    )
    across = W.partitionBy(*keys).orderBy(SEG)
    carry = totals.select(
        *[F.col(k).alias(f"__k_{k}") for k in keys],
        F.col(SEG).alias("__k_seg"),
        *[_carry(spec, F.col(f"__t_{name}"), across).alias(f"__c_{name}") for name, spec in wanted.items()],
    )
    on = [local[k].eqNullSafe(carry[f"__k_{k}"]) for k in keys] + [local[SEG] == carry["__k_seg"]]
    joined = local.join(carry, on, "left").drop(*[f"__k_{k}" for k in keys], "__k_seg")
    return _finish(joined, wanted, carried=True)


def ordinals(df: DataFrame, keys: list[str], order: list[str], out: str, *, coarse: Column | None = None) -> DataFrame:
    """A dense 0-based position per key along ``order``."""
    return scan(df, keys, order, coarse=coarse, **{out: sum_before(F.lit(1))})


def _local(spec: Scan, inside) -> Column:
    before = inside.rowsBetween(W.unboundedPreceding, -1)
    upto = inside.rowsBetween(W.unboundedPreceding, 0)
    onward = inside.rowsBetween(0, W.unboundedFollowing)
    value, boxed = spec.value, F.struct(spec.value.alias("v"))
    return {
        "sum_to": lambda: F.sum(value).over(upto),
        "sum_before": lambda: F.sum(value).over(before),
        "max_before": lambda: F.max(value).over(before),
        "min_before": lambda: F.min(value).over(before),
        "min_all": lambda: F.min(value).over(inside.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)),
        "last_to": lambda: F.last(value, ignorenulls=True).over(upto),
        "first_to": lambda: F.first(value, ignorenulls=True).over(upto),
        "last_before": lambda: F.last(value, ignorenulls=True).over(before),
        "next_from": lambda: F.first(value, ignorenulls=True).over(onward),
        "lag": lambda: F.lag(boxed).over(inside),
        "lead": lambda: F.lead(boxed).over(inside),
    }[spec.kind]()


def _total(spec: Scan, position: Column) -> Column:
    """What one segment hands to the segments after (or before) it."""
    value, boxed = spec.value, F.struct(spec.value.alias("v"))
    known = F.when(value.isNotNull(), position)
    return {
        "sum_to": lambda: F.sum(value),
        "sum_before": lambda: F.sum(value),
        "max_before": lambda: F.max(value),
        "min_before": lambda: F.min(value),
        "min_all": lambda: F.min(value),
        "last_to": lambda: F.max_by(value, known),
        "first_to": lambda: F.min_by(value, known),
        "last_before": lambda: F.max_by(value, known),
        "next_from": lambda: F.min_by(value, known),
        "lag": lambda: F.max_by(boxed, position),
        "lead": lambda: F.min_by(boxed, position),
    }[spec.kind]()


def _carry(spec: Scan, total: Column, across) -> Column:
    before = across.rowsBetween(W.unboundedPreceding, -1)
    after = across.rowsBetween(1, W.unboundedFollowing)
    return {
        "sum_to": lambda: F.sum(total).over(before),
        "sum_before": lambda: F.sum(total).over(before),
        "max_before": lambda: F.max(total).over(before),
        "min_before": lambda: F.min(total).over(before),
        "min_all": lambda: F.min(total).over(across.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)),
        "last_to": lambda: F.last(total, ignorenulls=True).over(before),
        "first_to": lambda: F.first(total, ignorenulls=True).over(before),
        "last_before": lambda: F.last(total, ignorenulls=True).over(before),
        "next_from": lambda: F.first(total, ignorenulls=True).over(after),
        "lag": lambda: F.lag(total).over(across),
        "lead": lambda: F.lead(total).over(across),
    }[spec.kind]()


def _finish(df: DataFrame, wanted: dict[str, Scan], carried: bool) -> DataFrame:
    out = {}
    for name, spec in wanted.items():
        local = F.col(f"__l_{name}")
        carry = F.col(f"__c_{name}") if carried else None
        if spec.kind in ("sum_to", "sum_before"):
            total = F.coalesce(local, F.lit(0))
            value = total if carry is None else total + F.coalesce(carry, F.lit(0))
        elif spec.kind == "max_before":
            value = local if carry is None else F.greatest(local, carry)
        elif spec.kind in ("min_before", "min_all"):
            value = local if carry is None else F.least(local, carry)
        elif spec.kind == "first_to":
            value = local if carry is None else F.coalesce(carry, local)
        else:
            value = local if carry is None else F.coalesce(local, carry)
            if spec.kind in ("lag", "lead"):
                value = value["v"]
        out[name] = value
    return df.withColumns(out).drop(SEG, *[f"__l_{n}" for n in wanted], *[f"__c_{n}" for n in wanted])

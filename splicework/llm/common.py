"""Helpers that several corpus operators share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint, checkpoint_folder, counted, release, scratch

__all__ = ["BROADCAST_ROWS", "SPREAD", "boxed", "checkpoint", "checkpoint_folder", "counted", "lookup", "release", "scratch", "small_or_spread", "table", "unboxed", "words"]

#: Pieces that the rows of one key are dealt over before they meet that key's single row.
SPREAD = 64
#: A table of at most this many short rows is sent to every task; a larger one is joined by shuffle.
BROADCAST_ROWS = 20_000
#: A word is a run of anything but the six ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def boxed(df: DataFrame, *needed: str | Column, without: Sequence[str] = ()) -> DataFrame:
    """The rows as one column ``row`` beside the needed ones, so that no other name can clash with an
    operator's. Columns that ``unboxed`` is going to replace may stay out of it."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns if c not in without]).alias("row"), *needed)


def unboxed(columns: Sequence[str], **replaced: Column) -> list[Column]:
    """The boxed columns in their order, some of them replaced, and further ones after them."""
    own = {c.lower() for c in columns}
    lowered = {name.lower(): column for name, column in replaced.items()}
    kept = [lowered.get(c.lower(), F.col("row").getField(c)).alias(c) for c in columns]
    return kept + [column.alias(name) for name, column in replaced.items() if name.lower() not in own]


def words(text: Column) -> Column:
    """Number of words; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def lookup(left: DataFrame, right: DataFrame, on: Sequence[str], by: Sequence[str], how: str = "inner", spread: int = SPREAD) -> DataFrame:
    """Join ``left`` to ``right``, which has one row per key, however many left rows share a key.

    Left rows are dealt over ``spread`` pieces by the columns ``by``. Only the distinct
    (key, piece) pairs meet the right side, so no task reads more than ``spread`` of them per
    key, and the left rows then join on key and piece. Keys are compared null-safely nowhere:
    a null key finds nothing.
    """
    on = list(on)
    dealt = left.withColumn("__piece", F.pmod(F.xxhash64(*[F.col(c) for c in by]), F.lit(spread)).cast("int"))
    asked = dealt.select(*on, "__piece").distinct().join(right, on)
    return dealt.join(asked, [*on, "__piece"], how).drop("__piece")


def small_or_spread(left: DataFrame, right: DataFrame, on: Sequence[str], by: Sequence[str], how: str = "inner", rows: int | None = None) -> DataFrame:
    """``lookup``, by broadcast where ``right`` (a checkpointed table of short rows, of ``rows`` if they were counted before) is counted to be small."""
    if (right.count() if rows is None else rows) <= BROADCAST_ROWS:
        return left.join(F.broadcast(right), list(on), how)
    return lookup(left, right, on, by, how)

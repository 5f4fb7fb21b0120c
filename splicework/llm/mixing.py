"""Mixing sources to target weights: whole copies plus one hash-seeded Bernoulli copy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import boxed, checkpoint, small_or_spread, table, unboxed, words
from .registry import corpus_query

#: Weights of the sources in code-point order, repeating; the share of all words that the mix
#: takes; and the most that one source may be repeated.
WEIGHTS, SHARE, MOST, SEED = (3, 1, 2), 1.5, 2, "mix"


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, size) per document -> source, source_size, target.

    ``share`` times the sum of all sizes is dealt by weight; a source's target stops at ``most``
    times its size and the excess goes to the others by weight. The level at which this settles
    is found in one pass over the sources ordered by size per weight: where the first k of them
    are full, the rest get what is left over per unit of weight. Weights go round in code-point
    order of the names, a null name last; equal names are one source. Only the table with one
    row per source is ordered as a whole.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    named = totals.withColumn("__at", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("__at") % len(weights) + 1).cast("int"))
    weighed = named.withColumn("__w", weight.cast("long")).withColumn("__full", F.col("source_size") * F.lit(most) / F.col("__w"))
    before = Window.orderBy("__full", "__at").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    levels = (
        weighed.withColumn("__taken", F.coalesce(F.sum(F.col("source_size") * F.lit(most)).over(before), F.lit(0)))
        .withColumn("__used", F.coalesce(F.sum("__w").over(before), F.lit(0)))
        .withColumn("__all", F.sum("source_size").over(everything))
        .withColumn("__weights", F.sum("__w").over(everything))
        .withColumn("__level", (F.col("__all") * F.lit(share) - F.col("__taken")) / (F.col("__weights") - F.col("__used")))
    )
    # the level that holds is that of the first source which it does not fill
    settled = F.min(F.when(F.col("__level") <= F.col("__full"), F.struct("__full", "__at", "__level"))).over(everything)["__level"]
    level = F.coalesce(settled, F.max("__full").over(everything))
    full = F.col("source_size") * F.lit(float(most))
    return levels.withColumn("target", F.least(F.col("__w") * level, full)).select("source", "source_size", "target")


def draw(seed: str, doc_id: Column, text: Column) -> Column:
    """A number in [0, 1) from 48 bits of an MD5; documents without an id draw by their text."""
    who = F.coalesce(doc_id.cast("string"), F.concat(F.lit("text:"), F.md5(text)), F.lit("none"))
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), who)), 1, 12), 16, 10).cast("long") / F.lit(float(1 << 48))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: str = SEED) -> DataFrame:
    """Every row of ``docs`` with size, source_size, target and ``copies``, the times the mix takes it.

    A source's repetition rate is its target over its size: each of its documents is taken
    floor(rate) times, and once more where a number drawn from a hash of (seed, doc_id) falls
    below the fraction. Rows that share an id share the draw. A null text has size 0; a source
    of no words is taken 0 times. Columns of the input other than doc_id, text and source pass
    through; those named size, source_size, target or copies are replaced.
    """
    base = boxed(docs, "doc_id", "source", words(F.col("text")).alias("size"), draw(seed, F.col("doc_id"), F.col("text")).alias("drawn")).withColumn("key", _key())
    targets = checkpoint(source_targets(base.select("source", "size"), weights, share, most)).withColumn("key", _key()).drop("source")
    joined = small_or_spread(base, targets, ["key"], ["doc_id", "size"])
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    extra = (F.col("drawn") < rate - F.floor(rate)).cast("int")
    copies = (F.floor(rate) + extra).cast("int")
    return joined.select(*unboxed(docs.columns, size=F.col("size"), source_size=F.col("source_size"), target=F.col("target"), copies=copies))


def _key() -> Column:
    """The source as a key that a null can be found by."""
    return F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null"))


def mix(docs: DataFrame, **parameters) -> DataFrame:
    """The mix itself: each row of ``docs`` as many times as ``mixed`` says, columns unchanged."""
    counted = mixed(boxed(docs, "doc_id", "text", "source"), **parameters)
    repeated = counted.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return repeated.select(*unboxed(docs.columns))


MIX_SQL = rf"""
WITH sized AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, text FROM documents),
totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS s FROM sized GROUP BY source),
named AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS nth FROM totals),
weighed AS (SELECT *, CAST([3, 1, 2][nth % 3 + 1] AS BIGINT) AS w FROM named),
filled AS (SELECT *, CAST(s * {MOST} AS DOUBLE) / w AS full_at FROM weighed),
levels AS (SELECT *, (sum(s) OVER () * 1.5::DOUBLE - coalesce(sum(s * {MOST}) OVER (ORDER BY full_at, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY full_at, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM filled),
settled AS (SELECT coalesce((SELECT level FROM levels WHERE level <= full_at ORDER BY full_at, nth LIMIT 1), (SELECT max(full_at) FROM levels)) AS level),
targets AS (SELECT source, s AS source_size, least(w * (SELECT level FROM settled), s * 2.0::DOUBLE) AS target FROM filled),
rated AS (SELECT d.doc_id, CAST(d.size AS BIGINT) AS size, t.source_size, t.target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
    CAST(('0x' || substr(md5('{SEED}:' || coalesce(CAST(d.doc_id AS VARCHAR), 'text:' || md5(d.text), 'none')), 1, 12)) AS BIGINT) / 281474976710656.0::DOUBLE AS u
    FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM rated
"""


@corpus_query("op4_mixing", sql=MIX_SQL)
def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = mixed(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return docs.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))

"""Interval joins through time bins, so that Spark sees an equality it can shuffle on.

A range is listed in every bin it touches and a point in its one bin; the exact bounds are
checked after the match. A pair of ranges is kept only in the bin where their shared part begins,
so no pair comes out twice. A hot key is spread over its bins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import floor_div
from ..functions.ranges import source_to_output
from .blocks import with_levels
from .scan import max_before, ordinals, scan

BIN_US = 10_000_000
#: Cells of ``in_cells`` are this many times as wide from one size to the next, and so many sizes; the last one is a key's whole time.
WIDER, SIZES = 8, 6


def _bins(df: DataFrame, start: Column, end: Column, width: int) -> DataFrame:
    """``df`` once per bin of ``[start, end)``; empty ranges touch none."""
    last = floor_div(end - 1, width)
    return df.where(end > start).withColumn("__bin", F.explode(F.sequence(floor_div(start, width), last)))


def points_in_ranges(points: DataFrame, ranges: DataFrame, keys: list[str], at: str, start: str, end: str, width: int = BIN_US) -> DataFrame:
    """Every point with every range of its key that contains it."""
    spread = _bins(ranges, F.col(start), F.col(end), width)
    marked = points.withColumn("__bin", floor_div(at, width))
    joined = marked.join(spread, [*keys, "__bin"])
    return joined.where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("__bin")


def overlapping(a: DataFrame, b: DataFrame, keys: list[str], a_range: tuple[str, str], b_range: tuple[str, str], width: int = BIN_US) -> DataFrame:
    """Pairs of one key whose ranges share time."""
    left = _bins(a, F.col(a_range[0]), F.col(a_range[1]), width)
    right = _bins(b, F.col(b_range[0]), F.col(b_range[1]), width)
    joined = left.join(right, [*keys, "__bin"])
    begins = F.greatest(F.col(a_range[0]), F.col(b_range[0]))
    shared = (F.col(a_range[0]) < F.col(b_range[1])) & (F.col(b_range[0]) < F.col(a_range[1]))
    return joined.where(shared & (floor_div(begins, width) == F.col("__bin"))).drop("__bin")


def _widths(width: int) -> list[int]:
    return [width * WIDER**size for size in range(SIZES - 1)] + [1 << 61]


def _of_size(cells: Column, size: int) -> Column:
    return F.transform(cells, lambda c: F.struct(F.lit(size).alias("size"), c.alias("cell")))


def in_cells(ranges: DataFrame, others: DataFrame, keys: list[str], range_: tuple[str, str], other: tuple[str, str], width: int = BIN_US) -> DataFrame:
    """Pairs of a range and another range of its key (whole, not empty) that share time, for many ranges over few others.

    A range has a single cell: the one it begins in, of the least width that is not below its length, so it is
    shuffled once. It ends in that cell or the next, so the others are listed, for each width, in the cells they touch
    and in the one before.
    """
    begin, end = F.col(range_[0]), F.col(range_[1])
    widths = _widths(width)
    size, cell = F.lit(SIZES - 1), floor_div(begin, widths[-1])
    for s in range(SIZES - 2, -1, -1):
        fits = end - begin <= widths[s]
        size, cell = F.when(fits, F.lit(s)).otherwise(size), F.when(fits, floor_div(begin, widths[s])).otherwise(cell)
    left = ranges.where(end > begin).withColumns({"__size": size, "__cell": cell})
    a, b = F.col(other[0]), F.col(other[1])
    listed = F.concat(*[_of_size(F.sequence(floor_div(a, w) - 1, floor_div(b - 1, w)), s) for s, w in enumerate(widths)])
    right = others.where(b > a).withColumn("__c", F.explode(listed)).withColumns({"__size": F.col("__c.size"), "__cell": F.col("__c.cell")}).drop("__c")
    return left.join(right, [*keys, "__size", "__cell"]).where((begin < b) & (a < end)).drop("__size", "__cell")


def regions_in_clips(regions: DataFrame, clips: DataFrame, min_us: int = 200_000) -> DataFrame:
    """Source regions cut to what a clip uses and moved to output time; short leftovers dropped."""
    named = regions.select("source_id", F.col("start").alias("__rs"), F.col("end").alias("__re"))
    pairs = in_cells(clips, named, ["source_id"], ("source_in", "source_out"), ("__rs", "__re"))
    s, e = F.greatest("__rs", "source_in"), F.least("__re", "source_out")
    pairs = pairs.withColumns({"__s": s, "__e": e}).where(F.col("__e") - F.col("__s") >= min_us)
    return pairs.select(
        "timeline_id", "clip_id", source_to_output("__s").alias("region_start"), source_to_output("__e").alias("region_end")
    )


def onsets_in_clips(onsets: DataFrame, clips: DataFrame) -> DataFrame:
    """Transients a clip uses, in output time."""
    named = onsets.select("source_id", F.col("t").alias("__t"), (F.col("t") + 1).alias("__after"), "strength")
    inside = in_cells(clips, named, ["source_id"], ("source_in", "source_out"), ("__t", "__after"))
    return inside.select("timeline_id", "clip_id", source_to_output("__t").alias("t"), "strength")


def clip_levels(clips: DataFrame, source_levels: DataFrame, levels: DataFrame) -> DataFrame:
    """Peak and typical level of the footage each clip uses, next to its source's median.

    ``source_levels`` gives ``source_id, hop_us, median_db``; clips of unmeasured sources vanish.
    """
    known = clips.join(source_levels.select("source_id", "hop_us", "median_db"), "source_id")
    ranged = known.withColumns({
        "h0": floor_div("source_in", F.col("hop_us")),
        "h1": -floor_div(-F.col("source_out"), F.col("hop_us")) - 1,
    })
    found = with_levels(ranged.select("timeline_id", "clip_id", "source_id", "median_db", "h0", "h1"), levels)
    return found.select("timeline_id", "clip_id", "source_id", "peak_db", "typical_db", F.col("median_db").alias("source_median_db"))


def top_hits(hits: DataFrame, n: int = 6) -> DataFrame:
    """The strongest hits of each clip, to be read in time order."""
    ordered = hits.withColumn("__weak", -F.col("strength"))
    return ordinals(ordered, ["clip_id"], ["__weak", "t"], "__r", coarse=F.floor(F.col("__weak") * 1000).cast("bigint")).where(F.col("__r") < n).drop("__weak", "__r")


def owners(clips: DataFrame, keys: list[str]) -> DataFrame:
    """The stretch of output time in which each clip is the first one not yet over.

    Clips are walked in order and never revisited, so the stretches of a track are disjoint even
    where disabled clips lie on top of others.
    """
    end = F.col("start") + F.col("out_len")
    seen = scan(clips, keys, ["ord"], ordinal="ord", __reach=max_before(end))
    own_from = F.coalesce("__reach", F.lit(-(1 << 62)))
    return seen.withColumns({"own_from": own_from, "own_to": end}).where("own_to > own_from").drop("__reach")

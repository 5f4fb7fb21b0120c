"""Colour grades and the frame statistics they are suggested from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import js_round
from .sampling import GRADE
from .scan import running_sum, scan


def is_graded(fields: tuple[str, ...] = GRADE) -> Column:
    """Whether any control is off its rest position."""
    moved = F.lit(False)
    for f in fields:
        moved = moved | (F.col(f) != 0)
    return moved


def graded(clips: DataFrame) -> DataFrame:
    return clips.where(is_graded())


def clamp_grade(df: DataFrame, fields: tuple[str, ...] = GRADE) -> DataFrame:
    """Controls within -1..1; missing, NaN and infinite ones at rest."""

    def safe(f: str) -> Column:
        c = F.col(f)
        usable = c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
        return F.when(usable, F.least(F.greatest(c, F.lit(-1.0)), F.lit(1.0))).otherwise(F.lit(0.0))

    return df.withColumns({f: safe(f) for f in fields})


def frame_stats(pixels: DataFrame, frames: DataFrame) -> DataFrame:
    """Black, mid and white points, saturation and channel means of each frame.

    ``pixels``: ``frame_id, r, g, b, a``; transparent ones are ignored. A frame of ``frames``
    without any visible pixel gets the fixed neutral answer.
    """
    seen = pixels.where("a >= 8")
    r, g, b = F.col("r"), F.col("g"), F.col("b")
    luma = r * F.lit(0.2126) + g * F.lit(0.7152) + b * F.lit(0.0722)
    shade = F.least(F.lit(255).cast("bigint"), F.greatest(F.lit(0).cast("bigint"), js_round(luma)))
    high, low = F.greatest(r, g, b), F.least(r, g, b)
    bins = seen.groupBy("frame_id", shade.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.when(high == 0, F.lit(0.0)).otherwise((high - low) / high)).alias("sat"),
        F.sum(r).alias("r"), F.sum(g).alias("g"), F.sum(b).alias("b"),
    )
    # At most 256 rows a frame from here on.
    means = bins.groupBy("frame_id").agg(
        F.sum("n").alias("total"), (F.sum("sat") / F.sum("n")).alias("saturation"),
        *[(F.sum(c) / F.sum("n") / 255).alias(name) for c, name in (("r", "red"), ("g", "green"), ("b", "blue"))],
    )
    grown = scan(bins.select("frame_id", "bin", "n"), ["frame_id"], ["bin"], seen=running_sum(F.col("n"))).join(means.select("frame_id", "total"), "frame_id")
    reach = lambda part: F.min(F.when(F.col("seen") >= F.col("total") * F.lit(part), F.col("bin"))) / 255
    points = grown.groupBy("frame_id").agg(reach(0.05).alias("black"), reach(0.5).alias("mid"), reach(0.95).alias("white"))
    rest = {"black": 0.0, "mid": 0.5, "white": 1.0, "saturation": 0.0, "red": 0.5, "green": 0.5, "blue": 0.5}
    full = frames.select("frame_id").join(points, "frame_id", "left").join(means.drop("total"), "frame_id", "left")
    return full.select("frame_id", *[F.coalesce(F.col(c), F.lit(value)).alias(c) for c, value in rest.items()])


def suggest_grade(stats: DataFrame) -> DataFrame:
    """A grade that would even out a frame; every control bounded, three decimals."""
    c = F.col

    def bounded(value: Column, limit: float) -> Column:
        return F.greatest(F.lit(-limit), F.least(F.lit(limit), F.round(value, 3)))

    spread = F.greatest(F.lit(0.05), c("white") - c("black"))
    mean = (c("red") + c("green") + c("blue")) / 3
    mean = F.when(mean == 0, F.lit(1.0)).otherwise(mean)
    return stats.select(
        "frame_id",
        bounded((1 - spread) * 0.9, 0.5).alias("contrast"),
        bounded((0.06 - c("black")) * 1.6, 0.4).alias("brilliance"),
        bounded((0.5 - c("mid")) * 0.7, 0.35).alias("exposure"),
        bounded(F.greatest(F.lit(0.0), 0.32 - c("saturation")) * 1.6, 0.3).alias("saturation"),
        bounded((c("blue") - c("red")) / mean * 0.8, 0.25).alias("warmth"),
        bounded(((c("red") + c("blue")) / 2 - c("green")) / mean * 0.8, 0.2).alias("tint"),
    )


def luma(rgba: Column) -> Column:
    """Brightness per pixel of a flat RGBA array, as whole numbers."""
    pixels = F.sequence(F.lit(0), F.call_function("div", F.size(rgba), F.lit(4)).cast("int") - 1)
    part = lambda i, k: F.get(rgba, i * 4 + k).cast("bigint")
    return F.when(F.size(rgba) >= 4, F.transform(pixels, lambda i: F.shiftright(part(i, 0) * 77 + part(i, 1) * 150 + part(i, 2) * 29, 8))).otherwise(F.array().cast("array<bigint>"))

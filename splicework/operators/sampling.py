"""Timelines looked at over output time: layers at an instant, frames, level columns, gain curves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.frames import frame_us
from ..functions.levels import SILENCE_DB, scale_db
from ..functions.numeric import floor_div, js_round
from ..functions.ranges import output_to_source, zero
from .asof import asof_backward, asof_forward, asof_interpolate
from .blocks import loudest
from .intervals import owners, points_in_ranges
from .timeline import TRACK, timeline_duration

FRAMING = ["scale", "x", "y", "rotation"]
#: Fixed value: the controls of a colour grade.
GRADE = ("exposure", "brilliance", "contrast", "saturation", "warmth", "tint")


def clip_at(points: DataFrame, clips: DataFrame) -> DataFrame:
    """The enabled video clip covering each ``timeline_id, at``; null in a gap or past the end."""
    shown = clips.where("enabled and kind = 'video' and out_len > 0").withColumn("clip_end", F.col("start") + F.col("out_len"))
    found = asof_backward(points, shown, ["timeline_id"], "at", "start", ["clip_id", "clip_end"], tie="ord", fallback_first=False)
    inside = F.col("at") < F.col("match")["clip_end"]
    return found.withColumn("clip_id", F.when(inside, F.col("match")["clip_id"])).drop("match")


def sample_timelines(points: DataFrame, clips: DataFrame, tracks: DataFrame, keys: DataFrame, statics: DataFrame) -> DataFrame:
    """Every layer on screen at each ``timeline_id, at``.

    ``keys`` holds the keys of animated effects, ``statics`` crops (``rect``) and grades
    (``color``). The last enabled effect of a type wins; gains multiply.
    """
    ranged = clips.where("enabled").withColumn("clip_end", F.col("start") + F.col("out_len"))
    layers = points_in_ranges(points, ranged, ["timeline_id"], "at", "start", "clip_end")
    layers = layers.join(tracks.select(*TRACK, "muted"), TRACK, "left").withColumns({
        "source_time": output_to_source("at"), "clip_offset": F.col("at") - F.col("start"),
    })
    active = keys.where("effect_enabled")
    effects = active.select("clip_id", "effect_id", "type", "effect_ord").distinct()
    asked = layers.select("clip_id", "at", "clip_offset").join(effects, "clip_id")
    valued = asof_interpolate(asked, active, ["clip_id", "effect_id"], "clip_offset", FRAMING)
    of = lambda kind, c: F.max_by(F.when(F.col("type") == kind, c), F.when(F.col("type") == kind, F.col("effect_ord")))
    moved = valued.groupBy("clip_id", "at").agg(
        of("transform", F.struct(*[F.col(f"at_{f}").alias(f) for f in FRAMING])).alias("__framing"),
        of("opacity", F.col("at_scale")).alias("__opacity"),
        F.product(F.when(F.col("type") == "volume", F.col("at_scale"))).alias("__volume"),
    )
    still = statics.where("effect_enabled").groupBy("clip_id").agg(
        F.max_by(F.when(F.col("type") == "crop", F.col("rect")), F.when(F.col("type") == "crop", F.col("effect_ord"))).alias("__rect"),
        F.max_by(F.when(F.col("type") == "color", F.col("color")), F.when(F.col("type") == "color", F.col("effect_ord"))).alias("__color"),
    )
    rows = layers.join(moved, ["clip_id", "at"], "left").join(still, "clip_id", "left")
    silent = F.col("mute") | F.coalesce("muted", F.lit(False))
    neutral = {"scale": 1.0, "x": 0.0, "y": 0.0, "rotation": 0.0}
    sides = {"left": 0.0, "top": 0.0, "right": 1.0, "bottom": 1.0}
    return rows.select(
        "timeline_id", "track_id", "ord", "clip_id", "source_id", "at", "source_time", "clip_offset",
        *[F.coalesce(F.col("__framing")[f], F.lit(v)).alias(f) for f, v in neutral.items()],
        *[F.coalesce(F.col("__rect")[f], F.lit(v)).alias(f"crop_{f}") for f, v in sides.items()],
        F.coalesce("__opacity", F.lit(1.0)).alias("opacity"),
        *[F.coalesce(F.col("__color")[f], F.lit(0.0)).alias(f) for f in GRADE],
        F.when(silent, F.lit(0.0)).otherwise(F.col("gain") * F.coalesce("__volume", F.lit(1.0))).alias("layer_gain"),
    )


def place_layers(layers: DataFrame) -> DataFrame:
    """Crop window, cover fit, centre and drawn size of layers with ``src_*`` and ``out_*`` sizes."""
    w, h = F.col("src_width").cast("double"), F.col("src_height").cast("double")
    ow, oh = F.col("out_width").cast("double"), F.col("out_height").cast("double")
    sized = layers.withColumns({
        "sx": F.col("crop_left") * w, "sy": F.col("crop_top") * h,
        "sw": F.greatest(F.lit(1.0), (F.col("crop_right") - F.col("crop_left")) * w),
        "sh": F.greatest(F.lit(1.0), (F.col("crop_bottom") - F.col("crop_top")) * h),
    }).withColumn("__fit", F.greatest(ow / F.col("sw"), oh / F.col("sh")) * F.col("scale"))
    return sized.withColumns({
        "cx": ow / 2 + F.col("x") * ow, "cy": oh / 2 + F.col("y") * oh,
        "dw": F.col("sw") * F.col("__fit"), "dh": F.col("sh") * F.col("__fit"),
        "radians": F.radians("rotation"),
    }).drop("__fit")


def output_frames(timelines: DataFrame) -> DataFrame:
    """The constant-rate frame clock of ``timeline_id, duration_us, fps_num, fps_den``."""
    step = frame_us("fps_num", "fps_den")
    frames = F.greatest(F.lit(1).cast("bigint"), F.ceil(F.col("duration_us") / step).cast("bigint"))
    spread = timelines.select("timeline_id", step.alias("__step"), F.explode(F.sequence(zero(), frames - 1)).alias("frame"))
    return spread.select("timeline_id", "frame", js_round(F.col("frame") * F.col("__step")).alias("at"))


def resample_constant_rate(grid: DataFrame, frames: DataFrame) -> DataFrame:
    """Which source frame each output frame shows.

    ``grid`` lists output frames of clips (``clip_id, at``); ``frames`` the presented source
    frames with their clip's ``start, source_in, source_out, speed`` and ``step_us``. Each output
    frame takes the first picture whose mapped time reaches it, the tail repeats the last one.
    """
    usable = frames.where(F.col("source_us") + F.col("step_us") >= F.col("source_in"))
    # Playback stops at the first picture at or past the end; later ones are never presented.
    stop = usable.where("source_us >= source_out").groupBy("clip_id").agg(F.min("source_us").alias("__stop"))
    shown = usable.join(stop, "clip_id", "left").where("__stop is null or source_us <= __stop")
    mapped = shown.select(
        "clip_id", "source_us", (F.col("start") + (F.col("source_us") - F.col("source_in")) / F.col("speed")).alias("reach")
    )
    found = asof_forward(grid, mapped, ["clip_id"], "at", "reach", ["source_us"])
    return found.withColumn("source_us", F.col("match")["source_us"]).drop("match")


def volume_automation(keys: DataFrame, clips: DataFrame) -> DataFrame:
    """Gain curve of every clip with volume effects, at the times any of them has a key."""
    volume = keys.where("effect_enabled and type = 'volume'")
    times = distinct_times(volume)
    asked = times.join(volume.select("clip_id", "effect_id").distinct(), "clip_id")
    found = asof_backward(asked, volume, ["clip_id", "effect_id"], "t", "t", ["scale", "easing"], tie="key_idx")
    held = (F.col("match")["t"] <= F.col("t")) & (F.col("match")["easing"] == "hold")
    curve = found.groupBy("clip_id", "t").agg(F.product(F.col("match")["scale"]).alias("value"), F.bool_or(held).alias("step"))
    return curve.join(clips.select("clip_id", "start"), "clip_id").select(
        "clip_id", "t", (F.col("start") / 1e6 + F.col("t") / 1e6).alias("at"), "value", "step"
    )


def distinct_times(keys: DataFrame) -> DataFrame:
    """All key times of a clip, once each."""
    return keys.select("clip_id", "t").distinct()


def downsample_levels(columns: DataFrame, clips: DataFrame, levels: DataFrame, source_levels: DataFrame) -> DataFrame:
    """Display level of buckets of output time: ``timeline_id, column, at, step_us``.

    Each bucket shows the loudest hop of the footage under it, at least one hop; 0 in gaps, under
    disabled clips, and for footage without levels.
    """
    video = clips.where("kind = 'video'")
    owned = owners(video, TRACK)
    found = asof_backward(
        columns, owned, ["timeline_id"], "at", "own_from",
        ["own_to", "enabled", "start", "speed", "source_id", "source_in", "source_out"], tie="ord", fallback_first=False,
    )
    m = F.col("match")
    live = (F.col("at") < m["own_to"]) & m["enabled"] & (F.col("at") >= m["start"])
    begin = m["source_in"] + (F.col("at") - m["start"]) * m["speed"]
    until = F.least(m["source_out"].cast("double"), begin + F.col("step_us") * m["speed"])
    rows = found.select(
        "timeline_id", "column", F.when(live, m["source_id"]).alias("source_id"), F.when(live, begin).alias("__from"), F.when(live, until).alias("__to")
    ).join(source_levels.select("source_id", "hop_us", "hops", "peak_db", "median_db"), "source_id", "left")
    first = F.greatest(zero(), F.floor(F.least("__from", "__to") / F.col("hop_us")).cast("bigint"))
    end = F.greatest(first, F.ceil(F.greatest("__from", "__to") / F.col("hop_us")).cast("bigint") - 1)
    rows = rows.withColumns({"h0": first, "h1": F.least(F.col("hops") - 1, end)})
    loud = loudest(rows.where("h0 is not null"), levels).withColumnRenamed("peak_db", "__loud")
    shown = F.greatest(F.col("__loud"), F.lit(SILENCE_DB))
    level = F.when(F.col("__loud").isNull(), F.lit(0.0)).otherwise(scale_db(shown, "peak_db", "median_db"))
    return rows.join(loud, ["source_id", "h0", "h1"], "left").select("timeline_id", "column", level.alias("level"))

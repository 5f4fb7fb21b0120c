"""Clips on a timeline: lengths, positions, discontinuities, coverage of the source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import session
from ..functions.frames import frame_step, frame_us, snap_to_frame
from ..functions.numeric import js_round, quotient
from ..functions.ranges import output_length, source_length, zero
from .scan import following, max_before, min_all, ordinals, previous, scan, sum_before

TRACK = ["timeline_id", "track_id"]


def with_durations(clips: DataFrame) -> DataFrame:
    """Source length, output length and output end of every clip."""
    return clips.withColumns({"source_len": source_length(), "out_len": output_length()}).withColumn(
        "clip_end", F.col("start") + F.col("out_len")
    )


def reflow(clips: DataFrame) -> DataFrame:
    """Positions as playback sees them: empty clips gone, video clips end to end.

    Disabled clips sit at the cursor without moving it. Clips of other tracks keep their start and
    stand in the order of start and id; the track's lowest ``ord`` counts on from there.
    """
    video = F.coalesce(F.col("kind") == "video", F.lit(False))
    kept = clips.where(F.col("source_out") > F.col("source_in")).withColumns({"out_len": output_length(), "__video": video})
    # Both kinds in one pass: video in its stored order, the rest by start and id.
    keyed = kept.withColumns({"__key": F.when(video, F.col("ord")).otherwise(F.col("start")).cast("bigint"), "__tie": F.when(~video, F.col("clip_id"))})
    coarse = F.when(video, quotient("ord", session.segment_rows(clips.sparkSession))).otherwise(quotient("start", 60_000_000))
    used = F.when(F.col("__video") & F.col("enabled"), F.col("out_len")).otherwise(zero())
    placed = scan(keyed, [*TRACK, "__video"], ["__key", "__tie"], coarse=coarse, __before=sum_before(used), __nth=sum_before(F.lit(1)), __lowest=min_all(F.col("ord")))
    moved = {"start": F.when(F.col("__video"), F.col("__before").cast("bigint")).otherwise(F.col("start")), "ord": F.when(F.col("__video"), F.col("ord")).otherwise(F.col("__lowest") + F.col("__nth")).cast(clips.schema["ord"].dataType)}
    return placed.withColumns(moved).drop("__video", "__key", "__tie", "__before", "__nth", "__lowest")


def timeline_duration(clips: DataFrame, extra_keys: tuple[str, ...] = ()) -> DataFrame:
    """Furthest output end of any enabled clip, 0 when there is none."""
    end = F.col("start") + output_length()
    return clips.groupBy("timeline_id", *extra_keys).agg(
        F.coalesce(F.max(F.when(F.col("enabled"), F.greatest(zero(), end))), zero()).alias("duration_us")
    )


def coarse_cuts(clips: DataFrame, tolerance_us: int = 0) -> DataFrame:
    """Source discontinuities between neighbouring visible clips of the same source.

    ``tolerance_us`` above 0 also reports whether the two clips still play as one shot.
    """
    shown = clips.where("enabled")
    ahead = scan(
        shown, TRACK, ["ord"], ordinal="ord",
        __next_source=following(F.col("source_id")), __next_in=following(F.col("source_in")),
        next_clip_id=following(F.col("clip_id")),
    )
    gap = F.col("__next_in") - F.col("source_out")
    return (
        ahead.where((F.col("__next_source") == F.col("source_id")) & (gap != 0))
        .withColumns({
            "gap_us": gap,
            "cut": F.when(gap > 0, "dropped").otherwise("overlapped"),
            "continuous": F.abs(gap) < tolerance_us,
        })
        .drop("__next_source", "__next_in")
    )


def dropped_regions(clips: DataFrame, sources: DataFrame, keys: tuple[str, ...] = ("timeline_id",), coarse: Column | None = None) -> DataFrame:
    """Source ranges no enabled clip uses, per timeline and source of the timeline.

    ``sources`` lists the pairs to cover: ``keys``, ``source_id`` and ``duration_us``.
    """
    group = [*keys, "source_id"]
    used = clips.where("enabled").select(*group, F.col("source_in").alias("s"), F.col("source_out").alias("e")).dropna(subset=group)
    # A zero-length mark at the source's end turns the tail gap into an ordinary gap.
    marks = sources.select(*group, F.col("duration_us").alias("s"), F.lit(None).cast("bigint").alias("e"))
    every = used.unionByName(marks)
    bucket = coarse if coarse is not None else F.call_function("div", F.col("s"), F.lit(60_000_000))
    # The tail mark sorts last: a used range that starts past the end reports no gap before it.
    tail = F.col("e").isNull().cast("int").alias("tail")
    ordered = every.select("*", tail).withColumn("bucket", F.when(F.col("tail") == 1, F.lit(1 << 60)).otherwise(bucket).cast("bigint"))
    seen = scan(ordered, group, ["tail", "s", "e"], coarse=F.col("bucket"), __reach=max_before(F.col("e")), __unlisted=min_all(1 - F.col("tail")))
    cursor = F.coalesce(F.col("__reach"), zero())
    # Pairs that are to be covered are those with a mark, so no join has to look for them.
    return seen.where((F.col("__unlisted") == 0) & (F.col("s") > cursor)).select(*group, cursor.alias("start"), F.col("s").alias("end"))


def overlapping_clips(clips: DataFrame) -> DataFrame:
    """Enabled video clips that start before the one before them has ended."""
    shown = clips.where("enabled and kind = 'video'")
    before = scan(
        shown, TRACK, ["ord"], ordinal="ord",
        __prev_end=previous(F.col("start") + output_length()), prev_clip_id=previous(F.col("clip_id")),
    )
    return before.where(F.col("start") < F.col("__prev_end")).drop("__prev_end")


def snap_timelines(clips: DataFrame) -> DataFrame:
    """Cut points moved to the output frame grid (``fps_num``/``fps_den``), then reflowed."""
    rate = ("fps_num", "fps_den")
    snapped_in = snap_to_frame("source_in", *rate)
    snapped_out = snap_to_frame("source_out", *rate)
    floor = snap_to_frame("source_in", *rate, mode="ceil") + frame_step(*rate)
    moved = clips.withColumns({
        "source_in": snapped_in,
        "source_out": F.when(snapped_out <= snapped_in, floor).otherwise(snapped_out),
        "start": snap_to_frame("start", *rate),
    })
    return reflow(moved)


def eligible_clips(clips: DataFrame, tracks: DataFrame) -> DataFrame:
    """Enabled clips of unlocked video tracks."""
    open_tracks = tracks.where((F.col("kind") == "video") & ~F.col("locked")).select(*TRACK)
    return clips.where("enabled").join(open_tracks, TRACK, "left_semi")


def audible_clips(clips: DataFrame, tracks: DataFrame) -> DataFrame:
    """Clips that make sound, as schedule entries in seconds."""
    heard = tracks.where((F.col("kind") != "overlay") & ~F.col("muted")).select(*TRACK)
    return (
        clips.where("enabled and not mute and gain > 0")
        .where(output_length() > 0)
        .join(heard, TRACK, "left_semi")
        .select(
            "timeline_id", "track_id", "ord", "clip_id", "source_id",
            (F.col("start") / 1e6).alias("at"),
            (F.col("source_in") / 1e6).alias("offset"),
            ((F.col("source_out") - F.col("source_in")) / 1e6).alias("duration"),
            F.col("speed").alias("rate"),
            "gain",
        )
    )


def trim_headroom(clips: DataFrame, sources: DataFrame, min_us: int = 100_000) -> DataFrame:
    """How far each edge of a clip may move, and the unused footage on either side."""
    known = clips.join(sources.select("source_id", "duration_us"), "source_id")
    floor = F.least(F.lit(min_us).cast("bigint"), F.greatest(F.lit(1).cast("bigint"), F.col("duration_us")))
    return known.withColumns({
        "in_min": zero(),
        "in_max": F.greatest(zero(), F.col("source_out") - floor),
        "out_min": F.least(F.col("source_in") + floor, F.col("duration_us")),
        "out_max": F.col("duration_us"),
        "head_us": F.col("source_in"),
        "tail_us": F.greatest(zero(), F.col("duration_us") - F.col("source_out")),
    })


def decode_plan(clips: DataFrame) -> DataFrame:
    """Source and output range and frame count of every enabled video clip."""
    shown = clips.where("enabled and kind = 'video'").withColumn("out_len", output_length())
    frames = js_round(F.col("out_len") / frame_us("fps_num", "fps_den"))
    return shown.select(
        "timeline_id", "clip_id", "source_id", "source_in", "source_out",
        F.col("start").alias("out_start"),
        (F.col("start") + F.col("out_len")).alias("out_end"),
        F.greatest(F.lit(1).cast("bigint"), frames).alias("frame_count"),
    )


def source_usage(clips: DataFrame) -> DataFrame:
    """Sources a timeline touches, and the furthest point any clip reaches in each."""
    return clips.groupBy("timeline_id", "source_id").agg(
        F.greatest(zero(), F.max("source_out")).alias("reach_us")
    )


def join_position(clips: DataFrame) -> DataFrame:
    """Whether a clip is the first or the last of its timeline's eligible clips."""
    around = scan(
        clips, ["timeline_id"], ["track_id", "ord"], coarse=F.shiftleft("track_id", 44) + F.call_function("div", F.col("ord"), F.lit(1 << 19)),
        __before=previous(F.lit(True)), __after=following(F.lit(True)),
    )
    return around.withColumns({"is_first": F.col("__before").isNull(), "is_last": F.col("__after").isNull()}).drop("__before", "__after")

"""Frame grids on exact rational rates, and time snapped to them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import SECOND_US, ceil_div, col, floor_div, js_round, js_round_ratio


def frame_to_micros(frame, num, den) -> Column:
    return js_round_ratio(col(frame).cast("bigint") * col(den) * SECOND_US, num)


def micros_to_frame(us, num, den) -> Column:
    """The last frame whose rounded start is at or before ``us``."""
    us = col(us).cast("bigint")
    guess = floor_div(us * col(num), col(den).cast("bigint") * SECOND_US)
    return (
        F.when(frame_to_micros(guess + 1, num, den) <= us, guess + 1)
        .when(frame_to_micros(guess, num, den) > us, guess - 1)
        .otherwise(guess)
    )


def snap_to_frame(us, num, den, mode: str = "nearest") -> Column:
    top, bottom = col(us).cast("bigint") * col(num), col(den).cast("bigint") * SECOND_US
    pick = {"floor": floor_div, "ceil": ceil_div, "nearest": js_round_ratio}[mode]
    return frame_to_micros(pick(top, bottom), num, den)


def is_frame_aligned(us, num, den) -> Column:
    return snap_to_frame(us, num, den) == col(us)


def frame_step(num, den) -> Column:
    return js_round_ratio(col(den).cast("bigint") * SECOND_US, num)


def frame_us(num, den) -> Column:
    """Length of one frame, unrounded."""
    return (col(den).cast("bigint") * SECOND_US).cast("double") / col(num).cast("double")


def keyframe_time_at(playhead, clip_start, duration, step_us) -> Column:
    """Clip-relative time of the frame nearest the playhead that lies inside the clip."""
    playhead, clip_start = col(playhead), col(clip_start)
    duration, step = col(duration), col(step_us).cast("double")
    loose = js_round(F.greatest(F.lit(0).cast("bigint"), F.least(duration, playhead - clip_start)))
    first = F.ceil(clip_start / step)
    last = F.floor((clip_start + duration) / step)
    frame = F.least(last, F.greatest(first, js_round(playhead / step)))
    usable = step.isNotNull() & ~F.isnan(step) & (step > 0) & (step < float("inf"))
    return F.when(usable & (last >= first), js_round(frame * step - clip_start)).otherwise(loose)

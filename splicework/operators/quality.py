"""Data-quality rules. Each finding is one row: severity, code, message, path, clip.

Rules of one clip are evaluated together on one enriched row and exploded, so the clip table is
read and shuffled once for all of them, whatever their number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.frames import frame_us, is_frame_aligned
from ..functions.numeric import js_round
from ..functions.ranges import output_length, zero
from .scan import last_before, previous, scan, sum_before
from .timeline import TRACK

#: Fixed value: id prefix of each entity.
ID_PREFIXES = {
    "project": "prj",
    "source": "src",
    "timeline": "tl",
    "track": "trk",
    "clip": "clp",
    "effect": "fx",
    "revision": "rev",
    "event": "evt",
}

ISSUE = ["severity", "code", "message", "path", "clip_id"]


def id_ok(kind: str, value) -> Column:
    value = F.col(value) if isinstance(value, str) else value
    return value.rlike(f"^{ID_PREFIXES[kind]}_[0-9a-zA-Z_-]{{1,64}}$")


def _text(template: str, *values: Column) -> Column:
    """``{}`` placeholders filled from columns."""
    parts = template.split("{}")
    pieces = [F.lit(parts[0])]
    for value, tail in zip(values, parts[1:]):
        pieces += [value.cast("string"), F.lit(tail)]
    return F.concat(*pieces)


def _issue(when: Column, severity: str, code: str, message: Column, path: Column) -> Column:
    fields = F.struct(F.lit(severity).alias("severity"), F.lit(code).alias("code"), message.alias("message"), path.alias("path"))
    return F.when(when, fields)


def indexed(clips: DataFrame) -> DataFrame:
    """Clips with their index in the track and what the rules compare them with."""
    out_len = output_length()
    filled = F.col("source_out") > F.col("source_in")
    used = F.when(F.col("enabled") & filled, out_len).otherwise(zero())
    end = F.when(F.col("enabled"), F.struct((F.col("start") + out_len).alias("end"), F.col("clip_id").alias("id")))
    return scan(
        clips.withColumn("out_len", out_len), TRACK, ["ord"], ordinal="ord",
        clip_index=sum_before(F.lit(1)), __cursor=sum_before(used), __prev=last_before(end),
    )


def clip_issues(clips: DataFrame, sources: DataFrame | None = None, frame_alignment: str | None = None) -> DataFrame:
    """Every rule about single clips. ``frame_alignment`` is off, ``"exact"`` or ``"compat"``.

    ``compat`` divides by the unrounded frame length with a 1e-6 tolerance and so also flags
    correctly snapped times; ``exact`` asks whether the time is on the rounded grid.
    """
    rows = indexed(clips)
    # Only ids used more than once come back from the count, so this join stays small. The first
    # clip of an id in its track decides where all of them are expected.
    seen = F.when(F.col("source_out") > F.col("source_in"), F.col("__cursor"))
    uses = rows.groupBy("timeline_id", "clip_id").agg(
        F.count(F.lit(1)).alias("__n"), F.min(F.struct("track_id", "ord")).alias("__first_use"),
    ).where("__n > 1").drop("__n")
    firsts = rows.join(uses.select("timeline_id", "clip_id"), ["timeline_id", "clip_id"], "left_semi").groupBy(
        "timeline_id", "clip_id", "track_id"
    ).agg(F.min(F.when(seen.isNotNull(), F.struct(F.col("ord"), seen.alias("at")))).alias("__first"))
    rows = rows.join(uses, ["timeline_id", "clip_id"], "left").join(firsts, ["timeline_id", "clip_id", "track_id"], "left")
    expected = F.when(F.col("kind") == "video", F.coalesce(F.col("__first")["at"], seen))
    if sources is not None:
        known = sources.select("source_id", F.col("duration_us").alias("__duration"))
        rows = rows.join(known, "source_id", "left")
    cid, out, size = F.col("clip_id"), F.col("source_out"), F.col("source_in")
    path = _text("tracks[{}].clips[{}]", F.col("track_id"), F.col("clip_index"))
    at = lambda field: F.concat(path, F.lit(f".{field}"))
    # Fixed output: codes and messages of the issues.
    rules = [
        _issue(F.struct("track_id", "ord") > F.col("__first_use"), "error", "duplicate-clip-id",
               _text("Duplicate clip id {}. Ops address clips by id, so this makes edits ambiguous.", cid), path),
        _issue(out <= size, "error", "empty-clip",
               _text("Clip {} has sourceOut ({}) <= sourceIn ({}).", cid, out, size), at("sourceOut")),
        _issue(expected != F.col("start"), "error", "position-drift",
               _text("Clip {} starts at {} but a reflow puts it at {}. Call reflow() after mutating.", cid, F.col("start"), expected),
               at("start")),
        _issue(F.col("enabled") & (F.col("kind") == "video") & (F.col("start") < F.col("__prev")["end"]), "error", "overlap",
               _text("Clips {} and {} overlap on video track {}.", F.col("__prev")["id"], cid, F.col("track_id")),
               _text("tracks[{}].clips", F.col("track_id"))),
    ]
    if sources is not None:
        rules += [
            _issue(F.col("__duration").isNull(), "error", "missing-source",
                   _text("Clip {} references source {}, which is not in the project.", cid, F.col("source_id")), at("sourceId")),
            _issue(out > F.col("__duration"), "error", "out-of-bounds",
                   _text("Clip {} ends at {} but source {} is only {} long.", cid, out, F.col("source_id"), F.col("__duration")), at("sourceOut")),
        ]
    if frame_alignment:
        for field, value in (("sourceIn", size), ("sourceOut", out)):
            if frame_alignment == "compat":
                steps = value / frame_us("fps_num", "fps_den")
                off = F.abs(steps - js_round(steps)) > 1e-6
            else:
                off = ~is_frame_aligned(value, "fps_num", "fps_den")
            rules.append(_issue(off, "warning", "not-frame-aligned",
                                _text(f"Clip {{}} {field} ({{}}) is not on a frame boundary; the renderer will snap it.", cid, value), at(field)))
    found = rows.select("timeline_id", "clip_id", F.explode(F.array_compact(F.array(*rules))).alias("__i"))
    return found.select("timeline_id", *[F.col(f"__i.{n}").alias(n) for n in ISSUE[:4]], "clip_id")


def repeat_ids(rows: DataFrame, key: str, id_col: str, order: list[str]) -> DataFrame:
    """Second and later uses of an id within ``key``."""
    first = rows.groupBy(key, id_col).agg(F.min(F.struct(*order)).alias("__first"), F.count(F.lit(1)).alias("__n")).where("__n > 1")
    return rows.join(first.drop("__n"), [key, id_col]).where(F.struct(*order) > F.col("__first")).drop("__first")


def track_issues(tracks: DataFrame) -> DataFrame:
    """Repeated track ids; ``track_index`` is the place in the document."""
    again = repeat_ids(tracks, "timeline_id", "track_id", ["track_index"])
    return again.select(
        "timeline_id", F.lit("error").alias("severity"), F.lit("duplicate-track-id").alias("code"),
        _text("Duplicate track id {}.", F.col("track_id")).alias("message"),
        _text("tracks[{}]", F.col("track_index")).alias("path"), F.lit(None).cast("string").alias("clip_id"),
    )


def unsorted_keyframes(keys: DataFrame) -> DataFrame:
    """Index of the first key of each effect that lies before its predecessor."""
    back = scan(keys, ["clip_id", "effect_id"], ["key_idx"], ordinal="key_idx", __prev=previous(F.col("t")))
    return back.where("t < __prev").groupBy("clip_id", "effect_id").agg(F.min("key_idx").alias("key_idx"))


def keyframe_issues(keys: DataFrame, clips: DataFrame) -> DataFrame:
    """Keys out of time order, and keys the clip ends before."""
    effect = ["timeline_id", "clip_id", "effect_id", "effect_ord"]
    back = scan(keys, ["clip_id", "effect_id"], ["key_idx"], ordinal="key_idx", __prev=previous(F.col("t")))
    ends = back.groupBy(*effect).agg(
        F.min(F.when(F.col("t") < F.col("__prev"), F.col("key_idx"))).alias("__bad"),
        F.max_by("t", "key_idx").alias("__last"),
    )
    place = indexed(clips).select("timeline_id", "track_id", "clip_id", "clip_index", "out_len")
    rows = ends.join(place, ["timeline_id", "clip_id"])
    path = _text("tracks[{}].clips[{}].effects[{}].keyframes", F.col("track_id"), F.col("clip_index"), F.col("effect_ord"))
    rules = [
        _issue(F.col("__bad").isNotNull(), "error", "unsorted-keyframes",
               _text("Effect {} on clip {} has keyframes out of time order.", F.col("effect_id"), F.col("clip_id")),
               F.concat(path, _text("[{}]", F.col("__bad")))),
        _issue(F.col("__last") > F.col("out_len"), "warning", "keyframe-past-end",
               _text("Effect {} on clip {} has a keyframe at {}, past the clip's {} output length. It will never be reached.",
                     F.col("effect_id"), F.col("clip_id"), F.col("__last"), F.col("out_len")), path),
    ]
    found = rows.select("timeline_id", "clip_id", F.explode(F.array_compact(F.array(*rules))).alias("__i"))
    return found.select("timeline_id", *[F.col(f"__i.{n}").alias(n) for n in ISSUE[:4]], "clip_id")


def project_issues(projects: DataFrame, revisions: DataFrame) -> DataFrame:
    """Heads that are no revision of the project, and late stages without a frozen coarse pass."""
    known = revisions.select(F.col("project_id").alias("__p"), F.col("revision_id").alias("__r"), F.lit(True).alias("__known")).distinct()
    rows = projects.join(known, (F.col("project_id") == F.col("__p")) & (F.col("head_revision_id") == F.col("__r")), "left")
    rules = [
        _issue(F.col("head_revision_id").isNotNull() & F.col("__known").isNull(), "error", "dangling-head",
               _text("headRevisionId {} is not in revisions.", F.col("head_revision_id")), F.lit("headRevisionId")),
        _issue((F.col("stage") != "coarse") & F.col("coarse_snapshot_id").isNull(), "warning", "missing-coarse-snapshot",
               _text("Project is at stage \"{}\" with no coarseSnapshot. The human's coarse pass is the training signal — freeze it at handoff or it is gone.", F.col("stage")),
               F.lit("coarseSnapshot")),
    ]
    found = rows.select(F.col("project_id").alias("timeline_id"), F.explode(F.array_compact(F.array(*rules))).alias("__i"))
    return found.select("timeline_id", *[F.col(f"__i.{n}").alias(n) for n in ISSUE[:4]], F.lit(None).cast("string").alias("clip_id"))


def all_issues(*parts: DataFrame) -> DataFrame:
    first, *rest = parts
    for part in rest:
        first = first.unionByName(part)
    return first


def has_errors(issues: DataFrame) -> DataFrame:
    return issues.groupBy("timeline_id").agg(F.bool_or(F.col("severity") == "error").alias("has_errors"))

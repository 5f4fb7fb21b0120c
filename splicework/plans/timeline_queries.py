"""Registered queries: clips, positions, coverage."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import frames, ranges, timecode
from ..operators import timeline as tl
from . import views as v
from .registry import query
from .views import CLIPS, PROJECTS, RAW_CLIPS, SIZED_CLIPS, SOURCES, sql_round


def placed(spark, d):
    """Reflowed clips without the working columns."""
    return tl.reflow(v.raw_clips(spark, d))


def tracks(spark, d):
    """Three tracks per timeline; locked and muted by rule."""
    ids = v.projects(spark, d).select(F.col("project_id").alias("timeline_id"))
    return ids.select(
        "timeline_id", F.explode(F.array(*[F.lit(i).cast("bigint") for i in range(3)])).alias("track_id")
    ).select(
        "*",
        F.element_at(F.array(F.lit("video"), F.lit("audio"), F.lit("overlay")), F.col("track_id").cast("int") + 1).alias("kind"),
        (F.pmod("timeline_id", F.lit(7)) == 0).alias("locked"),
        (F.pmod(F.col("timeline_id") + F.col("track_id"), F.lit(5)) == 0).alias("muted"),
    )


TRACKS = """tracks AS (
  SELECT o_orderkey AS timeline_id, CAST(track_id AS BIGINT) AS track_id, ['video','audio','overlay'][track_id + 1] AS kind,
    o_orderkey % 7 = 0 AS locked, (o_orderkey + track_id) % 5 = 0 AS muted
  FROM orders, (VALUES (0), (1), (2)) t(track_id))"""

RATED_CLIPS = CLIPS + ",\n" + PROJECTS + """,
rated AS (SELECT c.*, p.fps_num, p.fps_den, p.width, p.height FROM clips c JOIN projects p ON p.project_id = c.timeline_id)"""


def rated(spark, d):
    """Reflowed clips with the output rate and size of their timeline."""
    p = v.projects(spark, d).select(F.col("project_id").alias("timeline_id"), "fps_num", "fps_den", "width", "height")
    return placed(spark, d).join(p, "timeline_id")


@query("reflow_duration", "W1", "P1", "AG1", sql=f"""WITH {CLIPS}
SELECT timeline_id, CAST(coalesce(max(CASE WHEN enabled THEN greatest(0, start + out_len) END), 0) AS BIGINT) AS duration_us,
  count(*) AS clips, CAST(sum(CASE WHEN enabled THEN out_len ELSE 0 END) AS BIGINT) AS enabled_us
FROM clips GROUP BY timeline_id""")
def reflow_duration(spark, d):
    clips = placed(spark, d)
    end = F.col("start") + F.col("out_len")
    return clips.groupBy("timeline_id").agg(
        F.coalesce(F.max(F.when(F.col("enabled"), F.greatest(ranges.zero(), end))), ranges.zero()).alias("duration_us"),
        F.count(F.lit(1)).alias("clips"),
        F.sum(F.when(F.col("enabled"), F.col("out_len")).otherwise(ranges.zero())).alias("enabled_us"),
    )


@query("reflow", "W1", sql=f"WITH {CLIPS} SELECT timeline_id, track_id, ord, clip_id, start, out_len FROM clips")
def reflow(spark, d):
    return placed(spark, d).select("timeline_id", "track_id", "ord", "clip_id", "start", "out_len")


@query("timeline_duration", "AG1", sql=f"""WITH {CLIPS}
SELECT timeline_id, CAST(coalesce(max(CASE WHEN enabled THEN greatest(0, start + out_len) END), 0) AS BIGINT) AS duration_us
FROM clips GROUP BY timeline_id""")
def timeline_duration(spark, d):
    return tl.timeline_duration(placed(spark, d))


@query("with_durations", "P1", sql=f"""WITH {SIZED_CLIPS}
SELECT clip_id, source_len, out_len, start + out_len AS clip_end FROM sized_clips""")
def with_durations(spark, d):
    return tl.with_durations(v.raw_clips(spark, d)).select("clip_id", "source_len", "out_len", "clip_end")


@query("coarse_cuts", "W11", sql=f"""WITH {RAW_CLIPS}, shown AS (
  SELECT *, 0 AS one, CAST(floor(source_id / 200) AS BIGINT) AS shot FROM raw_clips WHERE enabled),
ahead AS (SELECT *, lead(shot) OVER w AS ns, lead(source_in) OVER w AS ni, lead(clip_id) OVER w AS next_clip_id
  FROM shown WINDOW w AS (PARTITION BY timeline_id, track_id ORDER BY ord))
SELECT clip_id, next_clip_id, ni - source_out AS gap_us, CASE WHEN ni - source_out > 0 THEN 'dropped' ELSE 'overlapped' END AS cut,
  abs(ni - source_out) < 3000000 AS continuous
FROM ahead WHERE ns = shot AND ni <> source_out""")
def coarse_cuts(spark, d):
    # Part ranges stand in for recordings, so that neighbours share one often enough.
    clips = v.raw_clips(spark, d).withColumn("source_id", F.call_function("div", F.col("source_id"), F.lit(200)))
    return tl.coarse_cuts(clips, tolerance_us=3_000_000).select("clip_id", "next_clip_id", "gap_us", "cut", "continuous")


@query("dropped_regions", "W10", "U4", sql=f"""WITH {RAW_CLIPS}, {SOURCES},
used AS (SELECT DISTINCT timeline_id, source_id FROM raw_clips),
want AS (SELECT u.timeline_id, u.source_id, s.duration_us FROM used u JOIN sources s USING (source_id)),
marks AS (
  SELECT c.timeline_id, c.source_id, c.source_in AS s, c.source_out AS e, 0 AS tail FROM raw_clips c SEMI JOIN want USING (timeline_id, source_id) WHERE enabled
  UNION ALL SELECT timeline_id, source_id, duration_us, NULL, 1 FROM want),
reach AS (SELECT *, coalesce(max(e) OVER (PARTITION BY timeline_id, source_id ORDER BY tail, s, e NULLS FIRST
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cursor FROM marks)
SELECT timeline_id, source_id, cursor AS start, s AS "end" FROM reach WHERE s > cursor""")
def dropped_regions(spark, d):
    clips = v.raw_clips(spark, d)
    pairs = clips.select("timeline_id", "source_id").distinct()
    want = pairs.join(v.sources(spark, d).select("source_id", "duration_us"), "source_id")
    return tl.dropped_regions(clips, want)


@query("dropped_by_source", "W10", sql=f"""WITH {RAW_CLIPS}, {SOURCES},
marks AS (
  SELECT c.source_id, c.source_in AS s, c.source_out AS e, 0 AS tail FROM raw_clips c SEMI JOIN sources USING (source_id) WHERE enabled
  UNION ALL SELECT source_id, duration_us, NULL, 1 FROM sources),
reach AS (SELECT *, coalesce(max(e) OVER (PARTITION BY source_id ORDER BY tail, s, e NULLS FIRST
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cursor FROM marks)
SELECT source_id, cursor AS start, s AS "end" FROM reach WHERE s > cursor""")
def dropped_by_source(spark, d):
    """What no timeline at all uses of a recording."""
    return tl.dropped_regions(v.raw_clips(spark, d), v.sources(spark, d), keys=())


@query("overlapping_clips", "W12", sql=f"""WITH {SIZED_CLIPS},
o AS (SELECT *, lag(start + out_len) OVER w AS pe, lag(clip_id) OVER w AS prev_clip_id FROM sized_clips WHERE enabled AND kind = 'video'
  WINDOW w AS (PARTITION BY timeline_id, track_id ORDER BY ord))
SELECT clip_id, prev_clip_id, start FROM o WHERE start < pe""")
def overlapping_clips(spark, d):
    return tl.overlapping_clips(v.raw_clips(spark, d)).select("clip_id", "prev_clip_id", "start")


def sql_snap(us: str, mode: str = "near", num: str = "fps_num", den: str = "fps_den") -> str:
    """A time on the frame grid, in integer arithmetic."""
    top, bottom = f"(CAST({us} AS HUGEINT) * {num})", f"(CAST({den} AS HUGEINT) * 1000000)"
    frame = {
        "floor": f"(({top} - ({top} % {bottom})) // {bottom})",
        "ceil": f"(({top} + {bottom} - 1) // {bottom})",
        "near": f"((2 * {top} + {bottom}) // (2 * {bottom}))",
    }[mode]
    return f"CAST((2 * ({frame}) * {den} * 1000000 + {num}) // (2 * {num}) AS BIGINT)"


@query("snap_timelines", "R23", "F3", sql=f"""WITH {RAW_CLIPS}, {PROJECTS},
s AS (SELECT c.*, {sql_snap('source_in')} AS a, {sql_snap('source_out')} AS b, {sql_snap('source_in', 'ceil')} AS up,
    CAST((2 * 1000000 * fps_den + fps_num) // (2 * fps_num) AS BIGINT) AS step, {sql_snap('start')} AS st
  FROM raw_clips c JOIN projects p ON p.project_id = c.timeline_id),
m AS (SELECT *, CASE WHEN b <= a THEN up + step ELSE b END AS b2 FROM s),
l AS (SELECT *, {sql_round('(b2 - a) / speed')} AS out_len FROM m WHERE b2 > a)
SELECT clip_id, a AS source_in, b2 AS source_out, out_len,
  CASE WHEN kind = 'video' THEN CAST(coalesce(sum(CASE WHEN enabled THEN out_len ELSE 0 END) OVER (
    PARTITION BY timeline_id, track_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) ELSE st END AS start
FROM l""")
def snap_timelines(spark, d):
    p = v.projects(spark, d).select(F.col("project_id").alias("timeline_id"), "fps_num", "fps_den")
    return tl.snap_timelines(v.raw_clips(spark, d).join(p, "timeline_id")).select("clip_id", "source_in", "source_out", "out_len", "start")


@query("eligible_clips", "P2", sql=f"""WITH {RAW_CLIPS}, {TRACKS}
SELECT c.clip_id FROM raw_clips c JOIN tracks t USING (timeline_id, track_id) WHERE t.kind = 'video' AND NOT t.locked AND c.enabled""")
def eligible_clips(spark, d):
    return tl.eligible_clips(v.raw_clips(spark, d), tracks(spark, d)).select("clip_id")


@query("audible_clips", "P3", sql=f"""WITH {CLIPS}, {TRACKS}
SELECT c.clip_id, c.start / CAST(1000000 AS DOUBLE) AS at, c.source_in / CAST(1000000 AS DOUBLE) AS "offset",
  (c.source_out - c.source_in) / CAST(1000000 AS DOUBLE) AS duration, c.speed AS rate, c.gain
FROM clips c JOIN tracks t USING (timeline_id, track_id)
WHERE t.kind <> 'overlay' AND NOT t.muted AND c.enabled AND NOT c.mute AND c.gain > 0 AND c.out_len > 0""")
def audible_clips(spark, d):
    return tl.audible_clips(placed(spark, d), tracks(spark, d)).select("clip_id", "at", "offset", "duration", "rate", "gain")


@query("trim_headroom", "P4", sql=f"""WITH {RAW_CLIPS}, {SOURCES}, k AS (
  SELECT c.*, s.duration_us, least(100000, greatest(1, s.duration_us)) AS fl FROM raw_clips c JOIN sources s USING (source_id))
SELECT clip_id, CAST(0 AS BIGINT) AS in_min, greatest(0, source_out - fl) AS in_max, least(source_in + fl, duration_us) AS out_min,
  duration_us AS out_max, source_in AS head_us, greatest(0, duration_us - source_out) AS tail_us FROM k""")
def trim_headroom(spark, d):
    return tl.trim_headroom(v.raw_clips(spark, d), v.sources(spark, d)).select(
        "clip_id", "in_min", "in_max", "out_min", "out_max", "head_us", "tail_us"
    )


@query("decode_plan", "T5", sql=f"""WITH {RATED_CLIPS}
SELECT timeline_id, clip_id, source_id, source_in, source_out, start AS out_start, start + out_len AS out_end,
  greatest(1, {sql_round('out_len / (CAST(fps_den * 1000000 AS DOUBLE) / fps_num)')}) AS frame_count
FROM rated WHERE enabled AND kind = 'video'""")
def decode_plan(spark, d):
    return tl.decode_plan(rated(spark, d))


@query("source_usage", "AG13", sql=f"""WITH {RAW_CLIPS}
SELECT timeline_id, source_id, CAST(greatest(0, max(source_out)) AS BIGINT) AS reach_us FROM raw_clips GROUP BY 1, 2""")
def source_usage(spark, d):
    return tl.source_usage(v.raw_clips(spark, d))


@query("join_position", "W22", sql=f"""WITH {RAW_CLIPS}, {TRACKS}, e AS (
  SELECT c.* FROM raw_clips c JOIN tracks t USING (timeline_id, track_id) WHERE t.kind = 'video' AND NOT t.locked AND c.enabled)
SELECT clip_id, ROW_NUMBER() OVER (PARTITION BY timeline_id ORDER BY track_id, ord) = 1 AS is_first,
  ROW_NUMBER() OVER (PARTITION BY timeline_id ORDER BY track_id DESC, ord DESC) = 1 AS is_last FROM e""")
def join_position(spark, d):
    clips = tl.eligible_clips(v.raw_clips(spark, d), tracks(spark, d))
    return tl.join_position(clips).select("clip_id", "is_first", "is_last")


# --- scalar functions over whole tables ------------------------------------------------------


def sql_tc(us: str, compact: bool = False) -> str:
    """The timecode of a time, as DuckDB text."""
    a = f"abs({us})"
    full = f"printf('%02d:%02d:%02d', {a} // 3600000000, ({a} % 3600000000) // 60000000, ({a} % 60000000) // 1000000)"
    if compact:
        short = f"printf('%d:%02d', ({a} % 3600000000) // 60000000, ({a} % 60000000) // 1000000)"
        full = f"(CASE WHEN {a} // 3600000000 = 0 THEN {short} ELSE {full} END)"
    return f"((CASE WHEN {us} < 0 THEN '-' ELSE '' END) || {full} || printf('.%03d', ({a} % 1000000) // 1000))"


@query("frame_math", "F2", "F3", sql=f"""WITH {RAW_CLIPS}, {PROJECTS}, t AS (
  SELECT clip_id, start + source_in AS us, fps_num, fps_den FROM raw_clips c JOIN projects p ON p.project_id = c.timeline_id),
g AS (SELECT *, CAST((CAST(us AS HUGEINT) * fps_num) // (CAST(fps_den AS HUGEINT) * 1000000) AS BIGINT) AS f FROM t),
h AS (SELECT *, CASE WHEN (2 * (f + 1) * fps_den * 1000000 + fps_num) // (2 * fps_num) <= us THEN f + 1
  WHEN (2 * f * fps_den * 1000000 + fps_num) // (2 * fps_num) > us THEN f - 1 ELSE f END AS frame FROM g)
SELECT clip_id, CAST(frame AS BIGINT) AS frame, CAST((2 * frame * fps_den * 1000000 + fps_num) // (2 * fps_num) AS BIGINT) AS frame_us,
  {sql_snap('us', 'floor')} AS snap_floor, {sql_snap('us', 'ceil')} AS snap_ceil, {sql_snap('us')} AS snap_near,
  {sql_snap('us')} = us AS aligned FROM h""")
def frame_math(spark, d):
    p = v.projects(spark, d).select(F.col("project_id").alias("timeline_id"), "fps_num", "fps_den")
    us, rate = F.col("us"), ("fps_num", "fps_den")
    rows = v.raw_clips(spark, d).withColumn("us", F.col("start") + F.col("source_in")).join(p, "timeline_id")
    frame = frames.micros_to_frame(us, *rate)
    return rows.select(
        "clip_id", frame.alias("frame"), frames.frame_to_micros(frame, *rate).alias("frame_us"),
        frames.snap_to_frame(us, *rate, mode="floor").alias("snap_floor"),
        frames.snap_to_frame(us, *rate, mode="ceil").alias("snap_ceil"),
        frames.snap_to_frame(us, *rate).alias("snap_near"),
        frames.is_frame_aligned(us, *rate).alias("aligned"),
    )


@query("timecodes", "F5", "F6", sql=f"""WITH {RAW_CLIPS}, t AS (SELECT clip_id, (source_in - start) * 97 AS us FROM raw_clips)
SELECT clip_id, {sql_tc('us')} AS tc, {sql_tc('us', True)} AS tc_short,
  (us // abs(us)) * ((abs(us) // 1000) * 1000) AS parsed,
  CAST(floor(CAST(abs(us) AS DOUBLE) / 1000000 + 0.5) AS BIGINT) // 60 || ':' || printf('%02d', CAST(floor(CAST(abs(us) AS DOUBLE) / 1000000 + 0.5) AS BIGINT) % 60) AS length
FROM t WHERE us <> 0""")
def timecodes(spark, d):
    us = F.col("us")
    tc = timecode.format_timecode(us)
    rows = v.raw_clips(spark, d).select("clip_id", ((F.col("source_in") - F.col("start")) * 97).alias("us")).where(us != 0)
    return rows.select(
        "clip_id", tc.alias("tc"), timecode.format_timecode(us, compact=True).alias("tc_short"),
        timecode.parse_timecode(tc).alias("parsed"), timecode.runtime(F.abs(us)).alias("length"),
    )


@query("keyframe_times", "F4", sql=f"""WITH {RATED_CLIPS}, k AS (
  SELECT clip_id, start + (source_id * 37777) % (out_len + 2000000) - 1000000 AS playhead, start, out_len,
    CAST(fps_den * 1000000 AS DOUBLE) / fps_num AS step FROM rated),
f AS (SELECT *, CAST(ceil(start / step) AS BIGINT) AS first, CAST(floor((start + out_len) / step) AS BIGINT) AS last, {sql_round('playhead / step')} AS near FROM k)
SELECT clip_id, CASE WHEN last >= first THEN {sql_round('least(last, greatest(first, near)) * step - start')}
  ELSE greatest(0, least(out_len, playhead - start)) END AS key_us FROM f""")
def keyframe_times(spark, d):
    playhead = F.col("start") + F.pmod(F.col("source_id") * 37777, F.col("out_len") + 2_000_000) - 1_000_000
    step = frames.frame_us("fps_num", "fps_den")
    return rated(spark, d).select("clip_id", frames.keyframe_time_at(playhead, "start", "out_len", step).alias("key_us"))


@query("range_algebra", "F7", sql=f"""WITH {RAW_CLIPS}, {SOURCES}, r AS (
  SELECT c.clip_id, c.source_in AS a0, c.source_out AS a1, s.duration_us // 3 AS b0, s.duration_us AS b1 FROM raw_clips c JOIN sources s USING (source_id))
SELECT clip_id, greatest(0, a1 - a0) AS length, a0 < b1 AND b0 < a1 AS overlap,
  CASE WHEN greatest(a0, b0) < least(a1, b1) THEN greatest(a0, b0) END AS shared_start,
  CASE WHEN greatest(a0, b0) < least(a1, b1) THEN least(a1, b1) END AS shared_end, least(greatest(a1, b0), b1) AS clamped FROM r""")
def range_algebra(spark, d):
    s = v.sources(spark, d).select("source_id", F.call_function("div", F.col("duration_us"), F.lit(3)).alias("b0"), F.col("duration_us").alias("b1"))
    rows = v.raw_clips(spark, d).join(s, "source_id")
    shared = ranges.intersection("source_in", "source_out", "b0", "b1")
    return rows.select(
        "clip_id", ranges.range_length("source_in", "source_out").alias("length"),
        ranges.overlaps("source_in", "source_out", "b0", "b1").alias("overlap"),
        shared["start"].alias("shared_start"), shared["end"].alias("shared_end"),
        ranges.clamp("source_out", "b0", "b1").alias("clamped"),
    )

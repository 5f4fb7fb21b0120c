"""Registered queries: generators and text."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import describe as ds
from ..operators import generators as g
from ..operators import intervals, signals
from ..operators import timeline as tl
from . import views as v
from .registry import query
from .join_queries import kept_onsets, used
from .replay_queries import prepared
from ..operators import replay
from ..operators.review import push_in
from .signal_queries import luma_frames
from .timeline_queries import TRACKS, placed, sql_tc, tracks
from .views import CLIPS, PROJECTS, RAW_CLIPS, SOURCES, sql_round

F15 = "CAST(0.15 AS DOUBLE)"


@query("sample_moments", "G1", sql=f"""WITH {RAW_CLIPS}, i AS (SELECT clip_id, source_in, source_out, source_in + least((source_out - source_in) * {F15}, 250000) AS a, source_out - least((source_out - source_in) * {F15}, 250000) AS b, source_id % 4 + 1 AS n FROM raw_clips)
SELECT clip_id, CAST(0 AS INTEGER) AS moment, CASE WHEN b <= a THEN {sql_round('(source_in + source_out) / CAST(2 AS DOUBLE)')} ELSE {sql_round('a + (b - a) / 3')} END AS "at" FROM i WHERE b <= a OR n <= 1
UNION ALL SELECT clip_id, CAST(k AS INTEGER), {sql_round('a + (b - a) * k / (n - 1)')} FROM i, (SELECT CAST(range AS BIGINT) AS k FROM range(4)) WHERE b > a AND n > 1 AND k < n""")
def sample_moments(spark, d):
    return g.sample_moments(v.raw_clips(spark, d).withColumn("n", F.pmod("source_id", F.lit(4)) + 1), "n")


@query("extraction_schedule", "G2", sql=f"""WITH {SOURCES}, s AS (SELECT source_id, duration_us, greatest(1000000, CAST(ceil(duration_us / CAST(80 AS DOUBLE)) AS BIGINT)) AS step FROM sources) SELECT source_id, unnest(range(0, duration_us, step)) AS "at" FROM s""")
def extraction_schedule(spark, d):
    return g.extraction_schedule(v.sources(spark, d))


@query("bucket_count", "G3", sql=f"""WITH {CLIPS} SELECT clip_id, greatest(1, least({sql_round('ord * 97 / CAST(56 AS DOUBLE)')}, CASE WHEN source_id % 3 > 0 THEN CAST(ceil(out_len / CAST(source_id % 3 * 900000 AS DOUBLE)) AS BIGINT) ELSE {sql_round('ord * 97 / CAST(56 AS DOUBLE)')} END, 40)) AS buckets FROM clips""")
def bucket_count(spark, d):
    return placed(spark, d).select("clip_id", g.bucket_count(F.col("ord") * 97, F.col("out_len"), F.pmod("source_id", F.lit(3)) * 900_000).alias("buckets"))


LADDER = "2, 5, 10, 15, 30, 60, 120, 300, 600, 1800"


@query("time_buckets", "G4", sql=f"""WITH {PROJECTS}, v AS (SELECT project_id AS view_id, (project_id * 7919) % 9000000 AS f, (project_id * 7919) % 9000000 + 2500000 AS t, CAST(8000000 AS BIGINT) AS tot, CAST(20 + project_id % 2000 AS DOUBLE) AS pps, fps_num / CAST(fps_den AS DOUBLE) AS fps FROM projects),
w AS (SELECT *, {sql_round('fps')} AS nom, 1000000 / fps AS fus FROM v), x AS (SELECT *, fus / 1000000 * pps AS px FROM w),
y AS (SELECT *, coalesce(list_filter(list_concat(list_filter(range(1, nom + 1), lambda k: nom % k = 0), list_transform([{LADDER}], lambda s: s * nom)), lambda k: px * k >= CASE WHEN k < nom THEN 150 ELSE 64 END)[1], nom * 1800) AS step FROM x),
z AS (SELECT *, CASE WHEN step > 1 AND px >= 9 THEN 1 ELSE step END AS grid, greatest(0, CAST(floor(f / fus) AS BIGINT)) AS a, CAST(floor(least(t, tot) / fus + 1e-6) AS BIGINT) AS b FROM y),
k AS (SELECT *, unnest(range(a - a % grid, b + 1, grid)) AS frame FROM z), u AS (SELECT *, {sql_round('frame * fus')} AS us FROM k)
SELECT view_id, frame, us, step AS step_frames, CASE WHEN frame % step = 0 THEN CASE WHEN frame % nom = 0 THEN regexp_replace({sql_tc('us', True)}, '\\.\\d+$', '') ELSE (frame % nom) || 'f' END END AS label FROM u WHERE us <= tot""")
def time_buckets(spark, d):
    p = v.projects(spark, d)
    begin = F.pmod(F.col("project_id") * 7919, F.lit(9_000_000))
    return g.time_buckets(p.select(
        F.col("project_id").alias("view_id"), begin.alias("from_us"), (begin + 2_500_000).alias("to_us"), F.lit(8_000_000).cast("bigint").alias("total_us"),
        (F.pmod("project_id", F.lit(2000)) + 20).cast("double").alias("px_per_second"), "fps_num", "fps_den",
    ))


@query("allocate_frame_budget", "T4", sql=f"""WITH {CLIPS}, s AS (SELECT c.*, w FROM clips c, (VALUES (1), (2), (3), (4)) t(w) WHERE enabled AND w <= 1 + CAST(out_len > 2000000 AS INT) + CAST(out_len > 6000000 AS INT) + CAST(out_len > 20000000 AS INT)),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY timeline_id ORDER BY w, out_len DESC, start, ord) AS k FROM s) SELECT timeline_id, clip_id, count(*) AS frames FROM r WHERE k <= 8 GROUP BY 1, 2""")
def allocate_frame_budget(spark, d):
    return g.allocate_frame_budget(placed(spark, d), 8)


@query("first_reasons", "T6")
def first_reasons(spark, d):
    clips, ops = prepared(spark, d, keys=False)
    return g.first_reasons(replay.replay_by_timeline(clips, ops).outcomes)


@query("push_in", "G6", sql=f"WITH {CLIPS} SELECT clip_id, 'fx_push_' || substr(clip_id, 5, 8) AS effect_id, CAST(2 AS INTEGER) AS keys, out_len AS last_t, CAST(1.12 AS DOUBLE) AS last_scale FROM clips")
def push_in_effects(spark, d):
    fx = push_in(F.concat(F.lit("fx_push_"), F.substring("clip_id", 5, 8)), F.col("out_len"))
    rows = placed(spark, d).select("clip_id", fx.alias("fx"))
    return rows.select("clip_id", "fx.effect_id", F.size("fx.keys").alias("keys"), F.get("fx.keys", F.lit(1))["t"].alias("last_t"), F.get("fx.keys", F.lit(1))["scale"].alias("last_scale"))


def timelines(spark, d):
    return v.projects(spark, d).select(F.col("project_id").alias("timeline_id"), "width", "height", "fps_num", "fps_den")


N = "CASE WHEN {0} = floor({0}) THEN CAST(CAST({0} AS BIGINT) AS VARCHAR) ELSE CAST({0} AS VARCHAR) END".format
# Recordings stand in groups of 200 parts, so that neighbours share one often enough.
LINES = CLIPS + f""", {PROJECTS}, {TRACKS},
shot AS (SELECT * REPLACE (source_id // 200 AS source_id) FROM clips WHERE enabled),
d0 AS (SELECT p.project_id AS timeline_id, any_value(width) AS width, any_value(height) AS height, any_value(fps_num) AS fps_num, any_value(fps_den) AS fps_den, CAST(coalesce(max(CASE WHEN enabled THEN start + out_len END), 0) AS BIGINT) AS dur FROM projects p LEFT JOIN clips c ON c.timeline_id = p.project_id GROUP BY 1),
nc AS (SELECT timeline_id, track_id, count(*) AS n FROM shot GROUP BY 1, 2),
tl AS (SELECT t.*, coalesce(n, 0) AS n FROM tracks t LEFT JOIN nc USING (timeline_id, track_id)),
pl AS (SELECT *, ROW_NUMBER() OVER w - 1 AS no, lead(source_id) OVER w AS ns, lead(source_in) OVER w AS ni FROM shot WINDOW w AS (PARTITION BY timeline_id, track_id ORDER BY ord)),
lines AS (
  SELECT timeline_id, -1 AS track_id, -1 AS no, 0 AS part, 'Timeline ' || timeline_id || ' — ' || {sql_tc('dur')} || ' (' || dur || 'us), ' || width || 'x' || height || ' @ ' || printf('%.3f', fps_num / CAST(fps_den AS DOUBLE)) || 'fps' AS line FROM d0
  UNION ALL SELECT timeline_id, track_id, -1, 0, '' FROM tl
  UNION ALL SELECT timeline_id, track_id, -1, 1, 'Track ' || track_id || ' (' || kind || CASE WHEN locked THEN ', locked' ELSE '' END || ') — ' || n || ' clips' FROM tl
  UNION ALL SELECT timeline_id, track_id, -1, 2, '  (empty)' FROM tl WHERE n = 0
  UNION ALL SELECT timeline_id, track_id, no, 0, '  ' || concat_ws('  ', printf('%2d.', no), clip_id, 'timeline ' || {sql_tc('start')} || '–' || {sql_tc('(start + out_len)')}, '(' || start || '–' || (start + out_len) || 'us)',
    'source ' || source_id || ' ' || {sql_tc('source_in')} || '–' || {sql_tc('source_out')}, '(' || source_in || '–' || source_out || 'us)', 'len ' || {sql_tc('out_len')}, CASE WHEN speed <> 1 THEN 'speed ' || {N('speed')} || 'x' END, CASE WHEN mute THEN 'muted' END, CASE WHEN coalesce(label, '') <> '' THEN '"' || label || '"' END) FROM pl
  UNION ALL SELECT timeline_id, track_id, no, 1, '      ^ coarse cut: ' || CASE WHEN ni > source_out THEN 'dropped ' ELSE 'overlapped ' END || {sql_tc('abs(ni - source_out)')} || ' of source here' FROM pl WHERE ns = source_id AND ni <> source_out),
txt AS (SELECT timeline_id, string_agg(line, chr(10) ORDER BY track_id, no, part) AS text FROM lines GROUP BY 1)"""


def shots(spark, d):
    return placed(spark, d).withColumn("source_id", F.call_function("div", F.col("source_id"), F.lit(200)))


@query("describe_timelines", "L4", sql=f"WITH {LINES} SELECT timeline_id, text FROM txt")
def describe_timelines(spark, d):
    return ds.describe_timelines(timelines(spark, d), tracks(spark, d), shots(spark, d))


def measured(spark, d):
    clips, lv = used(spark, d), v.levels(spark, d)
    return ds.describe_signals(
        clips, intervals.clip_levels(clips, signals.source_levels(lv), lv), intervals.regions_in_clips(signals.quiet_runs(lv), clips),
        intervals.onsets_in_clips(kept_onsets(spark, d), clips), intervals.regions_in_clips(signals.still_runs(signals.frame_motion(luma_frames(spark, d))), clips),
    )


@query("describe_signals", "L5")
def describe_signals(spark, d):
    return measured(spark, d)


def texts(spark, d):
    clips = shots(spark, d)
    return ds.request_texts(v.projects(spark, d), tl.timeline_duration(clips), ds.source_inventory(clips, v.sources(spark, d)), ds.describe_timelines(timelines(spark, d), tracks(spark, d), clips), measured(spark, d))


@query("request_texts", "L6")
def request_texts(spark, d):
    return texts(spark, d)


@query("request_blocks", "L7")
def request_blocks(spark, d):
    clips = shots(spark, d)
    plain = ds.request_texts(v.projects(spark, d), tl.timeline_duration(clips), ds.source_inventory(clips, v.sources(spark, d)), ds.describe_timelines(timelines(spark, d), tracks(spark, d), clips),
                             clips.select("timeline_id", F.lit(None).cast("string").alias("text")).where(F.lit(False)))
    frames = g.sample_moments(clips.where("enabled"), 2).withColumn("ref", F.concat_ws("@", "clip_id", F.col("at").cast("string")))
    return ds.request_blocks(plain, clips, frames)

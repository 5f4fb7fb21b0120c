"""Registered queries: data-quality rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import quality as q
from . import views as v
from .registry import query
from .views import PROJECTS, RAW_CLIPS, SOURCES, key_sql, sql_round

# Some clips reuse the id of the first clip, and some recordings are unknown.
BAD = RAW_CLIPS + f""", {SOURCES}, {PROJECTS},
bad AS (SELECT timeline_id, track_id, kind, ord,
    'clp_' || timeline_id || '_' || (CASE WHEN source_id % 20 = 0 THEN 0 ELSE ord END) AS clip_id,
    CASE WHEN source_id % 31 = 0 THEN -source_id ELSE source_id END AS source_id,
    source_in, source_out, start, speed, enabled, fps_num, fps_den,
    {sql_round('greatest(0, source_out - source_in) / speed')} AS out_len
  FROM raw_clips JOIN projects p ON p.project_id = timeline_id),
idx AS (SELECT *, ROW_NUMBER() OVER w - 1 AS clip_index,
    CAST(coalesce(sum(CASE WHEN enabled AND source_out > source_in THEN out_len ELSE 0 END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS cursor,
    last_value(CASE WHEN enabled THEN start + out_len END IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_end,
    last_value(CASE WHEN enabled THEN clip_id END IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_id
  FROM bad WINDOW w AS (PARTITION BY timeline_id, track_id ORDER BY ord)),
chk AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY timeline_id, clip_id ORDER BY track_id, ord) - 1 AS uses,
    CASE WHEN kind = 'video' THEN coalesce(first_value(CASE WHEN source_out > source_in THEN cursor END IGNORE NULLS) OVER (
      PARTITION BY timeline_id, clip_id, track_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING),
      CASE WHEN source_out > source_in THEN cursor END) END AS expected,
    'tracks[' || track_id || '].clips[' || clip_index || ']' AS path FROM idx)"""


def bad_clips(spark, d):
    clips = v.raw_clips(spark, d)
    p = v.projects(spark, d).select(F.col("project_id").alias("timeline_id"), "fps_num", "fps_den")
    rule = F.when(F.pmod("source_id", F.lit(20)) == 0, F.lit(0)).otherwise(F.col("ord"))
    return clips.withColumn("clip_id", F.concat_ws("_", F.lit("clp"), F.col("timeline_id").cast("string"), rule.cast("string"))).withColumn(
        "source_id", F.when(F.pmod("source_id", F.lit(31)) == 0, -F.col("source_id")).otherwise(F.col("source_id"))
    ).join(p, "timeline_id")


CLIP_RULES = """
SELECT timeline_id, 'error' AS severity, 'duplicate-clip-id' AS code, 'Duplicate clip id ' || clip_id || '. Ops address clips by id, so this makes edits ambiguous.' AS message, path, clip_id FROM chk WHERE uses > 0
UNION ALL SELECT timeline_id, 'error', 'empty-clip', 'Clip ' || clip_id || ' has sourceOut (' || source_out || ') <= sourceIn (' || source_in || ').', path || '.sourceOut', clip_id FROM chk WHERE source_out <= source_in
UNION ALL SELECT timeline_id, 'error', 'missing-source', 'Clip ' || clip_id || ' references source ' || source_id || ', which is not in the project.', path || '.sourceId', clip_id FROM chk c ANTI JOIN sources s ON s.source_id = c.source_id
UNION ALL SELECT c.timeline_id, 'error', 'out-of-bounds', 'Clip ' || clip_id || ' ends at ' || source_out || ' but source ' || c.source_id || ' is only ' || duration_us || ' long.', path || '.sourceOut', clip_id FROM chk c JOIN sources s ON s.source_id = c.source_id WHERE source_out > duration_us
UNION ALL SELECT timeline_id, 'error', 'position-drift', 'Clip ' || clip_id || ' starts at ' || start || ' but a reflow puts it at ' || expected || '. Call reflow() after mutating.', path || '.start', clip_id FROM chk WHERE expected <> start
UNION ALL SELECT timeline_id, 'error', 'overlap', 'Clips ' || prev_id || ' and ' || clip_id || ' overlap on video track ' || track_id || '.', 'tracks[' || track_id || '].clips', clip_id FROM chk WHERE enabled AND kind = 'video' AND start < prev_end"""


def _aligned(field: str, column: str) -> str:
    step = "(CAST(fps_den * 1000000 AS DOUBLE) / fps_num)"
    return f"""
UNION ALL SELECT timeline_id, 'warning', 'not-frame-aligned', 'Clip ' || clip_id || ' {field} (' || {column} || ') is not on a frame boundary; the renderer will snap it.', path || '.{field}', clip_id
FROM chk WHERE abs({column} / {step} - floor({column} / {step} + 0.5)) > 1e-6"""


@query("clip_issues", "Q-2", "Q-3", "Q-4", "Q-5", "Q-6", "Q-10", "J1", "W12", "W13", sql=f"WITH {BAD} {CLIP_RULES}")
def clip_issues(spark, d):
    return q.clip_issues(bad_clips(spark, d), v.sources(spark, d))


@query("frame_alignment_issues", "Q-9", sql=f"WITH {BAD} {CLIP_RULES}{_aligned('sourceIn', 'source_in')}{_aligned('sourceOut', 'source_out')}")
def frame_alignment_issues(spark, d):
    return q.clip_issues(bad_clips(spark, d), v.sources(spark, d), frame_alignment="compat")


KEY_RULES = """
SELECT k.timeline_id, 'error' AS severity, 'unsorted-keyframes' AS code, 'Effect ' || effect_id || ' on clip ' || clip_id || ' has keyframes out of time order.' AS message,
  path || '.effects[' || effect_ord || '].keyframes[' || bad || ']' AS path, clip_id FROM ke k WHERE bad IS NOT NULL
UNION ALL SELECT timeline_id, 'warning', 'keyframe-past-end', 'Effect ' || effect_id || ' on clip ' || clip_id || ' has a keyframe at ' || last_t || ', past the clip''s ' || out_len || ' output length. It will never be reached.',
  path || '.effects[' || effect_ord || '].keyframes', clip_id FROM ke WHERE last_t > out_len"""
KE = key_sql("raw_clips") + f""",
kp AS (SELECT *, lag(t) OVER (PARTITION BY effect_id ORDER BY key_idx) AS pt FROM keyframes),
rc AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY timeline_id, track_id ORDER BY ord) - 1 AS clip_index, {sql_round('greatest(0, source_out - source_in) / speed')} AS out_len FROM raw_clips),
ke AS (SELECT k.timeline_id, k.clip_id, effect_id, effect_ord, 'tracks[' || any_value(c.track_id) || '].clips[' || any_value(c.clip_index) || ']' AS path, any_value(c.out_len) AS out_len,
    min(CASE WHEN t < pt THEN key_idx END) AS bad, max_by(t, key_idx) AS last_t
  FROM kp k JOIN rc c ON c.clip_id = k.clip_id GROUP BY ALL)"""


@query("keyframe_issues", "Q-7", "Q-8", "W14", sql=f"WITH {RAW_CLIPS}, {KE} {KEY_RULES}")
def keyframe_issues(spark, d):
    return q.keyframe_issues(v.keyframes(spark, d), v.raw_clips(spark, d))


@query("unsorted_keyframes", "W14", sql=f"WITH {RAW_CLIPS}, {KE} SELECT clip_id, effect_id, bad AS key_idx FROM ke WHERE bad IS NOT NULL")
def unsorted_keyframes(spark, d):
    return q.unsorted_keyframes(v.keyframes(spark, d))


REVISIONS = """revs AS (SELECT o_orderkey AS project_id, o_custkey AS revision_id FROM orders WHERE o_orderkey % 10 <> 3)"""
PROJECT_RULES = """
SELECT project_id AS timeline_id, 'error' AS severity, 'dangling-head' AS code, 'headRevisionId ' || head_revision_id || ' is not in revisions.' AS message, 'headRevisionId' AS path, CAST(NULL AS VARCHAR) AS clip_id
FROM projects p ANTI JOIN revs r ON r.project_id = p.project_id AND r.revision_id = p.head_revision_id WHERE head_revision_id IS NOT NULL
UNION ALL SELECT project_id, 'warning', 'missing-coarse-snapshot', 'Project is at stage "' || stage || '" with no coarseSnapshot. The human''s coarse pass is the training signal — freeze it at handoff or it is gone.', 'coarseSnapshot', NULL
FROM projects WHERE stage <> 'coarse' AND coarse_snapshot_id IS NULL"""


def revisions(spark, d):
    return v.table(spark, d, "orders").where(F.pmod("o_orderkey", F.lit(10)) != 3).select(
        F.col("o_orderkey").alias("project_id"), F.col("o_custkey").alias("revision_id")
    )


@query("project_issues", "Q-11", "Q-12", sql=f"WITH {PROJECTS}, {REVISIONS} {PROJECT_RULES}")
def project_issues(spark, d):
    return q.project_issues(v.projects(spark, d), revisions(spark, d))


# Tracks in document order; every fourth timeline names its third track like its first.
TRACK_RULES = """
SELECT timeline_id, 'error' AS severity, 'duplicate-track-id' AS code, 'Duplicate track id ' || track_id || '.' AS message, 'tracks[' || track_index || ']' AS path, CAST(NULL AS VARCHAR) AS clip_id
FROM (SELECT o_orderkey AS timeline_id, i AS track_index, CASE WHEN i = 2 AND o_orderkey % 4 = 0 THEN 0 ELSE i END AS track_id,
  ROW_NUMBER() OVER (PARTITION BY o_orderkey, CASE WHEN i = 2 AND o_orderkey % 4 = 0 THEN 0 ELSE i END ORDER BY i) AS n FROM orders, (VALUES (0), (1), (2)) t(i)) WHERE n > 1"""


def listed_tracks(spark, d):
    ids = v.table(spark, d, "orders").select(F.col("o_orderkey").alias("timeline_id"))
    rows = ids.withColumn("track_index", F.explode(F.array(*[F.lit(i).cast("bigint") for i in range(3)])))
    same = (F.col("track_index") == 2) & (F.pmod("timeline_id", F.lit(4)) == 0)
    return rows.withColumn("track_id", F.when(same, 0).otherwise(F.col("track_index")))


@query("track_issues", "Q-1", "W13", sql=TRACK_RULES)
def track_issues(spark, d):
    return q.track_issues(listed_tracks(spark, d))


ALL = f"WITH {BAD}, {KE}, {REVISIONS}, issues AS ({CLIP_RULES} UNION ALL ({KEY_RULES}) UNION ALL ({PROJECT_RULES}) UNION ALL ({TRACK_RULES}))"


def everything(spark, d):
    return q.all_issues(
        q.clip_issues(bad_clips(spark, d), v.sources(spark, d)),
        q.keyframe_issues(v.keyframes(spark, d), v.raw_clips(spark, d)),
        q.project_issues(v.projects(spark, d), revisions(spark, d)),
        q.track_issues(listed_tracks(spark, d)),
    )


@query("all_issues", "U1", sql=f"{ALL} SELECT severity, code, count(*) AS n, count(DISTINCT timeline_id) AS timelines FROM issues GROUP BY 1, 2")
def all_issues(spark, d):
    return everything(spark, d).groupBy("severity", "code").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("timeline_id").alias("timelines")
    )


@query("has_errors", "AG16", sql=f"{ALL} SELECT timeline_id, bool_or(severity = 'error') AS has_errors FROM issues GROUP BY 1")
def has_errors(spark, d):
    return q.has_errors(everything(spark, d))


@query("id_shapes", "F16", "Q-13", sql=f"""WITH {RAW_CLIPS} SELECT clip_id, regexp_matches(clip_id, '^clp_[0-9a-zA-Z_-]{{1,64}}$') AS clip_ok,
  coalesce(regexp_matches(label, '^trk_[0-9a-zA-Z_-]{{1,64}}$'), false) AS label_is_track FROM raw_clips""")
def id_shapes(spark, d):
    return v.raw_clips(spark, d).select(
        "clip_id", q.id_ok("clip", "clip_id").alias("clip_ok"), F.coalesce(q.id_ok("track", "label"), F.lit(False)).alias("label_is_track")
    )

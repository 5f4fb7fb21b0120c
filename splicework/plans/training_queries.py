"""Registered queries: training rows from edited projects."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import intervals, signals, training
from . import views as v
from .join_queries import USED
from .registry import query
from .signal_queries import HOP, MEDIANS, QUIET
from .timeline_queries import placed
from .views import CLIPS, EVENTS, LEVELS, OPS, PROJECTS, SOURCES

SPANS = """pairs AS (SELECT DISTINCT c.timeline_id, c.source_id, duration_us FROM clips c JOIN sources s USING (source_id)),
edge AS (SELECT p.timeline_id, p.source_id, p.duration_us, least(greatest(c.source_in, 0), p.duration_us) AS t, 1 AS d FROM pairs p JOIN clips c USING (timeline_id, source_id) WHERE c.enabled
  UNION ALL SELECT p.timeline_id, p.source_id, p.duration_us, least(greatest(c.source_out, 0), p.duration_us), -1 FROM pairs p JOIN clips c USING (timeline_id, source_id) WHERE c.enabled
  UNION ALL SELECT *, 0, 0 FROM pairs UNION ALL SELECT *, duration_us, 0 FROM pairs),
sums AS (SELECT timeline_id, source_id, duration_us, t, sum(d) AS d FROM edge GROUP BY ALL),
swept AS (SELECT *, sum(d) OVER w > 0 AS keep, lead(t) OVER w AS nx FROM sums WINDOW w AS (PARTITION BY timeline_id, source_id ORDER BY t)),
turns AS (SELECT *, keep IS DISTINCT FROM lag(keep) OVER (PARTITION BY timeline_id, source_id ORDER BY t) AS fresh FROM swept WHERE t < duration_us),
runs AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY timeline_id, source_id ORDER BY t) AS run FROM turns),
spans AS (SELECT timeline_id, source_id, keep, CAST(min(t) AS BIGINT) AS start, CAST(max(nx) AS BIGINT) AS "end" FROM runs GROUP BY timeline_id, source_id, run, keep)"""


def sized_sources(spark, d):
    sources = v.sources(spark, d).select("source_id", "duration_us")
    return placed(spark, d).select("timeline_id", "source_id").distinct().join(sources, "source_id")


@query("keep_drop_labels", "C1", "W10", sql=f"""WITH {CLIPS}, {SOURCES}, {LEVELS}, {QUIET}, {SPANS},
win AS (SELECT s.*, m.median_db, start // {HOP} AS h0, ("end" + {HOP} - 1) // {HOP} - 1 AS h1 FROM spans s LEFT JOIN med m USING (source_id)),
ranked AS (SELECT w.timeline_id, w.source_id, w.start, db, ROW_NUMBER() OVER (PARTITION BY w.timeline_id, w.source_id, w.start ORDER BY db) - 1 AS k, count(*) OVER (PARTITION BY w.timeline_id, w.source_id, w.start) AS n
  FROM win w JOIN levels l ON l.source_id = w.source_id AND l.hop BETWEEN h0 AND h1),
heard AS (SELECT timeline_id, source_id, start, max(db) AS peak_db, max(CASE WHEN k = least(n - 1, n // 2) THEN db END) AS typical_db FROM ranked GROUP BY ALL),
calm AS (SELECT s.timeline_id, s.source_id, s.start, sum(least(s."end", q."end") - greatest(s.start, q.start)) AS quiet_us FROM spans s JOIN quiet q ON q.source_id = s.source_id AND q.start < s."end" AND q."end" > s.start GROUP BY ALL)
SELECT w.timeline_id, w.source_id, w.keep, w.start, w."end", peak_db, typical_db, median_db AS source_median_db, CAST(coalesce(quiet_us, 0) AS BIGINT) AS quiet_us
FROM win w LEFT JOIN heard USING (timeline_id, source_id, start) LEFT JOIN calm USING (timeline_id, source_id, start)""")
def keep_drop_labels(spark, d):
    levels = v.levels(spark, d)
    return training.keep_drop_labels(placed(spark, d), sized_sources(spark, d), levels, signals.source_levels(levels), signals.quiet_runs(levels))


PASSES = """passes AS (SELECT project_id AS timeline_id, CASE WHEN project_id % 7 = 0 THEN 'local-heuristics' ELSE 'm' || (project_id % 3) END AS model FROM projects)"""
EXAMPLES = f"""{USED}, {LEVELS}, {MEDIANS}, {OPS}, {PROJECTS}, {PASSES},
w AS (SELECT u.timeline_id, u.clip_id, source_in // {HOP} AS h0, (source_out + {HOP} - 1) // {HOP} - 1 AS h1, median_db, u.source_id FROM used u JOIN med USING (source_id)),
rk AS (SELECT w.timeline_id, w.clip_id, db, ROW_NUMBER() OVER (PARTITION BY w.timeline_id, w.clip_id ORDER BY db) - 1 AS k, count(*) OVER (PARTITION BY w.timeline_id, w.clip_id) AS n FROM w JOIN levels l ON l.source_id = w.source_id AND l.hop BETWEEN h0 AND h1),
hd AS (SELECT timeline_id, clip_id, max(db) AS peak_db, max(CASE WHEN k = least(n - 1, n // 2) THEN db END) AS typical_db FROM rk GROUP BY ALL),
ex AS (SELECT o.timeline_id, o.op_idx, o.op, o.clip_id, o.rationale, coalesce(o.accepted, false) AS accepted, p.model, c.source_id, c.start, c.out_len, c.speed, c.enabled, hd.peak_db, hd.typical_db, w.median_db AS source_median_db
  FROM ops o LEFT JOIN passes p USING (timeline_id) LEFT JOIN clips c ON c.timeline_id = o.timeline_id AND c.clip_id = o.clip_id
  LEFT JOIN w ON w.timeline_id = o.timeline_id AND w.clip_id = o.clip_id LEFT JOIN hd ON hd.timeline_id = o.timeline_id AND hd.clip_id = o.clip_id)"""


def passes(spark, d):
    key = F.col("project_id")
    model = F.when(F.pmod(key, F.lit(7)) == 0, "local-heuristics").otherwise(F.concat(F.lit("m"), F.pmod(key, F.lit(3)).cast("string")))
    return v.projects(spark, d).select(key.alias("timeline_id"), model.alias("model"))


def examples(spark, d):
    clips, levels = placed(spark, d), v.levels(spark, d)
    return training.op_verdict_examples(v.ops(spark, d), clips, intervals.clip_levels(clips, signals.source_levels(levels), levels), passes(spark, d))


@query("op_verdict_examples", "C2", sql=f"WITH {EXAMPLES} SELECT timeline_id, op_idx, op, clip_id, rationale, accepted, model, source_id, start, out_len, speed, enabled, peak_db, typical_db, source_median_db FROM ex")
def op_verdict_examples(spark, d):
    return examples(spark, d)


@query("acceptance_rates", "C4", sql=f"""WITH {EXAMPLES} SELECT model, op, count(*) AS ops, count(*) FILTER (accepted) AS accepted, CAST(grouping_id(model, op) AS INTEGER) AS level, count(*) FILTER (accepted) / CAST(count(*) AS DOUBLE) AS share
FROM ex GROUP BY ROLLUP (model, op)""")
def acceptance_rates(spark, d):
    return training.acceptance_rates(examples(spark, d))


# The playhead in steps of a quarter of the values, so that it often stays where it was; hours stand for seconds.
TRAIL = f"""{EVENTS}, tr AS (SELECT project_id, seq, at_us, CASE WHEN k % 9 <> 0 THEN playhead // 100000000 END AS playhead, type = 'llm.verdict' AS edit FROM ev)"""


@query("attention_dwell", "C3", sql=f"""WITH {TRAIL},
h AS (SELECT *, lag(playhead) OVER w AS was, lead(at_us) OVER w AS nx FROM tr WINDOW w AS (PARTITION BY project_id ORDER BY at_us, seq)),
m AS (SELECT *, sum((playhead IS NOT NULL AND playhead IS DISTINCT FROM was)::INT) OVER (PARTITION BY project_id ORDER BY at_us, seq) AS stay, coalesce(nx - at_us, 0) AS gap,
  min(CASE WHEN edit THEN struct_pack(a := at_us, s := seq) END) OVER (PARTITION BY project_id ORDER BY at_us, seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS goal FROM h),
r AS (SELECT *, sum(gap) OVER (PARTITION BY project_id, stay) AS rest FROM m),
s AS (SELECT project_id, goal.s AS seq, sum(gap) AS dwell FROM r WHERE rest >= 18000000000 AND goal IS NOT NULL GROUP BY 1, 2)
SELECT t.project_id, t.seq, CAST(coalesce(dwell, 0) AS BIGINT) AS dwell_us FROM tr t LEFT JOIN s USING (project_id, seq) WHERE edit""")
def attention_dwell(spark, d):
    ev = v.events(spark, d)
    place = F.when(F.pmod("k", F.lit(9)) != 0, F.call_function("div", F.col("playhead"), F.lit(100_000_000)))
    return training.attention_dwell(ev.select("project_id", "seq", "at_us", place.alias("playhead"), (F.col("type") == "llm.verdict").alias("edit")), 18_000_000_000)


def sql_lane(s: str, salt: str) -> str:
    return f"list_reduce(list_prepend(2166136261::BIGINT, list_transform(range(1, length({s}) + 1), lambda i: unicode(substr({s}, i, 1)) + {salt})), lambda h, c: (xor(h, c) * 16777619) & 4294967295)"



@query("steer_groups", "C5", "F10", sql=f"""WITH {PROJECTS}, p AS (SELECT project_id, trim(coalesce(brief, '')) AS b, target_us, stage = 'refined' AS accepted FROM projects),
g AS (SELECT b, target_us, count(*) AS passes, count(DISTINCT project_id) AS projects, count(*) FILTER (accepted) AS accepted FROM p GROUP BY 1, 2),
d AS (SELECT b, {sql_lane('b', '0')} AS high, {sql_lane('b', '(i - 1)')} AS low FROM (SELECT DISTINCT b FROM g))
SELECT lpad(printf('%x', high), 8, '0') || lpad(printf('%x', low), 8, '0') AS brief_digest, target_us, passes, projects, accepted FROM g JOIN d USING (b)""")
def steer_groups(spark, d):
    rows = v.projects(spark, d).select("project_id", "brief", "target_us", (F.col("stage") == "refined").alias("accepted"))
    return training.steer_groups(rows)

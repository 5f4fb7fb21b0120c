"""Registered queries: logs, documents, timing rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import session
from ..functions.numeric import quotient
from ..sources import eventlog, projects
from ..streaming import timing
from . import views as v
from .registry import query
from .timeline_queries import tracks
from .views import EVENTS, KEYFRAMES, PROJECTS, RAW_CLIPS, SOURCES

# Every 97th line is cut short, every 89th names an unknown type.
LOGGED = """logged AS (SELECT event_id, user_id, CASE WHEN event_id % 97 = 0 THEN 'cut' WHEN event_id % 89 = 0 THEN 'type' ELSE 'ok' END AS state, event_type FROM events)"""


def log_lines(spark, d):
    e = v.table(spark, d, "events")
    kind = F.when(F.pmod("event_id", F.lit(89)) == 0, "no.such").when(F.col("event_type") == "view", "playback.scrub").when(F.col("event_type") == "click", "playback.seek").otherwise("clip.trim")
    rows = e.select(
        F.concat(F.lit("evt_"), F.col("event_id").cast("string")).alias("event_id"), F.concat(F.lit("prj_"), F.col("user_id").cast("string")).alias("project_id"), F.col("event_id").alias("seq"),
        F.col("ts").cast("timestamp").alias("at"), F.lit("human").alias("actor"), kind.alias("type"), F.floor(F.col("value") * 1000).cast("bigint").alias("playhead"), F.col("props").alias("payload"),
    )
    lines = eventlog.to_lines(rows)
    return lines.withColumn("value", F.when(F.pmod("seq", F.lit(97)) == 0, F.expr("left(value, length(value) - 9)")).otherwise(F.col("value")))


@query("read_event_log", "S1", "Q-13", sql=f"""WITH {LOGGED} SELECT user_id, count(*) FILTER (state = 'ok') AS good, count(*) FILTER (state = 'cut') AS malformed, count(*) FILTER (state = 'type') AS wrong FROM logged GROUP BY 1""")
def read_event_log(spark, d):
    parsed = eventlog.parse_events(log_lines(spark, d))
    return parsed.groupBy(F.substring("project_id", 5, 20).cast("bigint").alias("user_id")).agg(
        F.count_if(F.col("error").isNull()).alias("good"), F.count_if(F.col("error").startswith("not a JSON")).alias("malformed"), F.count_if(F.col("error") == "type: unknown").alias("wrong")
    )


@query("write_event_log", "S2", sql=f"WITH {LOGGED} SELECT event_id AS seq, user_id FROM logged WHERE state = 'ok'")
def write_event_log(spark, d):
    """Lines written and read back give the rows they came from."""
    once = eventlog.good_events(eventlog.parse_events(log_lines(spark, d)))
    again = eventlog.good_events(eventlog.parse_events(eventlog.to_lines(once).select("value")))
    return again.select("seq", F.substring("project_id", 5, 20).cast("bigint").alias("user_id"))


@query("upsert_events", "S6", sql=f"""WITH {EVENTS} SELECT project_id, seq, CASE WHEN seq % 3 = 0 THEN -1 ELSE playhead END AS playhead FROM ev""")
def upsert_events(spark, d):
    rows = v.events(spark, d).select("project_id", "seq", "playhead")
    again = rows.where(F.pmod("seq", F.lit(3)) == 0).withColumn("playhead", F.lit(-1).cast("bigint"))
    return eventlog.upsert_events(rows, again)


@query("upsert_projects", "S5", sql="SELECT o_custkey AS project_id, max_by(o_orderkey, struct_pack(d := o_orderdate, k := o_orderkey)) AS version, strftime(max(o_orderdate), '%Y-%m-%d') AS updated_at FROM orders GROUP BY 1")
def upsert_projects(spark, d):
    o = v.table(spark, d, "orders").select(F.col("o_custkey").alias("project_id"), F.col("o_orderkey").alias("version"), "o_orderdate")
    # The newest order of a customer is the update; on one day the higher number came later.
    rows = o.withColumns({"updated_at": F.date_format("o_orderdate", "yyyy-MM-dd"), "__o": F.struct("o_orderdate", "version")})
    return eventlog.newest(rows.drop("o_orderdate"), ["project_id"], "__o")


@query("delete_projects", "S8", sql=f"WITH {EVENTS} SELECT project_id, count(*) AS n FROM ev WHERE project_id % 4 <> 1 GROUP BY 1")
def delete_projects(spark, d):
    ev = v.events(spark, d)
    ids = ev.select("project_id").where(F.pmod("project_id", F.lit(4)) == 1)
    (left,) = projects.delete_projects(ids, (ev, "project_id"))
    return left.groupBy("project_id").agg(F.count(F.lit(1)).alias("n"))


@query("read_events", "S7", sql=f"WITH {EVENTS} SELECT project_id, min(seq) AS first_seq, max(seq) AS last_seq, count(*) AS n FROM ev GROUP BY 1")
def read_events(spark, d):
    return v.events(spark, d).groupBy("project_id").agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.count(F.lit(1)).alias("n"))


@query("assign_seq", "W21", sql="""WITH old AS (SELECT user_id, max(event_id) AS top FROM events WHERE event_type = 'error' GROUP BY 1)
SELECT e.event_id, coalesce(top, -1) + ROW_NUMBER() OVER (PARTITION BY e.user_id ORDER BY e.event_id) AS seq FROM events e LEFT JOIN old USING (user_id) WHERE event_type <> 'error'""")
def assign_seq(spark, d):
    e = v.table(spark, d, "events").select(F.col("user_id").alias("project_id"), F.col("event_id"), "event_type")
    old = e.where("event_type = 'error'").select("project_id", F.col("event_id").alias("seq"))
    return eventlog.assign_seq(e.where("event_type <> 'error'"), old, ["event_id"], quotient("event_id", 1 << 20)).select("event_id", v.big("seq").alias("seq"))


@query("project_round_trip", "S3", "S4", sql=f"WITH {RAW_CLIPS} SELECT clip_id, source_in, source_out, speed, enabled, mute, label FROM raw_clips")
def project_round_trip(spark, d):
    """Flat tables to documents and back."""
    p = v.projects(spark, d).select(
        F.concat(F.lit("prj_"), F.col("project_id").cast("string")).alias("project_id"), F.col("project_id").alias("timeline_id"), "name", "stage", "updated_at", "brief", "target_us", "fps_num", "fps_den", "width", "height"
    )
    clips = v.raw_clips(spark, d)
    known = p.select("timeline_id").join(clips.select("timeline_id").distinct(), "timeline_id", "right").distinct()
    lanes = tracks(spark, d).withColumn("track_no", F.col("track_id")).join(known, "timeline_id", "left_semi")
    docs = projects.assemble_projects(p, lanes, clips)
    return projects.project_tables(projects.parse_projects(docs))["clips"].select("clip_id", "source_in", "source_out", "speed", "enabled", "mute", "label")


@query("document_parts", "S3", "S4", sql=f"""WITH {RAW_CLIPS}, {KEYFRAMES}, {SOURCES}, {PROJECTS},
known AS (SELECT p.* FROM projects p WHERE project_id IN (SELECT timeline_id FROM raw_clips)),
owned AS (SELECT DISTINCT timeline_id, source_id FROM raw_clips)
SELECT 'key' AS part, effect_id AS id, t AS n, key_idx AS m, easing AS a, scale AS x FROM keyframes
UNION ALL SELECT 'source', 'prj_' || timeline_id || '/' || source_id, duration_us, width, content_hash, NULL FROM owned JOIN sources USING (source_id)
UNION ALL SELECT 'revision', 'rev_' || project_id, CAST(1 + project_id % 3 AS BIGINT), CAST(project_id % 2 AS BIGINT), 'prj_' || project_id || ' by model', NULL FROM known
UNION ALL SELECT 'project', 'prj_' || project_id, target_us, CAST(project_id % 5 AS BIGINT), updated_at || 'T01|rev_' || project_id || '|' || coalesce(brief, '-') || '|say "' || project_id || '"', NULL FROM known""")
def document_parts(spark, d):
    """Everything but the clips' own fields, from tables to documents and back."""
    key, pid = F.col("project_id"), F.concat(F.lit("prj_"), F.col("project_id").cast("string"))
    clips = v.raw_clips(spark, d)
    known = v.projects(spark, d).join(clips.select(F.col("timeline_id").alias("project_id")).distinct(), "project_id", "left_semi")
    review = F.to_json(F.struct(F.concat(F.lit('say "'), key.cast("string"), F.lit('"')).alias("summary"), F.array(F.struct(F.lit("remove").alias("op"))).alias("ops")))
    p = known.select(
        pid.alias("project_id"), key.alias("timeline_id"), "name", "stage", "updated_at", F.concat("updated_at", F.lit("T01")).alias("created_at"), "brief", "target_us", "fps_num", "fps_den", "width", "height",
        F.concat(F.lit("rev_"), key.cast("string")).alias("head_revision_id"), review.alias("review"), F.to_json(F.struct(F.struct(F.pmod(key, F.lit(5)).alias("k")).alias("deep"))).alias("meta"),
    )
    op = F.struct(F.lit("setLabel").alias("op"), F.lit("a, b").alias("label"))
    revisions = known.select(
        pid.alias("project_id"), F.lit(0).alias("rev_ord"), F.concat(F.lit("rev_"), key.cast("string")).alias("revision_id"), F.lit(None).cast("string").alias("parent_id"), F.col("updated_at").alias("at"), F.lit("llm").alias("by"),
        F.to_json(F.array_repeat(op, (F.pmod(key, F.lit(3)) + 1).cast("int"))).alias("ops"), F.concat(pid, F.lit(" by model")).alias("summary"), (F.pmod(key, F.lit(2)) == 1).alias("accepted"),
    )
    owned = clips.select("timeline_id", "source_id").distinct().join(v.sources(spark, d), "source_id")
    video = F.struct("width", "height", F.struct(F.col("fps_num").alias("num"), F.col("fps_den").alias("den")).alias("frameRate"), "rotation")
    sources = owned.select(
        F.concat(F.lit("prj_"), F.col("timeline_id").cast("string")).alias("project_id"), F.col("source_id").alias("source_ord"), "source_id", "name", "duration_us",
        F.struct(F.col("locator_kind").alias("kind"), F.col("locator_path").alias("path")).alias("locator"), video.alias("video"), F.lit(None).cast("string").alias("audio"), "content_hash",
    )
    framing = F.to_json(F.struct("scale", "x", "y", "rotation"))
    keys = v.keyframes(spark, d).groupBy("timeline_id", "track_id", "ord", "clip_id", "effect_ord", "effect_id", "type", F.col("effect_enabled").alias("enabled")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("key_idx", F.struct("t", framing.alias("value"), "easing").alias("k")))), lambda x: x["k"]).alias("keyframes")
    ).withColumns({"rect": F.lit(None).cast("string"), "color": F.lit(None).cast("string")})
    lanes = tracks(spark, d).withColumn("track_no", F.col("track_id")).join(p.select("timeline_id"), "timeline_id", "left_semi")
    documents = projects.parse_projects(projects.assemble_projects(p, lanes, clips, keys, sources, revisions))
    back = projects.project_tables(session.checkpoint(documents.select("p", "error")))
    row = lambda df, part, id_, n, m, a, x=None: df.select(F.lit(part).alias("part"), id_.alias("id"), n.cast("bigint").alias("n"), m.cast("bigint").alias("m"), a.alias("a"), (F.lit(None) if x is None else x).cast("double").alias("x"))
    c, own = F.col, back["effects"].select("effect_id", F.posexplode("keyframes").alias("i", "k"))
    text = F.concat_ws("|", "created_at", "head_revision_id", F.coalesce("brief", F.lit("-")), F.get_json_object("review", "$.summary"))
    return (
        row(own, "key", c("effect_id"), c("k.t"), c("i"), c("k.easing"), F.get_json_object("k.value", "$.scale"))
        .unionByName(row(back["sources"], "source", F.concat_ws("/", "project_id", "source_id"), c("duration_us"), c("video.width"), c("content_hash")))
        .unionByName(row(back["revisions"], "revision", c("revision_id"), F.json_array_length("ops"), c("accepted").cast("int"), c("summary")))
        .unionByName(row(back["projects"], "project", c("project_id"), c("target_us"), F.get_json_object("meta", "$.deep.k"), text))
    )


# Replies made of whole turns: an object whose summary is the text, a list that labels a clip with it and speeds another up, or prose.
@query("parse_plans", "Q-13", "Q-14", sql="""WITH s AS (SELECT role, turn, text, CASE WHEN turn % 3 = 1 THEN length(text) > 200 END AS long, turn % 5 = 4 AS fast FROM conversations)
SELECT role, count(*) AS replies, count(*) FILTER (turn % 3 = 0 OR (turn % 3 = 1 AND NOT long AND NOT fast)) AS good, count(*) FILTER (turn % 3 = 1 AND long) AS long_labels, count(*) FILTER (turn % 3 = 1 AND fast) AS too_fast,
  CAST(sum(CASE WHEN turn % 3 = 0 THEN 1 WHEN turn % 3 = 1 THEN 2 ELSE 0 END) AS BIGINT) AS ops, CAST(sum(CASE WHEN turn % 3 = 0 THEN length(text) ELSE 0 END) AS BIGINT) AS told FROM s GROUP BY 1""")
def parse_plans(spark, d):
    kind, text = F.pmod("turn", F.lit(3)), F.col("text")
    clip = F.concat(F.lit("clp_"), F.col("conv_id").cast("string"))
    remove = F.struct(F.lit("remove").alias("op"), clip.alias("clipId"))
    label = F.to_json(F.struct(F.lit("setLabel").alias("op"), clip.alias("clipId"), text.alias("label")))
    speed = F.to_json(F.struct(F.lit("setSpeed").alias("op"), clip.alias("clipId"), F.when(F.pmod("turn", F.lit(5)) == 4, 20.5).otherwise(2.0).alias("speed")))
    said = F.when(kind == 0, F.to_json(F.struct(text.alias("summary"), F.array(remove).alias("ops")))).when(kind == 1, F.concat(F.lit("["), label, F.lit(","), speed, F.lit("]"))).otherwise(text)
    plans = projects.parse_plans(v.table(spark, d, "conversations").select("role", said.alias("value")))
    said_of = lambda what: F.count_if(F.exists("issues", lambda i: i.contains(what)))
    return plans.groupBy("role").agg(
        F.count(F.lit(1)).alias("replies"), F.count_if(F.col("error").isNull()).alias("good"), said_of("].label:").alias("long_labels"), said_of("].speed:").alias("too_fast"),
        F.sum(F.coalesce(F.size("ops"), F.lit(0))).alias("ops"), F.sum(F.coalesce(F.char_length("summary"), F.lit(0))).cast("bigint").alias("told"),
    )


# The event tables span a month, so the rules run with intervals of hours.
H = 3_600_000_000


@query("throttle", "ST2", sql=f"""WITH RECURSIVE {EVENTS}, s AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY project_id ORDER BY at_us, seq) AS n FROM ev WHERE type IN ('playback.scrub', 'playback.seek')),
w AS (SELECT project_id, n, seq, at_us AS last, true AS kept FROM s WHERE n = 1
  UNION ALL SELECT s.project_id, s.n, s.seq, CASE WHEN s.type = 'playback.seek' OR s.at_us - w.last >= {20 * H} THEN s.at_us ELSE w.last END, s.type = 'playback.seek' OR s.at_us - w.last >= {20 * H} FROM w JOIN s ON s.project_id = w.project_id AND s.n = w.n + 1)
SELECT project_id, seq FROM w WHERE kept""")
def throttle(spark, d):
    return timing.throttle(v.events(spark, d), 20 * H).select("project_id", "seq")


@query("coalesce_bursts", "ST3", sql=f"WITH {EVENTS}, n AS (SELECT *, lead(at_us) OVER (PARTITION BY project_id ORDER BY at_us, seq) AS nx FROM ev) SELECT project_id, seq FROM n WHERE nx IS NULL OR nx - at_us >= {6 * H}")
def coalesce_bursts(spark, d):
    return timing.coalesce_bursts(v.events(spark, d), 6 * H).select("project_id", "seq")


@query("quiet_gaps", "ST4", sql=f"""WITH {EVENTS}, n AS (SELECT *, lead(at_us) OVER (PARTITION BY project_id ORDER BY at_us, seq) AS nx FROM ev), c AS (SELECT *, CASE WHEN nx IS NULL OR nx - at_us >= {12 * H} THEN at_us + {12 * H} END AS q FROM n)
SELECT project_id, seq, least(min(q) OVER (PARTITION BY project_id ORDER BY at_us, seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), at_us + {30 * H}) AS starts_us FROM c""")
def quiet_gaps(spark, d):
    return timing.quiet_gaps(v.events(spark, d), 12 * H, 30 * H).select("project_id", "seq", "starts_us")


STEPS = EVENTS + """, st AS (SELECT project_id, seq, at_us, CASE WHEN type = 'project.open' THEN 'open' WHEN type = 'playback.seek' THEN 'finish' ELSE type END AS step FROM ev)"""


def steps(spark, d):
    step = F.when(F.col("type") == "project.open", "open").when(F.col("type") == "playback.seek", "finish").otherwise(F.col("type"))
    return v.events(spark, d).select("project_id", "seq", "at_us", step.alias("step"))


@query("failed_opens", "ST5", sql=f"""WITH {STEPS}, p AS (SELECT *, lag(at_us) OVER w AS pa, lag(step) OVER w AS ps FROM st WINDOW w AS (PARTITION BY project_id ORDER BY at_us, seq)),
o AS (SELECT *, coalesce(ps <> 'finish' AND at_us - pa < {24 * H}, false) AS failed, ROW_NUMBER() OVER (PARTITION BY project_id ORDER BY at_us, seq) AS n FROM p WHERE step = 'open'),
l AS (SELECT *, coalesce(max(CASE WHEN NOT failed THEN n END) OVER (PARTITION BY project_id ORDER BY n), 0) AS c FROM o)
SELECT project_id, seq, failed, CASE WHEN failed THEN ps END AS stage, CASE WHEN failed THEN n - c ELSE 0 END AS runs FROM l""")
def failed_opens(spark, d):
    return timing.failed_opens(steps(spark, d), 24 * H).drop("at_us")


@query("adaptive_interval", "ST6", sql=f"""WITH RECURSIVE {EVENTS}, s AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY project_id ORDER BY at_us, seq) AS n FROM ev),
w AS (SELECT project_id, n, seq, least(CAST(900 AS DOUBLE), greatest(CAST(160 AS DOUBLE), CAST(160 AS DOUBLE) * (1 - CAST(0.4 AS DOUBLE)) + greatest(0, value * 10) * CAST(0.4 AS DOUBLE))) AS x FROM s WHERE n = 1
  UNION ALL SELECT s.project_id, s.n, s.seq, least(CAST(900 AS DOUBLE), greatest(CAST(160 AS DOUBLE), w.x * (1 - CAST(0.4 AS DOUBLE)) + greatest(0, value * 10) * CAST(0.4 AS DOUBLE))) FROM w JOIN s ON s.project_id = w.project_id AND s.n = w.n + 1)
SELECT project_id, seq, round(x, 6) AS interval_ms FROM w""")
def adaptive_interval(spark, d):
    costs = v.events(spark, d).withColumn("cost_ms", F.col("value") * 10)
    return timing.adaptive_interval(costs).select("project_id", "seq", F.round("interval_ms", 6).alias("interval_ms"))


@query("current_verdicts", "ST7", sql=f"""WITH {EVENTS}, m AS (SELECT *, CASE WHEN type = 'project.open' THEN 'llm.review' ELSE type END AS t FROM ev WHERE type IN ('llm.plan', 'llm.verdict', 'project.open')),
k AS (SELECT *, max(CASE WHEN t <> 'llm.verdict' THEN seq END) OVER (PARTITION BY project_id ORDER BY seq) AS mark FROM m),
pl AS (SELECT project_id, seq AS review_seq, unnest(range(0, k % 8 + 1)) AS "index" FROM m WHERE t = 'llm.plan'),
vd AS (SELECT project_id, mark AS review_seq, seq, k % 8 AS i, k % 10 = 0 AS every, k % 2 = 0 AS acc FROM k WHERE t = 'llm.verdict' AND mark IS NOT NULL)
SELECT p.project_id, p.review_seq, p."index", coalesce(max_by(acc, vd.seq), false) AS accepted FROM pl p LEFT JOIN vd ON vd.project_id = p.project_id AND vd.review_seq = p.review_seq AND (every OR i = p."index") GROUP BY 1, 2, 3""")
def current_verdicts(spark, d):
    ev, k = v.events(spark, d), F.col("k")
    rows = ev.select(
        "project_id", "seq", F.when(F.col("type") == "project.open", "llm.review").otherwise(F.col("type")).alias("type"), (F.pmod(k, F.lit(8)) + 1).alias("ops"),
        F.pmod(k, F.lit(8)).alias("index"), (F.pmod(k, F.lit(10)) == 0).alias("all_ops"), (F.pmod(k, F.lit(2)) == 0).alias("accepted"),
    )
    return timing.current_verdicts(rows)


def timed(spark, d):
    e = v.events(spark, d)
    return e.select(F.timestamp_micros("at_us").alias("at"), "type", "k", F.concat(F.lit("m"), F.pmod("k", F.lit(3)).cast("string")).alias("model"), F.col("playhead").alias("elapsed_ms"))


@query("pass_costs", "ST9", sql=f"""WITH {EVENTS} SELECT 'm' || (k % 3) AS model, (at_us // 86400000000) * 86400000000 AS day_us, count(*) FILTER (type = 'llm.plan') AS passes, count(*) FILTER (type = 'project.open') AS errors, CAST(sum(k) AS BIGINT) AS tokens, CAST(sum(playhead) AS BIGINT) AS elapsed_ms
FROM ev WHERE type IN ('llm.plan', 'project.open') GROUP BY 1, 2""")
def pass_costs(spark, d):
    rows = timed(spark, d).withColumns({"type": F.when(F.col("type") == "project.open", "llm.error").otherwise(F.col("type")), "tokens": F.col("k"), "rejected": F.lit(0)})
    return timing.pass_costs(rows).select("model", F.unix_micros("window.start").alias("day_us"), "passes", "errors", "tokens", "elapsed_ms")


@query("device_costs", "ST10", sql=f"""WITH {EVENTS} SELECT CASE type WHEN 'playback.scrub' THEN 'render.complete' ELSE 'proxy.complete' END AS type, (at_us // 86400000000) * 86400000000 AS day_us, count(*) AS runs, CAST(sum(playhead) AS BIGINT) AS elapsed_ms, max(playhead) AS longest_ms
FROM ev WHERE type IN ('playback.scrub', 'playback.seek') GROUP BY 1, 2""")
def device_costs(spark, d):
    kind = F.when(F.col("type") == "playback.scrub", "render.complete").when(F.col("type") == "playback.seek", "proxy.complete")
    return timing.device_costs(timed(spark, d).withColumn("type", kind)).select("type", F.unix_micros("window.start").alias("day_us"), "runs", "elapsed_ms", "longest_ms")

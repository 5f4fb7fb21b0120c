"""Registered queries: reviews, previews, proposals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import digest, text
from ..operators import proposals as pr
from ..operators import review as rv
from ..operators import signals
from ..operators.quality import indexed
from ..operators.sampling import GRADE
from ..operators.timeline import eligible_clips
from . import views as v
from .join_queries import HITS_IN, QUIET_IN, USED, kept_onsets, used
from .registry import query
from .replay_queries import document_tracks, op_rows, prepared
from .signal_queries import KEPT, ONSETS, QUIET, STILL, luma_frames
from .timeline_queries import TRACKS, placed, sql_tc, tracks
from .views import CLIPS, KEYFRAMES, OPS, PROJECTS, RAW_CLIPS, SOURCES, sql_round

# A conversation is a review: its turns are the proposals, the last one was never ruled on.
VERDICTS = """verdicts AS (SELECT conv_id AS review_id, turn AS op_idx, text AS op, CASE WHEN turn = max(turn) OVER (PARTITION BY conv_id) THEN false ELSE role = 'user' END AS accepted FROM conversations)"""


def reviews(spark, d):
    """Reviews as documents: parallel arrays, the verdicts one short."""
    rows = v.table(spark, d, "conversations").groupBy(F.col("conv_id").alias("review_id")).agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("xs"))
    return rows.select("review_id", F.transform("xs", lambda x: x["text"]).alias("ops"), F.transform(F.slice("xs", F.lit(1), F.size("xs") - 1), lambda x: x["role"] == "user").alias("accepted"))


@query("align_verdicts", "J16", sql=f"WITH {VERDICTS} SELECT review_id, op_idx, length(op) AS op_size, accepted FROM verdicts")
def align_verdicts(spark, d):
    return rv.align_verdicts(reviews(spark, d)).select("review_id", "op_idx", F.length("op").cast("bigint").alias("op_size"), "accepted")


@query("pass_accepted", "AG14", sql=f"WITH {VERDICTS} SELECT review_id, bool_or(accepted) AS accepted FROM verdicts GROUP BY 1")
def pass_accepted(spark, d):
    return rv.pass_accepted(rv.align_verdicts(reviews(spark, d)))


@query("bootstrap_review", "R25", sql=f"WITH {RAW_CLIPS}, {OPS} SELECT timeline_id, count(*) AS ops, bool_or(false) AS accepted FROM ops GROUP BY 1")
def bootstrap_review(spark, d):
    return rv.bootstrap_review(v.ops(spark, d)).groupBy("timeline_id").agg(F.count(F.lit(1)).alias("ops"), F.bool_or("accepted").alias("accepted"))


@query("resolve_review", "R18", "J16")
def resolve_review(spark, d):
    """Accepted edits on the baseline, with what landed; checked against a plain model in the tests."""
    clips, ops = prepared(spark, d)
    verdicts = v.ops(spark, d).select("timeline_id", "op_idx", "accepted")
    return rv.resolve_review(clips, ops, verdicts)[1]


# Every edit alone on the baseline: what it leaves of its clip, a second piece where it makes one, and where both end on tracks that
# keep their starts. No clip carries an effect that an edit adds or removes.
PREVIEW = f"""tgt AS (SELECT o.*, c.clip_id IS NOT NULL AS there, c.start, c.out_len AS len, c.enabled AS was, c.speed AS rate, c.source_in AS ci, c.source_out AS co, cs.duration_us AS own_us, s.duration_us AS new_us,
    coalesce(c.track_id, o.track_id) AS track, coalesce(c.kind, CASE WHEN p.o_orderkey IS NOT NULL AND o.track_id < 3 THEN ['video', 'audio', 'overlay'][o.track_id + 1] END) AS kind,
    coalesce(o.source_in, c.source_in) AS ni, coalesce(o.source_out, c.source_out) AS no_, c.source_in + {sql_round('(o."at" - c.start) * c.speed')} AS cut
  FROM ops o LEFT JOIN clips c ON c.timeline_id = o.timeline_id AND c.clip_id = o.clip_id LEFT JOIN sources cs ON cs.source_id = c.source_id LEFT JOIN sources s ON s.source_id = o.source_id LEFT JOIN orders p ON p.o_orderkey = o.timeline_id),
cur AS (SELECT *, coalesce(CASE WHEN op = 'insertClip' THEN kind IS NOT NULL AND source_out > source_in AND new_us IS NOT NULL AND source_out <= new_us WHEN NOT there OR op = 'removeEffect' THEN false
      WHEN op = 'trim' THEN ni >= 0 AND no_ > ni AND (own_us IS NULL OR no_ <= own_us) WHEN op = 'split' THEN "at" > start AND "at" < start + len AND cut > ci AND cut < co
      WHEN op = 'setSpeed' THEN speed > 0 AND {sql_round('(co - ci) / speed')} > 0 ELSE true END, false) AS fine,
    CASE op WHEN 'remove' THEN 0 WHEN 'trim' THEN {sql_round('(no_ - ni) / rate')} WHEN 'split' THEN {sql_round('(cut - ci) / rate')} WHEN 'setSpeed' THEN {sql_round('(co - ci) / speed')} WHEN 'insertClip' THEN {sql_round('(source_out - source_in) / coalesce(speed, 1)')} ELSE len END AS l1,
    CASE op WHEN 'split' THEN {sql_round('(co - cut) / rate')} WHEN 'duplicateClip' THEN len ELSE 0 END AS l2, CASE op WHEN 'setEnabled' THEN enabled WHEN 'insertClip' THEN true ELSE was END AS on_,
    CASE WHEN op = 'insertClip' THEN 0 ELSE start END AS s1, CASE WHEN op = 'split' THEN "at" WHEN place = 'start' THEN 0 ELSE start + len END AS s2 FROM tgt),
ends AS (SELECT timeline_id, track_id, clip_id, CASE WHEN enabled THEN start + out_len ELSE 0 END AS e FROM clips),
oth AS (SELECT g.timeline_id, g.op_idx, max(e.e) AS total, max(CASE WHEN e.track_id <> g.track THEN e.e END) AS others, max(CASE WHEN e.track_id = g.track THEN e.e END) AS own, max(CASE WHEN e.track_id = g.track AND e.clip_id IS DISTINCT FROM g.clip_id THEN e.e END) AS rest
  FROM tgt g JOIN ends e ON e.timeline_id = g.timeline_id GROUP BY 1, 2)
SELECT g.timeline_id, g.op_idx, CASE WHEN op = 'split' THEN CAST("at" AS DOUBLE) WHEN there THEN start + len / CAST(2 AS DOUBLE) ELSE 0 END AS anchor_us, CASE WHEN there THEN len ELSE 0 END AS before_us,
  CASE WHEN fine AND there THEN l1 ELSE 0 END AS after_us,
  CASE WHEN NOT fine THEN 0 ELSE CAST(greatest(coalesce(others, 0), CASE WHEN kind = 'video' THEN coalesce(own, 0) + CASE WHEN on_ THEN l1 + l2 ELSE 0 END - CASE WHEN was THEN len ELSE 0 END
    ELSE greatest(coalesce(rest, 0), CASE WHEN on_ AND op <> 'remove' THEN s1 + l1 ELSE 0 END, CASE WHEN on_ AND l2 > 0 THEN s2 + l2 ELSE 0 END) END) - coalesce(total, 0) AS BIGINT) END AS delta_us
FROM cur g LEFT JOIN oth USING (timeline_id, op_idx)"""


@query("preview_ops", "R19", sql=f"WITH {CLIPS}, {SOURCES}, {OPS}, {PREVIEW}")
def preview_ops(spark, d):
    """Every edit of the tables, those that cannot apply included."""
    clips, ops = prepared(spark, d)
    return rv.preview_ops(placed(spark, d), ops, clips).select("timeline_id", "op_idx", "anchor_us", "before_us", "after_us", "delta_us")


@query("preview_all", "R19", "F15")
def preview_all(spark, d):
    clips, ops = prepared(spark, d)
    return rv.preview_ops(placed(spark, d), ops, clips)


def _edge(new: str, delta: str, name: str) -> str:
    return f"""CASE WHEN {new} IS NULL THEN NULL WHEN ci IS NULL THEN 'set the {name} to ' || {sql_tc(new, True)}
    WHEN {delta} <> 0 THEN CASE WHEN {delta} > 0 THEN 'trim ' ELSE 'extend ' END || {sql_tc(f'abs({delta})', True)} || CASE WHEN {delta} > 0 THEN ' off' ELSE ' onto' END || ' the {name}' END"""


N = "CASE WHEN {0} = floor({0}) THEN CAST(CAST({0} AS BIGINT) AS VARCHAR) ELSE CAST({0} AS VARCHAR) END".format
SENTENCES = f"""idx AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY timeline_id, track_id ORDER BY ord) AS no FROM clips),
s AS (SELECT o.*, o."at" AS at_, c.source_in AS ci, c.source_out AS co, o.source_in - c.source_in AS dh, c.source_out - o.source_out AS dt, CASE WHEN c.clip_id IS NULL THEN o.clip_id ELSE 'clip ' || no || CASE WHEN coalesce(c.label, '') <> '' THEN ' (' || c.label || ')' ELSE '' END END AS named FROM ops o LEFT JOIN idx c ON c.timeline_id = o.timeline_id AND c.clip_id = o.clip_id)
SELECT timeline_id, op_idx, CASE op WHEN 'remove' THEN 'Delete ' || named
  WHEN 'trim' THEN (SELECT upper(w[1]) || w[2:] FROM (SELECT coalesce(nullif(concat_ws(' and ', {_edge('source_in', 'dh', 'head')}, {_edge('source_out', 'dt', 'tail')}), ''), 'adjust') AS w)) || ' of ' || named
  WHEN 'split' THEN 'Split ' || named || ' at ' || {sql_tc('at_', True)} WHEN 'insertClip' THEN 'Restore ' || {sql_tc('abs(source_out - source_in)', True)} || ' of footage from ' || source_id
  WHEN 'setEnabled' THEN CASE WHEN enabled THEN 'Bring back ' ELSE 'Drop ' END || named WHEN 'move' THEN 'Move ' || named || ' to position ' || (to_index + 1)
  WHEN 'setSpeed' THEN CASE WHEN speed > 1 THEN 'Speed up ' ELSE 'Slow down ' END || named || ' to ' || {N('speed')} || '×' WHEN 'removeEffect' THEN 'Remove an effect from ' || named
  WHEN 'addEffect' THEN CASE WHEN effect_type = 'volume' THEN 'Ride the volume' ELSE 'Push in from 1× to 1.5×' END || ' on ' || named
  WHEN 'setAudio' THEN CASE WHEN mute THEN 'Mute ' || named WHEN NOT mute THEN 'Unmute ' || named WHEN gain IS NOT NULL THEN 'Set ' || named || ' volume to ' || {sql_round('gain * 100')} || '%' ELSE 'Adjust audio on ' || named END
  WHEN 'setColor' THEN CASE WHEN grade IS NULL THEN 'Clear the colour adjustment on ' || named ELSE 'Adjust colour on ' || named || ': ' || CASE WHEN grade = 0 THEN 'nothing' ELSE 'exposure ' || CASE WHEN grade > 0 THEN '+' ELSE '' END || {sql_round('grade * 100')} END END
  WHEN 'setTransform' THEN CASE WHEN n_keys IS NULL THEN 'Clear the framing on ' || named WHEN n_keys = 1 THEN 'Reframe ' || named || ' at 1×' ELSE 'Push in on ' || named || ', 1× to ' || CASE n_keys WHEN 2 THEN '1.25×' ELSE '1.5×' END END
  WHEN 'setLabel' THEN 'Label ' || named || ' "' || label || '"' WHEN 'duplicateClip' THEN CASE WHEN place = 'start' THEN 'Copy ' || named || ' to the start as a teaser' ELSE 'Duplicate ' || named END END AS sentence
FROM s"""


@query("describe_ops", "F15", sql=f"WITH {CLIPS}, {OPS}, {SENTENCES}")
def describe_ops(spark, d):
    clips, ops = prepared(spark, d, keys=False)
    at = indexed(placed(spark, d)).select("timeline_id", F.col("clip_id").alias("__id"), F.struct(F.col("clip_index").alias("index"), "label", "source_in", "source_out").alias("clip"))
    rows = ops.withColumn("__id", F.col("e.clip_id")).join(at, ["timeline_id", "__id"], "left")
    return rows.select(
        "timeline_id", F.col("e.op_idx").alias("op_idx"), text.describe_op(F.col("e"), F.col("clip"), GRADE).alias("sentence")
    )


# Proposals with an anchor somewhere on a minute.
ANCHORS = """anchors AS (SELECT timeline_id, op_idx, (coalesce(op_idx, 0) * 7919 + timeline_id * 104729) % 60000000 / CAST(2 AS DOUBLE) AS anchor_us, accepted, op <> 'insertClip' AS applicable FROM ops)"""


@query("cluster_proposals", "AG20", sql=f"""WITH RECURSIVE {RAW_CLIPS}, {OPS}, {ANCHORS}, n AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY timeline_id ORDER BY anchor_us, op_idx) AS n FROM anchors),
w AS (SELECT timeline_id, n, op_idx, anchor_us, accepted, applicable, n AS g, anchor_us AS a FROM n WHERE n = 1
  UNION ALL SELECT x.timeline_id, x.n, x.op_idx, x.anchor_us, x.accepted, x.applicable, CASE WHEN x.anchor_us - w.a <= 5000 THEN w.g ELSE x.n END, CASE WHEN x.anchor_us - w.a <= 5000 THEN w.a ELSE x.anchor_us END FROM w JOIN n x ON x.timeline_id = w.timeline_id AND x.n = w.n + 1)
SELECT timeline_id, min(anchor_us) AS at_us, count(*) AS n, min_by(op_idx, n) AS first_op, bool_and(accepted) AS accepted, bool_or(NOT applicable) AS stale FROM w GROUP BY timeline_id, g""")
def cluster_proposals(spark, d):
    o = v.ops(spark, d)
    rows = o.select("timeline_id", "op_idx", (F.pmod(F.col("op_idx") * 7919 + F.col("timeline_id") * 104729, F.lit(60_000_000)) / 2).alias("anchor_us"), "accepted", (F.col("op") != "insertClip").alias("applicable"))
    return rv.cluster_proposals(rows, 5000.0).drop("bubble")


@query("dedupe_resends", "U2", "F9", sql=f"""WITH {RAW_CLIPS}, {OPS}, k AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY timeline_id, op, mute, gain, enabled ORDER BY op_idx) AS n FROM ops WHERE op IN ('setEnabled', 'setAudio'))
SELECT timeline_id, op_idx FROM k WHERE n = 1""")
def dedupe_resends(spark, d):
    rows = v.ops(spark, d).where(F.col("op").isin("setEnabled", "setAudio")).select("timeline_id", "op_idx", "op", "mute", "gain", "enabled")
    return rv.dedupe_resends(rows, ["op_idx"]).select("timeline_id", "op_idx")


@query("merge_repair_round", "R20")
def merge_repair_round(spark, d):
    """Odd edits are the repair round of the even ones."""
    rows = op_rows(spark, d).drop("accepted")
    clips, _ = prepared(spark, d)
    even = F.pmod("op_idx", F.lit(2)) == 0
    return rv.merge_repair_round(clips, rows.where(even), rows.where(~even), v.sources(spark, d), document_tracks(spark, d)).outcomes


@query("commit_revisions", "R16", "R21")
def commit_revisions(spark, d):
    clips, ops = prepared(spark, d)
    verdicts = v.ops(spark, d).select("timeline_id", "op_idx", "accepted")
    replayed, _ = rv.resolve_review(clips, ops, verdicts)
    return rv.commit_revisions(v.projects(spark, d), replayed.outcomes, verdicts)


# Every fourth edit fails; every eighth batch was made on a head that has moved since.
LANDED = f"""{v.RAW_CLIPS}, {v.OPS}, {v.PROJECTS}, o AS (SELECT *, (op_idx + timeline_id) % 4 = 0 AS failed FROM ops),
listed AS (SELECT timeline_id, '[' || coalesce(string_agg('{{"clip_id":"' || clip_id || '","op":"' || op || '"}}', ',' ORDER BY op_idx) FILTER (NOT failed), '') || ']' AS ops,
  string_agg(op_idx || CASE WHEN accepted THEN '+' ELSE '-' END, ' ' ORDER BY op_idx) AS verdicts, bool_or(accepted) AS accepted FROM o WHERE clip_id IS NOT NULL GROUP BY 1)"""


@query("commit_ops", "R16", sql=f"""WITH {LANDED} SELECT timeline_id AS project_id, ops, verdicts, accepted, timeline_id % 8 <> 0 AS committed, CASE WHEN timeline_id % 8 <> 0 THEN '2024-05-05' ELSE updated_at END AS updated_at, timeline_id % 8 <> 0 AS moved
FROM listed JOIN projects ON project_id = timeline_id""")
def commit_ops(spark, d):
    """Batches as revisions with their edits and verdicts; heads that are still the parent move on."""
    rows = v.ops(spark, d).where("clip_id is not null").select("timeline_id", "op_idx", "op", "clip_id", "accepted")
    p = v.projects(spark, d)
    key = F.col("project_id")
    parent = F.when(F.pmod(key, F.lit(8)) == 0, F.lit("rev_gone")).otherwise(F.col("head_revision_id").cast("string"))
    batches = p.join(rows.select(F.col("timeline_id").alias("project_id")).distinct(), "project_id", "left_semi").select(
        key.alias("timeline_id"), parent.alias("parent_id"), F.lit("2024-05-05").alias("at"), F.lit("llm").alias("by"), F.lit("m1").alias("model"), F.lit(None).cast("string").alias("summary")
    )
    message = F.when(F.pmod(F.col("op_idx") + F.col("timeline_id"), F.lit(4)) == 0, "no")
    revisions, after = rv.commit_ops(p, batches, rows, rows.select("timeline_id", "op_idx", message.alias("message")), rows.select("timeline_id", "op_idx", "accepted"))
    said = F.array_join(F.transform("verdicts", lambda x: F.concat(x["op_idx"].cast("string"), F.when(x["accepted"], "+").otherwise("-"))), " ")
    heads = after.select("project_id", "updated_at", "head_revision_id")
    return revisions.select("project_id", "revision_id", "ops", said.alias("verdicts"), "accepted", "committed").join(heads, "project_id").select(
        "project_id", "ops", "verdicts", "accepted", "committed", "updated_at", F.coalesce(F.col("head_revision_id") == F.col("revision_id"), F.lit(False)).alias("moved")
    )


@query("close_reviews", "R21", sql="""SELECT o_orderkey AS review_id, CASE WHEN o_orderstatus <> 'O' THEN CASE WHEN o_custkey % 2 = 0 THEN 'm' || (o_custkey % 3) ELSE 'local-heuristics' END END AS model_label,
  CASE WHEN o_orderstatus <> 'O' THEN o_custkey % 5 ELSE 0 END AS committed, CASE WHEN o_orderstatus <> 'O' THEN 5 ELSE 0 END AS stored_verdicts, o_orderstatus <> 'O' AS has_revision FROM orders""")
def close_reviews(spark, d):
    o = v.table(spark, d, "orders")
    k = F.col("o_custkey")
    rows = o.select(
        F.col("o_orderkey").alias("review_id"), F.when(F.col("o_orderstatus") == "O", "discard").otherwise("finish").alias("action"), F.when(F.pmod(k, F.lit(2)) == 0, "model").otherwise("heuristics").alias("by"),
        F.concat(F.lit("m"), F.pmod(k, F.lit(3)).cast("string")).alias("model"), F.pmod(k, F.lit(5)).alias("accepted_ops"), F.lit(5).alias("ops"),
    )
    return rv.close_reviews(rows).select("review_id", "model_label", "committed", "stored_verdicts", "has_revision")


@query("effective_revisions", "R22", sql="SELECT o_custkey AS project_id, o_orderkey AS revision_id FROM orders WHERE o_orderpriority <> '1-URGENT'")
def effective_revisions(spark, d):
    o = v.table(spark, d, "orders").select(F.col("o_custkey").alias("project_id"), F.col("o_orderkey").alias("revision_id"), "o_orderpriority")
    return rv.effective_revisions(o.drop("o_orderpriority"), o.where("o_orderpriority = '1-URGENT'"))[0]


@query("freeze_coarse", "R17", sql=f"WITH {CLIPS}, {PROJECTS} SELECT 'snap_' || timeline_id AS snapshot_id, clip_id, start FROM clips JOIN projects p ON p.project_id = timeline_id WHERE stage = 'coarse'")
def freeze_coarse(spark, d):
    return rv.freeze_coarse(placed(spark, d), v.projects(spark, d).where("stage = 'coarse'"))[0].select("snapshot_id", "clip_id", "start")


@query("bulk_ops", "R24", sql=f"""WITH {CLIPS}, k AS (SELECT timeline_id, min(clip_id) AS keep FROM clips GROUP BY 1)
SELECT timeline_id, ord AS op_idx, 'setEnabled' AS op, clip_id FROM clips JOIN k USING (timeline_id) WHERE enabled AND track_id = 0 AND clip_id <> keep UNION ALL SELECT timeline_id, ord, 'setColor', clip_id FROM clips""")
def bulk_ops(spark, d):
    clips = placed(spark, d)
    keep = clips.groupBy("timeline_id").agg(F.min("clip_id").alias("clip_id"))
    grade = F.struct(*[F.lit(0.5 if g == "warmth" else 0.0).alias(g) for g in GRADE])
    cols = ["timeline_id", "op_idx", "op", "clip_id"]
    return rv.keep_only(clips, keep).select(cols).unionByName(rv.grade_all(clips, grade).select(cols))


@query("upsert_keyframes", "R27", sql=f"""WITH {RAW_CLIPS}, {KEYFRAMES}, f AS (SELECT * FROM keyframes WHERE type = 'transform'),
w AS (SELECT clip_id, count(*) AS n, (clip_id IS NOT NULL) AS x, max(CASE WHEN abs(t - 1500000) < 100000 THEN 1 ELSE 0 END) AS hit FROM f GROUP BY 1)
SELECT clip_id, n + 1 - hit AS keys FROM w""")
def upsert_keyframes(spark, d):
    k = v.keyframes(spark, d).where("type = 'transform'")
    key = F.struct("t", "scale", "x", "y", "rotation", "easing")
    docs = k.groupBy("clip_id").agg(F.array_sort(F.collect_list(key)).alias("keys"))
    write = F.struct(F.lit(1_500_000).cast("bigint").alias("at"), F.lit(2.0).alias("scale"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("rotation"))
    return rv.upsert_keyframes(docs.withColumn("writes", F.array(write)), F.lit(200_000.0)).select("clip_id", F.size("keys").cast("bigint").alias("keys"))


# Digest of a clip's place and bounds; every seventh log entry claims another one.
FNV = "printf('%08x', list_reduce(list_prepend(CAST(2166136261 AS BIGINT), list_transform(str_split(s, ''), lambda c: CAST(ord(c) AS BIGINT))), lambda h, c: (xor(h, c) * 16777619) & 4294967295))"


@query("digests", "F10", "F9", sql=f"""WITH {RAW_CLIPS}, j AS (SELECT clip_id, '{{"clipId":"' || clip_id || '","sourceIn":' || source_in || '}}' AS s FROM raw_clips) SELECT clip_id, {FNV} AS high FROM j""")
def digests(spark, d):
    doc = F.to_json(F.struct(F.col("clip_id").alias("clipId"), F.col("source_in").alias("sourceIn")))
    return v.raw_clips(spark, d).select("clip_id", F.substring(digest.digest(doc), 1, 8).alias("high"))


@query("replay_check", "R26", sql=f"WITH {RAW_CLIPS} SELECT timeline_id AS project_id, ord AS seq FROM raw_clips WHERE ord % 7 = 3 AND source_id % 5 <> 0")
def replay_check(spark, d):
    rows = v.raw_clips(spark, d)
    made = digest.digest(F.to_json(F.struct("clip_id", "source_in")))
    mine = rows.select(F.col("timeline_id").alias("project_id"), F.col("ord").alias("seq"), made.alias("digest"))
    said = F.when(F.pmod("source_id", F.lit(5)) == 0, None).when(F.pmod("ord", F.lit(7)) == 3, "0" * 16).otherwise(made)
    logged = rows.select(F.col("timeline_id").alias("project_id"), F.col("ord").alias("seq"), said.alias("timeline_digest"))
    return rv.replay_check(mine, logged).select("project_id", "seq")


# --- proposals -------------------------------------------------------------------------------

SEEN = USED + f""", {TRACKS}, {SOURCES}, {ONSETS}, {KEPT}, {QUIET}, {STILL},
elig AS (SELECT u.* FROM used u JOIN tracks t USING (timeline_id, track_id) WHERE t.kind = 'video' AND NOT t.locked AND u.enabled),
pos AS (SELECT *, start + out_len AS clip_end, ROW_NUMBER() OVER (PARTITION BY timeline_id ORDER BY track_id, ord) = 1 AS is_first, ROW_NUMBER() OVER (PARTITION BY timeline_id ORDER BY track_id DESC, ord DESC) = 1 AS is_last FROM elig),
{QUIET_IN.replace('used c', 'pos c')},
sin AS (SELECT clip_id, start + {sql_round('(greatest(q.s0, source_in) - source_in) / speed')} AS a, start + {sql_round('(least(q.e0, source_out) - source_in) / speed')} AS b
  FROM pos c JOIN (SELECT source_id AS s, start AS s0, "end" AS e0 FROM still) q ON q.s = c.source_id WHERE q.s0 < source_out AND q.e0 > source_in AND least(q.e0, source_out) - greatest(q.s0, source_in) >= 200000),
{HITS_IN.replace('used c', 'pos c')},
qf AS (SELECT q.clip_id, min(struct_pack(a := region_start, b := region_end)) FILTER (region_start <= p.start + 100000) AS head, min(struct_pack(a := region_start, b := region_end)) FILTER (region_end >= p.clip_end - 100000) AS tail, sum(region_end - region_start) AS quiet_for
  FROM qin q JOIN pos p USING (clip_id) GROUP BY 1),
sf AS (SELECT clip_id, sum(b - a) AS still_for FROM sin GROUP BY 1),
hf AS (SELECT clip_id, max(strength) AS strength, arg_min(t, struct_pack(s := -strength, t := t)) AS t FROM hits GROUP BY 1),
seen AS (SELECT p.*, p.source_id IN (SELECT source_id FROM levels) AS measured, head, tail, coalesce(quiet_for, 0) AS quiet_for, coalesce(still_for, 0) AS still_for, hf.strength, hf.t AS hit_t, s.duration_us
  FROM pos p LEFT JOIN qf USING (clip_id) LEFT JOIN sf USING (clip_id) LEFT JOIN hf USING (clip_id) LEFT JOIN sources s ON s.source_id = p.source_id)"""


def seen(spark, d):
    levels = v.levels(spark, d)
    facts = {
        "measured": levels.select("source_id").distinct(), "quiet": signals.quiet_runs(levels),
        "still": signals.still_runs(signals.frame_motion(luma_frames(spark, d))), "onsets": kept_onsets(spark, d),
    }
    return pr.observed(eligible_clips(used(spark, d), tracks(spark, d)), facts)


TRIMS = f"""tr0 AS (SELECT *, coalesce(CASE WHEN measured THEN CASE WHEN NOT is_first AND head IS NOT NULL THEN source_in + {sql_round('(head.b - start) * speed')} END WHEN NOT is_first THEN source_in + 250000 END, source_in) AS ni,
    coalesce(CASE WHEN measured THEN CASE WHEN NOT is_last AND tail IS NOT NULL THEN source_in + {sql_round('(tail.a - start) * speed')} END WHEN NOT is_last THEN source_out - 250000 END, source_out) AS no_
  FROM seen WHERE (NOT is_first OR NOT is_last) AND out_len > 1000000),
trims AS (SELECT timeline_id, track_id, ord, 0 AS kind_ord, 'trim' AS op, clip_id, CASE WHEN ni <> source_in THEN ni END AS source_in, CASE WHEN no_ <> source_out THEN no_ END AS source_out, CAST(NULL AS DOUBLE) AS speed, CAST(NULL AS DOUBLE) AS scale_to, CAST(NULL AS BIGINT) AS key_t,
  CASE WHEN measured THEN concat_ws(' and ', CASE WHEN ni <> source_in THEN 'opens' END, CASE WHEN no_ <> source_out THEN 'ends' END) || ' on measured silence' ELSE 'coarse cuts usually run a beat long at the join' END AS rationale
  FROM tr0 WHERE (ni <> source_in OR no_ <> source_out) AND no_ > ni AND (duration_us IS NULL OR no_ <= duration_us))"""
FRAMING = f"""fr0 AS (SELECT *, CASE WHEN measured AND strength >= 0.55 AND hit_t - start > 700000 THEN 'lands' WHEN measured AND quiet_for >= out_len * 0.5 AND still_for >= out_len * 0.5 THEN 'dull' WHEN measured AND still_for >= out_len * 0.6 AND out_len >= 6000000 THEN 'static'
    WHEN NOT measured AND out_len >= 20000000 THEN 'slow' WHEN NOT measured AND out_len >= 6000000 THEN 'long' END AS rule FROM seen WHERE clip_id NOT IN (SELECT clip_id FROM keyframes WHERE type = 'transform')),
framings AS (SELECT timeline_id, track_id, ord, 1 AS kind_ord, CASE WHEN rule IN ('lands', 'static', 'long') THEN 'addEffect' ELSE 'setSpeed' END AS op, clip_id, CAST(NULL AS BIGINT) AS source_in, CAST(NULL AS BIGINT) AS source_out, CASE WHEN rule IN ('dull', 'slow') THEN CAST(1.5 AS DOUBLE) END AS speed,
  CAST(CASE WHEN rule = 'lands' THEN 1.18 WHEN rule IN ('static', 'long') THEN 1.12 END AS DOUBLE) AS scale_to, CAST(CASE WHEN rule = 'lands' THEN hit_t - start WHEN rule IN ('static', 'long') THEN out_len END AS BIGINT) AS key_t,
  CASE rule WHEN 'lands' THEN 'something lands at ' || printf('%.1f', (hit_t - start) / CAST(1000000 AS DOUBLE)) || 's into the shot; the push arrives with it' WHEN 'dull' THEN 'quiet and static for most of its length' WHEN 'static' THEN 'the picture barely moves for ' || printf('%.1f', still_for / CAST(1000000 AS DOUBLE)) || 's of this shot'
    WHEN 'slow' THEN {sql_round('out_len / CAST(1000000 AS DOUBLE)')} || 's on one shot is a long time to hold' ELSE 'a locked-off shot this long goes dead without some movement' END AS rationale FROM fr0 WHERE rule IS NOT NULL)"""
PROPOSALS = f"WITH RECURSIVE {SEEN}, {KEYFRAMES}, {TRIMS}, {FRAMING}, props AS (SELECT * FROM trims UNION ALL SELECT * FROM framings)"


@query("region_totals", "AG15", sql=f"WITH RECURSIVE {SEEN} SELECT clip_id, CAST(quiet_for AS BIGINT) AS quiet_for, CAST(still_for AS BIGINT) AS still_for, measured, is_first, is_last FROM seen")
def region_totals(spark, d):
    return seen(spark, d).select("clip_id", "quiet_for", "still_for", "measured", "is_first", "is_last")


@query("propose_trims", "L1", "W22", sql=f"{PROPOSALS} SELECT clip_id, source_in, source_out, rationale FROM trims")
def propose_trims(spark, d):
    return pr.propose_trims(seen(spark, d), v.sources(spark, d)).select("clip_id", "source_in", "source_out", "rationale")


@query("propose_framing", "L2", sql=f"{PROPOSALS} SELECT clip_id, op, speed, scale_to, key_t, rationale FROM framings")
def propose_framing(spark, d):
    return pr.propose_framing(seen(spark, d), framed(spark, d)).select("clip_id", "op", "speed", "scale_to", "key_t", "rationale")


def framed(spark, d):
    """Clips that already carry a framing."""
    return v.keyframes(spark, d).where("type = 'transform'")


def plan(spark, d):
    return pr.plan_refinements(seen(spark, d), v.sources(spark, d), framed(spark, d))


@query("plan_refinements", "L3", "T3", sql=f"""{PROPOSALS}, n AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY timeline_id ORDER BY track_id, ord, kind_ord) - 1 AS op_idx FROM props) SELECT timeline_id, op_idx, op, clip_id, source_in, source_out, speed FROM n WHERE op_idx < 4""")
def plan_refinements(spark, d):
    return pr.cap_ops(plan(spark, d), 4).select("timeline_id", v.big("op_idx").alias("op_idx"), "op", "clip_id", "source_in", "source_out", "speed")


@query("plan_summaries", "L3", sql=f"""{PROPOSALS}, pc AS (SELECT timeline_id, count(*) AS n FROM props GROUP BY 1), u AS (SELECT timeline_id, bool_or(quiet_for > 0 OR still_for > 0 OR strength IS NOT NULL) AS used FROM seen GROUP BY 1), j AS (SELECT timeline_id, coalesce(n, 0) AS n, used FROM u LEFT JOIN pc USING (timeline_id))
SELECT timeline_id, n, CASE WHEN n = 0 AND used THEN 'Nothing worth changing — no dead air at the joins and nothing sitting still.' WHEN n = 0 THEN 'Nothing worth changing — the clips are already short and tight.'
  ELSE n || ' suggested ' || CASE WHEN n = 1 THEN 'edit' ELSE 'edits' END || CASE WHEN used THEN ', based on where the footage goes quiet, holds still, or lands a hit.' ELSE ': tightened joins, plus movement on the longer shots.' END END AS summary FROM j""")
def plan_summaries(spark, d):
    return pr.summaries(plan(spark, d), seen(spark, d))

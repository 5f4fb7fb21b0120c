"""Registered queries: projects, recordings, grades, media tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import digest, numeric, rational
from ..functions.numeric import quotient
from ..operators import color, library, media
from ..operators import timeline as tl
from ..operators.scan import ordinals
from . import views as v
from .registry import query
from .timeline_queries import placed
from .join_queries import DURATIONS
from .views import CLIPS, OPS, PROJECTS, RAW_CLIPS, SOURCES, sql_round

MEDIA = """media AS (SELECT 'media/' || doc_id AS path, 'take ' || doc_id || '.' || ['mp4', 'MOV', 'wav', 'xyz'][doc_id % 4 + 1] AS filename, n_chars AS size_bytes, text FROM documents)"""


def files(spark, d):
    rows = v.table(spark, d, "documents")
    ext = F.element_at(F.array(*[F.lit(e) for e in ("mp4", "MOV", "wav", "xyz")]), (F.pmod("doc_id", F.lit(4)) + 1).cast("int"))
    return rows.select(
        F.concat(F.lit("media/"), F.col("doc_id").cast("string")).alias("path"),
        F.concat(F.lit("take "), F.col("doc_id").cast("string"), F.lit("."), ext).alias("filename"), F.col("n_chars").alias("size_bytes"), "text",
    )


@query("heavy_sources", "P7", sql=f"WITH {SOURCES} SELECT source_id FROM sources WHERE coalesce(width, 0) * coalesce(height, 0) >= 3000000 OR duration_us >= 300000000")
def heavy_sources(spark, d):
    return library.heavy_sources(v.sources(spark, d)).select("source_id")


@query("orphaned_media", "J12", "U4", sql=f"WITH {SOURCES}, {MEDIA} SELECT path FROM media WHERE path NOT IN (SELECT locator_path FROM sources WHERE locator_kind = 'opfs')")
def orphaned_media(spark, d):
    return library.orphaned_media(files(spark, d), v.sources(spark, d)).select("path")


@query("missing_media", "J13", sql=f"""WITH {SOURCES}, {MEDIA}
SELECT source_id, coalesce(name, CASE WHEN locator_kind = 'unresolved' THEN locator_filename END, CAST(source_id AS VARCHAR)) AS filename, duration_us
FROM sources WHERE NOT (locator_kind = 'opfs' AND locator_path IN (SELECT path FROM media))""")
def missing_media(spark, d):
    return library.missing_media(v.sources(spark, d), files(spark, d))


@query("rebind_sources", "J15", sql=f"""WITH {SOURCES}
SELECT source_id, CASE WHEN source_id % 4 = 0 THEN 'opfs' ELSE locator_kind END AS locator_kind, CASE WHEN source_id % 4 = 0 THEN 'new/' || source_id ELSE locator_path END AS locator_path,
  CASE WHEN source_id % 4 <> 0 THEN locator_filename END AS locator_filename, CASE WHEN source_id % 4 = 0 THEN 'f' || source_id ELSE content_hash END AS content_hash FROM sources""")
def rebind_sources(spark, d):
    s = v.sources(spark, d)
    new = s.where(F.pmod("source_id", F.lit(4)) == 0).select(
        "source_id", F.concat(F.lit("new/"), F.col("source_id").cast("string")).alias("path"), F.concat(F.lit("f"), F.col("source_id").cast("string")).alias("fingerprint")
    )
    return library.rebind_sources(s, new).select("source_id", "locator_kind", "locator_path", "locator_filename", "content_hash")


@query("bootstrap_projects", "S11", sql=f"""WITH {SOURCES} SELECT source_id, coalesce(name, 'Untitled') AS name, 'coarse' AS stage, CAST(0 AS BIGINT) AS source_in, duration_us AS source_out, CAST(0 AS BIGINT) AS start,
  CASE WHEN width IS NULL THEN 30 ELSE fps_num END AS fps_num, CASE WHEN width IS NULL THEN 1 ELSE fps_den END AS fps_den,
  CASE WHEN width IS NULL THEN 1080 WHEN rotation IN (90, 270) THEN height ELSE width END AS width, CASE WHEN width IS NULL THEN 1920 WHEN rotation IN (90, 270) THEN width ELSE height END AS height FROM sources""")
def bootstrap_projects(spark, d):
    return library.bootstrap_projects(v.sources(spark, d))


@query("project_summaries", "AG2", sql=f"""WITH {RAW_CLIPS}, {PROJECTS}, n AS (SELECT timeline_id, count(*) FILTER (enabled) AS clips FROM raw_clips GROUP BY 1)
SELECT project_id, name, stage, updated_at, coalesce(clips, 0) AS clips FROM projects LEFT JOIN n ON timeline_id = project_id""")
def project_summaries(spark, d):
    return library.project_summaries(v.projects(spark, d), v.raw_clips(spark, d))


RT = "CAST(floor({0} / CAST(1000000 AS DOUBLE) + 0.5) AS BIGINT) // 60 || ':' || printf('%02d', CAST(floor({0} / CAST(1000000 AS DOUBLE) + 0.5) AS BIGINT) % 60)".format


@query("length_standing", "AG17", "F5", sql=f"""WITH {CLIPS}, {PROJECTS}, {DURATIONS},
l AS (SELECT p.project_id, duration_us AS cur, nullif(target_us, 0) AS tgt, duration_us - nullif(target_us, 0) AS over_us FROM dur JOIN projects p ON p.project_id = timeline_id)
SELECT project_id, cur AS current_us, tgt AS target_us, over_us, CASE WHEN tgt IS NULL THEN {RT('cur')} WHEN abs(over_us) < 1000000 THEN {RT('cur')} || ' — on target'
  ELSE {RT('cur')} || ' of ' || {RT('tgt')} || ' — ' || {RT('abs(over_us)')} || CASE WHEN over_us > 0 THEN ' over' ELSE ' under' END END AS label FROM l""")
def length_standing(spark, d):
    return library.length_standing(v.projects(spark, d), tl.timeline_duration(placed(spark, d)))


@query("estimate_render_cost", "P9", sql=f"""WITH {CLIPS}, {PROJECTS}, {DURATIONS},
s AS (SELECT p.*, duration_us, CASE WHEN greatest(width, height) > 1920 THEN CAST(1920 AS DOUBLE) / greatest(width, height) ELSE CAST(1 AS DOUBLE) END AS sc FROM dur d JOIN projects p ON p.project_id = d.timeline_id),
e AS (SELECT *, greatest(2, {sql_round('width * sc / 2')} * 2) AS out_width, greatest(2, {sql_round('height * sc / 2')} * 2) AS out_height FROM s)
SELECT project_id, out_width, out_height, greatest(2000000, {sql_round('out_width * out_height * CAST(0.1 AS DOUBLE) * 30')}) AS bitrate,
  greatest(1, CAST(ceil(duration_us / (CAST(fps_den * 1000000 AS DOUBLE) / fps_num)) AS BIGINT)) AS frames,
  {sql_round('duration_us / CAST(1000000 AS DOUBLE) * 1000000 / 8')} AS proxy_bytes, {sql_round('duration_us / CAST(1000000 AS DOUBLE) * 1000 / 4')} AS proxy_ms FROM e""")
def estimate_render_cost(spark, d):
    return library.estimate_render_cost(v.projects(spark, d), tl.timeline_duration(placed(spark, d)))


@query("mime_types", "S9", sql=f"""WITH {MEDIA} SELECT path, CASE lower(split_part(filename, '.', -1)) WHEN 'mp4' THEN 'video/mp4' WHEN 'mov' THEN 'video/quicktime' WHEN 'wav' THEN 'audio/wav' END AS mime, size_bytes FROM media""")
def mime_types(spark, d):
    return files(spark, d).select("path", library.mime_of("filename").alias("mime"), "size_bytes")


@query("media_fingerprints", "F11", sql=f"""WITH h AS (SELECT doc_id, hex(encode(text)) AS h FROM documents),
f AS (SELECT doc_id, lpad(lower(to_hex(len(h) // 2)), 12, '0') || md5(substr(h, 1, 131072) || CASE WHEN len(h) > 131072 THEN right(h, 131072) ELSE h END) AS fp FROM h)
SELECT fp AS fingerprint, count(*) AS imports, min(doc_id) AS first_id FROM f GROUP BY 1""")
def media_fingerprints(spark, d):
    rows = v.table(spark, d, "documents").select("doc_id", digest.fingerprint(F.encode("text", "UTF-8")).alias("fingerprint"))
    return rows.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("imports"), F.min("doc_id").alias("first_id"))


@query("op_histogram", "AG3", sql=f"WITH {RAW_CLIPS}, {OPS} SELECT op, count(*) AS n FROM ops GROUP BY 1")
def op_histogram(spark, d):
    return library.op_histogram(v.ops(spark, d))


@query("resolve_targets", "J3", sql=f"""WITH {RAW_CLIPS}, {OPS} SELECT o.timeline_id, op_idx, op, c.source_in AS clip_in, CASE WHEN o.clip_id IS NOT NULL AND c.clip_id IS NULL THEN 'no clip ' || o.clip_id || ' on the timeline' END AS reason
FROM ops o LEFT JOIN raw_clips c ON c.timeline_id = o.timeline_id AND c.clip_id = o.clip_id""")
def resolve_targets(spark, d):
    return library.resolve_targets(v.ops(spark, d), v.raw_clips(spark, d)).select("timeline_id", "op_idx", "op", "clip_in", "reason")


@query("drop_noop_trims", "P8", sql=f"""WITH {RAW_CLIPS}, {OPS} SELECT o.timeline_id, op_idx, op FROM ops o LEFT JOIN raw_clips c ON c.timeline_id = o.timeline_id AND c.clip_id = o.clip_id
WHERE NOT coalesce(op = 'trim' AND coalesce(o.source_in, c.source_in) = c.source_in AND coalesce(o.source_out, c.source_out) = c.source_out, false)""")
def drop_noop_trims(spark, d):
    return library.drop_noop_trims(v.ops(spark, d), v.raw_clips(spark, d)).select("timeline_id", "op_idx", "op")


@query("decodable_segments", "J14", sql=f"WITH {RAW_CLIPS} SELECT clip_id FROM raw_clips WHERE enabled AND source_id IN (SELECT user_id FROM events)")
def decodable_segments(spark, d):
    decoded = v.table(spark, d, "events").select(F.col("user_id").alias("source_id"))
    return v.raw_clips(spark, d).where("enabled").join(decoded, "source_id", "left_semi").select("clip_id")


@query("clip_sources", "J1", sql=f"WITH {RAW_CLIPS}, {SOURCES} SELECT clip_id, s.name, duration_us, locator_kind FROM raw_clips c LEFT JOIN sources s USING (source_id)")
def clip_sources(spark, d):
    # AQE broadcasts the source table only while its measured size allows it.
    return v.raw_clips(spark, d).join(v.sources(spark, d), "source_id", "left").select("clip_id", "name", "duration_us", "locator_kind")


# Revisions: the customer's orders in date order are the versions of one document.
REVS = """revs AS (SELECT o_custkey AS project_id, o_orderkey AS revision_id, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS rev_ord FROM orders)"""


def chain(spark, d):
    rows = v.table(spark, d, "orders").select(F.col("o_custkey").alias("project_id"), F.col("o_orderkey").alias("revision_id"), "o_orderdate")
    return ordinals(rows, ["project_id"], ["o_orderdate", "revision_id"], "rev_ord", coarse=F.unix_date(F.col("o_orderdate").cast("date"))).drop("o_orderdate")


@query("parent_chain", "W24", sql=f"WITH {REVS} SELECT project_id, revision_id, lag(revision_id) OVER (PARTITION BY project_id ORDER BY rev_ord) AS parent_id FROM revs")
def parent_chain(spark, d):
    return library.parent_chain(chain(spark, d)).select("project_id", "revision_id", "parent_id")


@query("revision_rollup", "AG19", sql=f"""WITH {REVS}, heads AS (SELECT c_custkey AS project_id, CASE c_custkey % 3 WHEN 0 THEN NULL WHEN 1 THEN (SELECT min(o_orderkey) FROM orders WHERE o_custkey = c_custkey) ELSE -1 END AS head_revision_id FROM customer),
n AS (SELECT project_id, count(*) AS revisions, max_by(revision_id, rev_ord) AS last FROM revs GROUP BY 1)
SELECT h.project_id, coalesce(n.revisions, 0) AS revisions, CASE WHEN head_revision_id IS NULL THEN last WHEN r.revision_id IS NOT NULL THEN head_revision_id END AS head
FROM heads h LEFT JOIN n USING (project_id) LEFT JOIN revs r ON r.project_id = h.project_id AND r.revision_id = head_revision_id""")
def revision_rollup(spark, d):
    first = v.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.min("o_orderkey").alias("first"))
    c = v.table(spark, d, "customer").select(F.col("c_custkey").alias("project_id")).join(first, F.col("project_id") == F.col("k"), "left")
    rule = F.pmod("project_id", F.lit(3))
    heads = c.select("project_id", F.when(rule == 0, None).when(rule == 1, F.col("first")).otherwise(F.lit(-1)).cast("bigint").alias("head_revision_id"))
    return library.revision_rollup(chain(spark, d), heads)


# --- grades ----------------------------------------------------------------------------------

GRADES = """grades AS (SELECT l_orderkey, l_linenumber, l_partkey, l_discount * CAST(20 AS DOUBLE) - 1 AS exposure, CASE l_suppkey % 10 WHEN 0 THEN CAST('NaN' AS DOUBLE) WHEN 1 THEN CAST('Infinity' AS DOUBLE) WHEN 2 THEN NULL ELSE l_tax * CAST(50 AS DOUBLE) - 2 END AS contrast FROM lineitem)"""


def grades(spark, d):
    s = F.pmod("l_suppkey", F.lit(10))
    return v.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", (F.col("l_discount") * 20.0 - 1).alias("exposure"),
        F.when(s == 0, F.lit(float("nan"))).when(s == 1, F.lit(float("inf"))).when(s == 2, F.lit(None)).otherwise(F.col("l_tax") * 50.0 - 2).alias("contrast"),
    )


@query("clamp_grade", "P6", sql=f"""WITH {GRADES} SELECT l_orderkey, l_linenumber, l_partkey, greatest(-1, least(1, exposure)) AS exposure,
  CASE WHEN contrast IS NULL OR isnan(contrast) OR isinf(contrast) THEN CAST(0 AS DOUBLE) ELSE greatest(-1, least(1, contrast)) END AS contrast FROM grades""")
def clamp_grade(spark, d):
    return color.clamp_grade(grades(spark, d), ("exposure", "contrast"))


@query("graded", "P5", sql="SELECT l_returnflag, count(*) AS graded FROM lineitem WHERE l_discount <> 0 OR l_tax <> 0 GROUP BY 1")
def graded(spark, d):
    rows = v.table(spark, d, "lineitem").select("l_returnflag", "l_discount", "l_tax")
    return rows.where(color.is_graded(("l_discount", "l_tax"))).groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("graded"))


RGBA = """rgba AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(abs(CAST(x AS DOUBLE)) * 765) AS BIGINT) % 256) AS p FROM embeddings),
pixels AS (SELECT vec_id AS frame_id, p[4*i+1] AS r, p[4*i+2] AS g, p[4*i+3] AS b, CASE WHEN vec_id % 50 = 0 THEN 0 ELSE p[4*i+4] % 20 END AS a FROM rgba, (SELECT CAST(range AS BIGINT) AS i FROM range(16))),
seen AS (SELECT *, least(255, greatest(0, CAST(floor(r * CAST(0.2126 AS DOUBLE) + g * CAST(0.7152 AS DOUBLE) + b * CAST(0.0722 AS DOUBLE) + 0.5) AS BIGINT))) AS bin FROM pixels WHERE a >= 8),
acc AS (SELECT frame_id, bin, count(*) AS n FROM seen GROUP BY 1, 2), run AS (SELECT *, sum(n) OVER (PARTITION BY frame_id ORDER BY bin) AS s, sum(n) OVER (PARTITION BY frame_id) AS t FROM acc),
pts AS (SELECT frame_id, min(bin) FILTER (s >= t * CAST(0.05 AS DOUBLE)) / CAST(255 AS DOUBLE) AS black, min(bin) FILTER (s >= t * CAST(0.5 AS DOUBLE)) / CAST(255 AS DOUBLE) AS mid, min(bin) FILTER (s >= t * CAST(0.95 AS DOUBLE)) / CAST(255 AS DOUBLE) AS white FROM run GROUP BY 1),
mea AS (SELECT frame_id, avg(CASE WHEN greatest(r, g, b) = 0 THEN CAST(0 AS DOUBLE) ELSE (greatest(r, g, b) - least(r, g, b)) / CAST(greatest(r, g, b) AS DOUBLE) END) AS saturation, avg(r) / 255 AS red, avg(g) / 255 AS green, avg(b) / 255 AS blue FROM seen GROUP BY 1),
stats AS (SELECT e.vec_id AS frame_id, coalesce(black, 0) AS black, coalesce(mid, 0.5) AS mid, coalesce(white, 1) AS white, coalesce(saturation, 0) AS saturation, coalesce(red, 0.5) AS red, coalesce(green, 0.5) AS green, coalesce(blue, 0.5) AS blue
  FROM embeddings e LEFT JOIN pts p ON p.frame_id = e.vec_id LEFT JOIN mea m ON m.frame_id = e.vec_id)"""
STAT_COLS = ("black", "mid", "white", "saturation", "red", "green", "blue")


def rgba(spark, d):
    return v.table(spark, d, "embeddings").select(
        F.col("vec_id").alias("frame_id"), F.transform("embedding", lambda x: F.pmod(F.floor(F.abs(x.cast("double")) * 765), F.lit(256)).cast("bigint")).alias("p")
    )


def pixels(spark, d):
    p = rgba(spark, d).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(15))))
    at = lambda k: F.get("p", F.col("i") * 4 + k)
    return p.select("frame_id", at(0).alias("r"), at(1).alias("g"), at(2).alias("b"), F.when(F.pmod("frame_id", F.lit(50)) == 0, 0).otherwise(F.pmod(at(3), F.lit(20))).alias("a"))


def stats(spark, d):
    return color.frame_stats(pixels(spark, d), rgba(spark, d).select("frame_id"))


@query("frame_stats", "AG11", sql=f"WITH {RGBA} SELECT frame_id, {', '.join(f'round({c}, 9) AS {c}' for c in STAT_COLS)} FROM stats")
def frame_stats(spark, d):
    return stats(spark, d).select("frame_id", *[F.round(c, 9).alias(c) for c in STAT_COLS])


@query("suggest_grade", "P11", sql=f"""WITH {RGBA}, m AS (SELECT *, CASE WHEN red + green + blue = 0 THEN CAST(1 AS DOUBLE) ELSE (red + green + blue) / 3 END AS l FROM stats)
SELECT frame_id, {', '.join(f"greatest(-{lim}, least({lim}, round({e}, 3))) AS {n}" for n, e, lim in (
    ("contrast", "(1 - greatest(CAST(0.05 AS DOUBLE), white - black)) * 0.9", "CAST(0.5 AS DOUBLE)"), ("brilliance", "(0.06 - black) * 1.6", "CAST(0.4 AS DOUBLE)"), ("exposure", "(0.5 - mid) * 0.7", "CAST(0.35 AS DOUBLE)"),
    ("saturation", "greatest(0, 0.32 - saturation) * 1.6", "CAST(0.3 AS DOUBLE)"), ("warmth", "(blue - red) / l * 0.8", "CAST(0.25 AS DOUBLE)"), ("tint", "((red + blue) / 2 - green) / l * 0.8", "CAST(0.2 AS DOUBLE)")))} FROM m""")
def suggest_grade(spark, d):
    return color.suggest_grade(stats(spark, d))


@query("luma", "F12", sql=f"WITH {RGBA} SELECT vec_id AS frame_id, CAST(list_sum(list_transform(range(0, 16), lambda i: (p[4*i+1] * 77 + p[4*i+2] * 150 + p[4*i+3] * 29) // 256)) AS BIGINT) AS total FROM rgba")
def luma(spark, d):
    return rgba(spark, d).select("frame_id", F.aggregate(color.luma(F.col("p")), F.lit(0).cast("bigint"), lambda s, x: s + x).alias("total"))


@query("units", "F1", "F13", sql=f"""WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, CAST((l_extendedprice - 50000) AS DOUBLE) AS x, CAST(l_quantity AS BIGINT) * 1001 AS n, l_partkey + 7 AS m FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, {sql_round('x * 1000000')} AS from_s, {sql_round('x * 1000')} AS from_ms, {sql_round('x * 1000')} / CAST(1000 AS DOUBLE) AS to_ms, n // gcd(n, m) AS num, m // gcd(n, m) AS den FROM r""")
def units(spark, d):
    rows = v.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_extendedprice") - 50000).alias("x"),
                                                (F.col("l_quantity").cast("bigint") * 1001).alias("n"), (F.col("l_partkey") + 7).alias("m"))
    low = rational.reduced("n", "m")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", numeric.seconds_to_micros("x").alias("from_s"), numeric.millis_to_micros("x").alias("from_ms"),
                       numeric.micros_to_millis(numeric.millis_to_micros("x")).alias("to_ms"), low["num"].alias("num"), low["den"].alias("den"))


# --- sample tables of media files: an event is a sample, a user a track ----------------------

SAMPLES = """smp AS (SELECT user_id AS track_id, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS sample_no, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
samples AS (SELECT *, 500 + k * 10 AS size, CASE WHEN k % 10 < 9 THEN 1001 ELSE 2002 END AS delta, sample_no * 2000 + (sample_no // 40) * 700000 AS "offset",
  sample_no * 33366 - 50000 + (k % 5) * 100 AS time_us, CASE WHEN k % 2 = 0 THEN 33000 + k END AS duration_us, [30000, 24000, 48000][track_id % 3 + 1] AS timescale, (track_id % 3) * 1024 AS priming FROM smp)"""


def media_samples(spark, d):
    rows = v.table(spark, d, "events").select("user_id", "event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))
    s = ordinals(rows, ["user_id"], ["event_id"], "n", coarse=quotient("event_id", 1 << 20))
    k, n, t = F.col("k"), F.col("n").cast("bigint"), F.col("user_id")
    return s.select(
        t.alias("track_id"), n.alias("sample_no"), k.alias("k"), (k * 10 + 500).alias("size"), F.when(F.pmod(k, F.lit(10)) < 9, 1001).otherwise(2002).cast("bigint").alias("delta"),
        (n * 2000 + quotient(n, 40) * 700_000).alias("offset"), (n * 33366 - 50000 + F.pmod(k, F.lit(5)) * 100).alias("time_us"), F.when(F.pmod(k, F.lit(2)) == 0, k + 33000).alias("duration_us"),
        F.element_at(F.array(*[v.big(F.lit(x)) for x in (30000, 24000, 48000)]), (F.pmod(t, F.lit(3)) + 1).cast("int")).alias("timescale"), (F.pmod(t, F.lit(3)) * 1024).alias("priming"),
    )


@query("sample_durations", "W16", sql=f"""WITH {SAMPLES}, b AS (SELECT *, {sql_round("(time_us - least(0, min(time_us) OVER (PARTITION BY track_id))) * timescale / CAST(1000000 AS DOUBLE)")} AS start FROM samples),
l AS (SELECT *, lead(start) OVER w AS nx, lag(start) OVER w AS pv FROM b WINDOW w AS (PARTITION BY track_id ORDER BY sample_no))
SELECT track_id, sample_no, start, CASE WHEN nx IS NOT NULL THEN greatest(1, nx - start) ELSE greatest(1, coalesce({sql_round('duration_us * timescale / CAST(1000000 AS DOUBLE)')}, greatest(1, start - pv), 1)) END AS duration FROM l""")
def sample_durations(spark, d):
    return media.sample_durations(media_samples(spark, d)).select("track_id", "sample_no", "start", "duration")


RLE = """ch AS (SELECT *, CASE WHEN lag(delta) OVER w = delta THEN 0 ELSE 1 END AS c FROM samples WINDOW w AS (PARTITION BY track_id ORDER BY sample_no)),
rn AS (SELECT *, sum(c) OVER (PARTITION BY track_id ORDER BY sample_no) - 1 AS run_no FROM ch),
runs AS (SELECT track_id, CAST(run_no AS BIGINT) AS run_no, count(*) AS "count", any_value(delta) AS "value" FROM rn GROUP BY 1, 2)"""


def runs(spark, d):
    return media.rle_encode(media_samples(spark, d), ["track_id"], "sample_no", "delta")


@query("rle_encode", "W17", sql=f'WITH {SAMPLES}, {RLE} SELECT track_id, run_no, "count", "value" FROM runs')
def rle_encode(spark, d):
    return runs(spark, d).withColumn("run_no", v.big("run_no"))


@query("rle_expand", "W17", sql=f"""WITH {SAMPLES}, n AS (SELECT track_id, count(*) AS have, greatest(0, count(*) + (track_id % 7) * 5 - 10) AS want, max_by(delta, sample_no) AS last FROM samples GROUP BY 1),
cut AS (SELECT n.*, max_by(delta, sample_no) AS lastcut FROM n JOIN samples s ON s.track_id = n.track_id AND sample_no < want GROUP BY ALL)
SELECT track_id, sample_no, delta AS "value" FROM samples JOIN n USING (track_id) WHERE sample_no < want
UNION ALL SELECT track_id, unnest(range(have, want)), lastcut FROM cut WHERE want > have""")
def rle_expand(spark, d):
    sizes = media_samples(spark, d).groupBy("track_id").agg(F.greatest(F.lit(0).cast("bigint"), F.count(F.lit(1)) + F.pmod("track_id", F.lit(7)) * 5 - 10).alias("samples"))
    return media.rle_expand(runs(spark, d), sizes, ["track_id"])


@query("sample_clock", "W18", sql=f"""WITH {SAMPLES}, c AS (SELECT *, coalesce(sum(delta) OVER (PARTITION BY track_id ORDER BY sample_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) - priming AS x FROM samples)
SELECT track_id, sample_no, {sql_round('CAST(x AS DOUBLE) * 1000000 / timescale')} AS time_us, {sql_round('CAST(delta AS DOUBLE) * 1000000 / timescale')} AS duration_us FROM c""")
def sample_clock(spark, d):
    s = media_samples(spark, d)
    clock = media.sample_clock(s.select("track_id", "sample_no", "delta"), s.select("track_id", "timescale", "priming").distinct())
    return clock.select("track_id", "sample_no", "time_us", "duration_us")


@query("gop_id", "W19", sql=f"""WITH {SAMPLES}, f AS (SELECT *, track_id % 3 = 0 OR k % 8 = 0 AS is_key FROM samples)
SELECT track_id, sample_no, is_key, CAST(sum(CASE WHEN is_key THEN 1 ELSE 0 END) OVER (PARTITION BY track_id ORDER BY sample_no) AS BIGINT) AS gop FROM f WHERE track_id % 3 = 0 OR EXISTS (SELECT 1 FROM samples s WHERE s.track_id = f.track_id AND s.k % 8 = 0)
UNION ALL SELECT track_id, sample_no, true, sample_no + 1 FROM f WHERE NOT (track_id % 3 = 0 OR EXISTS (SELECT 1 FROM samples s WHERE s.track_id = f.track_id AND s.k % 8 = 0))""")
def gop_id(spark, d):
    s = media_samples(spark, d)
    sync = s.where((F.pmod("track_id", F.lit(3)) != 0) & (F.pmod("k", F.lit(8)) == 0)).select("track_id", "sample_no")
    return media.gop_id(s, sync).select("track_id", "sample_no", "is_key", "gop")


CHUNKS = """cr AS (SELECT track_id, sample_no + 1 AS first_chunk, 1 + k % 4 AS per_chunk FROM samples WHERE sample_no = 0 OR k % 10 = 0),
lay AS (SELECT s.track_id, s.sample_no AS chunk_no, s.sample_no * 100000 AS "offset", r.per_chunk FROM samples s ASOF JOIN cr r ON r.track_id = s.track_id AND s.sample_no + 1 >= r.first_chunk)"""


def chunks(spark, d):
    s = media_samples(spark, d)
    layout = s.where((F.col("sample_no") == 0) | (F.pmod("k", F.lit(10)) == 0)).select("track_id", (F.col("sample_no") + 1).alias("first_chunk"), (F.pmod("k", F.lit(4)) + 1).alias("per_chunk"))
    return media.chunk_layout(s.select("track_id", F.col("sample_no").alias("chunk_no"), (F.col("sample_no") * 100_000).alias("offset")), layout)


@query("chunk_layout", "J17", sql=f'WITH {SAMPLES}, {CHUNKS} SELECT track_id, chunk_no, "offset", per_chunk FROM lay')
def chunk_layout(spark, d):
    return chunks(spark, d)


@query("sample_offsets", "W18", sql=f"""WITH {SAMPLES}, {CHUNKS}, f AS (SELECT *, sum(per_chunk) OVER (PARTITION BY track_id ORDER BY chunk_no) - per_chunk AS first FROM lay),
p AS (SELECT s.track_id, sample_no, size, chunk_no, f."offset" AS o FROM samples s JOIN f ON f.track_id = s.track_id AND s.sample_no >= first AND s.sample_no < first + per_chunk)
SELECT track_id, sample_no, chunk_no, CAST(o + coalesce(sum(size) OVER (PARTITION BY track_id, chunk_no ORDER BY sample_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM p""")
def sample_offsets(spark, d):
    return media.sample_offsets(chunks(spark, d), media_samples(spark, d).select("track_id", "sample_no", "size")).select("track_id", "sample_no", "chunk_no", "offset")


@query("samples_in_window", "J11", sql=f"""WITH {SAMPLES}, t AS (SELECT track_id, sample_no, sample_no * 33366 AS time_us, 33000 AS duration_us FROM samples),
w AS (SELECT event_id AS window_id, user_id AS track_id, (event_id * 7919) % 4000000 AS from_us, (event_id * 7919) % 4000000 + 300000 AS to_us FROM events),
m AS (SELECT w.*, (SELECT min(sample_no) FROM t WHERE t.track_id = w.track_id AND time_us + duration_us > from_us) AS first FROM w),
f AS (SELECT *, greatest(0, first - 2) AS lo FROM m WHERE first IS NOT NULL)
SELECT window_id, t.track_id, sample_no FROM f JOIN t ON t.track_id = f.track_id AND sample_no >= lo AND time_us < to_us""")
def samples_in_window(spark, d):
    t = media_samples(spark, d).select("track_id", "sample_no", (F.col("sample_no") * 33366).alias("time_us"), F.lit(33000).alias("duration_us"))
    # A window per event, over the whole length of its track and beyond.
    begin = F.pmod(F.col("event_id") * 7919, F.lit(4_000_000))
    w = v.table(spark, d, "events").select(F.col("event_id").alias("window_id"), F.col("user_id").alias("track_id"), begin.alias("from_us"), (begin + 300_000).alias("to_us"))
    return media.samples_in_window(t, w).select("window_id", "track_id", "sample_no")


@query("coalesce_reads", "W20", sql=f"""WITH RECURSIVE {SAMPLES}, g AS (SELECT track_id, sample_no, "offset" AS b, "offset" + size AS e, lag("offset" + size) OVER (PARTITION BY track_id ORDER BY sample_no) AS pe FROM samples),
walk AS (SELECT track_id, sample_no, b, e, sample_no AS read_no, b AS rb FROM g WHERE sample_no = 0
  UNION ALL SELECT g.track_id, g.sample_no, g.b, g.e, CASE WHEN g.b - g.pe < 0 OR g.b - g.pe > 300000 OR g.e - w.rb > 20000 THEN g.sample_no ELSE w.read_no END, CASE WHEN g.b - g.pe < 0 OR g.b - g.pe > 300000 OR g.e - w.rb > 20000 THEN g.b ELSE w.rb END
  FROM walk w JOIN g ON g.track_id = w.track_id AND g.sample_no = w.sample_no + 1)
SELECT track_id, sample_no, read_no FROM walk""")
def coalesce_reads(spark, d):
    s = media_samples(spark, d).select("track_id", "sample_no", "offset", "size")
    return media.coalesce_reads(s, max_gap=300_000, max_span=20_000).select("track_id", "sample_no", "read_no")


@query("modal_frame_rate", "AG12", "F13", sql=f"""WITH {SAMPLES}, r AS (SELECT track_id, sample_no AS run_no, k % 5 AS n, CASE WHEN k % 10 < 8 THEN 1001 ELSE 1000 * (k % 3) END AS delta, timescale FROM samples),
g AS (SELECT track_id, delta, any_value(timescale) AS timescale, sum(n) AS n, min(run_no) AS seen FROM r WHERE n > 0 AND delta > 0 GROUP BY 1, 2),
o AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY track_id ORDER BY n DESC, seen) AS k, sum(n) OVER (PARTITION BY track_id) AS frames FROM g)
SELECT track_id, timescale // gcd(timescale, delta) AS num, delta // gcd(timescale, delta) AS den, n / CAST(frames AS DOUBLE) AS share, n / CAST(frames AS DOUBLE) < 0.9 AS variable, CAST(frames AS BIGINT) AS frames
FROM o WHERE k = 1 AND timescale / CAST(delta AS DOUBLE) BETWEEN 1 AND 1000""")
def modal_frame_rate(spark, d):
    s = media_samples(spark, d)
    delta = F.when(F.pmod("k", F.lit(10)) < 8, 1001).otherwise(F.pmod("k", F.lit(3)) * 1000).cast("bigint")
    table = s.select("track_id", F.col("sample_no").alias("run_no"), F.pmod("k", F.lit(5)).alias("count"), delta.alias("delta"))
    return media.modal_frame_rate(table, s.select("track_id", "timescale").distinct())


@query("drop_non_monotonic", "W25", sql="""WITH s AS (SELECT user_id AS track_id, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS frame_no, CAST(floor(value * 1000) AS BIGINT) + event_id * 20 AS time_us FROM events),
m AS (SELECT *, max(time_us) OVER (PARTITION BY track_id ORDER BY frame_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mx FROM s)
SELECT track_id, frame_no, time_us, mx IS NULL OR time_us > mx AS kept FROM m""")
def drop_non_monotonic(spark, d):
    rows = v.table(spark, d, "events").select(F.col("user_id").alias("track_id"), "event_id", (F.floor(F.col("value") * 1000).cast("bigint") + F.col("event_id") * 20).alias("time_us"))
    frames = ordinals(rows, ["track_id"], ["event_id"], "frame_no", coarse=quotient("event_id", 1 << 20)).drop("event_id")
    return media.drop_non_monotonic(frames.withColumn("frame_no", v.big("frame_no")))

"""Registered queries: levels, transients, quiet and still stretches."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import quotient
from ..operators import signals as s
from ..operators import stats
from . import views as v
from .registry import query
from .views import LEVEL_HOP_US, LEVELS, SOURCES, sql_round

HOP = LEVEL_HOP_US
# One second either side, in hops.
WINDOW = max(3, int(1_000_000 / HOP + 0.5))

RISES = LEVELS + """,
rises AS (SELECT *, coalesce(greatest(0, db - lag(db) OVER (PARTITION BY source_id ORDER BY hop)), 0) AS rise FROM levels)"""
CANDIDATES = RISES + f""",
around AS (SELECT *, lag(rise) OVER w AS a, lead(rise) OVER w AS b,
    quantile_cont(rise, 0.5) OVER (PARTITION BY source_id ORDER BY hop ROWS BETWEEN {WINDOW} PRECEDING AND {WINDOW - 1} FOLLOWING) AS local_median
  FROM rises WINDOW w AS (PARTITION BY source_id ORDER BY hop)),
cand AS (SELECT * FROM around WHERE rise >= a AND rise >= b AND rise >= greatest(local_median * 2 + 3, 3))"""
# The scan below keeps one hop a second apart; at 0.25 s hops the gap is one hop, so a longer one is used.
GAP_MS = 1500
ONSETS = CANDIDATES + f""",
tops AS (SELECT source_id, max(rise) AS top FROM rises GROUP BY 1),
c AS (SELECT source_id, hop * {HOP} AS t, floor(rise / top * 1000 + 0.5) / 1000 AS strength, ROW_NUMBER() OVER (PARTITION BY source_id ORDER BY hop) AS n
  FROM cand JOIN tops USING (source_id)),
walk AS (
  SELECT source_id, n, t, strength, 1 AS g FROM c WHERE n = 1
  UNION ALL SELECT w.source_id, c.n,
    CASE WHEN c.t - w.t < {GAP_MS * 1000} AND c.strength <= w.strength THEN w.t ELSE c.t END,
    CASE WHEN c.t - w.t < {GAP_MS * 1000} AND c.strength <= w.strength THEN w.strength ELSE c.strength END,
    CASE WHEN c.t - w.t < {GAP_MS * 1000} THEN w.g ELSE w.g + 1 END
  FROM walk w JOIN c ON c.source_id = w.source_id AND c.n = w.n + 1),
onsets AS (SELECT source_id, max_by(t, n) AS t, max_by(strength, n) AS strength FROM walk GROUP BY source_id, g)"""
MEDIANS = "med AS (SELECT source_id, quantile_cont(db, 0.5) AS median_db, greatest(max(db), -100) AS peak_db, count(*) AS hops FROM levels GROUP BY 1)"
QUIET = MEDIANS + f""",
qm AS (SELECT l.*, db < greatest(median_db - 18, -99) AS m FROM levels l JOIN med USING (source_id)),
qi AS (SELECT *, hop - ROW_NUMBER() OVER (PARTITION BY source_id ORDER BY hop) AS g FROM qm WHERE m),
quiet AS (SELECT source_id, min(hop) * {HOP} AS start, (max(hop) + 1) * {HOP} AS "end" FROM qi GROUP BY source_id, g HAVING (max(hop) + 1 - min(hop)) * {HOP} >= 600000)"""


@query("level_rise", "W2", sql=f"WITH {RISES} SELECT source_id, hop, rise FROM rises")
def level_rise(spark, d):
    return s.level_rise(v.levels(spark, d)).select("source_id", "hop", "rise")


@query("local_peaks", "W3", sql=f"""WITH {RISES}, a AS (SELECT *, lag(rise) OVER w AS a, lead(rise) OVER w AS b FROM rises WINDOW w AS (PARTITION BY source_id ORDER BY hop))
SELECT source_id, hop, rise FROM a WHERE rise >= a AND rise >= b""")
def local_peaks(spark, d):
    return s.local_peaks(s.level_rise(v.levels(spark, d))).select("source_id", "hop", "rise")


@query("onset_candidates", "W4", sql=f"WITH {CANDIDATES} SELECT source_id, hop, rise, local_median FROM cand")
def onset_candidates(spark, d):
    return s.onset_candidates(v.levels(spark, d)).select("source_id", "hop", "rise", "local_median")


def found(spark, d):
    return s.detect_onsets(v.levels(spark, d), GAP_MS)


@query("detect_onsets", "W5", sql="WITH RECURSIVE " + ONSETS + " SELECT source_id, t, strength FROM onsets")
def detect_onsets(spark, d):
    return found(spark, d)


KEPT = f"""
mins AS (SELECT source_id, count(*) * {HOP} / CAST(60000000 AS DOUBLE) AS minutes FROM levels GROUP BY 1),
kept AS (SELECT o.*, ROW_NUMBER() OVER (PARTITION BY source_id ORDER BY strength DESC, t) AS r,
  greatest(4, {sql_round('greatest(minutes, CAST(1 AS DOUBLE) / 60) * 12')}) AS keep FROM onsets o JOIN mins USING (source_id))"""


@query("strongest_onsets", "T1", sql=f"WITH RECURSIVE {ONSETS}, {KEPT} SELECT source_id, t, strength FROM kept WHERE r <= keep")
def strongest_onsets(spark, d):
    levels = v.levels(spark, d)
    return s.strongest(s.detect_onsets(levels, GAP_MS), s.minutes_of(levels)).select("source_id", "t", "strength")


@query("source_levels", "AG7", sql=f"WITH {LEVELS}, {MEDIANS} SELECT source_id, peak_db, median_db, hops FROM med")
def source_levels(spark, d):
    return s.source_levels(v.levels(spark, d)).drop("hop_us")


@query("percentile_lower", "AG8", sql=f"""WITH {LEVELS}, r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY source_id ORDER BY db) - 1 AS k, count(*) OVER (PARTITION BY source_id) AS n FROM levels)
SELECT source_id, db AS p90_db FROM r WHERE k = least(n - 1, CAST(floor(n * CAST(0.9 AS DOUBLE)) AS BIGINT))""")
def percentile_lower(spark, d):
    return stats.percentile_lower(v.levels(spark, d), ["source_id"], "db", 0.9, "p90_db")


@query("quiet_runs", "W6", "W7", sql=f'WITH {LEVELS}, {QUIET} SELECT source_id, start, "end" FROM quiet')
def quiet_runs(spark, d):
    return s.quiet_runs(v.levels(spark, d))


# --- motion: an embedding read as an 8x8 frame, some of them dark ----------------------------


def luma_frames(spark, d):
    pixel = lambda x: F.pmod(F.floor(F.abs(x.cast("double")) * 255), F.lit(256))
    dark = F.pmod(quotient("vec_id", 37), F.lit(2)) == 1
    return v.table(spark, d, "embeddings").select(
        F.col("label").cast("bigint").alias("source_id"), (F.col("vec_id") * 1_000_000).alias("t"),
        F.lit(8).alias("width"), F.lit(8).alias("height"),
        F.transform("embedding", lambda x: F.when(dark, F.lit(0)).otherwise(pixel(x)).cast("bigint")).alias("luma"),
    )


FRAMES = """px AS (SELECT CAST(label AS BIGINT) AS source_id, vec_id * 1000000 AS t,
    CASE WHEN (vec_id // 37) % 2 = 1 THEN list_transform(embedding, lambda x: CAST(0 AS BIGINT))
      ELSE list_transform(embedding, lambda x: CAST(floor(abs(CAST(x AS DOUBLE)) * 255) AS BIGINT) % 256) END AS luma FROM embeddings),
pl AS (SELECT *, lag(luma) OVER w AS pluma, ROW_NUMBER() OVER w - 1 AS idx FROM px WINDOW w AS (PARTITION BY source_id ORDER BY t)),
df AS (SELECT *, CASE WHEN pluma IS NOT NULL THEN CAST(list_sum(list_transform(range(1, len(luma) + 1), lambda i: abs(luma[i] - pluma[i]))) AS BIGINT) / (len(luma) * CAST(255 AS DOUBLE)) END AS dd FROM pl),
sp AS (SELECT source_id, greatest(1, CAST(floor((max(t) - min(t)) / CAST(count(*) - 1 AS DOUBLE) + 0.5) AS BIGINT)) AS hop_us, min(t) AS t0 FROM px GROUP BY 1 HAVING count(*) >= 2),
motion AS (SELECT source_id, t, idx, hop_us, t0, coalesce(dd, lead(dd) OVER (PARTITION BY source_id ORDER BY t), 0) AS motion FROM df JOIN sp USING (source_id)),
typ AS (SELECT source_id, greatest(0.004, quantile_cont(motion, 0.5)) AS typical FROM motion WHERE idx > 0 GROUP BY 1)"""
STILL = FRAMES + """,
sm AS (SELECT *, idx - ROW_NUMBER() OVER (PARTITION BY source_id ORDER BY idx) AS g FROM motion JOIN typ USING (source_id) WHERE motion < typical * CAST(0.4 AS DOUBLE)),
runs AS (SELECT source_id, min(idx) * any_value(hop_us) AS a, (max(idx) + 1) * any_value(hop_us) AS b, any_value(hop_us) AS h, any_value(t0) AS t0 FROM sm GROUP BY source_id, g),
still AS (SELECT source_id, greatest(t0, t0 + a - h) AS start, greatest(t0, t0 + b - h) AS "end" FROM runs WHERE b - a >= 1500000)"""


@query("frame_motion", "W8", sql=f"WITH {FRAMES} SELECT source_id, t, idx, hop_us, floor(motion * 10000 + 0.5) / 10000 AS motion FROM motion")
def frame_motion(spark, d):
    m = s.frame_motion(luma_frames(spark, d))
    return m.select("source_id", "t", "idx", "hop_us", (F.floor(F.col("motion") * 10000 + 0.5) / 10000).alias("motion"))


@query("typical_motion", "AG10", sql=f"WITH {FRAMES} SELECT source_id, round(typical, 9) AS typical FROM typ")
def typical_motion(spark, d):
    t = s.typical_motion(s.frame_motion(luma_frames(spark, d)))
    return t.select("source_id", F.round("typical", 9).alias("typical"))


@query("still_runs", "W9", sql=f'WITH {STILL} SELECT source_id, start, "end" FROM still')
def still_runs(spark, d):
    return s.still_runs(s.frame_motion(luma_frames(spark, d)))


@query("signals_report", "AG18", sql=f"""WITH RECURSIVE {ONSETS}, {KEPT}, {QUIET}, {STILL},
oc AS (SELECT source_id, count(*) AS n FROM kept WHERE r <= keep GROUP BY 1), qc AS (SELECT source_id, count(*) AS n FROM quiet GROUP BY 1), sc AS (SELECT source_id, count(*) AS n FROM still GROUP BY 1)
SELECT m.source_id, hops, coalesce(oc.n, 0) AS onsets, coalesce(qc.n, 0) AS quiet, coalesce(sc.n, 0) AS still,
  floor(peak_db * 10 + 0.5) / 10 AS peak_db, floor(median_db * 10 + 0.5) / 10 AS median_db
FROM med m LEFT JOIN oc USING (source_id) LEFT JOIN qc USING (source_id) LEFT JOIN sc USING (source_id)""")
def signals_report(spark, d):
    levels = v.levels(spark, d)
    onsets = s.strongest(s.detect_onsets(levels, GAP_MS), s.minutes_of(levels))
    return s.signals_report(levels, onsets, s.quiet_runs(levels), s.still_runs(s.frame_motion(luma_frames(spark, d))))


# --- samples: an embedding read as 64 audio samples ------------------------------------------


def samples(spark, d):
    rows = v.table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "x"))
    return rows.select(
        quotient("vec_id", 50).alias("source_id"), F.col("vec_id"), F.col("pos").cast("bigint").alias("pos"),
        (F.pmod("vec_id", F.lit(50)) * 64 + F.col("pos")).alias("i"), F.col("x").cast("double").alias("x"),
    )


SAMPLES = """samples AS (SELECT vec_id // 50 AS source_id, vec_id, p - 1 AS pos, (vec_id % 50) * 64 + p - 1 AS i, CAST(embedding[p] AS DOUBLE) AS x
  FROM embeddings, (SELECT CAST(range AS BIGINT) AS p FROM range(1, 65)))"""


@query("rms_levels", "AG4", sql=f"""WITH {SAMPLES}, r AS (SELECT source_id, i // 80 AS hop, sqrt(sum(x * x) / count(*)) AS rms FROM samples GROUP BY 1, 2)
SELECT source_id, hop, round(CASE WHEN rms > 0 THEN greatest(-100, 20 * log10(rms)) ELSE -100 END, 6) AS db FROM r""")
def rms_levels(spark, d):
    return s.rms_levels(samples(spark, d), 80).select("source_id", "hop", F.round("db", 6).alias("db"))


@query("downmix", "AG6", sql=f"""WITH {SAMPLES} SELECT source_id, i // 2 AS i, round(sum(x / 2), 9) AS x FROM samples GROUP BY 1, 2""")
def downmix(spark, d):
    stereo = samples(spark, d).select("source_id", quotient("i", 2).alias("i"), F.pmod("i", F.lit(2)).alias("channel"), "x", F.lit(2).alias("channels"))
    return s.downmix(stereo).select("source_id", "i", F.round("x", 9).alias("x"))


@query("rms_decimate", "AG5", sql=f"""WITH {SAMPLES},
b AS (SELECT source_id, CAST(floor((vec_id % 50) * 12000 / CAST(1000000 AS DOUBLE) * 2000 + pos * (CAST(2000 AS DOUBLE) / 8000)) AS BIGINT) AS block, sqrt(sum(x * x) / count(*)) AS rms FROM samples GROUP BY 1, 2),
spine AS (SELECT DISTINCT source_id, CAST(range AS BIGINT) AS block FROM samples, range(0, CAST(ceil(600000 / CAST(1000000 AS DOUBLE) * 2000) AS BIGINT) + 1))
SELECT source_id, block, round(coalesce(rms, 0), 9) AS x FROM spine LEFT JOIN b USING (source_id, block)""")
def rms_decimate(spark, d):
    rows = samples(spark, d).select("source_id", (F.pmod("vec_id", F.lit(50)) * 12000).alias("ts_us"), F.lit(8000).alias("sample_rate"), F.col("pos").alias("i"), "x")
    span = rows.select("source_id").distinct().select("source_id", F.lit(0).cast("bigint").alias("from_us"), F.lit(600_000).cast("bigint").alias("to_us"))
    return s.rms_decimate(rows, span).select("source_id", "block", F.round("x", 9).alias("x"))


@query("pending_sources", "S10", sql=f"""WITH {SOURCES}, derived AS (SELECT DISTINCT coalesce(content_hash, CAST(source_id AS VARCHAR)) AS cache_key,
  CASE WHEN source_id % 4 = 0 THEN 4 ELSE 3 END AS version FROM sources WHERE source_id % 2 = 0)
SELECT source_id, coalesce(content_hash, CAST(source_id AS VARCHAR)) AS cache_key FROM sources
WHERE coalesce(content_hash, CAST(source_id AS VARCHAR)) NOT IN (SELECT cache_key FROM derived WHERE version = 4)""")
def pending_sources(spark, d):
    rows = v.sources(spark, d)
    derived = rows.where(F.pmod("source_id", F.lit(2)) == 0).select(
        F.coalesce("content_hash", F.col("source_id").cast("string")).alias("cache_key"),
        F.when(F.pmod("source_id", F.lit(4)) == 0, 4).otherwise(3).alias("version"),
    )
    return s.pending_sources(rows, derived).select("source_id", "cache_key")

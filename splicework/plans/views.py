"""The given tables read as editing data: one Spark builder and one SQL text per view.

The two sides of a view must produce the same rows; nothing here selects a subset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.scan import is_light, marked, ordinals


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql_round(x: str) -> str:
    return f"CAST(floor(CAST({x} AS DOUBLE) + 0.5) AS BIGINT)"


def big(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("bigint")


# --- clips: one row per line item ------------------------------------------------------------

_CLIP_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity", "l_discount", "l_tax"]


def raw_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clips with their stored start; ``ord`` is the dense position within the timeline."""
    # The flag only tells equal lines apart. With it in the order, all who read clips shuffle the same columns, and so do it once.
    order = [*_CLIP_ORDER, "l_returnflag"]
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", *order)
    # Rises along the order: line number first, then the part range.
    coarse = F.shiftleft(big("l_linenumber"), 40) + F.call_function("div", big("l_partkey"), F.lit(512))
    placed = ordinals(lines, ["l_orderkey"], order, "ord", coarse=coarse)
    line, supp, part = big("l_linenumber"), F.col("l_suppkey"), F.col("l_partkey")
    track = F.greatest(F.lit(0).cast("bigint"), line - 5)
    source_in = line * 1_000_000 + F.pmod(supp * 7919, F.lit(1_000_000))
    empty = (F.round(F.col("l_discount") * 100) == 10) & (F.round(F.col("l_tax") * 100) == 8)
    clips = placed.select(
        F.col("l_orderkey").alias("timeline_id"),
        track.alias("track_id"),
        F.element_at(F.array(F.lit("video"), F.lit("audio"), F.lit("overlay")), track.cast("int") + 1).alias("kind"),
        big("ord").alias("ord"),
        F.concat_ws("_", F.lit("clp"), F.col("l_orderkey").cast("string"), big("ord").cast("string")).alias("clip_id"),
        part.alias("source_id"),
        source_in.alias("source_in"),
        (source_in + F.when(empty, F.lit(0)).otherwise(big("l_quantity") * 1_000_000)).cast("bigint").alias("source_out"),
        (F.pmod(part, F.lit(60)) * 1_000_000).alias("start"),
        F.element_at(F.array(*[F.lit(s) for s in (0.5, 1.0, 2.0, 4.0)]), (F.pmod(supp, F.lit(4)) + 1).cast("int")).alias("speed"),
        (F.col("l_returnflag") != "R").alias("enabled"),
        (F.col("l_discount") * F.lit(10.0)).alias("gain"),
        (F.round(F.col("l_tax") * 100) == 7).alias("mute"),
        F.when(F.pmod(line, F.lit(3)) == 0, F.concat(F.lit("take "), supp.cast("string"))).alias("label"),
    )
    # Ids hold the position within the timeline, so each has one row.
    return marked(clips, "clip_id", 1) if is_light(clips, ["timeline_id"]) else clips


RAW_CLIPS = """raw_clips AS (
  SELECT timeline_id, track_id, ['video','audio','overlay'][track_id + 1] AS kind, ord,
    'clp_' || timeline_id || '_' || ord AS clip_id, source_id, source_in,
    CAST(source_in + CASE WHEN round(l_discount * 100) = 10 AND round(l_tax * 100) = 8 THEN 0 ELSE CAST(l_quantity AS BIGINT) * 1000000 END AS BIGINT) AS source_out,
    (source_id % 60) * 1000000 AS start,
    CAST([0.5, 1.0, 2.0, 4.0][(l_suppkey % 4) + 1] AS DOUBLE) AS speed,
    l_returnflag <> 'R' AS enabled, l_discount * CAST(10 AS DOUBLE) AS gain, round(l_tax * 100) = 7 AS mute,
    CASE WHEN l_linenumber % 3 = 0 THEN 'take ' || l_suppkey END AS label
  FROM (SELECT *, l_orderkey AS timeline_id, l_partkey AS source_id,
      CAST(greatest(0, l_linenumber - 5) AS BIGINT) AS track_id,
      CAST(l_linenumber AS BIGINT) * 1000000 + (l_suppkey * 7919) % 1000000 AS source_in,
      ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate,
        l_extendedprice, l_quantity, l_discount, l_tax) - 1 AS ord
    FROM lineitem))"""

# Lengths, then positions after a reflow (empty clips gone, video contiguous).
SIZED_CLIPS = RAW_CLIPS + f""",
sized_clips AS (
  SELECT *, greatest(0, source_out - source_in) AS source_len,
    {sql_round("greatest(0, source_out - source_in) / speed")} AS out_len FROM raw_clips)"""

CLIPS = SIZED_CLIPS + """,
clips AS (
  SELECT timeline_id, track_id, kind,
    CASE WHEN kind = 'video' THEN ord ELSE min(ord) OVER (PARTITION BY timeline_id, track_id) + ROW_NUMBER() OVER (PARTITION BY timeline_id, track_id ORDER BY start, clip_id) - 1 END AS ord,
    clip_id, source_id, source_in, source_out,
    CASE WHEN kind = 'video' THEN CAST(coalesce(sum(CASE WHEN enabled THEN out_len ELSE 0 END) OVER (
      PARTITION BY timeline_id, track_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT)
      ELSE start END AS start,
    speed, enabled, gain, mute, label, source_len, out_len
  FROM sized_clips WHERE source_out > source_in)"""


# --- sources ---------------------------------------------------------------------------------

_RATES = [(30, 1), (30000, 1001), (24, 1), (60, 1)]


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    key = F.col("p_partkey")
    kind = F.pmod(key, F.lit(4))
    at = (kind + 1).cast("int")
    locator = F.pmod(key, F.lit(5))
    return part.select(
        key.alias("source_id"),
        F.when(F.pmod(key, F.lit(7)) != 0, F.col("p_name")).alias("name"),
        ((big("p_size") + 10) * 1_000_000 + key).alias("duration_us"),
        F.when(F.pmod(key, F.lit(11)) != 0, F.element_at(F.array(*[big(F.lit(v)) for v in (1920, 3840, 1280, 1080)]), at)).alias("width"),
        F.when(F.pmod(key, F.lit(11)) != 0, F.element_at(F.array(*[big(F.lit(v)) for v in (1080, 2160, 720, 1920)]), at)).alias("height"),
        F.element_at(F.array(*[big(F.lit(n)) for n, _ in _RATES]), at).alias("fps_num"),
        F.element_at(F.array(*[big(F.lit(d)) for _, d in _RATES]), at).alias("fps_den"),
        (F.pmod(F.call_function("div", key, F.lit(4)), F.lit(4)) * 90).alias("rotation"),
        F.element_at(F.array(*[F.lit(v) for v in ("opfs", "opfs", "url", "object", "unresolved")]), (locator + 1).cast("int")).alias("locator_kind"),
        F.when(locator <= 1, F.concat(F.lit("media/"), key.cast("string"))).alias("locator_path"),
        F.when(locator == 4, F.concat(F.lit("lost-"), key.cast("string"), F.lit(".mov"))).alias("locator_filename"),
        F.when(F.pmod(key, F.lit(3)) != 0, F.concat(F.lit("h"), F.pmod(key, F.lit(1500)).cast("string"))).alias("content_hash"),
    )


SOURCES = """sources AS (
  SELECT p_partkey AS source_id, CASE WHEN p_partkey % 7 <> 0 THEN p_name END AS name,
    (CAST(p_size AS BIGINT) + 10) * 1000000 + p_partkey AS duration_us,
    CASE WHEN p_partkey % 11 <> 0 THEN CAST([1920, 3840, 1280, 1080][p_partkey % 4 + 1] AS BIGINT) END AS width,
    CASE WHEN p_partkey % 11 <> 0 THEN CAST([1080, 2160, 720, 1920][p_partkey % 4 + 1] AS BIGINT) END AS height,
    CAST([30, 30000, 24, 60][p_partkey % 4 + 1] AS BIGINT) AS fps_num,
    CAST([1, 1001, 1, 1][p_partkey % 4 + 1] AS BIGINT) AS fps_den,
    (p_partkey // 4) % 4 * 90 AS rotation,
    ['opfs', 'opfs', 'url', 'object', 'unresolved'][p_partkey % 5 + 1] AS locator_kind,
    CASE WHEN p_partkey % 5 <= 1 THEN 'media/' || p_partkey END AS locator_path,
    CASE WHEN p_partkey % 5 = 4 THEN 'lost-' || p_partkey || '.mov' END AS locator_filename,
    CASE WHEN p_partkey % 3 <> 0 THEN 'h' || (p_partkey % 1500) END AS content_hash
  FROM part)"""


# --- projects: one per order; the timeline carries the same id -------------------------------


def projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_custkey")
    key = F.col("o_orderkey")
    at = (F.pmod(key, F.lit(4)) + 1).cast("int")
    target = F.floor(F.col("o_totalprice") * 1000).cast("bigint")
    return orders.select(
        key.alias("project_id"),
        F.concat(F.lit("Cut "), key.cast("string")).alias("name"),
        F.when(F.col("o_orderstatus") == "O", "coarse").when(F.col("o_orderstatus") == "P", "handoff").otherwise("refined").alias("stage"),
        F.when(F.pmod(key, F.lit(5)) == 0, F.lit(None)).when(F.pmod(key, F.lit(5)) == 1, F.lit(0)).otherwise(target).cast("bigint").alias("target_us"),
        F.when(F.pmod(key, F.lit(3)) == 0, F.concat(F.lit("make it about "), F.pmod(F.col("o_custkey"), F.lit(9)).cast("string"))).alias("brief"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("updated_at"),
        F.element_at(F.array(*[big(F.lit(n)) for n, _ in _RATES]), at).alias("fps_num"),
        F.element_at(F.array(*[big(F.lit(d)) for _, d in _RATES]), at).alias("fps_den"),
        F.element_at(F.array(*[big(F.lit(v)) for v in (1920, 3840, 1280, 1080)]), at).alias("width"),
        F.element_at(F.array(*[big(F.lit(v)) for v in (1080, 2160, 720, 1920)]), at).alias("height"),
        F.when(F.pmod(key, F.lit(6)) != 0, F.col("o_custkey")).alias("head_revision_id"),
        F.when(F.pmod(key, F.lit(4)) != 3, F.col("o_custkey")).alias("coarse_snapshot_id"),
    )


PROJECTS = """projects AS (
  SELECT o_orderkey AS project_id, 'Cut ' || o_orderkey AS name,
    CASE o_orderstatus WHEN 'O' THEN 'coarse' WHEN 'P' THEN 'handoff' ELSE 'refined' END AS stage,
    CAST(CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 0 ELSE CAST(floor(o_totalprice * 1000) AS BIGINT) END AS BIGINT) AS target_us,
    CASE WHEN o_orderkey % 3 = 0 THEN 'make it about ' || (o_custkey % 9) END AS brief,
    strftime(o_orderdate, '%Y-%m-%d') AS updated_at,
    CAST([30, 30000, 24, 60][o_orderkey % 4 + 1] AS BIGINT) AS fps_num,
    CAST([1, 1001, 1, 1][o_orderkey % 4 + 1] AS BIGINT) AS fps_den,
    CAST([1920, 3840, 1280, 1080][o_orderkey % 4 + 1] AS BIGINT) AS width,
    CAST([1080, 2160, 720, 1920][o_orderkey % 4 + 1] AS BIGINT) AS height,
    CASE WHEN o_orderkey % 6 <> 0 THEN o_custkey END AS head_revision_id,
    CASE WHEN o_orderkey % 4 <> 3 THEN o_custkey END AS coarse_snapshot_id
  FROM orders)"""


# --- events and levels -----------------------------------------------------------------------


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event log rows; ``event_id`` rises with time, so it serves as the sequence number."""
    rows = table(spark, sf_dir, "events")
    kind = F.col("event_type")
    return rows.select(
        F.col("user_id").alias("project_id"),
        F.col("event_id").alias("seq"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("at_us"),
        F.when(kind == "view", "playback.scrub").when(kind == "click", "playback.seek").when(kind == "purchase", "llm.verdict")
        .when(kind == "signup", "llm.plan").otherwise("project.open").alias("type"),
        F.floor(F.col("value") * 1_000_000).cast("bigint").alias("playhead"),
        F.col("value"),
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
    )


EVENTS = """ev AS (
  SELECT user_id AS project_id, event_id AS seq, epoch_us(ts) AS at_us,
    CASE event_type WHEN 'view' THEN 'playback.scrub' WHEN 'click' THEN 'playback.seek' WHEN 'purchase' THEN 'llm.verdict'
      WHEN 'signup' THEN 'llm.plan' ELSE 'project.open' END AS type,
    CAST(floor(value * 1000000) AS BIGINT) AS playhead, value,
    CAST(json_extract_string(props, '$.k') AS BIGINT) AS k
  FROM events)"""

LEVEL_HOP_US = 250_000


def levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A level series per user: one hop per event, dBFS from the event's value."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "value")
    placed = ordinals(rows, ["user_id"], ["event_id"], "hop", coarse=F.call_function("div", F.col("event_id"), F.lit(1 << 20)))
    return placed.select(
        F.col("user_id").alias("source_id"),
        big("hop").alias("hop"),
        F.lit(LEVEL_HOP_US).cast("bigint").alias("hop_us"),
        F.greatest(F.lit(-100.0), F.col("value") / F.lit(-4.0)).alias("db"),
    )


LEVELS = f"""levels AS (
  SELECT user_id AS source_id, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS hop,
    CAST({LEVEL_HOP_US} AS BIGINT) AS hop_us,
    greatest(CAST(-100 AS DOUBLE), value / CAST(-4 AS DOUBLE)) AS db
  FROM events)"""


# --- effects and keyframes of clips ----------------------------------------------------------

#: Names of easings.
EASING_NAMES = ("linear", "hold", "easeIn", "easeOut", "easeInOut")


def keyframes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per key; scalar effects keep their number in ``scale``."""
    return key_rows(raw_clips(spark, sf_dir))


def key_rows(clips: DataFrame) -> DataFrame:
    src = F.col("source_id")
    e = F.col("effect_ord")
    effects = clips.select("timeline_id", "track_id", "ord", "clip_id", "source_id", F.explode(F.array(*[big(F.lit(i)) for i in range(3)])).alias("effect_ord"))
    effects = effects.where(F.pmod(src + e, F.lit(3)) == 0).withColumn("n", F.pmod(src + e, F.lit(4)) + 1)
    keys = effects.withColumn("key_idx", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)))
    i = F.col("key_idx")
    number = i.cast("double")
    place = F.when(F.pmod(src, F.lit(17)) == 0, F.col("n") - 1 - i).otherwise(i)
    return keys.select(
        "timeline_id", "track_id", "ord", "clip_id", "effect_ord",
        F.concat_ws("_", F.lit("fx"), F.col("clip_id"), e.cast("string")).alias("effect_id"),
        F.element_at(F.array(F.lit("transform"), F.lit("volume"), F.lit("opacity")), (e + 1).cast("int")).alias("type"),
        (F.pmod(src + e, F.lit(13)) != 0).alias("effect_enabled"),
        "key_idx",
        (place * 1_500_000 + F.pmod(src, F.lit(7)) * 100_000).alias("t"),
        F.when(e == 0, 1 + number * 0.25).when(e == 1, 0.5 + number * 0.5).otherwise(1 - number * 0.25).alias("scale"),
        F.when(e == 0, number * 0.125).otherwise(0.0).alias("x"),
        F.when(e == 0, number * -0.0625).otherwise(0.0).alias("y"),
        F.when(e == 0, number * 2.0).otherwise(0.0).alias("rotation"),
        F.element_at(F.array(*[F.lit(n) for n in EASING_NAMES]), (F.pmod(i + src, F.lit(5)) + 1).cast("int")).alias("easing"),
    )


def key_sql(clips: str, name: str = "keyframes") -> str:
    d = "CAST({} AS DOUBLE)".format
    return f"""{name} AS (
  SELECT timeline_id, track_id, ord, clip_id, e AS effect_ord, 'fx_' || clip_id || '_' || e AS effect_id,
    ['transform','volume','opacity'][e + 1] AS type, (source_id + e) % 13 <> 0 AS effect_enabled, i AS key_idx,
    (CASE WHEN source_id % 17 = 0 THEN (source_id + e) % 4 - i ELSE i END) * 1500000 + (source_id % 7) * 100000 AS t,
    CASE e WHEN 0 THEN 1 + i * {d('0.25')} WHEN 1 THEN {d('0.5')} + i * {d('0.5')} ELSE 1 - i * {d('0.25')} END AS scale,
    CASE WHEN e = 0 THEN i * {d('0.125')} ELSE {d('0')} END AS x, CASE WHEN e = 0 THEN i * {d('-0.0625')} ELSE {d('0')} END AS y,
    CASE WHEN e = 0 THEN i * {d('2')} ELSE {d('0')} END AS rotation,
    ['linear','hold','easeIn','easeOut','easeInOut'][(i + source_id) % 5 + 1] AS easing
  FROM {clips}, (SELECT CAST(range AS BIGINT) AS e FROM range(3)), (SELECT CAST(range AS BIGINT) AS i FROM range(4))
  WHERE (source_id + e) % 3 = 0 AND i <= (source_id + e) % 4)"""


KEYFRAMES = key_sql("raw_clips")


# --- proposed edits: one op per clip row, aimed at clips that may or may not exist -----------

#: Kinds of edits.
OP_KINDS = (
    "trim", "split", "remove", "setEnabled", "move", "setSpeed", "addEffect", "setColor", "setTransform",
    "removeEffect", "setAudio", "setLabel", "duplicateClip", "insertClip",
)


def ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide op rows; fields an op does not use are null."""
    c = raw_clips(spark, sf_dir)
    src, n = F.col("source_id"), F.col("ord")
    kind = F.element_at(F.array(*[F.lit(k) for k in OP_KINDS]), (F.pmod(src + n, F.lit(14)) + 1).cast("int"))
    target = F.concat_ws("_", F.lit("clp"), F.col("timeline_id").cast("string"), F.pmod(src * 7 + n, F.lit(6)).cast("string"))
    rows = c.select("timeline_id", n.alias("op_idx"), kind.alias("op"), target.alias("clip_id"), src.alias("k"),
                    F.col("source_in").alias("i"), F.col("source_out").alias("o"), F.col("start").alias("s"), "speed")
    op, k = F.col("op"), F.col("k")
    only = lambda name, value: F.when(op == name, value)
    return rows.select(
        "timeline_id", "op_idx", "op",
        F.when(op != "insertClip", F.col("clip_id")).alias("clip_id"),
        F.when((op == "insertClip") | ((op == "trim") & (F.pmod(k, F.lit(4)) != 0)), F.col("i")).alias("source_in"),
        F.when((op == "insertClip") | ((op == "trim") & (F.pmod(k, F.lit(5)) != 0)), F.col("o")).alias("source_out"),
        only("split", F.col("s")).alias("at"),
        only("move", F.pmod(k, F.lit(9))).alias("to_index"),
        F.when((op == "setSpeed") | (op == "insertClip"), F.col("speed")).alias("speed"),
        only("setEnabled", F.pmod(k, F.lit(2)) == 0).alias("enabled"),
        F.when((op == "addEffect") | (op == "removeEffect"), F.concat(F.lit("fx_add_"), F.pmod(k, F.lit(2)).cast("string"))).alias("effect_id"),
        only("addEffect", F.when(F.pmod(k, F.lit(2)) == 0, "volume").otherwise("transform")).alias("effect_type"),
        F.when((op == "setAudio") & (F.pmod(k, F.lit(3)) != 0), F.pmod(k, F.lit(8)).cast("double") / 4).alias("gain"),
        F.when((op == "setAudio") & (F.pmod(k, F.lit(3)) != 1), F.pmod(k, F.lit(2)) == 0).alias("mute"),
        only("setLabel", F.concat(F.lit("label "), k.cast("string"))).alias("label"),
        F.when(((op == "setColor") & (F.pmod(k, F.lit(5)) != 0)), (F.pmod(k, F.lit(9)) - 4).cast("double") / 4).alias("grade"),
        F.when((op == "setTransform") & (F.pmod(k, F.lit(5)) != 0), F.pmod(k, F.lit(3)) + 1).alias("n_keys"),
        F.when((op == "split") | (op == "duplicateClip") | (op == "insertClip"), F.concat_ws("_", F.lit("clp"), F.col("timeline_id").cast("string"), F.lit("n"), F.col("op_idx").cast("string"))).alias("new_clip_id"),
        only("insertClip", F.pmod(k, F.lit(4))).alias("track_id"),
        only("insertClip", k).alias("source_id"),
        F.when((op == "insertClip") & (F.pmod(k, F.lit(2)) == 0), F.pmod(k, F.lit(5))).alias("at_index"),
        only("duplicateClip", F.when(F.pmod(k, F.lit(2)) == 0, "start").otherwise("after")).alias("place"),
        F.when(F.pmod(k, F.lit(6)) == 0, F.concat(F.lit("because "), F.pmod(k, F.lit(10)).cast("string"))).alias("rationale"),
        (F.pmod(k + F.col("op_idx"), F.lit(3)) != 0).alias("accepted"),
    )


OPS = f"""ops AS (
  SELECT timeline_id, ord AS op_idx, op,
    CASE WHEN op <> 'insertClip' THEN 'clp_' || timeline_id || '_' || ((k * 7 + ord) % 6) END AS clip_id,
    CASE WHEN op = 'insertClip' OR (op = 'trim' AND k % 4 <> 0) THEN source_in END AS source_in,
    CASE WHEN op = 'insertClip' OR (op = 'trim' AND k % 5 <> 0) THEN source_out END AS source_out,
    CASE WHEN op = 'split' THEN start END AS at, CASE WHEN op = 'move' THEN k % 9 END AS to_index,
    CASE WHEN op IN ('setSpeed', 'insertClip') THEN speed END AS speed,
    CASE WHEN op = 'setEnabled' THEN k % 2 = 0 END AS enabled,
    CASE WHEN op IN ('addEffect', 'removeEffect') THEN 'fx_add_' || (k % 2) END AS effect_id,
    CASE WHEN op = 'addEffect' THEN CASE WHEN k % 2 = 0 THEN 'volume' ELSE 'transform' END END AS effect_type,
    CASE WHEN op = 'setAudio' AND k % 3 <> 0 THEN CAST(k % 8 AS DOUBLE) / 4 END AS gain,
    CASE WHEN op = 'setAudio' AND k % 3 <> 1 THEN k % 2 = 0 END AS mute,
    CASE WHEN op = 'setLabel' THEN 'label ' || k END AS label,
    CASE WHEN op = 'setColor' AND k % 5 <> 0 THEN CAST(k % 9 - 4 AS DOUBLE) / 4 END AS grade,
    CASE WHEN op = 'setTransform' AND k % 5 <> 0 THEN k % 3 + 1 END AS n_keys,
    CASE WHEN op IN ('split', 'duplicateClip', 'insertClip') THEN 'clp_' || timeline_id || '_n_' || ord END AS new_clip_id,
    CASE WHEN op = 'insertClip' THEN k % 4 END AS track_id, CASE WHEN op = 'insertClip' THEN k END AS source_id,
    CASE WHEN op = 'insertClip' AND k % 2 = 0 THEN k % 5 END AS at_index,
    CASE WHEN op = 'duplicateClip' THEN CASE WHEN k % 2 = 0 THEN 'start' ELSE 'after' END END AS place,
    CASE WHEN k % 6 = 0 THEN 'because ' || (k % 10) END AS rationale, (k + ord) % 3 <> 0 AS accepted
  FROM (SELECT *, source_id AS k, [{", ".join(f"'{k}'" for k in OP_KINDS)}][(source_id + ord) % 14 + 1] AS op FROM raw_clips))"""

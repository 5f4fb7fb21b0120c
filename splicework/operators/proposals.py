"""Rule-based edit proposals from clip lengths and measured signals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import js_round, quotient
from ..functions.ranges import output_length, output_to_source, zero
from ..functions.text import seconds
from .intervals import onsets_in_clips, regions_in_clips
from .review import push_in
from .scan import ordinals
from .timeline import join_position

#: The planner's settings.
JOIN_TRIM_US = 250_000
PUSH_IN_US = 6_000_000
SPEED_UP_US = 20_000_000
SPEED_UP = 1.5
MAX_OPS = 12
MIN_HIT = 0.55
TOUCH_US = 100_000
LEAD_US = 700_000


def region_totals(regions: DataFrame, name: str) -> DataFrame:
    return regions.groupBy("clip_id").agg(F.sum(F.col("region_end") - F.col("region_start")).alias(name))


def observed(clips: DataFrame, signals: dict[str, DataFrame]) -> DataFrame:
    """Clips with what was measured of them, as one row of small facts.

    ``signals``: ``measured`` (source_id), ``quiet`` and ``still`` regions, ``onsets``.
    """
    rows = join_position(clips).withColumn("out_len", output_length()).withColumn("clip_end", F.col("start") + F.col("out_len"))
    edges = rows.select("clip_id", "start", "clip_end")
    quiet, still = regions_in_clips(signals["quiet"], rows), regions_in_clips(signals["still"], rows)
    hits = onsets_in_clips(signals["onsets"], rows)
    touched = quiet.join(edges, "clip_id")
    head = F.when(F.col("region_start") <= F.col("start") + TOUCH_US, F.struct("region_start", "region_end"))
    tail = F.when(F.col("region_end") >= F.col("clip_end") - TOUCH_US, F.struct("region_start", "region_end"))
    quiet_facts = touched.groupBy("clip_id").agg(
        F.min(head).alias("head"), F.min(tail).alias("tail"), F.sum(F.col("region_end") - F.col("region_start")).alias("quiet_for")
    )
    hit_facts = hits.groupBy("clip_id").agg(F.max(F.struct("strength", (-F.col("t")).alias("back"))).alias("hit"))
    measured = signals["measured"].select("source_id", F.lit(True).alias("measured")).distinct()
    return (
        rows.join(measured, "source_id", "left").join(quiet_facts, "clip_id", "left").join(hit_facts, "clip_id", "left")
        .join(region_totals(still, "still_for"), "clip_id", "left")
        .withColumns({"measured": F.coalesce("measured", F.lit(False)), "quiet_for": F.coalesce("quiet_for", zero()), "still_for": F.coalesce("still_for", zero())})
    )


def propose_trims(seen: DataFrame, sources: DataFrame) -> DataFrame:
    """Tighter joins: to the far edge of measured silence, or a quarter second where nothing was measured."""
    rows = seen.join(sources.select("source_id", "duration_us"), "source_id", "left").where(
        (~F.col("is_first") | ~F.col("is_last")) & (F.col("out_len") > JOIN_TRIM_US * 4)
    )
    quiet_in = F.when(~F.col("is_first") & F.col("head").isNotNull(), output_to_source("head.region_end"))
    quiet_out = F.when(~F.col("is_last") & F.col("tail").isNotNull(), output_to_source("tail.region_start"))
    blind_in = F.when(~F.col("is_first"), F.col("source_in") + JOIN_TRIM_US)
    blind_out = F.when(~F.col("is_last"), F.col("source_out") - JOIN_TRIM_US)
    rows = rows.withColumns({
        "new_in": F.coalesce(F.when(F.col("measured"), quiet_in).otherwise(blind_in), F.col("source_in")),
        "new_out": F.coalesce(F.when(F.col("measured"), quiet_out).otherwise(blind_out), F.col("source_out")),
    })
    opens, ends = F.col("new_in") != F.col("source_in"), F.col("new_out") != F.col("source_out")
    where = F.concat_ws(" and ", F.when(opens, "opens"), F.when(ends, "ends"))
    sound = (F.col("new_out") > F.col("new_in")) & (F.col("duration_us").isNull() | (F.col("new_out") <= F.col("duration_us")))
    return rows.where((opens | ends) & sound).select(
        "timeline_id", "track_id", "ord", F.lit(0).alias("kind_ord"), F.lit("trim").alias("op"), "clip_id",
        F.when(opens, F.col("new_in")).alias("source_in"), F.when(ends, F.col("new_out")).alias("source_out"),
        F.lit(None).cast("double").alias("speed"), F.lit(None).cast("double").alias("scale_to"), F.lit(None).cast("bigint").alias("key_t"),
        F.when(F.col("measured"), F.concat(where, F.lit(" on measured silence"))).otherwise(F.lit("coarse cuts usually run a beat long at the join")).alias("rationale"),
    )


def propose_framing(seen: DataFrame, framed: DataFrame) -> DataFrame:
    """One movement or speed-up per clip without effects; the first rule that fits decides.

    ``framed`` lists clips that already carry an effect.
    """
    rows = seen.join(framed.select("clip_id").distinct(), "clip_id", "left_anti")
    size, into = F.col("out_len"), -F.col("hit.back") - F.col("start")
    lands = F.col("measured") & (F.col("hit.strength") >= MIN_HIT) & (into > LEAD_US)
    dull = F.col("measured") & (F.col("quiet_for") >= size * 0.5) & (F.col("still_for") >= size * 0.5)
    static = F.col("measured") & (F.col("still_for") >= size * 0.6) & (size >= PUSH_IN_US)
    slow = ~F.col("measured") & (size >= SPEED_UP_US)
    long = ~F.col("measured") & (size >= PUSH_IN_US)
    rule = F.when(lands, "lands").when(dull, "dull").when(static, "static").when(slow, "slow").when(long, "long")
    rows = rows.withColumn("rule", rule).where("rule is not null")
    push = F.col("rule").isin("lands", "static", "long")
    why = (
        F.when(F.col("rule") == "lands", F.concat(F.lit("something lands at "), seconds(into), F.lit("s into the shot; the push arrives with it")))
        .when(F.col("rule") == "dull", F.lit("quiet and static for most of its length"))
        .when(F.col("rule") == "static", F.concat(F.lit("the picture barely moves for "), seconds("still_for"), F.lit("s of this shot")))
        .when(F.col("rule") == "slow", F.concat(js_round(size / 1e6).cast("string"), F.lit("s on one shot is a long time to hold")))
        .otherwise(F.lit("a locked-off shot this long goes dead without some movement"))
    )
    none = F.lit(None).cast("bigint")
    return rows.select(
        "timeline_id", "track_id", "ord", F.lit(1).alias("kind_ord"), F.when(push, "addEffect").otherwise("setSpeed").alias("op"), "clip_id",
        none.alias("source_in"), none.alias("source_out"), F.when(~push, F.lit(SPEED_UP)).alias("speed"),
        F.when(F.col("rule") == "lands", F.lit(1.18)).when(push, F.lit(1.12)).alias("scale_to"),
        F.when(F.col("rule") == "lands", into).when(push, size).alias("key_t"), why.alias("rationale"),
    )


def cap_ops(proposals: DataFrame, n: int = MAX_OPS) -> DataFrame:
    """The first ``n`` proposals of each timeline, numbered in the order they were made."""
    step = F.shiftleft("track_id", 44) + quotient("ord", 1 << 19)
    return ordinals(proposals, ["timeline_id"], ["track_id", "ord", "kind_ord"], "op_idx", coarse=step).where(F.col("op_idx") < n)


def summaries(proposals: DataFrame, seen: DataFrame) -> DataFrame:
    """One sentence per timeline; the count is taken before the cap."""
    counts = proposals.groupBy("timeline_id").agg(F.count(F.lit(1)).alias("n"))
    facts = (F.col("quiet_for") > 0) | (F.col("still_for") > 0) | F.col("hit").isNotNull()
    used = seen.groupBy("timeline_id").agg(F.bool_or(facts).alias("used"))
    rows = used.join(counts, "timeline_id", "left").withColumn("n", F.coalesce("n", zero()))
    noun = F.concat(F.col("n").cast("string"), F.lit(" suggested "), F.when(F.col("n") == 1, "edit").otherwise("edits"))
    text = (
        F.when((F.col("n") == 0) & F.col("used"), "Nothing worth changing — no dead air at the joins and nothing sitting still.")
        .when(F.col("n") == 0, "Nothing worth changing — the clips are already short and tight.")
        .when(F.col("used"), F.concat(noun, F.lit(", based on where the footage goes quiet, holds still, or lands a hit.")))
        .otherwise(F.concat(noun, F.lit(": tightened joins, plus movement on the longer shots.")))
    )
    return rows.select("timeline_id", "n", text.alias("summary"))


def plan_refinements(seen: DataFrame, sources: DataFrame, framed: DataFrame) -> DataFrame:
    """All proposals, a clip's trim before its framing; cap with ``cap_ops``."""
    return propose_trims(seen, sources).unionByName(propose_framing(seen, framed))


def as_ops(capped: DataFrame) -> DataFrame:
    """Capped proposals as edits that can be replayed."""
    effect_id = F.concat(F.lit("fx_push_"), F.substring("clip_id", 5, 8))
    push = push_in(effect_id, F.col("key_t"))
    grown = F.transform(push["keys"], lambda k, i: k.withField("scale", F.when(i == 1, F.col("scale_to")).otherwise(k["scale"])))
    return capped.select(
        "timeline_id", F.col("op_idx"), "op", "clip_id", "source_in", "source_out", "speed", "rationale",
        F.when(F.col("op") == "addEffect", push.withField("keys", grown)).alias("effect"),
    )

"""Training rows from edited projects: what was kept, what was accepted, where attention went."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.digest import digest
from ..functions.numeric import floor_div, quotient
from ..functions.ranges import zero
from .blocks import with_levels
from .intervals import in_cells
from .scan import following, next_known, previous, running_sum, scan

SPAN = ["timeline_id", "source_id"]
#: A playhead that stays this long in one place is at rest, in microseconds.
REST_US = 1_000_000


def keep_drop_spans(clips: DataFrame, sources: DataFrame) -> DataFrame:
    """Every source of a timeline cut into maximal spans that some enabled clip uses, or none: ``keep, start, end``.

    ``sources`` lists the pairs to cover with their ``duration_us``; the spans of a pair tile ``[0, duration)``. A clip opens
    a use where it begins and closes it where it ends, so the running number of open uses says what is kept.
    """
    pairs = sources.where("duration_us > 0").select(*SPAN, "duration_us")
    used = clips.where("enabled AND source_out > source_in").select(*SPAN, "source_in", "source_out").join(pairs, SPAN)
    inside = lambda c: F.least(F.greatest(F.col(c), zero()), F.col("duration_us"))
    mark = lambda at, by: F.struct(at.cast("bigint").alias("t"), F.lit(by).alias("by"))
    edges = used.select(*SPAN, "duration_us", F.explode(F.array(mark(inside("source_in"), 1), mark(inside("source_out"), -1))).alias("m"))
    ends = pairs.select(*SPAN, "duration_us", F.explode(F.array(mark(zero(), 0), mark(F.col("duration_us"), 0))).alias("m"))
    at = edges.unionByName(ends).groupBy(*SPAN, "duration_us", F.col("m.t").alias("t")).agg(F.sum("m.by").alias("by"))
    minute = quotient("t", 60_000_000)
    swept = scan(at, SPAN, ["t"], coarse=minute, __open=running_sum(F.col("by")), __next=following(F.col("t"))).where("t < duration_us")
    marked = scan(swept.withColumn("keep", F.col("__open") > 0), SPAN, ["t"], coarse=minute, __was=previous(F.col("keep")))
    turned = marked.withColumn("__turn", (F.col("__was").isNull() | (F.col("__was") != F.col("keep"))).cast("bigint"))
    placed = scan(turned, SPAN, ["t"], coarse=minute, __run=running_sum(F.col("__turn")))
    return placed.groupBy(*SPAN, "__run", "keep").agg(F.min("t").alias("start"), F.max("__next").alias("end")).drop("__run")


def keep_drop_labels(clips: DataFrame, sources: DataFrame, levels: DataFrame, source_levels: DataFrame, quiet: DataFrame) -> DataFrame:
    """The spans of ``keep_drop_spans`` with what was measured of them: loudest and typical level, the source's median, quiet time.

    ``quiet`` are ranges of sources. A span of a source without levels has null features and no quiet time.
    """
    spans = keep_drop_spans(clips, sources)
    known = spans.join(source_levels.select("source_id", "hop_us", F.col("median_db").alias("source_median_db")), "source_id", "left")
    windows = known.withColumns({"h0": floor_div("start", F.col("hop_us")), "h1": -floor_div(-F.col("end"), F.col("hop_us")) - 1})
    heard = with_levels(windows, levels)
    shared = in_cells(spans, quiet.select("source_id", F.col("start").alias("__qs"), F.col("end").alias("__qe")), ["source_id"], ("start", "end"), ("__qs", "__qe"))
    calm = shared.groupBy(*SPAN, "start").agg(F.sum(F.least("end", "__qe") - F.greatest("start", "__qs")).alias("quiet_us"))
    return heard.join(calm, [*SPAN, "start"], "left").select(*SPAN, "keep", "start", "end", "peak_db", "typical_db", "source_median_db", F.coalesce("quiet_us", zero()).alias("quiet_us"))


def op_verdict_examples(ops: DataFrame, clips: DataFrame, clip_levels: DataFrame, passes: DataFrame) -> DataFrame:
    """Each proposed edit with its verdict, who proposed it and what was known of its clip on the coarse timeline.

    ``ops``: timeline_id, op_idx, op, clip_id, rationale, accepted (null: no); ``passes``: timeline_id, model. An edit that names no
    clip, or one that isn't there, has null features.
    """
    shape = clips.select("timeline_id", "clip_id", "source_id", "start", "out_len", "speed", "enabled")
    heard = clip_levels.select("timeline_id", "clip_id", "peak_db", "typical_db", "source_median_db")
    rows = ops.select("timeline_id", "op_idx", "op", "clip_id", "rationale", F.coalesce("accepted", F.lit(False)).alias("accepted"))
    return rows.join(passes.select("timeline_id", "model"), "timeline_id", "left").join(shape, ["timeline_id", "clip_id"], "left").join(heard, ["timeline_id", "clip_id"], "left")


def acceptance_rates(examples: DataFrame) -> DataFrame:
    """Share of accepted edits per model and kind, per model, and over all: ``level`` 0, 1 and 3 as in grouping ids.

    Only totals of a task's rows are shuffled, so a model that made most edits is no burden.
    """
    rolled = examples.rollup("model", "op").agg(
        F.count(F.lit(1)).alias("ops"), F.count_if("accepted").alias("accepted"), F.grouping_id().cast("int").alias("level")
    )
    return rolled.withColumn("share", F.col("accepted") / F.col("ops"))


def attention_dwell(trail: DataFrame, rest_us: int = REST_US) -> DataFrame:
    """How long the playhead lay at rest between the edit before and this one: ``project_id, seq, dwell_us`` per edit.

    ``trail``: project_id, seq, at_us, playhead, edit (whether the row is one). The playhead is where the last row put it, a null
    leaves it there. A stretch in one place counts from ``rest_us`` on, whole; where edits fall into it, each
    gets the part since the one before. Time after the last edit belongs to none.
    """
    keys, order, hour = ["project_id"], ["at_us", "seq"], quotient("at_us", 3_600_000_000)
    held = scan(trail, keys, order, coarse=hour, __was=previous(F.col("playhead")), __next=following(F.col("at_us")))
    moved = held.withColumn("__moved", (F.col("playhead").isNotNull() & ~F.col("playhead").eqNullSafe(F.col("__was"))).cast("bigint"))
    placed = scan(moved, keys, order, coarse=hour, __stay=running_sum(F.col("__moved")), __edit=next_known(F.when(F.col("edit"), F.col("seq"))))
    onward = scan(placed, keys, order, coarse=hour, __for=following(F.col("__edit")))
    gaps = onward.withColumn("gap", F.coalesce(F.col("__next") - F.col("at_us"), zero()))
    stays = gaps.groupBy("project_id", "__stay").agg(F.sum("gap").alias("__rest")).where(F.col("__rest") >= rest_us)
    rest = gaps.join(stays, ["project_id", "__stay"]).where("__for IS NOT NULL").groupBy("project_id", F.col("__for").alias("seq")).agg(F.sum("gap").alias("dwell_us"))
    return trail.where("edit").select("project_id", "seq").join(rest, ["project_id", "seq"], "left").select("project_id", "seq", F.coalesce("dwell_us", zero()).alias("dwell_us"))


def steer_groups(passes: DataFrame) -> DataFrame:
    """Passes under the same brief and target: ``brief_digest, target_us, passes, projects, accepted``.

    ``passes``: project_id, brief, target_us, accepted. Briefs are the same without outer blanks; no brief is an empty one.
    """
    named = passes.withColumn("__brief", F.trim(F.coalesce("brief", F.lit(""))))
    sums = named.groupBy("__brief", "target_us").agg(F.count(F.lit(1)).alias("passes"), F.count_distinct("project_id").alias("projects"), F.count_if("accepted").alias("accepted"))
    return sums.select(digest("__brief").alias("brief_digest"), "target_us", "passes", "projects", "accepted")

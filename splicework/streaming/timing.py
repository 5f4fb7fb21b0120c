"""Timing rules over event streams, set-based; the streaming counterparts are in ``live``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import quotient
from ..operators.media import greedy_groups
from ..operators.scan import following, last_known, next_known, ordinals, previous, scan

HOUR_US = 3_600_000_000
#: The timing rules, in microseconds, and the pacing of seeks in milliseconds.
SCRUB_LOG_US = 250_000
BURST_US = 400_000
QUIET_US = 350_000
MAX_HOLD_US = 4_000_000
STALE_US = 3_600_000_000
MIN_INTERVAL_MS = 160.0
MAX_INTERVAL_MS = 900.0
BLEND = 0.4
#: After this many blends the start value has shrunk below what a double can hold of the result.
MEMORY = 128

P = ["project_id"]


def _hours() -> Column:
    return quotient("at_us", HOUR_US)


def throttle(events: DataFrame, interval_us: int = SCRUB_LOG_US) -> DataFrame:
    """Scrub rows at most once per interval, every seek; both restart the interval.

    A seek, a row right after a seek's island, and a row an interval or more after its predecessor
    are kept whatever came before, so the stretches between them are independent.
    """
    rows = events.where(F.col("type").isin("playback.scrub", "playback.seek"))
    rows = ordinals(rows, P, ["at_us", "seq"], "__n", coarse=_hours()).withColumn("__n", F.col("__n").cast("bigint"))
    behind = scan(rows, P, ["__n"], ordinal="__n", __p=previous(F.col("at_us")))
    seek = F.col("type") == "playback.seek"
    fresh = F.when(seek | F.col("__p").isNull() | (F.col("at_us") - F.col("__p") >= interval_us), F.col("__n"))
    islands = scan(behind.withColumn("__f", fresh), P, ["__n"], ordinal="__n", __island=last_known(F.col("__f")))
    grouped = greedy_groups(islands.drop("__f", "__p"), [*P, "__island"], "__n", F.col("at_us"), F.col("at_us"), interval_us - 1, "__open")
    return grouped.where(F.col("__n") == F.col("__open")).drop("__n", "__island", "__open")


def coalesce_bursts(events: DataFrame, gap_us: int = BURST_US) -> DataFrame:
    """The last row of every burst: nothing follows it within the gap."""
    ahead = scan(events, P, ["at_us", "seq"], coarse=_hours(), __next=following(F.col("at_us")))
    return ahead.where(F.col("__next").isNull() | (F.col("__next") - F.col("at_us") >= gap_us)).drop("__next")


def quiet_gaps(events: DataFrame, gap_us: int = QUIET_US, hold_us: int = MAX_HOLD_US) -> DataFrame:
    """When work asked for at each event would start: at the first quiet gap, or when waiting runs out."""
    ahead = scan(events, P, ["at_us", "seq"], coarse=_hours(), __next=following(F.col("at_us")))
    calm = F.when(F.col("__next").isNull() | (F.col("__next") - F.col("at_us") >= gap_us), F.col("at_us") + gap_us)
    found = scan(ahead.withColumn("__calm", calm), P, ["at_us", "seq"], coarse=_hours(), __q=next_known(F.col("__calm")))
    return found.withColumn("starts_us", F.least("__q", F.col("at_us") + hold_us)).drop("__next", "__calm", "__q")


def failed_opens(events: DataFrame, stale_us: int = STALE_US) -> DataFrame:
    """Opens that found an unfinished earlier open of the project, the stage it had reached, and how many in a row.

    ``step`` is ``open``, a stage name, or ``finish``.
    """
    behind = scan(events, P, ["at_us", "seq"], coarse=_hours(), __p=previous(F.struct("at_us", "step")))
    opens = behind.where("step = 'open'")
    p = F.col("__p")
    failed = p.isNotNull() & (p["step"] != "finish") & (F.col("at_us") - p["at_us"] < stale_us)
    opens = opens.withColumns({"failed": failed, "stage": F.when(failed, p["step"])})
    numbered = ordinals(opens, P, ["at_us", "seq"], "__n", coarse=_hours())
    clean = F.when(~F.col("failed"), F.col("__n"))
    counted = scan(numbered.withColumn("__c", clean), P, ["at_us", "seq"], coarse=_hours(), __last=last_known(F.col("__c")))
    run = F.when(F.col("failed"), F.col("__n") - F.coalesce("__last", F.lit(-1))).otherwise(0)
    return counted.select("project_id", "seq", "at_us", "failed", "stage", run.cast("bigint").alias("runs"))


def adaptive_interval(costs: DataFrame) -> DataFrame:
    """Seek interval after each landed seek: a bounded moving blend of what seeks cost (``cost_ms``).

    Each step keeps 0.6 of what came before, so the value rests on the last 128 costs to the last
    bit. Rows are packed in blocks of that size and every block starts from the one before it.
    """
    rows = ordinals(costs, P, ["at_us", "seq"], "__n", coarse=_hours())
    blocks = rows.groupBy("project_id", quotient("__n", MEMORY).alias("block")).agg(F.array_sort(F.collect_list(F.struct("__n", "seq", "cost_ms"))).alias("cur"))
    wide = scan(blocks, P, ["block"], coarse=quotient("block", 1 << 12), __prev=previous(F.col("cur")))
    blend = lambda x, cost: F.least(F.lit(MAX_INTERVAL_MS), F.greatest(F.lit(MIN_INTERVAL_MS), x * (1 - BLEND) + F.greatest(F.lit(0.0), cost) * BLEND))
    none = F.array().cast("array<struct<__n:bigint,seq:bigint,cost_ms:double>>")
    start = F.aggregate(F.coalesce("__prev", none), F.lit(MIN_INTERVAL_MS), lambda x, c: blend(x, c["cost_ms"]))
    state = F.struct(start.alias("x"), F.array().cast("array<struct<seq:bigint,interval_ms:double>>").alias("out"))

    def step(s: Column, c: Column) -> Column:
        x = blend(s["x"], c["cost_ms"])
        return F.struct(x.alias("x"), F.concat(s["out"], F.array(F.struct(c["seq"].alias("seq"), x.alias("interval_ms")))).alias("out"))

    return wide.select("project_id", F.explode(F.aggregate("cur", state, step)["out"]).alias("o")).select("project_id", "o.*")


def current_verdicts(events: DataFrame) -> DataFrame:
    """Latest verdict of every proposal of every review: ``review_seq, index, accepted``.

    A review runs from its plan row to the next plan or closing row. ``events`` carry ``ops`` on
    plan rows and ``index, all_ops, accepted`` on verdict rows.
    """
    marks = events.where(F.col("type").isin("llm.plan", "llm.verdict", "llm.review"))
    marker = F.when(F.col("type") != "llm.verdict", F.struct("seq", (F.col("type") == "llm.plan").alias("open"), "ops"))
    known = scan(marks, P, ["seq"], coarse=quotient("seq", 1 << 20), __m=last_known(marker))
    said = known.where("type = 'llm.verdict' and __m.open")
    latest = lambda rows, keys, name: rows.groupBy(*keys).agg(F.max(F.struct("seq", "accepted")).alias(name))
    review = F.col("__m.seq").alias("review_seq")
    one = latest(said.where(~F.col("all_ops")).select("project_id", review, "index", "seq", "accepted"), ["project_id", "review_seq", "index"], "__one")
    every = latest(said.where("all_ops").select("project_id", review, "seq", "accepted"), ["project_id", "review_seq"], "__all")
    plans = marks.where("type = 'llm.plan' and ops > 0").select("project_id", F.col("seq").alias("review_seq"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("ops") - 1)).alias("index"))
    rows = plans.join(one, ["project_id", "review_seq", "index"], "left").join(every, ["project_id", "review_seq"], "left")
    return rows.select("project_id", "review_seq", "index", F.coalesce(F.greatest("__one", "__all")["accepted"], F.lit(False)).alias("accepted"))


def pass_costs(events: DataFrame, width: str = "1 day") -> DataFrame:
    """Per model and time window: passes, failures, tokens and time; works on streams as well."""
    return events.where(F.col("type").isin("llm.plan", "llm.error")).groupBy("model", F.window("at", width)).agg(
        F.count_if(F.col("type") == "llm.plan").alias("passes"), F.count_if(F.col("type") == "llm.error").alias("errors"),
        F.sum("tokens").alias("tokens"), F.sum("elapsed_ms").alias("elapsed_ms"), F.sum("rejected").alias("rejected"),
    )


def device_costs(events: DataFrame, width: str = "1 day") -> DataFrame:
    """Per kind of finished work and time window: runs, total and longest time; works on streams as well."""
    done = events.where(F.col("type").isin("render.complete", "proxy.complete", "signals.compute"))
    return done.groupBy("type", F.window("at", width)).agg(F.count(F.lit(1)).alias("runs"), F.sum("elapsed_ms").alias("elapsed_ms"), F.max("elapsed_ms").alias("longest_ms"))

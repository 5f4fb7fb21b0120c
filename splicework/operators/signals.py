"""Loudness, transients and dead air of recordings, from samples or from level series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import js_round, quotient
from ..functions.ranges import zero
from ..session import checkpoint
from .asof import brackets
from .chains import reached
from .intervals import points_in_ranges
from .scan import following, has_heavy, last_known, ordinals, previous, running_sum, scan
from .stats import exact_median

#: The analysis settings.
SILENCE_DB = -100.0
QUIET_BELOW_DB = -18.0
MIN_QUIET_MS = 600
MIN_ONSET_GAP_MS = 150
MAX_ONSETS_PER_MINUTE = 12
ANALYSIS_VERSION = 4

SOURCE = ["source_id"]


def downmix(samples: DataFrame, channels: str = "channels") -> DataFrame:
    """Mean across channels of ``source_id, i, channel, x, channels``."""
    return samples.groupBy("source_id", "i").agg(F.sum(F.col("x") / F.col(channels)).alias("x"))


def rms_levels(samples: DataFrame, hop: int) -> DataFrame:
    """RMS per hop of samples in dBFS, floored at silence; a short last hop uses its own length."""
    rms = F.sqrt(F.sum(F.col("x") * F.col("x")) / F.count(F.lit(1)))
    return (
        samples.groupBy("source_id", quotient("i", hop).alias("hop"))
        .agg(rms.alias("__rms"))
        .select(
            "source_id", "hop",
            F.when(F.col("__rms") > 0, F.greatest(F.lit(SILENCE_DB), F.log10("__rms") * 20)).otherwise(F.lit(SILENCE_DB)).alias("db"),
        )
    )


def rms_decimate(samples: DataFrame, sources: DataFrame, rate: int = 2000) -> DataFrame:
    """RMS per time bin of ``ts_us, sample_rate, i, x``; a bin without samples is zero.

    ``sources`` gives ``source_id, from_us, to_us``. The RMS of any run of bins equals the RMS of
    the samples under it, so levels can be taken from the bins.
    """
    span = sources.select("source_id", "from_us", F.greatest(F.lit(1), F.ceil((F.col("to_us") - F.col("from_us")) / 1e6 * rate) + 1).cast("bigint").alias("blocks"))
    at = (F.col("ts_us") - F.col("from_us")) / 1e6 * rate + F.col("i") * (F.lit(float(rate)) / F.col("sample_rate"))
    binned = (
        samples.join(span, "source_id")
        .withColumn("block", F.floor(at).cast("bigint"))
        .where((F.col("block") >= 0) & (F.col("block") < F.col("blocks")))
        .groupBy("source_id", "block")
        .agg(F.sqrt(F.sum(F.col("x") * F.col("x")) / F.count(F.lit(1))).alias("__rms"))
    )
    spine = span.select("source_id", F.explode(F.sequence(zero(), F.col("blocks") - 1)).alias("block"))
    return spine.join(binned, ["source_id", "block"], "left").select("source_id", "block", F.coalesce("__rms", F.lit(0.0)).alias("x"))


def source_levels(levels: DataFrame) -> DataFrame:
    """Peak and exact median level per source."""
    peak = levels.groupBy("source_id").agg(
        F.greatest(F.max("db"), F.lit(SILENCE_DB)).alias("peak_db"),
        F.count(F.lit(1)).alias("hops"), F.max("hop_us").alias("hop_us"),
    )
    return peak.join(exact_median(levels, SOURCE, "db", "median_db"), "source_id")


def level_rise(levels: DataFrame) -> DataFrame:
    """Positive change from the hop before; 0 on the first hop."""
    before = scan(levels, SOURCE, ["hop"], ordinal="hop", __db=previous(F.col("db")))
    return before.withColumn("rise", F.coalesce(F.greatest(F.lit(0.0), F.col("db") - F.col("__db")), F.lit(0.0))).drop("__db")


def local_peaks(rises: DataFrame) -> DataFrame:
    """Hops whose rise is not below either neighbour's; the two ends never qualify."""
    around = scan(rises, SOURCE, ["hop"], ordinal="hop", __a=previous(F.col("rise")), __b=following(F.col("rise")))
    return around.where((F.col("rise") >= F.col("__a")) & (F.col("rise") >= F.col("__b"))).drop("__a", "__b")


def onset_candidates(levels: DataFrame) -> DataFrame:
    """Local peaks that stand out from the second around them, with that second's median rise.

    Hops are packed into blocks of one window length. A block and its two neighbours hold every
    window that starts in it, so medians are taken inside one row, without a range join.
    """
    window = F.greatest(F.lit(3).cast("bigint"), js_round(F.lit(1e6) / F.col("hop_us")))
    rises = level_rise(levels).withColumn("w", window)
    blocks = (
        rises.groupBy("source_id", quotient("hop", F.col("w")).alias("block"), "w", "hop_us")
        .agg(F.array_sort(F.collect_list(F.struct("hop", "rise"))).alias("cur"))  # at most w entries
    )
    wide = scan(
        blocks, SOURCE, ["block"], coarse=quotient("block", 1 << 14), __prev=previous(F.col("cur")), __next=following(F.col("cur"))
    )
    none = F.array().cast("array<struct<hop:bigint,rise:double>>")
    wide = wide.select(
        "source_id", "hop_us", "w", "cur",
        F.concat(F.coalesce("__prev", none), F.col("cur"), F.coalesce("__next", none)).alias("near"),
        F.size(F.coalesce("__prev", none)).alias("skip"),
    )
    # Only hops that can pass the absolute 3 dB test get a median.
    tall = F.transform("cur", lambda h, i: F.struct(h["hop"].alias("hop"), h["rise"].alias("rise"), (i + F.col("skip")).alias("at")))
    each = wide.select("source_id", "hop_us", "w", "near", F.explode(F.filter(tall, lambda h: h["rise"] >= 3)).alias("h"))
    at, w = F.col("h.at"), F.col("w").cast("int")
    each = each.select(
        "source_id", "hop_us", F.col("h.hop").alias("hop"), F.col("h.rise").alias("rise"),
        F.get("near", at - 1)["rise"].alias("before"),
        F.get("near", at + 1)["rise"].alias("after"),
        F.array_sort(
            F.transform(
                F.slice("near", F.greatest(at - w, F.lit(0)) + 1, F.least(at + w, F.size("near")) - F.greatest(at - w, F.lit(0))),
                lambda x: x["rise"],
            )
        ).alias("span"),
    )
    n = F.size("span")
    middle = (F.get("span", quotient(n - 1, 2).cast("int")) + F.get("span", quotient(n, 2).cast("int"))) / 2
    return (
        each.where((F.col("rise") >= F.col("before")) & (F.col("rise") >= F.col("after")))
        .withColumn("local_median", middle)
        .where(F.col("rise") >= F.greatest(F.col("local_median") * 2 + 3, F.lit(3.0)))
        .drop("span", "before", "after")
    )


def detect_onsets(levels: DataFrame, min_gap_ms: int = MIN_ONSET_GAP_MS) -> DataFrame:
    """Transients as ``source_id, t, strength``; two closer than the gap become the sharper one."""
    tops = level_rise(levels).groupBy("source_id").agg(F.max("rise").alias("__top"))
    found = onset_candidates(levels).join(tops, "source_id").select(
        "source_id",
        (F.col("hop") * F.col("hop_us")).alias("t"),
        (F.floor(F.col("rise") / F.col("__top") * 1000 + 0.5) / 1000).alias("strength"),
        (F.greatest(F.lit(1).cast("bigint"), js_round(F.lit(min_gap_ms * 1000) / F.col("hop_us"))) * F.col("hop_us")).alias("gap"),
    )
    return merge_close(found)


def merge_close(candidates: DataFrame) -> DataFrame:
    """Keep one of any candidates closer than ``gap`` to the kept one; the sharper takes its place.

    A distance of a gap or more to the candidate just before always starts afresh, so candidates
    fall into independent islands, and only an island is folded in order.
    """
    by_time = quotient("t", 3_600_000_000)
    behind = scan(candidates, SOURCE, ["t"], coarse=by_time, __t=previous(F.col("t")))
    fresh = F.col("__t").isNull() | (F.col("t") - F.col("__t") >= F.col("gap"))
    islands = scan(behind.withColumn("__fresh", F.when(fresh, F.col("t"))), SOURCE, ["t"], coarse=by_time, island=last_known(F.col("__fresh")))
    islands = islands.select("source_id", "island", "t", "strength", "gap")
    return _jumped_merge(islands) if has_heavy(islands, ["source_id", "island"], ["t"]) else _folded_merge(islands)


def _folded_merge(islands: DataFrame) -> DataFrame:
    packed = islands.groupBy("source_id", "island").agg(
        F.array_sort(F.collect_list(F.struct("t", "strength"))).alias("xs"), F.max("gap").alias("gap")
    )

    def step(kept: Column, x: Column) -> Column:
        last = F.try_element_at(kept, F.lit(-1))
        close = x["t"] - last["t"] < F.col("gap")
        moved = F.concat(F.slice(kept, 1, F.size(kept) - 1), F.array(x))
        return F.when(close & (x["strength"] > last["strength"]), moved).when(close, kept).otherwise(F.concat(kept, F.array(x)))

    kept = F.aggregate(F.slice("xs", 2, F.size("xs")), F.slice("xs", 1, 1), step)
    return packed.select("source_id", F.explode(kept).alias("o")).select("source_id", F.col("o.t").alias("t"), F.col("o.strength").alias("strength"))


def _jumped_merge(islands: DataFrame) -> DataFrame:
    """The same merge for islands too long for one row.

    The kept candidate is handed on to the first later one that is sharper or a gap away; the ones
    that are left by a gap are the result. Sharper ones are looked for within a gap only.
    """
    keys = ["source_id", "island"]
    rows = checkpoint(islands.withColumns({"i": F.col("t"), "__far": F.col("t") + F.col("gap") - 1}))
    found = brackets(rows, rows.select(*keys, "t"), keys, "__far", "t", []).select(*keys, "i", "strength", "gap", F.col("after")["t"].alias("far"))
    width = 1_000_000
    near = points_in_ranges(
        rows.select(*keys, F.col("t").alias("__p"), F.col("strength").alias("__s")),
        found.select(*keys, "i", "strength", (F.col("i") + 1).alias("__a"), (F.col("i") + F.col("gap")).alias("__b")), keys, "__p", "__a", "__b", width,
    ).where(F.col("__s") > F.col("strength")).groupBy(*keys, "i").agg(F.min("__p").alias("near"))
    nexts = checkpoint(found.join(near, [*keys, "i"], "left").withColumn("to", F.least("near", "far")))
    on_way = reached(rows.groupBy(*keys).agg(F.min("i").alias("i")), nexts.where("to is not null"), keys)
    left_by_gap = F.col("to").isNull() | (F.col("to") - F.col("i") >= F.col("gap"))
    return nexts.join(on_way, [*keys, "i"], "left_semi").where(left_by_gap).select("source_id", F.col("i").alias("t"), "strength")


def strongest(onsets: DataFrame, minutes: DataFrame, per_minute: int = MAX_ONSETS_PER_MINUTE) -> DataFrame:
    """The sharpest few onsets a minute per source; of equals the earlier one stays.

    ``minutes`` gives ``source_id, minutes``. No row is lost for a source under its ceiling.
    """
    keep = F.greatest(F.lit(4).cast("bigint"), js_round(F.greatest(F.col("minutes"), F.lit(1 / 60)) * per_minute))
    order = onsets.withColumn("__weak", -F.col("strength"))
    rank = ordinals(order, SOURCE, ["__weak", "t"], "__rank", coarse=F.floor(F.col("__weak") * 1000).cast("bigint"))
    return rank.join(minutes.select("source_id", keep.alias("__keep")), "source_id").where("__rank < __keep").drop("__weak", "__rank", "__keep")


def minutes_of(levels: DataFrame) -> DataFrame:
    return levels.groupBy("source_id").agg((F.count(F.lit(1)) * F.max("hop_us") / F.lit(6e7)).alias("minutes"))


def find_runs(series: DataFrame, keys: list[str], index: str, matches: Column, hop_us: str = "hop_us", min_ms: int = 0) -> DataFrame:
    """Stretches of consecutive indices where ``matches`` holds, as ``start, end`` in time.

    ``index`` is dense per key; a run ends at its first failing index.
    """
    marked = series.withColumn("__m", F.coalesce(matches, F.lit(False)))
    behind = scan(marked, keys, [index], ordinal=index, __break=last_known(F.when(~F.col("__m"), F.col(index))))
    runs = behind.where("__m").groupBy(*keys, F.coalesce("__break", F.lit(-1)).alias("__break")).agg(
        F.min(index).alias("__a"), F.max(index).alias("__b"), F.max(hop_us).alias("__hop")
    )
    return runs.select(
        *keys, (F.col("__a") * F.col("__hop")).alias("start"), ((F.col("__b") + 1) * F.col("__hop")).alias("end")
    ).where(F.col("end") - F.col("start") >= min_ms * 1000)


def quiet_runs(levels: DataFrame, below_db: float = QUIET_BELOW_DB, min_ms: int = MIN_QUIET_MS) -> DataFrame:
    """Runs well below the recording's own median level."""
    floor = exact_median(levels, SOURCE, "db", "median_db").withColumn(
        "__floor", F.greatest(F.col("median_db") + below_db, F.lit(SILENCE_DB + 1))
    )
    return find_runs(levels.join(floor, "source_id"), SOURCE, "hop", F.col("db") < F.col("__floor"), min_ms=min_ms)


# --- motion ----------------------------------------------------------------------------------


def frame_motion(frames: DataFrame) -> DataFrame:
    """Mean brightness change from the frame before, 0..1; the first frame borrows the second's.

    Input ``source_id, t, width, height, luma``. Adds the frame's ``idx`` and the mean ``hop_us``.
    """
    by_time = quotient("t", 3_600_000_000)
    shape = F.struct("width", "height", "luma")
    rows = scan(frames, SOURCE, ["t"], coarse=by_time, __p=previous(shape), idx=running_sum(F.lit(1)))
    p = F.col("__p")
    total = F.aggregate(
        F.zip_with(p["luma"], F.col("luma"), lambda a, b: F.abs(b - a)), F.lit(0).cast("bigint"), lambda s, x: s + x
    )
    alike = (p["width"] == F.col("width")) & (p["height"] == F.col("height")) & (F.size(p["luma"]) == F.size("luma")) & (F.size("luma") > 0)
    diff = F.when(p.isNull(), F.lit(None)).when(alike, total / (F.size("luma") * F.lit(255.0))).otherwise(F.lit(0.0))
    rows = rows.select("source_id", "t", (F.col("idx") - 1).alias("idx"), diff.alias("__d"))
    rows = scan(rows, SOURCE, ["t"], coarse=by_time, __n=following(F.col("__d")))
    span = frames.groupBy("source_id").agg(
        F.greatest(F.lit(1).cast("bigint"), js_round((F.max("t") - F.min("t")) / (F.count(F.lit(1)) - 1))).alias("hop_us"),
        F.min("t").alias("t0"), F.count(F.lit(1)).alias("__frames"),
    ).where("__frames >= 2").drop("__frames")
    return rows.join(span, "source_id").withColumn("motion", F.coalesce("__d", "__n", F.lit(0.0))).drop("__d", "__n")


def typical_motion(motion: DataFrame) -> DataFrame:
    """Median motion without the first frame, never below 0.004."""
    rest = motion.where("idx > 0")
    return exact_median(rest, SOURCE, "motion", "__m", coarse=F.floor(F.col("motion") * 65536).cast("bigint")).select(
        "source_id", F.greatest(F.col("__m"), F.lit(0.004)).alias("typical")
    )


def still_runs(motion: DataFrame, below: float = 0.4, min_ms: int = 1500) -> DataFrame:
    """Stretches where the picture barely moves, on the frames' own clock."""
    rows = motion.join(typical_motion(motion), "source_id")
    runs = find_runs(rows, SOURCE, "idx", F.col("motion") < F.col("typical") * below, min_ms=min_ms)
    base = motion.where("idx = 0").select("source_id", "t0", "hop_us")
    shifted = lambda c: F.greatest(F.col("t0"), F.col("t0") + F.col(c) - F.col("hop_us"))
    return runs.join(base, "source_id").select("source_id", shifted("start").alias("start"), shifted("end").alias("end"))


# --- upkeep ----------------------------------------------------------------------------------


def pending_sources(sources: DataFrame, derived: DataFrame, version: int = ANALYSIS_VERSION) -> DataFrame:
    """Sources with no current result; a result belongs to the bytes, or to the id without a hash."""
    have = derived.where(F.col("version") == version).select(F.col("cache_key").alias("__key"))
    key = F.coalesce(F.col("content_hash"), F.col("source_id").cast("string"))
    return sources.withColumn("cache_key", key).join(have, F.col("cache_key") == F.col("__key"), "left_anti")


def signals_report(levels: DataFrame, onsets: DataFrame, quiet: DataFrame, still: DataFrame) -> DataFrame:
    """Counts and one-decimal levels per source."""
    count = lambda df, name: df.groupBy("source_id").agg(F.count(F.lit(1)).alias(name))
    report = source_levels(levels)
    for part, name in ((onsets, "onsets"), (quiet, "quiet"), (still, "still")):
        report = report.join(count(part, name), "source_id", "left").withColumn(name, F.coalesce(name, zero()))
    one = lambda c: (F.floor(F.col(c) * 10 + 0.5) / 10).alias(c)
    return report.select("source_id", "hops", "onsets", "quiet", "still", one("peak_db"), one("median_db"))

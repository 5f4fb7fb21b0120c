"""Algebra on the sample tables of media files: durations, clocks, chunks, read batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import js_round, quotient
from ..functions.ranges import zero
from ..functions.rational import reduced
from ..session import checkpoint
from .asof import asof_backward, brackets
from .chains import reached
from .intervals import overlapping
from .scan import following, has_heavy, last_known, max_before, previous, running_sum, scan, sum_before

TRACK = ["track_id"]
#: How far one read may skip and span, in bytes.
MAX_READ_GAP = 512 * 1024
MAX_READ_BYTES = 4 * 1024 * 1024


def sample_durations(samples: DataFrame) -> DataFrame:
    """Start and duration in track ticks of ``track_id, sample_no, time_us, duration_us, timescale``.

    A duration reaches to the next start, at least one tick; the last sample uses its declared
    duration, else the one before. A clock that starts below zero is moved to zero.
    """
    base = samples.groupBy("track_id").agg(F.least(zero(), F.min("time_us")).alias("__base"))
    ticks = lambda us: js_round(us * F.col("timescale") / 1_000_000)
    rows = samples.join(base, "track_id").withColumn("start", ticks(F.col("time_us") - F.col("__base")))
    one = F.lit(1).cast("bigint")
    around = scan(rows, TRACK, ["sample_no"], ordinal="sample_no", __next=following(F.col("start")), __prev=previous(F.col("start")))
    step = F.when(F.col("__next").isNotNull(), F.greatest(one, F.col("__next") - F.col("start")))
    before = F.greatest(one, F.col("start") - F.col("__prev"))
    last = F.greatest(one, F.coalesce(ticks(F.col("duration_us")), before, one))
    return around.withColumn("duration", F.coalesce(step, last)).drop("__base", "__next", "__prev")


def rle_encode(rows: DataFrame, keys: list[str], index: str, value: str) -> DataFrame:
    """Runs of equal neighbouring values: ``run_no, count, value``; ``index`` is dense."""
    behind = scan(rows, keys, [index], ordinal=index, __p=previous(F.col(value)))
    change = F.when(F.col("__p").isNull() | (F.col("__p") != F.col(value)), F.col(index))
    runs = scan(behind.withColumn("__c", change), keys, [index], ordinal=index, __run=last_known(F.col("__c"))).groupBy(*keys, "__run").agg(
        F.count(F.lit(1)).alias("count"), F.first(value).alias("value")
    )
    numbered = scan(runs, keys, ["__run"], coarse=quotient("__run", 1 << 20), run_no=sum_before(F.lit(1)))
    return numbered.select(*keys, "run_no", "count", "value")


def rle_expand(runs: DataFrame, sizes: DataFrame, keys: list[str], pad: str = "last") -> DataFrame:
    """One value per sample from runs, for exactly ``samples`` rows per key.

    A table that is too short repeats its last value (``pad="last"``) or continues with zeros; one
    that is too long is cut. Positions come from running sums, so a long run is never one row's work
    alone on the way there.
    """
    placed = scan(runs, keys, ["run_no"], coarse=quotient("run_no", 1 << 16), __from=sum_before(F.col("count")))
    placed = placed.join(sizes.select(*keys, F.col("samples").alias("__n")), keys).where(F.col("__from") < F.col("__n")).where("count > 0")
    tail = placed.groupBy(*keys).agg(
        F.max(F.col("__from") + F.col("count")).alias("__have"), F.max_by("value", "__from").alias("__last"), F.max("__n").alias("__n")
    )
    filler = F.col("__last") if pad == "last" else F.lit(0)
    short = sizes.select(*keys, F.col("samples").alias("__want")).join(tail, keys, "left").withColumn("__have", F.coalesce("__have", zero())).where("__have < __want").select(
        *keys, F.col("__have").alias("__from"), (F.col("__want") - F.col("__have")).alias("count"), F.coalesce(filler, F.lit(0)).cast("bigint").alias("value"), F.col("__want").alias("__n")
    )
    every = placed.select(*keys, "__from", "count", F.col("value").cast("bigint").alias("value"), "__n").unionByName(short)
    upto = F.least(F.col("__from") + F.col("count"), F.col("__n")) - 1
    return every.select(*keys, F.explode(F.sequence(F.col("__from"), upto)).alias("sample_no"), "value")


def sample_clock(samples: DataFrame, tracks: DataFrame) -> DataFrame:
    """Presentation time of each sample: running ticks less the priming, in whole microseconds."""
    rows = samples.join(tracks.select("track_id", "timescale", "priming"), "track_id")
    timed = scan(rows, TRACK, ["sample_no"], ordinal="sample_no", __at=sum_before(F.col("delta")))
    return timed.withColumns({
        "time_us": js_round((F.col("__at") - F.col("priming")) * 1_000_000 / F.col("timescale")),
        "duration_us": js_round(F.col("delta") * 1_000_000 / F.col("timescale")),
    }).drop("__at")


def chunk_layout(chunks: DataFrame, runs: DataFrame) -> DataFrame:
    """Samples per chunk: the last run that starts at or before the (1-based) chunk number."""
    numbered = chunks.withColumn("__c", F.col("chunk_no") + 1)
    found = asof_backward(numbered, runs, TRACK, "__c", "first_chunk", ["per_chunk"])
    return found.withColumn("per_chunk", F.col("match")["per_chunk"]).drop("match", "__c")


def sample_offsets(chunks: DataFrame, samples: DataFrame) -> DataFrame:
    """Byte offset of each sample: its chunk's offset plus the sizes before it in the chunk.

    ``chunks`` carries ``per_chunk``; samples beyond the last chunk's capacity have no offset and drop out.
    """
    first = scan(chunks, TRACK, ["chunk_no"], ordinal="chunk_no", __first=sum_before(F.col("per_chunk")))
    first = first.where("per_chunk > 0")
    placed = asof_backward(samples, first, TRACK, "sample_no", "__first", ["chunk_no", "offset", "per_chunk"], fallback_first=False)
    m = F.col("match")
    inside = placed.where(F.col("sample_no") < m["t"] + m["per_chunk"]).withColumns({"chunk_no": m["chunk_no"], "__o": m["offset"]}).drop("match")
    summed = scan(inside, [*TRACK, "chunk_no"], ["sample_no"], coarse=quotient("sample_no", 1 << 16), __before=sum_before(F.col("size")))
    return summed.withColumn("offset", F.col("__o") + F.col("__before")).drop("__o", "__before")


def gop_id(samples: DataFrame, sync: DataFrame) -> DataFrame:
    """Keyframe flag and group number; a track without a list of keys has only keys."""
    listed = sync.select("track_id").distinct().withColumn("__listed", F.lit(True))
    marks = sync.select("track_id", "sample_no").distinct().withColumn("__key", F.lit(True))
    rows = samples.join(listed, "track_id", "left").join(marks, ["track_id", "sample_no"], "left")
    rows = rows.withColumn("is_key", F.col("__listed").isNull() | F.col("__key").isNotNull()).drop("__listed", "__key")
    return scan(rows, TRACK, ["sample_no"], ordinal="sample_no", gop=running_sum(F.col("is_key").cast("bigint")))


def samples_in_window(samples: DataFrame, windows: DataFrame, preroll: int = 2) -> DataFrame:
    """Samples from the first one still sounding at ``from_us`` (less the preroll) up to ``to_us``."""
    ahead = samples.withColumn("__end", F.col("time_us") + F.col("duration_us"))
    # Ends rise with the sample number, so the first row ending after the start is found as-of.
    ends = scan(ahead, TRACK, ["sample_no"], ordinal="sample_no", __reach=max_before(F.col("__end")))
    firsts = ends.where(F.col("__reach").isNull() | (F.col("__end") > F.col("__reach"))).withColumn("__lo", F.coalesce("__reach", F.lit(-(1 << 60))))
    opened = asof_backward(windows, firsts, TRACK, "from_us", "__lo", ["sample_no", "__end"], fallback_first=False)
    opened = opened.where(F.col("match")["__end"] > F.col("from_us")).withColumn("first_no", F.greatest(zero(), F.col("match")["sample_no"] - preroll)).drop("match")
    # The stop is the first sample at or past to_us; times rise with the number as well.
    starts = samples.select(*TRACK, "time_us", "sample_no")
    stopped = asof_backward(
        opened.withColumn("__to", F.col("to_us") - 1), starts, TRACK, "__to", "time_us", ["sample_no"], tie="sample_no", fallback_first=False
    )
    stopped = stopped.withColumn("last_no", F.col("match")["sample_no"]).where("last_no >= first_no").drop("match", "__to")
    numbered = samples.withColumn("__no_end", F.col("sample_no") + 1)
    ranged = stopped.withColumn("__last_end", F.col("last_no") + 1)
    pairs = overlapping(ranged, numbered, TRACK, ("first_no", "__last_end"), ("sample_no", "__no_end"), width=4096)
    return pairs.drop("__no_end", "__last_end", "first_no", "last_no")


def coalesce_reads(samples: DataFrame, max_gap: int = MAX_READ_GAP, max_span: int = MAX_READ_BYTES) -> DataFrame:
    """Samples with the read they belong to: neighbours in the file, not too far, not too many bytes.

    A gap outside the bounds always starts a read, so stretches between such gaps are independent.
    """
    behind = scan(samples, TRACK, ["sample_no"], ordinal="sample_no", __end=previous(F.col("offset") + F.col("size")))
    gap = F.col("offset") - F.col("__end")
    fresh = F.col("__end").isNull() | (gap < 0) | (gap > max_gap)
    marked = behind.withColumn("__m", F.when(fresh, F.col("sample_no")))
    marked = scan(marked, TRACK, ["sample_no"], ordinal="sample_no", __stretch=last_known(F.col("__m")))
    return greedy_groups(marked.drop("__m", "__end"), [*TRACK, "__stretch"], "sample_no", F.col("offset"), F.col("offset") + F.col("size"), max_span, "read_no").drop("__stretch")


def greedy_groups(rows: DataFrame, keys: list[str], index: str, begin: Column, end: Column, span: float, out: str) -> DataFrame:
    """Walk rows in order and open a new group when one would reach past its opener by more than ``span``.

    ``out`` is the index of the group's first row. ``index`` is dense inside ``keys`` and ``end`` never
    falls along it. Ordinary stretches are folded over (index, begin, end); with a heavy stretch
    around, openers are found by following jumps instead, without collecting anything.
    """
    spots = rows.select(*keys, F.col(index).alias("i"), begin.alias("b"), end.alias("e"))
    openers = _jumped_openers(spots, keys, span) if has_heavy(rows, keys, [index]) else _folded_openers(spots, keys, span)
    both = rows.join(openers.select(*keys, F.col("i").alias(index), F.col("i").alias("__open")), [*keys, index], "left")
    return scan(both, keys, [index], coarse=quotient(index, 1 << 20), **{out: last_known(F.col("__open"))}).drop("__open")


def _folded_openers(spots: DataFrame, keys: list[str], span: float) -> DataFrame:
    packed = spots.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("i", "b", "e"))).alias("xs"))

    def step(opens: Column, x: Column) -> Column:
        return F.when(x["e"] - F.try_element_at(opens, F.lit(-1))["b"] > span, F.concat(opens, F.array(x))).otherwise(opens)

    opened = F.aggregate(F.slice("xs", 2, F.size("xs")), F.slice("xs", 1, 1), step)
    return packed.select(*keys, F.explode(opened).alias("o")).select(*keys, "o.i")


def _jumped_openers(spots: DataFrame, keys: list[str], span: float) -> DataFrame:
    """Openers as the rows reached from each stretch's first row, where a row jumps to its group's successor."""
    rows = checkpoint(spots.withColumn("__at", F.col("b") + span))
    found = brackets(rows, rows.select(*keys, "e", F.col("i").alias("j")), keys, "__at", "e", ["j"], tie="j")
    # A row larger than the span is still its own group's opener, so a jump goes forward at least by one.
    jumps = found.where(F.col("after").isNotNull()).select(*keys, "i", F.greatest(F.col("after")["j"], F.col("i") + 1).alias("to"))
    marks = reached(rows.groupBy(*keys).agg(F.min("i").alias("i")), jumps, keys)
    return marks.join(rows.select(*keys, "i"), [*keys, "i"], "left_semi")


def modal_frame_rate(runs: DataFrame, tracks: DataFrame, constant_share: float = 0.9) -> DataFrame:
    """Rate from the commonest non-zero duration, weighted by run length; runs are not expanded.

    Of equally common durations the one met first wins.
    """
    real = runs.where("delta > 0 and count > 0").groupBy("track_id", "delta").agg(F.sum("count").alias("n"), F.min("run_no").alias("__seen"))
    best = real.groupBy("track_id").agg(
        F.max_by("delta", F.struct(F.col("n"), -F.col("__seen"))).alias("delta"), F.max("n").alias("__top"), F.sum("n").alias("frames")
    )
    rows = best.join(tracks.select("track_id", "timescale"), "track_id")
    fps = F.col("timescale") / F.col("delta")
    rate = reduced("timescale", "delta")
    share = F.col("__top") / F.col("frames")
    return rows.where((fps >= 1) & (fps <= 1000)).select(
        "track_id", rate["num"].alias("num"), rate["den"].alias("den"), share.alias("share"), (share < constant_share).alias("variable"), "frames"
    )


def drop_non_monotonic(frames: DataFrame) -> DataFrame:
    """Frames with a flag for those not later than every frame before them."""
    seen = scan(frames, TRACK, ["frame_no"], ordinal="frame_no", __max=max_before(F.col("time_us")))
    return seen.withColumn("kept", F.col("__max").isNull() | (F.col("time_us") > F.col("__max"))).drop("__max")

"""Projects, their recordings and the files behind them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import col, js_round
from ..functions.ranges import zero
from ..functions.timecode import runtime
from .scan import previous, scan

#: What counts as heavy to seek in.
HEAVY_PIXELS = 3_000_000
HEAVY_DURATION_US = 300_000_000
#: Fixed value: file types by extension.
MIME_BY_EXTENSION = {
    "mp4": "video/mp4",
    "m4v": "video/mp4",
    "mov": "video/quicktime",
    "qt": "video/quicktime",
    "webm": "video/webm",
    "mkv": "video/x-matroska",
    "avi": "video/x-msvideo",
    "m4a": "audio/mp4",
    "mp3": "audio/mpeg",
    "wav": "audio/wav",
}
#: The small copy's rate, its safety share, and the decoder's speed-up.
PROXY_BITS = 2_000_000
PROXY_SHARE = 0.5
DECODER_SPEEDUP = 4


def heavy_sources(sources: DataFrame) -> DataFrame:
    """Recordings too large or too long to seek through; unknown sizes count as nothing."""
    pixels = F.coalesce(F.col("width"), zero()) * F.coalesce(F.col("height"), zero())
    return sources.where((pixels >= HEAVY_PIXELS) | (F.col("duration_us") >= HEAVY_DURATION_US))


def orphaned_media(media: DataFrame, sources: DataFrame) -> DataFrame:
    """Stored files no recording points at."""
    used = sources.where("locator_kind = 'opfs'").select(F.col("locator_path").alias("path"))
    return media.join(used, "path", "left_anti")


def missing_media(sources: DataFrame, media: DataFrame) -> DataFrame:
    """Recordings whose bytes cannot be opened here, with a name to ask for."""
    have = media.select(F.col("path").alias("__path"), F.lit(True).alias("__have")).distinct()
    found = sources.join(have, (F.col("locator_kind") == "opfs") & (F.col("locator_path") == F.col("__path")), "left")
    lost = F.when(F.col("locator_kind") == "unresolved", F.col("locator_filename"))
    return found.where(F.col("__have").isNull()).select(
        "source_id", F.coalesce("name", lost, F.col("source_id").cast("string")).alias("filename"), "duration_us"
    )


def rebind_sources(sources: DataFrame, bindings: DataFrame) -> DataFrame:
    """Point recordings at new files: ``source_id, path, fingerprint``; ids stay."""
    new = bindings.select("source_id", F.col("path").alias("__path"), F.col("fingerprint").alias("__hash"))
    joined = sources.join(new, "source_id", "left")
    moved = F.col("__path").isNotNull()
    return joined.withColumns({
        "locator_kind": F.when(moved, "opfs").otherwise(F.col("locator_kind")),
        "locator_path": F.coalesce("__path", "locator_path"),
        "locator_filename": F.when(~moved, F.col("locator_filename")),
        "content_hash": F.coalesce("__hash", "content_hash"),
    }).drop("__path", "__hash")


def bootstrap_projects(sources: DataFrame) -> DataFrame:
    """A first project per recording: one full-length clip, and the recording's rate and upright size."""
    turned = F.col("rotation").isin(90, 270)
    known = F.col("width").isNotNull()
    pick = lambda value, fallback: F.when(known, value).otherwise(F.lit(fallback))
    return sources.select(
        "source_id", F.coalesce("name", F.lit("Untitled")).alias("name"), F.lit("coarse").alias("stage"),
        zero().alias("source_in"), F.col("duration_us").alias("source_out"), zero().alias("start"),
        pick(F.col("fps_num"), 30).alias("fps_num"), pick(F.col("fps_den"), 1).alias("fps_den"),
        pick(F.when(turned, F.col("height")).otherwise(F.col("width")), 1080).alias("width"),
        pick(F.when(turned, F.col("width")).otherwise(F.col("height")), 1920).alias("height"),
    )


def project_summaries(projects: DataFrame, clips: DataFrame) -> DataFrame:
    """One line per project with its enabled clips; read it ordered by ``updated_at`` descending."""
    counts = clips.groupBy("timeline_id").agg(F.count_if("enabled").alias("clips"))
    return projects.join(counts, F.col("project_id") == F.col("timeline_id"), "left").select(
        "project_id", "name", "stage", "updated_at", F.coalesce("clips", zero()).alias("clips")
    )


def length_standing(projects: DataFrame, durations: DataFrame) -> DataFrame:
    """Running length against the target: how far over, and a label for people."""
    rows = projects.select("project_id", "target_us").join(durations, F.col("project_id") == F.col("timeline_id"))
    current = F.col("duration_us")
    target = F.nullif(F.col("target_us"), zero())
    over = current - target
    now, gap = runtime(current), runtime(F.abs(over))
    label = (
        F.when(target.isNull(), now)
        .when(F.abs(over) < 1_000_000, F.concat(now, F.lit(" — on target")))
        .otherwise(F.concat(now, F.lit(" of "), runtime(target), F.lit(" — "), gap, F.when(over > 0, " over").otherwise(" under")))
    )
    return rows.select("project_id", current.alias("current_us"), target.alias("target_us"), over.alias("over_us"), label.alias("label"))


def estimate_render_cost(projects: DataFrame, durations: DataFrame, max_dimension: int = 1920, share: float = PROXY_SHARE) -> DataFrame:
    """Output size, bitrate, frame count and small-copy cost of rendering each project.

    A small copy takes ``share`` of the least bitrate for its picture, and the recordings' own audio,
    which is copied: ``audio_bytes`` of ``projects``, where there is such a column.
    """
    audio = F.coalesce(F.col("audio_bytes"), zero()) if "audio_bytes" in projects.columns else zero()
    rows = projects.select("project_id", "width", "height", "fps_num", "fps_den", audio.alias("audio_bytes")).join(durations, F.col("project_id") == F.col("timeline_id"))
    longest = F.greatest("width", "height")
    scale = F.when(longest > max_dimension, F.lit(float(max_dimension)) / longest).otherwise(F.lit(1.0))
    even = lambda c: F.greatest(F.lit(2).cast("bigint"), js_round(F.col(c) * scale / 2) * 2)
    step = F.col("fps_den") * 1_000_000 / F.col("fps_num")
    seconds = F.col("duration_us") / 1e6
    sized = rows.withColumns({"out_width": even("width"), "out_height": even("height")})
    return sized.select(
        "project_id", "out_width", "out_height",
        F.greatest(F.lit(2_000_000).cast("bigint"), js_round(F.col("out_width") * F.col("out_height") * F.lit(0.1) * 30)).alias("bitrate"),
        F.greatest(F.lit(1).cast("bigint"), F.ceil(F.col("duration_us") / step).cast("bigint")).alias("frames"),
        js_round(seconds * (PROXY_BITS * share) / 8 + F.col("audio_bytes")).alias("proxy_bytes"),
        js_round(seconds * 1000 / DECODER_SPEEDUP).alias("proxy_ms"),
    )


def mime_of(filename) -> Column:
    """File type by the text after the last dot."""
    table = F.create_map(*[F.lit(x) for pair in MIME_BY_EXTENSION.items() for x in pair])
    return table[F.lower(F.element_at(F.split(col(filename), r"\."), -1))]


def op_histogram(ops: DataFrame) -> DataFrame:
    return ops.groupBy("op").agg(F.count(F.lit(1)).alias("n"))


def resolve_targets(ops: DataFrame, clips: DataFrame) -> DataFrame:
    """Ops next to the clip they name, or the reason there is none."""
    held = clips.select("timeline_id", "clip_id", F.col("source_in").alias("clip_in"), F.col("source_out").alias("clip_out"))
    rows = ops.join(held, ["timeline_id", "clip_id"], "left")
    lost = F.col("clip_id").isNotNull() & F.col("clip_in").isNull()
    return rows.withColumn("reason", F.when(lost, F.concat(F.lit("no clip "), "clip_id", F.lit(" on the timeline"))))


def drop_noop_trims(ops: DataFrame, clips: DataFrame) -> DataFrame:
    """Ops without the trims that would leave their clip as it is."""
    rows = resolve_targets(ops, clips)
    same = (F.coalesce("source_in", "clip_in") == F.col("clip_in")) & (F.coalesce("source_out", "clip_out") == F.col("clip_out"))
    idle = (F.col("op") == "trim") & F.coalesce(same, F.lit(False))
    return rows.where(~idle).drop("clip_in", "clip_out", "reason")


def revision_rollup(revisions: DataFrame, projects: DataFrame) -> DataFrame:
    """Chain length and current revision per project; the latest when no head is named."""
    chain = revisions.groupBy("project_id").agg(F.count(F.lit(1)).alias("revisions"), F.max_by("revision_id", "rev_ord").alias("__last"))
    named = revisions.select("project_id", F.col("revision_id").alias("__r")).distinct()
    heads = projects.select("project_id", "head_revision_id").join(
        named.withColumn("__ok", F.lit(True)), (projects["project_id"] == named["project_id"]) & (F.col("head_revision_id") == F.col("__r")), "left"
    ).select(projects["project_id"], "head_revision_id", "__ok")
    head = F.when(F.col("head_revision_id").isNull(), F.col("__last")).when(F.col("__ok"), F.col("head_revision_id"))
    return heads.join(chain, "project_id", "left").select("project_id", F.coalesce("revisions", zero()).alias("revisions"), head.alias("head"))


def parent_chain(revisions: DataFrame) -> DataFrame:
    """Each revision's parent: the one before it in its project."""
    return scan(revisions, ["project_id"], ["rev_ord"], ordinal="rev_ord", parent_id=previous(F.col("revision_id")))

"""Event logs as JSON lines: reading with quarantine, writing, upserting, numbering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.easing import bind
from ..operators.quality import id_ok
from ..operators.scan import ordinals

#: The event types and who may act.
EVENT_TYPES = (
    "project.create", "project.open", "source.import", "source.probe", "media.diagnostics", "app.recovered",
    "proxy.complete", "proxy.error", "signals.compute", "playback.play", "playback.pause", "playback.seek",
    "playback.rate", "playback.scrub", "mark.in", "mark.out", "range.keep", "range.delete", "clip.split",
    "clip.trim", "clip.remove", "clip.move", "clip.restore", "clip.color", "clip.transform", "clip.speed",
    "clip.duplicate", "edit.undo", "edit.redo", "coarse.commit", "project.brief", "llm.request", "llm.plan",
    "llm.error", "llm.apply", "llm.verdict", "llm.review", "render.start", "render.complete", "render.error",
)
ACTORS = ("human", "llm", "import", "system")

#: ``payload`` and ``ops`` stay JSON text; read fields of them with ``get_json_object`` or ``parse_json``.
EVENT_DDL = (
    "id string, projectId string, seq bigint, at string, actor string, type string, playhead bigint, "
    "payload string, ops string, revisionId string, timelineDigest string, _bad string"
)


def _event_error(e: Column) -> Column:
    def rule(holds: Column, text: str) -> Column:
        return F.when(~F.coalesce(holds, F.lit(False)), F.lit(text))

    optional = lambda c, holds: c.isNull() | holds
    broken = F.array_compact(F.array(
        rule(id_ok("event", e["id"]), "id: expected an event id"),
        rule(id_ok("project", e["projectId"]), "projectId: expected a project id"),
        rule(e["seq"] >= 0, "seq: expected a whole number from 0"),
        rule(F.try_to_timestamp(e["at"]).isNotNull() & e["at"].endswith("Z"), "at: expected an ISO time"),
        rule(e["actor"].isin(*ACTORS), "actor: unknown"),
        rule(e["type"].isin(*EVENT_TYPES), "type: unknown"),
        rule(optional(e["payload"], e["payload"].startswith("{")), "payload: expected an object"),
        rule(optional(e["ops"], e["ops"].startswith("[")), "ops: expected a list"),
        rule(optional(e["revisionId"], id_ok("revision", e["revisionId"])), "revisionId: expected a revision id"),
    ))
    shapeless = e.isNull() | e["_bad"].isNotNull()
    return F.when(shapeless, F.lit("not a JSON object of the event shape")).otherwise(bind(broken, lambda b: F.when(F.size(b) > 0, F.array_join(b, "; "))))


def parse_events(lines: DataFrame, value: str = "value") -> DataFrame:
    """Lines with their event ``e`` and an ``error``, null for a good line; blank lines dropped."""
    text = F.trim(F.regexp_replace(F.col(value), r"\s+$", ""))
    rows = lines.withColumn("raw", text).where(F.col("raw") != "")
    event = F.from_json("raw", EVENT_DDL, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    # Bound, so that a line is parsed once and not once per rule.
    checked = bind(event, lambda e: F.struct(e.alias("e"), _event_error(e).alias("error")))
    return rows.withColumn("__p", checked).withColumns({"e": F.col("__p.e"), "error": F.col("__p.error")}).drop("__p")


def good_events(parsed: DataFrame, *more: Column) -> DataFrame:
    """The events of good lines, and whatever else is asked of the lines."""
    e = F.col("e")
    return parsed.where("error is null").select(
        e["id"].alias("event_id"), e["projectId"].alias("project_id"), e["seq"].alias("seq"), F.to_timestamp(e["at"]).alias("at"), e["actor"].alias("actor"),
        e["type"].alias("type"), e["playhead"].alias("playhead"), F.coalesce(e["payload"], F.lit("{}")).alias("payload"), e["ops"].alias("ops"),
        e["revisionId"].alias("revision_id"), e["timelineDigest"].alias("timeline_digest"), *more,
    )


def read_event_log(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Events, and the skipped lines with file, 1-based line number, text and reason.

    Files are read in splits, never whole. A line's number is its place in its split plus the lines
    of the splits before it, so only one small row per split is ordered per file.
    """
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("__id")
    )
    parsed = parse_events(lines)
    blocks = lines.groupBy("file", "block").agg(F.min("__id").alias("__first"), F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = blocks.select("file", "block", "__first", before.alias("__before"))
    skipped = parsed.where("error is not null").join(starts, ["file", "block"]).select(
        "file", (F.col("__before") + F.col("__id") - F.col("__first") + 1).alias("line"), "raw", "error"
    )
    return good_events(parsed), skipped


def to_lines(events: DataFrame) -> DataFrame:
    """One JSON object per event, absent fields left out."""
    names = {"event_id": "id", "project_id": "projectId", "revision_id": "revisionId", "timeline_digest": "timelineDigest"}
    fields = []
    for c in ("event_id", "project_id", "seq", "at", "actor", "type", "playhead", "payload", "ops", "revision_id", "timeline_digest"):
        if c not in events.columns:
            continue
        value = F.col(c)
        if c == "at":
            value = F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
        if c in ("payload", "ops"):
            value = F.try_parse_json(value)
        fields.append(value.alias(names.get(c, c)))
    return events.select("project_id", "seq", F.to_json(F.struct(*fields)).alias("value"))


def write_event_log(events: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write a log in (project, seq) order; a long project spans several files, in order."""
    lines = to_lines(events)
    lines.repartitionByRange("project_id", "seq").sortWithinPartitions("project_id", "seq").select("value").write.mode(mode).text(path)


def upsert_events(existing: DataFrame | None, batch: DataFrame, arrival: str | None = None) -> DataFrame:
    """The log after a batch: a sequence number written again replaces the row it had.

    Of rows of one number inside the batch the last along the batch's column ``arrival`` stays,
    which the log doesn't keep; rows that arrived together are told apart by their content, so
    that the outcome never depends on the plan.
    """
    named = batch.withColumnRenamed(arrival, "__arrival") if arrival else batch.withColumn("__arrival", F.lit(0))
    kept = _last(named, ["project_id", "seq"])
    if existing is None:
        return kept
    return newest(existing.withColumn("__new", F.lit(0)).unionByName(kept.withColumn("__new", F.lit(1))), ["project_id", "seq"], "__new")


def _last(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The row of each key that arrived last."""
    rest = [c for c in rows.columns if c not in keys and c != "__arrival"]
    order = F.struct(F.col("__arrival"), F.to_json(F.struct(*rest)))
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("__row")).select(*keys, "__row.*").select(*[c for c in rows.columns if c != "__arrival"])


def newest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key along ``order``; duplicates are folded before the shuffle."""
    rest = [c for c in rows.columns if c not in keys and not c.startswith("__")]
    kept = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("__row"))
    return kept.select(*keys, "__row.*")


def save_events(events: DataFrame, path: str) -> None:
    """Store events so that one project's rows are found by directory, in files sorted by seq."""
    bucket = F.pmod(F.xxhash64("project_id"), F.lit(256))
    out = events.withColumn("bucket", bucket)
    out.repartitionByRange("bucket", "project_id", "seq").sortWithinPartitions("bucket", "project_id", "seq").write.partitionBy("bucket").mode("append").parquet(path)


def read_events(spark: SparkSession, path: str, project_id: str) -> DataFrame:
    """One project's stored events in order: one directory, then min/max pruning inside it."""
    bucket = spark.range(1).select(F.pmod(F.xxhash64(F.lit(project_id)), F.lit(256)).alias("b")).first()["b"]
    return spark.read.parquet(path).where((F.col("bucket") == bucket) & (F.col("project_id") == project_id)).drop("bucket").orderBy("seq")


def assign_seq(events: DataFrame, existing: DataFrame, order: list[str], coarse: Column | None = None) -> DataFrame:
    """Number new events after the highest stored number of their project."""
    top = existing.groupBy("project_id").agg(F.max("seq").alias("__top"))
    placed = ordinals(events, ["project_id"], order, "__n", coarse=coarse)
    return placed.join(top, "project_id", "left").withColumn("seq", F.coalesce("__top", F.lit(-1)) + 1 + F.col("__n")).drop("__top", "__n")

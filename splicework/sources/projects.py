"""Project documents: JSON in and out of flat tables, upserts and deletes, media folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.library import mime_of
from ..operators.quality import id_ok
from .eventlog import newest
from .shapes import CLIP_RULES, OP_RULES, broken

#: Fixed value: the only document version read.
SCHEMA_VERSION = 1

_KEY = "struct<t:bigint,value:string,easing:string>"
_EFFECT = f"struct<id:string,type:string,enabled:boolean,keyframes:array<{_KEY}>,rect:string,value:string>"
_CLIP = (
    "struct<id:string,sourceId:string,sourceIn:bigint,sourceOut:bigint,start:bigint,speed:double,enabled:boolean,"
    f"audio:struct<gain:double,mute:boolean>,effects:array<{_EFFECT}>,label:string,origin:string>"
)
_TRACK = f"struct<id:string,kind:string,name:string,clips:array<{_CLIP}>,muted:boolean,locked:boolean>"
_TIMELINE = f"struct<id:string,frameRate:struct<num:bigint,den:bigint>,resolution:struct<width:bigint,height:bigint>,tracks:array<{_TRACK}>>"
_SOURCE = (
    "struct<id:string,name:string,duration:bigint,locator:struct<kind:string,path:string,url:string,bucket:string,key:string,filename:string>,"
    "video:struct<width:bigint,height:bigint,frameRate:struct<num:bigint,den:bigint>,rotation:bigint,variableFrameRate:boolean>,"
    "audio:struct<sampleRate:bigint,channels:bigint>,mimeType:string,sizeBytes:bigint,contentHash:string>"
)
_REVISION = "struct<id:string,parentId:string,at:string,by:string,ops:string,summary:string,model:string,review:string,accepted:boolean>"
DOCUMENT = (
    f"schemaVersion bigint, id string, name string, createdAt string, updatedAt string, sources array<{_SOURCE}>, timeline {_TIMELINE}, stage string, "
    f"revisions array<{_REVISION}>, headRevisionId string, brief string, targetDurationUs bigint, "
    "coarseSnapshot string, coarseSnapshotAt string, review string, render string, meta string, _bad string"
)
#: Parts of a document that stay JSON text in the tables, by column and field: they go through as they are.
_AS_TEXT = {"coarse_snapshot": "coarseSnapshot", "review": "review", "render": "render", "meta": "meta"}


def parse_projects(documents: DataFrame, value: str = "value") -> DataFrame:
    """Documents with their content ``p`` and an ``error``; a bad one never hides the others."""
    def error(p: Column) -> Column:
        return (
            F.when(p.isNull() | p["_bad"].isNotNull(), "not a JSON object of the project shape")
            .when(~F.coalesce(p["schemaVersion"] == SCHEMA_VERSION, F.lit(False)), F.concat(F.lit("schema version "), F.coalesce(p["schemaVersion"].cast("string"), F.lit("missing"))))
            .when(~F.coalesce(id_ok("project", p["id"]), F.lit(False)), "id: expected a project id")
            .when(p["timeline"].isNull() | F.coalesce(F.size(p["timeline"]["tracks"]) < 1, F.lit(True)), "timeline: expected at least one track")
        )

    # As rows of a list, so that a document is parsed once however often its parts are asked for.
    whole = F.from_json(F.col(value), DOCUMENT, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    return documents.select("*", F.inline(F.transform(F.array(whole), lambda p: F.struct(p.alias("p"), error(p).alias("error")))))


def read_projects(spark: SparkSession, path: str, per_file: bool = True) -> DataFrame:
    """Parsed documents of a folder, one per file or one per line."""
    return parse_projects(spark.read.text(path, wholetext=per_file))


def project_tables(parsed: DataFrame) -> dict[str, DataFrame]:
    """Flat tables of the good documents, defaults filled in, orders made explicit.

    Snapshot, review, render settings, free-form data, the origin of clips, the values of effects and the edits of revisions
    stay JSON text, fields unknown here included; ``assemble_projects`` writes them back as they came.
    """
    good = parsed.where("error is null").select("p.*")
    pid = F.col("id").alias("project_id")
    t = good.select(pid, F.col("timeline.id").alias("timeline_id"), F.posexplode("timeline.tracks").alias("track_no", "t"))
    c = t.select("timeline_id", F.col("t.id").alias("track_id"), F.coalesce("t.kind", F.lit("video")).alias("kind"), F.posexplode("t.clips").alias("ord", "c"))
    long = lambda name: F.col(name).cast("bigint").alias(name)
    effects = c.select("timeline_id", "track_id", "ord", F.col("c.id").alias("clip_id"), F.posexplode("c.effects").alias("effect_ord", "e"))
    return {
        "projects": good.select(
            pid, F.coalesce("name", F.lit("Untitled")).alias("name"), F.coalesce("stage", F.lit("coarse")).alias("stage"), F.col("createdAt").alias("created_at"),
            F.col("updatedAt").alias("updated_at"), F.col("timeline.id").alias("timeline_id"), "timeline.resolution.width", "timeline.resolution.height",
            F.col("timeline.frameRate.num").alias("fps_num"), F.col("timeline.frameRate.den").alias("fps_den"), F.col("headRevisionId").alias("head_revision_id"),
            "brief", F.col("targetDurationUs").alias("target_us"), F.col("coarseSnapshotAt").alias("coarse_snapshot_at"), *[F.col(field).alias(c) for c, field in _AS_TEXT.items()],
        ),
        "sources": good.select(pid, F.posexplode("sources").alias("source_ord", "s")).select("project_id", long("source_ord"), F.col("s.id").alias("source_id"), "s.name", F.col("s.duration").alias("duration_us"), "s.locator", "s.video", "s.audio", F.col("s.mimeType").alias("mime"), F.col("s.sizeBytes").alias("size_bytes"), F.col("s.contentHash").alias("content_hash")),
        "tracks": t.select("timeline_id", F.col("t.id").alias("track_id"), long("track_no"), F.coalesce("t.kind", F.lit("video")).alias("kind"), F.col("t.name").alias("name"), F.coalesce("t.muted", F.lit(False)).alias("muted"), F.coalesce("t.locked", F.lit(False)).alias("locked")),
        "clips": c.select(
            "timeline_id", "track_id", "kind", long("ord"), F.col("c.id").alias("clip_id"), F.col("c.sourceId").alias("source_id"), F.col("c.sourceIn").alias("source_in"), F.col("c.sourceOut").alias("source_out"),
            F.col("c.start").alias("start"), F.coalesce("c.speed", F.lit(1.0)).alias("speed"), F.coalesce("c.enabled", F.lit(True)).alias("enabled"), F.coalesce("c.audio.gain", F.lit(1.0)).alias("gain"),
            F.coalesce("c.audio.mute", F.lit(False)).alias("mute"), F.col("c.label").alias("label"), F.col("c.origin").alias("origin"),
        ),
        "effects": effects.select("timeline_id", "track_id", long("ord"), "clip_id", long("effect_ord"), F.col("e.id").alias("effect_id"), F.col("e.type").alias("type"), F.coalesce("e.enabled", F.lit(True)).alias("enabled"), "e.rect", F.col("e.value").alias("color"), "e.keyframes"),
        "revisions": good.select(pid, F.posexplode("revisions").alias("rev_ord", "r")).select("project_id", long("rev_ord"), F.col("r.id").alias("revision_id"), F.col("r.parentId").alias("parent_id"), "r.at", "r.by", "r.model", "r.summary", "r.review", "r.accepted", "r.ops"),
    }


def _optional(df: DataFrame, *names: str) -> DataFrame:
    """The table with columns that it lacks as nulls."""
    return df.withColumns({n: F.lit(None).cast("string") for n in names if n not in df.columns})


def _listed(df: DataFrame, keys: list[str], order: str, item: Column, name: str) -> DataFrame:
    """The items of each key in an array, in their order."""
    return df.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), item.alias("item")))), lambda x: x["item"]).alias(name))


def _object(scalars: Column, **lists: str) -> Column:
    """JSON text of an object with ``scalars``, and of columns with lists of JSON text, which goes in as it is."""
    heads = [F.concat(F.lit(f'"{name}":['), F.array_join(F.coalesce(c, F.array().cast("array<string>")), ","), F.lit("]")) for name, c in lists.items()]
    rest = F.regexp_replace(F.substring(F.to_json(scalars), 2, (1 << 31) - 1), r'\A(?=")', ",")
    return F.concat(F.lit("{"), F.concat_ws(",", *heads), rest)


def assemble_projects(projects: DataFrame, tracks: DataFrame, clips: DataFrame, effects: DataFrame | None = None, sources: DataFrame | None = None, revisions: DataFrame | None = None) -> DataFrame:
    """Documents as JSON text from the flat tables; one document is the unit of output.

    Every level is gathered on its own keys before it joins the next, so no join multiplies rows; its text goes into the
    next as it is. What is stored as JSON text is written as JSON again; columns that a table lacks, and nulls, are left out of the document. Clips are told apart by
    track and position, so repeated ids keep their own effects.
    """
    json = lambda c: F.try_parse_json(F.col(c))
    none = F.array().cast("array<string>")
    clips = _optional(clips, "origin")
    parts = clips
    if effects is not None:
        key = F.transform("keyframes", lambda k: F.struct(k["t"].alias("t"), F.try_parse_json(k["value"]).alias("value"), k["easing"].alias("easing")))
        effect = F.struct(F.col("effect_id").alias("id"), "type", "enabled", key.alias("keyframes"), json("rect").alias("rect"), json("color").alias("value"))
        item = F.to_json(effect)  # variants can't be compared, so they are gathered as text
        parts = clips.join(_listed(effects, ["timeline_id", "track_id", "ord"], "effect_ord", item, "effects"), ["timeline_id", "track_id", "ord"], "left")
    else:
        parts = clips.withColumn("effects", none)
    clip = F.struct(
        F.col("clip_id").alias("id"), F.col("source_id").cast("string").alias("sourceId"), F.col("source_in").alias("sourceIn"), F.col("source_out").alias("sourceOut"), "start", "speed", "enabled",
        F.struct("gain", "mute").alias("audio"), "label", json("origin").alias("origin"),
    )
    listed = _listed(parts.withColumn("__item", _object(clip, effects="effects")), ["timeline_id", "track_id"], "ord", F.col("__item"), "clips")
    track = F.struct(F.col("track_id").alias("id"), "kind", "name", "muted", "locked")
    lanes = _optional(tracks, "name").join(listed, ["timeline_id", "track_id"], "left").withColumn("__item", _object(track, clips="clips"))
    rows = projects.join(_listed(lanes, ["timeline_id"], "track_no", F.col("__item"), "tracks"), "timeline_id")
    if sources is not None:
        own = _optional(sources, "mime", "size_bytes")
        item = F.to_json(F.struct(F.col("source_id").cast("string").alias("id"), "name", F.col("duration_us").alias("duration"), "locator", "video", "audio", F.col("mime").alias("mimeType"), F.col("size_bytes").cast("bigint").alias("sizeBytes"), F.col("content_hash").alias("contentHash")))
        rows = rows.join(_listed(own.withColumn("__item", item), ["project_id"], "source_ord", F.col("__item"), "sources"), "project_id", "left")
    else:
        rows = rows.withColumn("sources", none)
    if revisions is not None:
        own = _optional(revisions, "review", "summary", "model")
        item = F.to_json(F.struct(F.col("revision_id").alias("id"), F.col("parent_id").alias("parentId"), "at", "by", json("ops").alias("ops"), "summary", "model", json("review").alias("review"), "accepted"))
        rows = rows.join(_listed(own.withColumn("__item", item), ["project_id"], "rev_ord", F.col("__item"), "revisions"), "project_id", "left")
    else:
        rows = rows.withColumn("revisions", none)
    rows = _optional(rows, "created_at", "head_revision_id", "coarse_snapshot_at", *_AS_TEXT)
    timeline = F.struct(F.col("timeline_id").alias("id"), F.struct(F.col("fps_num").alias("num"), F.col("fps_den").alias("den")).alias("frameRate"), F.struct("width", "height").alias("resolution"))
    document = F.struct(
        F.lit(SCHEMA_VERSION).alias("schemaVersion"), F.col("project_id").alias("id"), "name", F.coalesce("created_at", "updated_at").alias("createdAt"), F.col("updated_at").alias("updatedAt"),
        "stage", F.col("coarse_snapshot_at").alias("coarseSnapshotAt"), F.col("head_revision_id").cast("string").alias("headRevisionId"),
        F.col("brief").alias("brief"), F.col("target_us").alias("targetDurationUs"), *[json(c).alias(field) for c, field in _AS_TEXT.items()],
    )
    whole = F.concat(F.lit('{"timeline":'), _object(timeline, tracks="tracks"), F.lit(","), F.substring(_object(document, sources="sources", revisions="revisions"), 2, (1 << 31) - 1))
    return rows.select("project_id", whole.alias("value"))


def write_projects(documents: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One document per line."""
    documents.select("value").write.mode(mode).text(path)


def upsert_projects(existing: DataFrame, updates: DataFrame) -> DataFrame:
    """Saving overwrites by id; of equal times the update wins."""
    both = existing.withColumn("__new", F.lit(0)).unionByName(updates.withColumn("__new", F.lit(1)))
    return newest(both.withColumn("__order", F.struct("updated_at", "__new")), ["project_id"], "__order")


def delete_projects(ids: DataFrame, *tables: tuple[DataFrame, str]) -> list[DataFrame]:
    """Each table without the rows of the deleted projects; pairs of table and its id column."""
    gone = ids.select(F.col("project_id").alias("__gone")).distinct()
    return [t.join(gone, t[key] == gone["__gone"], "left_anti") for t, key in tables]


def scan_media(spark: SparkSession, folder: str) -> DataFrame:
    """Files of a media folder with size and type; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length", "modificationTime")
    name = F.element_at(F.split("path", "/"), -1)
    return files.select("path", name.alias("filename"), F.col("length").alias("size_bytes"), mime_of(name).alias("mime"), F.col("modificationTime").alias("imported_at"))


def media_usage(media: DataFrame) -> DataFrame:
    return media.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("size_bytes"))


_OP = "struct<" + ",".join(f"{f}:string" for f in dict.fromkeys(r.field for r in OP_RULES)) + ">"


def parse_plans(replies: DataFrame, value: str = "value") -> DataFrame:
    """Replies as edit lists: an object with ``ops``, or a bare list; ``issues`` say where an edit breaks the shape of its kind.

    A reply with any issue, or that is neither, has an ``error``. Fields are read as text, so numbers are told by how they are written.
    """
    whole = F.from_json(value, f"summary string, ops array<{_OP}>")
    bare = F.when(F.ltrim(F.col(value)).startswith("["), F.from_json(value, f"array<{_OP}>"))
    rows = replies.withColumn("__w", whole).withColumns({"summary": F.col("__w.summary"), "ops": F.coalesce("__w.ops", bare)}).drop("__w")
    rows = rows.withColumn("issues", broken(F.col("ops"), OP_RULES, F.lit("ops"), "op"))
    return rows.withColumn("error", F.when(F.col("ops").isNull() | (F.size("issues") > 0), "reply did not match the op schema"))


def clip_issues(parsed: DataFrame) -> DataFrame:
    """Shape issues of the clips of parsed documents: project_id, issue, with the place of the clip in its document."""
    tracks = parsed.where("error is null").select(F.col("p.id").alias("project_id"), F.posexplode("p.timeline.tracks").alias("i", "t"))
    at = F.concat(F.lit("timeline.tracks["), F.col("i").cast("string"), F.lit("].clips"))
    return tracks.select("project_id", F.explode(broken(F.col("t.clips"), CLIP_RULES, at)).alias("issue"))

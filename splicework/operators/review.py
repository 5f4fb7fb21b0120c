"""Reviews of proposed edits: verdicts, previews, repair rounds, revisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..session import checkpoint
from ..functions.numeric import quotient
from ..functions.ranges import output_length, zero
from ..functions.text import headline
from .media import greedy_groups
from .quality import indexed
from .replay import _STATE, Replayed, _length, prepare_ops, replay_ops, replayed, upsert_key
from .sampling import GRADE
from .scan import last_known, ordinals, previous, scan


def align_verdicts(reviews: DataFrame) -> DataFrame:
    """Each proposed edit with its verdict; a missing verdict is a no."""
    zipped = F.posexplode(F.arrays_zip("ops", "accepted"))
    return reviews.select("review_id", zipped.alias("op_idx", "__v")).select(
        "review_id", F.col("op_idx").cast("bigint").alias("op_idx"), F.col("__v.ops").alias("op"), F.coalesce(F.col("__v.accepted"), F.lit(False)).alias("accepted")
    ).where(F.col("op").isNotNull())


def bootstrap_review(ops: DataFrame) -> DataFrame:
    """A fresh review: nothing accepted yet."""
    return ops.withColumn("accepted", F.lit(False))


def resolve_review(clips: DataFrame, ops: DataFrame, verdicts: DataFrame) -> tuple[Replayed, DataFrame]:
    """Baseline plus accepted edits in proposal order, and per edit whether it landed and why not."""
    flags = verdicts.select("timeline_id", F.col("op_idx").alias("__i"), "accepted")
    marked = ops.withColumn("__i", F.col("e.op_idx")).join(flags, ["timeline_id", "__i"], "left")
    done = replay_ops(clips, marked.where("accepted").select("timeline_id", "e"))
    told = done.outcomes.withColumn("__ran", F.lit(True))
    landed = flags.withColumnRenamed("__i", "op_idx").join(told, ["timeline_id", "op_idx"], "left").select(
        "timeline_id", "op_idx", (F.col("__ran").isNotNull() & F.col("message").isNull()).alias("landed"), F.col("message").alias("failure")
    )
    return done, landed


def track_ends(clips: DataFrame) -> DataFrame:
    """Per track its kind and end, and the furthest end of every other track."""
    end = F.when(F.col("enabled"), F.col("start") + output_length()).otherwise(zero())
    tracks = clips.groupBy("timeline_id", "track_id").agg(F.greatest(zero(), F.max(end)).alias("end"))
    # Two best ends per timeline answer "all tracks but mine" for every track.
    best = tracks.groupBy("timeline_id").agg(F.max(F.struct("end", "track_id")).alias("top"))
    second = tracks.join(best, "timeline_id").where(F.col("track_id") != F.col("top.track_id")).groupBy("timeline_id").agg(F.max("end").alias("next"))
    joined = tracks.join(best, "timeline_id").join(second, "timeline_id", "left")
    return joined.select(
        "timeline_id", "track_id", "end",
        F.when(F.col("track_id") == F.col("top.track_id"), F.coalesce("next", zero())).otherwise(F.col("top.end")).alias("others_end"),
        F.col("top.end").alias("duration_us"),
    )


def preview_ops(clips: DataFrame, ops: DataFrame, prepared: DataFrame) -> DataFrame:
    """Each edit alone on the baseline: what happens to its clip and to the running length.

    Only the target clip is replayed. On a video track the length changes by what the clip changes;
    on other tracks the rest of the track is known from its two furthest ends. ``prepared`` are the
    same clips as structs.
    """
    target = prepared.select("timeline_id", F.col("c.clip_id").alias("__id"), F.col("c").alias("before"))
    places = indexed(clips).select("timeline_id", F.col("clip_id").alias("__id"), F.col("clip_index"))
    rows = ops.withColumn("__id", F.col("e.clip_id")).join(target, ["timeline_id", "__id"], "left").join(places, ["timeline_id", "__id"], "left")
    held = F.when(F.col("before").isNull(), F.array().cast(schemas.array(schemas.CLIP))).otherwise(F.array("before"))
    start = F.struct(held.alias("clips"), F.array().cast("array<struct<op_idx:bigint,message:string>>").alias("done")).cast(_STATE)
    rows = rows.withColumns({"__ops": F.array("e"), "__start": start}).withColumn("__state", replayed(clips.sparkSession)).drop("__ops", "__start")
    after = F.col("__state.clips")
    rows = rows.withColumns({
        "reason": F.get("__state.done", F.lit(0))["message"],
        "after": F.try_element_at(F.filter(after, lambda c: c["clip_id"] == F.col("e.clip_id")), F.lit(1)),
        "__track": F.coalesce(F.col("before.track_id"), F.col("e.track_id")),
        "__kind": F.coalesce(F.col("before.kind"), F.col("e.track_kind")),
    })
    used = lambda c: F.when(c["enabled"], _length(c)).otherwise(zero())
    ends = F.aggregate(after, zero(), lambda s, c: F.greatest(s, F.when(c["enabled"], c["start"] + _length(c)).otherwise(zero())))
    rows = rows.withColumns({
        "__gained": F.aggregate(after, zero(), lambda s, c: s + used(c)) - F.when(F.col("before").isNotNull(), used(F.col("before"))).otherwise(zero()),
        "__end": ends,
    })
    fine = F.col("reason").isNull()
    before = F.when(F.col("before").isNotNull(), F.struct(F.col("clip_index").alias("index"), *[F.col(f"before.{f}").alias(f) for f in ("label", "source_in", "source_out", "speed")]))
    anchor = F.when(F.col("e.op") == "split", F.col("e.at").cast("double")).when(F.col("before").isNull(), F.lit(0.0)).otherwise(F.col("before.start") + _length(F.col("before")) / 2)
    # All but the running length is known by now, so clips and edits don't go through the joins below.
    rows = rows.select(
        "timeline_id", F.col("e.op_idx").alias("op_idx"), F.col("e.op").alias("op"), F.col("e.clip_id").alias("clip_id"), anchor.alias("anchor_us"),
        F.when(F.col("before").isNull(), zero()).otherwise(_length(F.col("before"))).alias("before_us"),
        F.when(fine & F.col("after").isNotNull(), _length(F.col("after"))).otherwise(zero()).alias("after_us"), fine.alias("applicable"), "reason",
        headline(F.col("e"), before, F.when(fine, F.col("after")), GRADE).alias("headline"), "__track", "__kind", "__gained", "__end",
    )
    # The furthest end of the track without this clip.
    by_end = clips.where("enabled").select("timeline_id", F.col("track_id").alias("__track"), F.struct((F.col("start") + output_length()).alias("end"), F.col("clip_id").alias("id")).alias("s"))
    top = by_end.groupBy("timeline_id", "__track").agg(F.max("s").alias("__top"))
    runner = by_end.join(top, ["timeline_id", "__track"]).where(F.col("s.id") != F.col("__top.id")).groupBy("timeline_id", "__track").agg(F.max("s.end").alias("__second"))
    tracks = track_ends(clips).select("timeline_id", F.col("track_id").alias("__track"), F.col("end").alias("__track_end"), "others_end", "duration_us")
    whole = clips.groupBy("timeline_id").agg(F.greatest(zero(), F.max(F.when(F.col("enabled"), F.col("start") + output_length()))).alias("__total"))
    rows = rows.join(tracks, ["timeline_id", "__track"], "left").join(top, ["timeline_id", "__track"], "left").join(runner, ["timeline_id", "__track"], "left").join(whole, "timeline_id", "left")
    rest = F.when(F.col("__top.id") == F.col("clip_id"), F.coalesce("__second", zero())).otherwise(F.coalesce(F.col("__top.end"), zero()))
    video = F.coalesce("__track_end", zero()) + F.col("__gained")
    new_end = F.when(F.col("__kind") == "video", video).otherwise(F.greatest(rest, F.col("__end")))
    total = F.coalesce("__total", zero())
    # A track the edit opens has no row of its own; the others are then the whole timeline.
    new_total = F.greatest(F.coalesce("others_end", total), new_end)
    return rows.select(
        "timeline_id", "op_idx", "op", "clip_id", "anchor_us", "before_us", "after_us", F.when(F.col("applicable"), new_total - total).otherwise(zero()).alias("delta_us"), "applicable", "reason", "headline"
    )


def cluster_proposals(previews: DataFrame, gap_us: float) -> DataFrame:
    """Bubbles over a timeline: proposals within the gap of the bubble's first one share it.

    All must be accepted for a bubble to count as accepted; one stale proposal makes it stale.
    Input ``timeline_id, op_idx, anchor_us, accepted, applicable``.
    """
    placed = ordinals(previews, ["timeline_id"], ["anchor_us", "op_idx"], "__n", coarse=F.floor(F.col("anchor_us") / 60e6).cast("bigint"))
    placed = placed.withColumn("__n", F.col("__n").cast("bigint"))
    behind = scan(placed, ["timeline_id"], ["__n"], ordinal="__n", __p=previous(F.col("anchor_us")))
    fresh = F.when(F.col("__p").isNull() | (F.col("anchor_us") - F.col("__p") > gap_us), F.col("__n"))
    islands = scan(behind.withColumn("__f", fresh), ["timeline_id"], ["__n"], ordinal="__n", __island=last_known(F.col("__f")))
    grouped = greedy_groups(islands.drop("__f", "__p"), ["timeline_id", "__island"], "__n", F.col("anchor_us"), F.col("anchor_us"), gap_us, "bubble")
    return grouped.groupBy("timeline_id", "bubble").agg(
        F.min("anchor_us").alias("at_us"), F.count(F.lit(1)).alias("n"), F.min_by("op_idx", "__n").alias("first_op"),
        F.bool_and("accepted").alias("accepted"), F.bool_or(~F.col("applicable")).alias("stale"),
    )


def canonical_ops(ops: DataFrame) -> DataFrame:
    """Edits with a key that is equal exactly for structurally equal edits, nested parts included."""
    fields = sorted(c for c in ops.columns if c not in ("timeline_id", "op_idx", "round", "accepted"))
    return ops.withColumn("canonical", F.to_json(F.struct(*fields)))


def dedupe_resends(ops: DataFrame, order: list[str]) -> DataFrame:
    """Structural duplicates dropped, the first along ``order`` kept."""
    keyed = canonical_ops(ops)
    firsts = keyed.groupBy("timeline_id", "canonical").agg(F.min(F.struct(*order)).alias("__at"))
    spot = F.struct(*order)
    return keyed.join(firsts, ["timeline_id", "canonical"]).where(spot == F.col("__at")).drop("canonical", "__at")


def merge_repair_round(clips: DataFrame, first: DataFrame, second: DataFrame, sources: DataFrame | None = None, tracks: DataFrame | None = None) -> Replayed:
    """What of round one applied, then the new edits, resends out, replayed as one batch.

    ``first`` and ``second`` are plain edit rows of two rounds.
    """
    # Round two reads this several times, so the first replay is settled once.
    one = checkpoint(replay_ops(clips, prepare_ops(first, sources, tracks)).outcomes.where("message is null").select("timeline_id", "op_idx"))
    both = first.join(one, ["timeline_id", "op_idx"], "left_semi").withColumn("round", F.lit(0)).unionByName(second.withColumn("round", F.lit(1)))
    kept = dedupe_resends(both, ["round", "op_idx"])
    numbered = ordinals(kept, ["timeline_id"], ["round", "op_idx"], "__n", coarse=F.shiftleft(F.col("round").cast("bigint"), 40) + quotient("op_idx", 1 << 16))
    again = checkpoint(numbered).drop("op_idx", "round").withColumnRenamed("__n", "op_idx")
    return replay_ops(clips, prepare_ops(again, sources, tracks))


def pass_accepted(verdicts: DataFrame) -> DataFrame:
    """Whether anything of a pass was kept."""
    return verdicts.groupBy("review_id").agg(F.bool_or("accepted").alias("accepted"))


def commit_revisions(projects: DataFrame, outcomes: DataFrame, verdicts: DataFrame | None = None) -> DataFrame:
    """A revision per replayed batch: how many edits applied, its parent, and whether the pass was kept."""
    counts = outcomes.groupBy("timeline_id").agg(F.count_if(F.col("message").isNull()).alias("applied"), F.count_if(F.col("message").isNotNull()).alias("rejected"))
    rows = projects.join(counts, F.col("project_id") == F.col("timeline_id")).select(
        "project_id", F.col("head_revision_id").alias("parent_id"), "applied", "rejected",
        F.concat_ws("_", F.lit("rev"), F.col("project_id").cast("string"), F.coalesce(F.col("head_revision_id").cast("string"), F.lit("0"))).alias("revision_id"),
    )
    if verdicts is None:
        return rows.withColumn("accepted", F.lit(None).cast("boolean"))
    kept = verdicts.groupBy(F.col("timeline_id").alias("project_id")).agg(F.bool_or("accepted").alias("accepted"), F.count(F.lit(1)).alias("verdicts"))
    return rows.join(kept, "project_id", "left")


def applied_ops(ops: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(timeline_id, ops): the edits that applied, in order, as a JSON list; ``ops`` are plain edit rows, null fields left out."""
    fields = sorted(c for c in ops.columns if c not in ("timeline_id", "op_idx", "round", "accepted"))
    landed = outcomes.where("message is null").select("timeline_id", "op_idx")
    rows = ops.join(landed, ["timeline_id", "op_idx"], "left_semi").select("timeline_id", F.struct("op_idx", F.to_json(F.struct(*fields)).alias("op")).alias("o"))
    listed = F.transform(F.array_sort(F.collect_list("o")), lambda o: o["op"])
    return rows.groupBy("timeline_id").agg(F.concat(F.lit("["), F.array_join(listed, ","), F.lit("]")).alias("ops"))


def commit_ops(projects: DataFrame, batches: DataFrame, ops: DataFrame, outcomes: DataFrame, verdicts: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """A batch of edits per timeline as a revision, and the projects with their heads moved on: revisions, projects.

    ``batches``: timeline_id, parent_id (the head that the batch was made on), at, by, model, summary. ``ops`` are the batch's plain
    edits, with ``accepted`` where a person judged them: then ``verdicts`` (timeline_id, op_idx, accepted) go along for
    every edit, those turned down included, and the revision is accepted if one was. The revision holds what
    applied, also if that is nothing, and its id follows from the project, the parent, the time and the edits, so a job that
    runs again makes the same one. A head moves only where it is still the batch's parent; other batches come out with
    ``committed`` false and leave their project alone, and so do batches without a project.
    """
    rows = batches.join(applied_ops(ops, outcomes), "timeline_id", "left").withColumn("ops", F.coalesce("ops", F.lit("[]")))
    if verdicts is None:
        rows = rows.withColumns({"verdicts": F.lit(None).cast("array<struct<op_idx:bigint,accepted:boolean>>"), "accepted": F.lit(None).cast("boolean")})
    else:
        said = F.struct(F.col("op_idx").cast("bigint").alias("op_idx"), F.coalesce("accepted", F.lit(False)).alias("accepted"))
        own = verdicts.groupBy("timeline_id").agg(F.array_sort(F.collect_list(said)).alias("verdicts"), F.bool_or(F.coalesce("accepted", F.lit(False))).alias("accepted"))
        rows = rows.join(own, "timeline_id", "left")
    heads = projects.select(F.col("project_id").alias("timeline_id"), F.col("head_revision_id").cast("string").alias("__head"), F.lit(True).alias("__there"))
    named = F.sha2(F.to_json(F.struct("timeline_id", F.col("parent_id").alias("parent"), "at", "ops")), 256)
    found = rows.withColumn("parent_id", F.col("parent_id").cast("string")).join(heads, "timeline_id", "left").select(
        F.col("timeline_id").alias("project_id"), F.concat(F.lit("rev_"), F.substring(named, 1, 20)).alias("revision_id"), "parent_id", "at", "by", "model", "summary", "ops", "verdicts", "accepted",
        (F.coalesce("__there", F.lit(False)) & F.col("parent_id").eqNullSafe(F.col("__head"))).alias("committed"),
    )
    moved = found.where("committed").select("project_id", F.col("revision_id").alias("__to"), F.col("at").alias("__at"))
    after = projects.withColumn("head_revision_id", F.col("head_revision_id").cast("string")).join(moved, "project_id", "left").withColumns({
        "head_revision_id": F.coalesce("__to", "head_revision_id"), "updated_at": F.coalesce("__at", "updated_at"),
    })
    return found, after.select(*projects.columns)


def settle_reviews(projects: DataFrame, reviews: DataFrame, baseline: DataFrame, prepared: DataFrame, ops: DataFrame, verdicts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Reviews closed for good: clips, revisions and projects afterwards.

    ``reviews``: timeline_id, action, parent_id, at, by, model, summary. A finished one replays its accepted edits on its baseline and commits
    them with all verdicts, under the model's name or that of the local rules; a discarded one leaves no revision, and its
    timeline is the baseline again. ``baseline`` has the clips (timeline_id, ord, c), ``prepared`` the edits (timeline_id, e).
    """
    finished = reviews.where("action = 'finish'")
    named = finished.withColumns({"model": F.when(F.col("by") == "model", F.col("model")).otherwise("local-heuristics"), "by": F.lit("llm")})
    ids = finished.select("timeline_id")
    own = verdicts.join(ids, "timeline_id", "left_semi")
    done, _ = resolve_review(baseline.join(ids, "timeline_id", "left_semi"), prepared.join(ids, "timeline_id", "left_semi"), own)
    revisions, after = commit_ops(projects, named.drop("action"), ops.join(ids, "timeline_id", "left_semi"), done.outcomes, own)
    kind, fields = schemas.struct(schemas.CLIP), baseline.schema["c"].dataType.fieldNames()
    kept = baseline.join(ids, "timeline_id", "left_anti").join(reviews.select("timeline_id"), "timeline_id", "left_semi")
    clips = kept.select("timeline_id", "ord", F.col("c").cast(kind).alias("c")).unionByName(done.clips.select("timeline_id", "ord", F.struct(*fields).cast(kind).alias("c")))
    return clips, revisions, after


def close_reviews(reviews: DataFrame) -> DataFrame:
    """What closing does: finish commits the accepted edits, discard leaves no revision."""
    finished = F.col("action") == "finish"
    return reviews.withColumns({
        "model_label": F.when(finished, F.when(F.col("by") == "model", F.col("model")).otherwise("local-heuristics")),
        "committed": F.when(finished, F.col("accepted_ops")).otherwise(F.lit(0)), "stored_verdicts": F.when(finished, F.col("ops")).otherwise(F.lit(0)),
        "has_revision": finished,
    })


def effective_revisions(revisions: DataFrame, undos: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Revisions still standing, and the undone ones, which live on only in the undo rows."""
    gone = undos.select("project_id", "revision_id").where("revision_id is not null").distinct()
    keys = ["project_id", "revision_id"]
    return revisions.join(gone, keys, "left_anti"), revisions.join(gone, keys, "left_semi")


def freeze_coarse(clips: DataFrame, projects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Copy the timelines under snapshot ids and move their projects to the handoff stage."""
    ids = projects.select(F.col("project_id").alias("timeline_id"))
    snap = clips.join(ids, "timeline_id", "left_semi").withColumn("snapshot_id", F.concat(F.lit("snap_"), F.col("timeline_id").cast("string")))
    return snap, projects.withColumns({"stage": F.lit("handoff"), "coarse_snapshot_id": F.concat(F.lit("snap_"), F.col("project_id").cast("string"))})


def grade_all(clips: DataFrame, grade: Column) -> DataFrame:
    """One grade edit per clip of a timeline."""
    return clips.select("timeline_id", F.col("ord").alias("op_idx"), F.lit("setColor").alias("op"), "clip_id", grade.alias("color"))


def keep_only(clips: DataFrame, kept: DataFrame) -> DataFrame:
    """Edits that switch off every other enabled clip of the first track: ``timeline_id, clip_id`` to keep."""
    chosen = kept.select("timeline_id", F.col("clip_id").alias("__keep"))
    rows = clips.where("enabled and track_id = 0").join(chosen, "timeline_id").where(F.col("clip_id") != F.col("__keep"))
    return rows.select("timeline_id", F.col("ord").alias("op_idx"), F.lit("setEnabled").alias("op"), "clip_id", F.lit(False).alias("enabled"))


def upsert_keyframes(keys: DataFrame, frame_us: Column) -> DataFrame:
    """Write framings into key arrays: ``keys, writes (array of at + framing)``, in write order."""
    near = F.greatest(F.lit(1.0), frame_us / 2)
    written = F.aggregate("writes", F.col("keys").cast(schemas.array(schemas.KEY)), lambda ks, w: upsert_key(ks, w["at"], w, near).cast(schemas.array(schemas.KEY)))
    return keys.withColumn("keys", written)


def replay_check(recomputed: DataFrame, events: DataFrame) -> DataFrame:
    """Logged digests that the replay does not reproduce; events without a digest say nothing."""
    logged = events.where("timeline_digest is not null").select("project_id", "seq", "timeline_digest")
    return logged.join(recomputed, ["project_id", "seq"]).where(F.col("timeline_digest") != F.col("digest"))


def push_in(effect_id, length, start: float = 1.0, end: float = 1.12) -> Column:
    """A two-key framing across a clip."""
    key = lambda t, scale: F.struct(
        t.cast("bigint").alias("t"), F.lit(scale).alias("scale"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("rotation"), F.lit("easeInOut").alias("easing")
    )
    none = {"rect": schemas.RECT, "color": schemas.GRADE}
    return F.struct(
        effect_id.alias("effect_id"), F.lit("transform").alias("type"), F.lit(True).alias("enabled"), F.array(key(F.lit(0), start), key(F.greatest(zero(), length), end)).alias("keys"),
        *[F.lit(None).cast(schemas.struct(ddl)).alias(n) for n, ddl in none.items()], F.lit(None).cast("string").alias("rationale"),
    )

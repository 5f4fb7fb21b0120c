"""Replay against a plain model: lists and dicts, one edit at a time."""

import math
import random

from pyspark.sql import functions as F

from conftest import rows
from splicework import schemas
from splicework.operators import replay as r
from splicework.operators import review as rv
from splicework.operators.timeline import reflow

KINDS = ["trim", "split", "remove", "setEnabled", "move", "setSpeed", "setAudio", "setLabel", "duplicateClip", "insertClip", "addEffect", "removeEffect", "setColor"]
OP_COLS = "timeline_id bigint, op_idx bigint, op string, clip_id string, source_in bigint, source_out bigint, at bigint, to_index bigint, speed double, enabled boolean, gain double, mute boolean, label string, new_clip_id string, track_id bigint, source_id bigint, at_index bigint, place string, effect_id string, grade double"
CLIP_COLS = "timeline_id bigint, track_id bigint, kind string, ord bigint, clip_id string, source_id bigint, source_in bigint, source_out bigint, start bigint, speed double, enabled boolean, gain double, mute boolean, label string"
LIMIT = {1: 1000, 2: 500}
KIND = {0: "video", 1: "audio"}


def half_up(x):
    return math.floor(x + 0.5)


def length(c):
    return half_up(max(0, c["out"] - c["in"]) / c["speed"])


def settle(tracks):
    for t, clips in tracks.items():
        clips[:] = [c for c in clips if c["out"] > c["in"]]
        if KIND[t] == "video":
            at = 0
            for c in clips:
                c["start"] = at
                at += length(c) if c["enabled"] else 0
        else:
            clips.sort(key=lambda c: (c["start"], c["id"]))


def apply_one(tracks, op):
    """Change ``tracks`` or raise."""
    kind = op["op"]
    if kind == "insertClip":
        t, limit = op["track_id"], LIMIT.get(op["source_id"])
        if t not in tracks or op["source_out"] <= op["source_in"] or limit is None or op["source_out"] > limit:
            raise ValueError
        clips = tracks[t]
        at = len(clips) if op["at_index"] is None else min(op["at_index"], len(clips))
        clips.insert(at, {"id": op["new_clip_id"], "src": op["source_id"], "in": op["source_in"], "out": op["source_out"], "start": 0, "speed": op["speed"] or 1.0,
                          "enabled": True, "gain": 1.0, "mute": False, "label": None, "fx": []})
        return
    found = [(t, i) for t, clips in sorted(tracks.items()) for i, c in enumerate(clips) if c["id"] == op["clip_id"]]
    if not found:
        raise ValueError
    t, i = found[0]
    clips, c = tracks[t], tracks[t][i]
    if kind == "trim":
        a = c["in"] if op["source_in"] is None else op["source_in"]
        b = c["out"] if op["source_out"] is None else op["source_out"]
        if a < 0 or b <= a or b > LIMIT.get(c["src"], b):
            raise ValueError
        c["in"], c["out"] = a, b
    elif kind == "split":
        cut = c["in"] + half_up((op["at"] - c["start"]) * c["speed"])
        if not c["start"] < op["at"] < c["start"] + length(c) or not c["in"] < cut < c["out"]:
            raise ValueError
        clips.insert(i + 1, {**c, "id": op["new_clip_id"], "in": cut, "start": op["at"], "fx": list(c["fx"])})
        c["out"] = cut
    elif kind == "remove":
        del clips[i]
    elif kind == "setEnabled":
        c["enabled"] = op["enabled"]
    elif kind == "move":
        clips.insert(min(op["to_index"], len(clips) - 1), clips.pop(i))
    elif kind == "setSpeed":
        if half_up((c["out"] - c["in"]) / op["speed"]) <= 0:
            raise ValueError
        c["speed"] = op["speed"]
    elif kind == "setAudio":
        c["gain"] = c["gain"] if op["gain"] is None else op["gain"]
        c["mute"] = c["mute"] if op["mute"] is None else op["mute"]
    elif kind == "setLabel":
        c["label"] = op["label"]
    elif kind == "duplicateClip":
        start = (-1 if KIND[t] == "video" else 0) if op["place"] == "start" else c["start"] + length(c)
        clips.insert(0 if op["place"] == "start" else i + 1, {**c, "id": op["new_clip_id"], "start": start, "fx": list(c["fx"])})
    elif kind == "addEffect":
        if op["effect_id"] in c["fx"] or any(f == op["effect_id"] for f in c["fx"]):
            raise ValueError
        c["fx"] = c["fx"] + [op["effect_id"]]
    elif kind == "removeEffect":
        if op["effect_id"] not in c["fx"]:
            raise ValueError
        c["fx"] = [f for f in c["fx"] if f != op["effect_id"]]
    elif kind == "setColor":
        rest = [f for f in c["fx"] if f != "grade"]
        c["fx"] = rest + ["grade"] if op["grade"] else rest


def model(clips, ops):
    tracks = {0: [], 1: []}
    for c in sorted(clips, key=lambda c: c[3]):
        tracks[c[1]].append({"id": c[4], "src": c[5], "in": c[6], "out": c[7], "start": c[8], "speed": c[9], "enabled": c[10], "gain": c[11], "mute": c[12], "label": c[13], "fx": []})
    settle(tracks)
    bad = set()
    for op in sorted(ops, key=lambda o: o["op_idx"]):
        try:
            apply_one(tracks, op)
            settle(tracks)
        except ValueError:
            bad.add(op["op_idx"])
    out = [(t, c["id"], c["in"], c["out"], c["start"], c["speed"], c["enabled"], c["gain"], c["mute"], c["label"], len(c["fx"])) for t, cs in tracks.items() for c in cs]
    return out, bad


def random_case(rng, timeline, kinds):
    clips = []
    for n in range(rng.randrange(1, 6)):
        t = 0 if n < 4 else 1
        a = rng.randrange(0, 400)
        clips.append((timeline, t, KIND[t], n, f"clp_{n}", rng.choice([1, 2, 3]), a, a + rng.randrange(1, 100), rng.randrange(0, 300), rng.choice([0.5, 1.0, 2.0]), rng.random() < 0.8, 1.0, False, None))
    ops = []
    for n in range(rng.randrange(0, 9)):
        kind = rng.choice(kinds)
        a = rng.randrange(0, 500)
        op = dict.fromkeys([c.split()[0] for c in OP_COLS.split(", ")])
        op.update(timeline_id=timeline, op_idx=n, op=kind, clip_id=None if kind == "insertClip" else rng.choice([f"clp_{rng.randrange(6)}", f"clp_n{rng.randrange(8)}"]))
        if kind in ("trim", "insertClip"):
            op.update(source_in=a if kind != "trim" or rng.random() < 0.7 else None, source_out=a + rng.randrange(-5, 120) if kind != "trim" or rng.random() < 0.7 else None)
        op["new_clip_id"] = f"clp_n{n}" if kind in ("split", "duplicateClip", "insertClip") else None
        op["at"] = rng.randrange(0, 300) if kind == "split" else None
        op["to_index"] = rng.randrange(0, 7) if kind == "move" else None
        op["speed"] = rng.choice([0.5, 1.0, 3.0, 20.0]) if kind in ("setSpeed", "insertClip") else None
        op["enabled"] = rng.random() < 0.5 if kind == "setEnabled" else None
        op["gain"] = rng.choice([None, 0.5]) if kind == "setAudio" else None
        op["mute"] = rng.choice([None, True, False]) if kind == "setAudio" else None
        op["label"] = f"l{n}" if kind == "setLabel" else None
        op["effect_id"] = rng.choice(["fx_a", "fx_b"]) if kind in ("addEffect", "removeEffect") else None
        op["grade"] = rng.choice([None, 0.0, 0.5]) if kind == "setColor" else None
        if kind == "insertClip":
            op.update(track_id=rng.choice([0, 1, 2]), source_id=rng.choice([1, 2, 9]), at_index=rng.choice([None, 0, 2, 9]))
        op["place"] = rng.choice(["start", "after"]) if kind == "duplicateClip" else None
        ops.append(op)
    return clips, ops


def frames(spark, cases):
    clips = spark.createDataFrame([c for cs, _ in cases for c in cs], CLIP_COLS)
    names = [c.split()[0] for c in OP_COLS.split(", ")]
    ops = spark.createDataFrame([tuple(o[n] for n in names) for _, os in cases for o in os], OP_COLS)
    sources = spark.createDataFrame(list(LIMIT.items()), "source_id bigint, duration_us bigint")
    tracks = spark.createDataFrame([(cs[0][0], t, k) for cs, _ in cases for t, k in KIND.items()], "timeline_id bigint, track_id bigint, kind string")
    nothing = F.lit(None)
    effect = F.struct(F.col("effect_id"), F.lit("volume").alias("type"), F.lit(True).alias("enabled"), F.array().cast(schemas.array(schemas.KEY)).alias("keys"),
                      nothing.cast(schemas.struct(schemas.RECT)).alias("rect"), nothing.cast(schemas.struct(schemas.GRADE)).alias("color"), nothing.cast("string").alias("rationale"))
    zero = F.lit(0.0)
    color = F.struct(F.col("grade").alias("exposure"), *[zero.alias(g) for g in ("brilliance", "contrast", "saturation", "warmth", "tint")])
    ops = ops.withColumns({"effect": F.when(F.col("op") == "addEffect", effect), "color": F.when(F.col("grade").isNotNull(), color)})
    return r.prepare_clips(reflow(clips), sources), r.prepare_ops(ops, sources, tracks)


def compare(spark, cases, run):
    clips, ops = frames(spark, cases)
    done = run(clips, ops)
    got = {}
    for row in done.clips.select("timeline_id", "ord", "track_id", "clip_id", "source_in", "source_out", "start", "speed", "enabled", "gain", "mute", "label", F.size("effects")).collect():
        got.setdefault(row[0], []).append(row)
    failed = {}
    for row in done.outcomes.where("message is not null").collect():
        failed.setdefault(row["timeline_id"], set()).add(row["op_idx"])
    total = 0
    for cs, os in cases:
        timeline = cs[0][0]
        want, bad = model(cs, os)
        mine = [tuple(x[2:]) for x in sorted(got.get(timeline, []), key=lambda x: (x["track_id"], x["ord"]))]
        assert mine == want, (timeline, os, mine, want)
        assert failed.get(timeline, set()) == bad, (timeline, os)
        total += len(os)
    assert total > 100


def test_any_batch_by_timeline(spark):
    rng = random.Random(11)
    compare(spark, [random_case(rng, t, KINDS) for t in range(80)], r.replay_by_timeline)


def test_any_batch_by_the_cheapest_way(spark):
    rng = random.Random(12)
    few = [["setLabel", "setAudio", "setEnabled"], ["trim", "setSpeed", "remove", "setLabel", "addEffect", "removeEffect", "setColor"], KINDS]
    compare(spark, [random_case(rng, t, few[t % 3]) for t in range(80)], r.replay_ops)


def test_partial_failure_reports_and_goes_on(spark):
    base = random_case(random.Random(1), 1, ["setLabel"])[0]
    ops = [dict.fromkeys([c.split()[0] for c in OP_COLS.split(", ")]) | dict(timeline_id=1, op_idx=i, op=k, clip_id=c, label="x") for i, (k, c) in enumerate([("setLabel", "clp_0"), ("remove", "clp_ghost")])]
    clips, edits = frames(spark, [(base, ops)])
    done = r.replay_ops(clips, edits)
    assert rows(done.outcomes.select("op_idx", "message")) == [(0, None), (1, "no clip clp_ghost on the timeline")]


def test_repair_round_keeps_what_applied(spark):
    clip = (1, 0, "video", 0, "clp_0", 1, 0, 100, 0, 1.0, True, 1.0, False, None)
    make = lambda i, **kw: dict.fromkeys([c.split()[0] for c in OP_COLS.split(", ")]) | dict(timeline_id=1, op_idx=i) | kw
    first = [make(0, op="setLabel", clip_id="clp_0", label="a"), make(1, op="remove", clip_id="clp_x")]
    second = [make(0, op="setLabel", clip_id="clp_0", label="a"), make(1, op="setSpeed", clip_id="clp_0", speed=2.0)]
    names = [c.split()[0] for c in OP_COLS.split(", ")]
    frame = lambda os: spark.createDataFrame([tuple(o[n] for n in names) for o in os], OP_COLS)
    clips, _ = frames(spark, [([clip], first)])
    done = rv.merge_repair_round(clips, frame(first), frame(second))
    assert rows(done.outcomes.select("op_idx", "message")) == [(0, None), (1, None)]
    assert rows(done.clips.select("label", "speed")) == [("a", 2.0)]


def test_keys_follow_the_footage(spark):
    clip = (1, 0, "video", 0, "clp_0", 1, 100, 300, 0, 1.0, True, 1.0, False, None)
    sources = spark.createDataFrame([(1, 1000)], "source_id bigint, duration_us bigint")
    keys = spark.createDataFrame([("clp_0", "fx_1", 0, "transform", True, i, t, s, 0.0, 0.0, 0.0, "linear") for i, (t, s) in enumerate([(0, 1.0), (100, 2.0)])],
                                 "clip_id string, effect_id string, effect_ord bigint, type string, effect_enabled boolean, key_idx bigint, t bigint, scale double, x double, y double, rotation double, easing string")
    names = [c.split()[0] for c in OP_COLS.split(", ")]

    def after(**kw):
        op = dict.fromkeys(names) | dict(timeline_id=1, op_idx=0, clip_id="clp_0") | kw
        clips = r.prepare_clips(reflow(spark.createDataFrame([clip], CLIP_COLS)), sources, keys)
        ops = r.prepare_ops(spark.createDataFrame([tuple(op[n] for n in names)], OP_COLS), sources)
        return [[(k["t"], k["scale"]) for k in row["effects"][0]["keys"]] for row in r.replay_ops(clips, ops).clips.orderBy("ord").collect()]

    assert after(op="trim", source_in=50) == [[(50, 1.0), (150, 2.0)]]
    assert after(op="trim", source_in=150) == [[(0, 1.5), (50, 2.0)]]
    assert after(op="setSpeed", speed=2.0) == [[(0, 1.0), (50, 2.0)]]
    assert after(op="split", at=40, new_clip_id="clp_r") == [[(0, 1.0), (40, 1.4)], [(0, 1.4), (60, 2.0)]]


def test_edits_and_clips_without_a_timeline_stay_apart(spark):
    clip = [(None, 0, "video", 0, "a", 1, 0, 100, 0, 1.0, True, 1.0, False, None), (1, 0, "video", 0, "a", 1, 0, 100, 0, 1.0, True, 1.0, False, None)]
    clips = r.prepare_clips(spark.createDataFrame(clip, CLIP_COLS))
    cols = "timeline_id bigint, op_idx bigint, op string, clip_id string, source_in bigint, source_out bigint, track_id bigint, source_id bigint"
    ops = spark.createDataFrame([(None, 0, "remove", "a", None, None, None, None), (1, 0, "insertClip", None, 0, 50, None, None), (1, 1, "insertClip", None, 0, 50, 0, 1)], cols)
    sources = spark.createDataFrame([(1, 1000)], "source_id bigint, duration_us bigint")
    tracks = spark.createDataFrame([(1, 0, "video")], "timeline_id bigint, track_id bigint, kind string")
    prepared = r.prepare_ops(ops, sources, tracks)
    assert rows(prepared.select("timeline_id", "e.op_idx", "e.source_len", "e.track_kind")) == [(1, 0, -1, None), (1, 1, 1000, "video"), (None, 0, None, None)]
    done = r.replay_by_timeline(clips, prepared)
    assert rows(done.clips.select("timeline_id", "clip_id")) == [(1, "a"), (1, "clp_e1"), (None, "a")]
    assert rows(done.outcomes.select("timeline_id", "op_idx", F.col("message").isNull())) == [(1, 0, False), (1, 1, True), (None, 0, False)]


def test_rows_are_shuffled_once_for_a_fold(spark):
    clips = r.prepare_clips(spark.createDataFrame([], CLIP_COLS))
    ops = r.prepare_ops(spark.createDataFrame([], OP_COLS))
    plan = r.fold(clips, ops, ["timeline_id"])._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Aggregate [") == 1

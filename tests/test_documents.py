"""Documents to tables and back lose nothing."""

import json

from pyspark.sql import functions as F

from splicework.sources import projects


def test_a_whole_document_comes_back(spark):
    framing = {"id": "fx_1", "type": "transform", "enabled": True, "keyframes": [{"t": 0, "value": {"scale": 1.5, "x": 0.25}, "easing": "linear"}, {"t": 9, "value": {"scale": 1, "own": [1, {"a": None}]}, "easing": "hold"}]}
    crop = {"id": "fx_2", "type": "crop", "enabled": False, "keyframes": [], "rect": {"left": 0.1, "right": 1}}
    clip = lambda label, effects, **more: {"id": "clp_1", "sourceId": "src_1", "sourceIn": 0, "sourceOut": 5, "start": 0, "speed": 1.0, "enabled": True, "audio": {"gain": 1.0, "mute": False}, "effects": effects, "label": label, **more}
    timeline = {"id": "tml_1", "frameRate": {"num": 30, "den": 1}, "resolution": {"width": 10, "height": 20}, "tracks": [
        {"id": "trk_b", "kind": "video", "name": "Main", "clips": [clip('say "hi"\\n', [framing, crop], origin={"by": "llm", "note": {"x": [1]}}), clip("same id again", [])], "muted": False, "locked": True},
        {"id": "trk_a", "kind": "audio", "clips": [], "muted": True, "locked": False},
    ]}
    document = {
        "schemaVersion": 1, "id": "prj_1", "name": "Cut", "createdAt": "2024-01-01", "updatedAt": "2024-02-02",
        "sources": [{"id": "src_1", "name": "a", "duration": 9, "locator": {"kind": "url", "url": "https://x"}, "video": {"width": 1, "height": 2, "frameRate": {"num": 24, "den": 1}, "rotation": 90, "variableFrameRate": True}, "audio": {"sampleRate": 48000, "channels": 2}, "mimeType": "video/mp4", "sizeBytes": 7, "contentHash": "h"}],
        "timeline": timeline, "stage": "refined", "coarseSnapshotAt": "2024-01-15",
        "revisions": [{"id": "rev_1", "at": "t1", "by": "human", "ops": [{"op": "remove", "clipId": "clp_0"}]}, {"id": "rev_2", "parentId": "rev_1", "at": "t2", "by": "llm", "ops": [], "model": "m", "review": {"verdicts": [{"accepted": False}]}, "accepted": False}],
        "headRevisionId": "rev_2", "brief": "short", "targetDurationUs": 1000, "coarseSnapshot": timeline, "review": {"id": "r", "ops": [{"op": "trim"}], "accepted": [True]}, "render": {"codec": "h264"}, "meta": {"free": {"z": 1, "a": [None, "x"]}},
    }
    parsed = projects.parse_projects(spark.createDataFrame([(json.dumps(document),)], "value string"))
    assert parsed.where("error IS NOT NULL").count() == 0
    t = projects.project_tables(parsed)
    written = projects.assemble_projects(t["projects"], t["tracks"], t["clips"], t["effects"], t["sources"], t["revisions"]).collect()
    assert len(written) == 1 and json.loads(written[0].value) == document


def test_shapes_of_edits(spark):
    good = [
        {"op": "trim", "clipId": "clp_1", "sourceIn": 0}, {"op": "split", "clipId": "clp_1", "at": 5, "newClipId": "clp_2"}, {"op": "setEnabled", "clipId": "clp_1", "enabled": False}, {"op": "setSpeed", "clipId": "clp_1", "speed": 0.05},
        {"op": "addEffect", "clipId": "clp_1", "effect": {"id": "fx_1", "type": "volume"}}, {"op": "setColor", "clipId": "clp_1", "color": None}, {"op": "setAudio", "clipId": "clp_1", "audio": {"mute": True}},
        {"op": "duplicateClip", "clipId": "clp_1", "at": "start"}, {"op": "insertClip", "trackId": "trk_1", "sourceId": "src_1", "sourceIn": 0, "sourceOut": 9}, {"op": "setLabel", "clipId": "clp_1", "label": ""},
    ]
    bad = [
        ({"op": "trim"}, "clipId"), ({"op": "fly", "clipId": "clp_1"}, "op"), ({"op": "split", "clipId": "clp_1"}, "at"), ({"op": "setSpeed", "clipId": "clp_1", "speed": 21}, "speed"), ({"op": "setSpeed", "clipId": "clp_1", "speed": "fast"}, "speed"),
        ({"op": "move", "clipId": "clp_1", "toIndex": -1}, "toIndex"), ({"op": "setAudio", "clipId": "clp_1", "audio": {"gain": 9}}, "audio"), ({"op": "setLabel", "clipId": "clp_1", "label": "x" * 201}, "label"),
        ({"op": "duplicateClip", "clipId": "clp_1", "at": "end"}, "at"), ({"op": "insertClip", "trackId": "trk_1", "sourceId": "src_1", "sourceIn": 0}, "sourceOut"), ({"op": "remove", "clipId": "clip one"}, "clipId"), ({"op": "trim", "clipId": "clp_1", "sourceIn": 1.5}, "sourceIn"),
    ]
    replies = [json.dumps({"summary": "s", "ops": good}), json.dumps([o for o, _ in bad]), "[]", "prose", '{"ops": 5}', None]
    got = projects.parse_plans(spark.createDataFrame([(i, r) for i, r in enumerate(replies)], "i int, value string")).orderBy("i").collect()
    assert [r.error is None for r in got] == [True, False, True, False, False, False] and len(got[0].ops) == len(good)
    assert [x.split(":")[0] for x in got[1].issues] == [f"ops[{i}].{field}" for i, (_, field) in enumerate(bad)]


def test_shapes_of_clips(spark):
    clip = lambda **more: {"id": "clp_1", "sourceId": "src_1", "sourceIn": 0, "sourceOut": 5, "start": 0, **more}
    document = {"schemaVersion": 1, "id": "prj_1", "timeline": {"id": "tl_1", "tracks": [{"id": "trk_1", "clips": [clip(), clip(speed=0.01)]}, {"id": "trk_2"}, {"id": "trk_3", "clips": [clip(audio={"gain": 8.5}, sourceIn=-1)]}]}}
    parsed = projects.parse_projects(spark.createDataFrame([(json.dumps(document),)], "value string"))
    got = sorted(r.issue.split(":")[0] for r in projects.clip_issues(parsed).collect())
    assert got == ["timeline.tracks[0].clips[1].speed", "timeline.tracks[2].clips[0].audio.gain", "timeline.tracks[2].clips[0].sourceIn"]


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_documents_are_parsed_once(spark):
    one = {"schemaVersion": 1, "id": "prj_1", "timeline": {"id": "tl_1", "tracks": [{"id": "trk_1", "clips": [{"id": "clp_1", "sourceIn": 0, "speed": 0.5}]}, {"id": "trk_2", "clips": []}]}}
    t = projects.project_tables(projects.parse_projects(spark.createDataFrame([(json.dumps(one),), ("{",), (None,)], "value string")))
    assert {name: plan(df).count("from_json") for name, df in t.items()} == dict.fromkeys(t, 1)
    assert [(r.clip_id, r.source_in, r.speed) for r in t["clips"].collect()] == [("clp_1", 0, 0.5)]
    written = projects.assemble_projects(t["projects"], t["tracks"], t["clips"])
    assert [json.loads(r.value)["timeline"]["tracks"][0]["clips"][0]["speed"] for r in written.collect()] == [0.5]


def test_objects_without_fields_of_their_own(spark):
    row = spark.createDataFrame([(None, ["1", '{"b":2}'], None)], "a string, x array<string>, y array<string>")
    got = row.select(projects._object(F.struct("a"), x="x", y="y").alias("v"), projects._object(F.struct(F.lit(',"}').alias("k")), x="x").alias("w")).first()
    assert (got.v, got.w) == ('{"x":[1,{"b":2}],"y":[]}', '{"x":[1,{"b":2}],"k":",\\"}"}')

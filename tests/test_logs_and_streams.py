import json
import random

import pytest
from pyspark.sql import functions as F

from conftest import rows
from splicework.operators import replay as r
from splicework.sources import eventlog, projects
from splicework.streaming import live, timing
from splicework.streaming.store import BucketedTable
from test_replay import KINDS, frames, model, random_case


def line(i, **kw):
    return json.dumps({"id": f"evt_{i}", "projectId": "prj_a", "seq": i, "at": f"2024-01-01T00:00:{i % 60:02d}.000Z", "actor": "human", "type": "playback.seek", "playhead": i} | kw)


def test_truncated_line_is_named(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("\n".join([line(1, payload={"k": 1}), line(0), '{"id":"evt_3","proje', "", line(4, type="nope")]))
    events, skipped = eventlog.read_event_log(spark, str(tmp_path))
    assert rows(events.select("seq", "payload")) == [(0, "{}"), (1, '{"k":1}')]
    assert sorted((s["line"], s["error"]) for s in skipped.collect()) == [(3, "not a JSON object of the event shape"), (5, "type: unknown")]


def test_line_numbers_across_splits(spark, tmp_path):
    text = [line(i) if i % 50 else "broken" for i in range(1, 2001)]
    (tmp_path / "a.jsonl").write_text("\n".join(text))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        _, skipped = eventlog.read_event_log(spark, str(tmp_path))
        assert sorted(s["line"] for s in skipped.collect()) == list(range(50, 2001, 50))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_log_is_written_read_and_looked_up(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text("\n".join(line(i) for i in range(20)))
    events, _ = eventlog.read_event_log(spark, str(tmp_path / "in"))
    eventlog.write_event_log(events, str(tmp_path / "out"))
    again, skipped = eventlog.read_event_log(spark, str(tmp_path / "out"))
    assert rows(again) == rows(events) and skipped.count() == 0
    eventlog.save_events(events, str(tmp_path / "store"))
    assert [x["seq"] for x in eventlog.read_events(spark, str(tmp_path / "store"), "prj_a").collect()] == list(range(20))


def test_one_bad_document_hides_no_other(spark, tmp_path):
    good = {"schemaVersion": 1, "id": "prj_1", "createdAt": "x", "updatedAt": "x", "sources": [], "timeline": {"id": "tl_1", "frameRate": {"num": 30, "den": 1}, "resolution": {"width": 1, "height": 2},
            "tracks": [{"id": "trk_1", "clips": [{"id": "clp_1", "sourceId": "src_1", "sourceIn": 0, "sourceOut": 5, "start": 0}]}]}}
    for name, doc in (("a", good), ("b", good | {"id": "prj_2", "schemaVersion": 2})):
        (tmp_path / f"{name}.json").write_text(json.dumps(doc, indent=1))
    (tmp_path / "c.json").write_text("{")
    parsed = projects.read_projects(spark, str(tmp_path))
    tables = projects.project_tables(parsed)
    assert rows(tables["clips"].select("clip_id", "speed", "enabled", "gain")) == [("clp_1", 1.0, True, 1.0)]
    assert rows(tables["projects"].select("name", "stage")) == [("Untitled", "coarse")]
    assert parsed.where("error is not null").count() == 2
    (tmp_path / "x.MOV").write_bytes(b"123")
    found = projects.scan_media(spark, str(tmp_path))
    assert rows(found.where("filename = 'x.MOV'").select("size_bytes", "mime")) == [(3, "video/quicktime")]


@pytest.fixture(scope="module")
def trail(spark, tmp_path_factory):
    rng, at, data = random.Random(5), 0, []
    for seq in range(120):
        at += rng.choice([40_000, 90_000, 300_000, 600_000])
        data.append((rng.randrange(2), seq, at, rng.choice(["playback.scrub"] * 4 + ["playback.seek"]), rng.choice(["open", "signals", "finish"]), rng.random() * 1500))
    df = spark.createDataFrame(data, "project_id bigint, seq bigint, at_us bigint, type string, step string, cost_ms double")
    path = str(tmp_path_factory.mktemp("trail"))
    for lo in range(0, 120, 40):  # three files in time order, one per batch
        df.where((F.col("seq") >= lo) & (F.col("seq") < lo + 40)).coalesce(1).write.mode("append").parquet(path)
    return df, path


@pytest.mark.parametrize("name", ["throttle", "failed_opens", "adaptive_interval"])
def test_stream_gives_what_the_table_gives(spark, trail, name, tmp_path):
    df, path = trail
    want = rows(getattr(timing, name)(df).select(*{"throttle": ["project_id", "seq"], "failed_opens": ["project_id", "seq", "failed", "stage", "runs"], "adaptive_interval": ["project_id", "seq", F.round("interval_ms", 9)]}[name]))
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)
    query = getattr(live, name)(source).writeStream.format("memory").queryName(f"out_{name}").option("checkpointLocation", str(tmp_path)).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    got = spark.table(f"out_{name}")
    cols = {"throttle": ["project_id", "seq"], "failed_opens": ["project_id", "seq", "failed", "stage", "runs"], "adaptive_interval": ["project_id", "seq", F.round("interval_ms", 9)]}[name]
    assert rows(got.select(*cols)) == want


def test_throttle_when_split(spark, trail, split):
    df, _ = trail
    last, want = {}, []
    for p, seq, at, kind, _, _ in sorted(df.collect(), key=lambda x: x[1]):
        if kind == "playback.seek" or p not in last or at - last[p] >= 250_000:
            last[p] = at
            want.append((seq,))
    assert sorted(rows(timing.throttle(df).select("seq"))) == want


def test_ingest_is_idempotent_and_quarantines(spark, tmp_path):
    folder, store = tmp_path / "in", tmp_path / "store"
    folder.mkdir()
    (folder / "a.jsonl").write_text("\n".join([line(0), line(1), "broken"]))
    go = lambda: live.ingest_events(spark, str(folder), str(store), str(tmp_path / "ck")).awaitTermination()
    go()
    (folder / "b.jsonl").write_text("\n".join([line(1, playhead=99), line(2)]))
    go()
    table = live.event_table(spark, str(store)).read()
    assert {x["seq"]: x["playhead"] for x in table.collect()}[1] == 99 and sorted(x["seq"] for x in table.collect()) == [0, 1, 2]
    assert spark.read.json(f"{store}/skipped").count() == 1


def test_ingest_keeps_late_events_and_the_last_write(spark, tmp_path):
    folder, store = tmp_path / "in", tmp_path / "store"
    folder.mkdir()
    (folder / "a.jsonl").write_text("\n".join([line(0), line(1, playhead=1), line(1, playhead=2)]))
    go = lambda: live.ingest_events(spark, str(folder), str(store), str(tmp_path / "ck")).awaitTermination()
    go()
    (folder / "b.jsonl").write_text("\n".join([line(7, at="2020-01-01T02:00:00.000Z"), line(0, playhead=5), line(0, playhead=6)]))
    go()
    log = {x["seq"]: x["playhead"] for x in live.event_table(spark, str(store)).read().collect()}
    assert log.keys() == {0, 1, 7} and log[1] == 2 and log[0] == 6


def test_streamed_edits_reach_the_timelines(spark, tmp_path):
    rng = random.Random(21)
    cases = [random_case(rng, t, KINDS) for t in range(6)]
    clips, ops = frames(spark, cases)
    table = BucketedTable(spark, str(tmp_path / "clips"), ["timeline_id"], ["ord"], buckets=8)
    table.write(clips, -1)
    ops.coalesce(1).write.parquet(str(tmp_path / "ops"))
    source = spark.readStream.schema(ops.schema).parquet(str(tmp_path / "ops"))
    live.stream_replay(source, table, str(tmp_path / "ck")).awaitTermination()
    live.stream_replay(source, table, str(tmp_path / "again")).awaitTermination()  # the same batch once more
    assert table.commits() == [-1, 0]
    got = {}
    for x in table.read().select("timeline_id", "c.track_id", "ord", "c.clip_id", "c.source_in", "c.source_out").orderBy("track_id", "ord").collect():
        got.setdefault(x[0], []).append((x[1], x[3], x[4], x[5]))
    for cs, os in cases:
        assert got.get(cs[0][0], []) == [w[:4] for w in model(cs, os)[0]]

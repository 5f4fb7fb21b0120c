from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import rows
from splicework.operators import generators as g
from splicework.operators import quality as q
from splicework.operators import timeline as tl

COLS = "timeline_id bigint, track_id bigint, kind string, ord bigint, clip_id string, source_id bigint, source_in bigint, source_out bigint, start bigint, speed double, enabled boolean"
S = 1_000_000


def coarse(spark):
    spans = [(2, 10), (18, 30), (44, 52)]
    return spark.createDataFrame([(1, 0, "video", i, f"clp_t{i + 1}", 7, a * S, b * S, 0, 1.0, True) for i, (a, b) in enumerate(spans)], COLS)


def test_coarse_pass(spark):
    clips = tl.reflow(coarse(spark))
    assert rows(clips.select("start")) == sorted([(0,), (8 * S,), (20 * S,)], key=str)
    assert rows(tl.timeline_duration(clips)) == [(1, 28 * S)]
    source = spark.createDataFrame([(1, 7, 60 * S)], "timeline_id bigint, source_id bigint, duration_us bigint")
    gaps = sorted((r["start"] // S, r["end"] // S) for r in tl.dropped_regions(clips, source).collect())
    assert gaps == [(0, 2), (10, 18), (30, 44), (52, 60)]
    assert q.clip_issues(clips, source.select("source_id", "duration_us")).count() == 0


def test_disabled_clips_take_no_room(spark):
    clips = coarse(spark).withColumn("enabled", F.col("ord") != 1)
    assert [r["start"] for r in tl.reflow(clips).orderBy("ord").collect()] == [0, 8 * S, 8 * S]


clip = st.tuples(st.integers(0, 500), st.integers(-5, 300), st.sampled_from([0.5, 1.0, 3.0]), st.booleans())


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(clip, min_size=1, max_size=12))
def test_reflow_twice_is_reflow_once(spark, clips):
    df = spark.createDataFrame([(1, 0, "video", i, f"clp_{i}", 7, a, a + n, 0, s, on) for i, (a, n, s, on) in enumerate(clips)], COLS)
    once = tl.reflow(df)
    assert rows(tl.reflow(once.drop("out_len"))) == rows(once)
    # Used and dropped ranges together tile the recording.
    source = spark.createDataFrame([(1, 7, 1000)], "timeline_id bigint, source_id bigint, duration_us bigint")
    gaps = [(r["start"], r["end"]) for r in tl.dropped_regions(df, source).collect()]
    used = [(a, a + n) for a, n, _, on in clips if on and n > 0]
    assert set().union(*[range(a, b) for a, b in gaps + used]) == set(range(1000))
    assert not any(set(range(a, b)) & set(range(c, e)) for a, b in gaps for c, e in used)


def test_frame_budget_serves_every_clip_first(spark):
    spans = [(0, 30), (0, 3), (0, 1), (0, 8)]
    df = spark.createDataFrame([(1, 0, "video", i, f"c{i}", 7, a, b * S, i, 1.0, True) for i, (a, b) in enumerate(spans)], COLS)
    got = dict(rows(g.allocate_frame_budget(df, 6).select("clip_id", "frames")))
    assert got == {"c0": 2, "c3": 2, "c1": 1, "c2": 1}


def test_other_tracks_stand_in_order_of_start_and_id(spark):
    rows_in = [(1, 0, "video", 0, "v1", 0, 5, 100, 1.0, True), (1, 0, "video", 1, "v2", 0, 7, 0, 1.0, True)]
    rows_in += [(1, 1, "audio", 2, "clp_a", 0, 9, 500, 1.0, True), (1, 1, "audio", 3, "clp_b", 0, 9, 10, 1.0, True), (1, 1, "audio", 4, "clp_0", 0, 9, 500, 1.0, True)]
    df = spark.createDataFrame(rows_in, "timeline_id bigint, track_id bigint, kind string, ord bigint, clip_id string, source_in bigint, source_out bigint, start bigint, speed double, enabled boolean")
    got = [(r.clip_id, r.ord, r.start) for r in tl.reflow(df).orderBy("track_id", "ord").collect()]
    assert got == [("v1", 0, 0), ("v2", 1, 5), ("clp_b", 2, 10), ("clp_0", 3, 500), ("clp_a", 4, 500)]


def test_dropped_regions_need_no_join(spark):
    clips = spark.createDataFrame([(1, 7, 2 * S, 4 * S, True), (1, 7, 6 * S, 7 * S, False), (2, 7, 1 * S, 2 * S, True), (None, 7, 1 * S, 3 * S, True)], "timeline_id long, source_id long, source_in long, source_out long, enabled boolean")
    sources = spark.createDataFrame([(1, 7, 9 * S), (None, 7, 5 * S)], "timeline_id long, source_id long, duration_us long")
    found = tl.dropped_regions(clips, sources)
    got = sorted(((r.timeline_id, r.start // S, r.end // S) for r in found.collect()), key=str)
    assert got == [(1, 0, 2), (1, 4, 9), (None, 0, 5)]
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()

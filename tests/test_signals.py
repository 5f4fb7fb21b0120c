import math

from pyspark.sql import functions as F

from conftest import rows
from splicework.operators import signals as s

RATE = 8000


def recording(spark, parts):
    """Levels of tone and silence at 10 ms hops."""
    data, i = [], 0
    for seconds, loud in parts:
        for _ in range(int(seconds * RATE)):
            data.append((1, i, 0.3 * math.sin(2 * math.pi * 220 * i / RATE) if loud else 0.0))
            i += 1
    df = spark.createDataFrame(data, "source_id bigint, i bigint, x double")
    return s.rms_levels(df, 80).withColumn("hop_us", F.lit(10_000).cast("bigint"))


def test_pause_is_found_and_breath_is_not(spark):
    (run,) = s.quiet_runs(recording(spark, [(2, True), (1.5, False), (2, True)])).collect()
    assert abs(run["start"] - 2_000_000) <= 20_000 and abs(run["end"] - 3_500_000) <= 20_000
    assert s.quiet_runs(recording(spark, [(1, True), (0.2, False), (1, True)])).count() == 0


def test_levels_of_full_scale_and_nothing(spark):
    df = spark.createDataFrame([(1, i, 1.0) for i in range(80)] + [(1, 80 + i, 0.0) for i in range(40)], "source_id bigint, i bigint, x double")
    assert rows(s.rms_levels(df, 80).select("hop", "db")) == [(0, 0.0), (1, -100.0)]


def test_sharper_onset_moves_the_anchor(spark):
    data = [(1, 0, 0.5, 150), (1, 100, 0.9, 150), (1, 200, 0.4, 150), (1, 400, 0.3, 150)]
    df = spark.createDataFrame(data, "source_id bigint, t bigint, strength double, gap bigint")
    assert sorted(rows(s.merge_close(df).select("t", "strength"))) == [(100, 0.9), (400, 0.3)]


def test_held_shot(spark):
    frames = [[(i * 61) % 200] * 64 for i in range(4)] + [[120] * 64] * 3 + [[(i * 53) % 200] * 64 for i in range(3)]
    df = spark.createDataFrame([(1, i * 1_000_000, 8, 8, f) for i, f in enumerate(frames)], "source_id bigint, t bigint, width int, height int, luma array<bigint>")
    motion = s.frame_motion(df)
    assert rows(s.still_runs(motion).select("start", "end")) == [(4_000_000, 6_000_000)]
    first, second = [r["motion"] for r in motion.orderBy("t").limit(2).collect()]
    assert first == second


def test_onsets_when_split(spark, split):
    db = [-60.0] * 40
    for i in (5, 20, 33):
        db[i] = -10.0 - i / 10
    df = spark.createDataFrame([(1, i, 250_000, x) for i, x in enumerate(db)], "source_id bigint, hop bigint, hop_us bigint, db double")
    assert sorted(r["t"] // 250_000 for r in s.detect_onsets(df).collect()) == [5, 20, 33]


def test_long_islands_merge_as_short_ones_do(spark, request):
    import random

    rng, t, data = random.Random(4), 0, []
    for _ in range(60):
        t += rng.choice([20, 40, 90, 160])
        data.append((1, t, rng.randrange(10) / 10, 150))
    df = spark.createDataFrame(data, "source_id bigint, t bigint, strength double, gap bigint")
    short = rows(s.merge_close(df))
    request.getfixturevalue("split")
    assert rows(s.merge_close(df)) == short

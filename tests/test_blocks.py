"""Windows over level series against plain lists of their hops."""

import math
import random

import pytest
from pyspark.sql import functions as F

from splicework.operators import blocks
from splicework.operators import timeline as tl


def plain(series, windows, fraction):
    out = set()
    for source, h0, h1 in set(windows):
        own = sorted(db for hop, db in series.get(source, {}).items() if h0 <= hop <= h1 and db is not None)
        if own and h1 >= h0:
            out.add((source, h0, h1, own[-1], own[min(len(own) - 1, math.floor(len(own) * fraction))]))
    return out


@pytest.mark.parametrize(("block", "fan", "sizes"), [(256, 3, 6), (4, 1, 3), (4, 1, 12), (1, 2, 4)])
def test_peak_and_typical(spark, monkeypatch, block, fan, sizes):
    """Also with blocks of a hop or four, and with fewer sizes of nodes than the windows would fill."""
    for name, value in (("BLOCK", block), ("FAN", fan), ("SIZES", sizes)):
        monkeypatch.setattr(blocks, name, value)
    draw = random.Random(block)
    level = {1: lambda: -round(draw.random() * 60, 1), 2: lambda: draw.choice([-100.0, -100.0, -3.25, -3.75]), 3: lambda: draw.choice([None, -5.0, -5.0, 2.5])}
    series = {source: {hop: of() for hop in range(700) if draw.random() < 0.9} for source, of in level.items()}
    windows = [(draw.randint(1, 4), a, a + draw.choice([-1, 0, 1, 3, 9, 40, 300, 900])) for a in (draw.randint(0, 720) for _ in range(150))]
    levels = spark.createDataFrame([(s, h, db) for s, own in series.items() for h, db in own.items()], "source_id bigint, hop bigint, db double")
    asked = spark.createDataFrame(windows, "source_id bigint, h0 bigint, h1 bigint")
    for fraction in (0.5, 0.9):
        got = {tuple(r) for r in blocks.peak_and_typical(asked, levels, fraction).select("source_id", "h0", "h1", "peak_db", "typical_db").collect()}
        assert got == plain(series, windows, fraction)
    assert {tuple(r) for r in blocks.loudest(asked, levels).select("source_id", "h0", "h1", "peak_db").collect()} == {x[:4] for x in plain(series, windows, 0.5)}


@pytest.mark.parametrize("block", [256, 4])
def test_rows_with_levels(spark, monkeypatch, block):
    """Every row comes back once, windows asked for twice, without levels, of no source or no hop included; short and long ones."""
    monkeypatch.setattr(blocks, "BLOCK", block)
    draw = random.Random(block)
    series = {source: {hop: draw.choice([None, -100.0, -3.25, -round(draw.random() * 60, 1)]) for hop in range(700) if draw.random() < 0.9} for source in (1, 2)}
    windows = [(draw.randint(1, 3), a, a + draw.choice([-1, 0, 3, 9, 40, 300, 600])) for a in (draw.randint(-20, 720) for _ in range(80))]
    windows += windows[:5] + [(None, 1, 2), (1, None, None)]
    levels = spark.createDataFrame([(s, h, db) for s, own in series.items() for h, db in own.items()], "source_id bigint, hop bigint, db double")
    asked = spark.createDataFrame([(i, *w) for i, w in enumerate(windows)], "id bigint, source_id bigint, h0 bigint, h1 bigint")
    known = {x[:3]: x for x in plain(series, [w for w in windows if None not in w], 0.5)}
    got = sorted(tuple(r) for r in blocks.with_levels(asked, levels).collect())
    assert [r[0] for r in got] == list(range(len(windows)))
    assert [r[1:] for r in got] == [known.get(w, (*w, None, None)) for w in windows]


def test_long_windows_read_few_rows(spark):
    """A window of a million hops asks for its two ends and some tens of nodes."""
    asked = spark.createDataFrame([(1, 1_000, 1_000_000), (1, 0, 255), (1, 200, 300)], "source_id bigint, h0 bigint, h1 bigint")
    filled = blocks._filled(asked).collect()
    assert len(filled) < 60
    covered = sorted(b for r in filled for b in range(r.node << 3 * r.size, (r.node + 1) << 3 * r.size))
    assert covered == list(range(4, 3906))


@pytest.mark.usefixtures("split")
def test_reflow_of_split_tracks(spark):
    draw = random.Random(2)
    clips = [(draw.randint(1, 2), draw.randint(0, 1), draw.choice(["video", "audio", None]), i, f"clp_{i}", 7, a := draw.randint(0, 9) * 1_000_000, a + draw.choice([0, 1, 5]) * 1_000_000, draw.randint(0, 300) * 1_000_000, draw.choice([0.5, 1.0]), draw.random() < 0.8) for i in range(60)]
    df = spark.createDataFrame(clips, "timeline_id bigint, track_id bigint, kind string, ord bigint, clip_id string, source_id bigint, source_in bigint, source_out bigint, start bigint, speed double, enabled boolean")
    want, at, places = {}, {}, {}
    kept = [c for c in clips if c[7] > c[6]]
    for c in kept:
        if c[2] == "video":
            want[c[4]] = (c[3], at.get(c[:2], 0))
            at[c[:2]] = at.get(c[:2], 0) + (round((c[7] - c[6]) / c[9]) if c[10] else 0)
        else:
            places.setdefault(c[:2], []).append((c[8], c[4], c[3]))
    for own in places.values():
        for i, (start, clip_id, _) in enumerate(sorted(own)):
            want[clip_id] = (min(o for *_, o in own) + i, start)
    got = {r.clip_id: (r.ord, r.start) for r in tl.reflow(df).collect()}
    assert got == want
    assert tl.reflow(df.withColumn("ord", F.col("ord").cast("int"))).schema["ord"].dataType.simpleString() == "int"

"""Line dedup and mixing against plain models, with odd rows."""

import random

from pyspark.sql import functions as F
from pyspark.sql import types as T

from splicework.llm import line_dedup, mixing

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("source", T.StringType()), T.StructField("starts", T.StringType()), T.StructField("size", T.StringType())])


def dedup_model(docs):
    """Cuts later windows from (doc_id, text) pairs in order."""
    seen, out = set(), {}
    for doc_id, text in sorted(docs):
        lines, gone = text.split("\n"), set()
        for i in range(len(lines) - 2):
            window = tuple(lines[i : i + 3])
            if all(not x.strip(" ") for x in window):
                continue
            if window in seen:
                gone |= {i, i + 1, i + 2}
            seen.add(window)
        out[doc_id] = (len(lines), len(gone), "\n".join(x for i, x in enumerate(lines) if i not in gone))
    return out


def test_line_dedup_against_model(spark):
    draw = random.Random(4)
    docs = [(i, "\n".join(draw.choice(["a", "b", "c", "", "long line"]) for _ in range(draw.randint(1, 14)))) for i in range(120)]
    docs.append((500, "\n".join(["same"] * 3000)))
    df = spark.createDataFrame([(i, t, None, "mine", "mine") for i, t in docs], DOCS)
    got = {r.doc_id: r for r in line_dedup.line_dedup(df).collect()}
    want = dedup_model(docs)
    assert {i: (r.lines, r.lines_removed, r.text) for i, r in got.items()} == want
    assert all(r.starts == "mine" and r.size == "mine" for r in got.values())


def test_line_dedup_odd_rows(spark):
    df = spark.createDataFrame([(None, "x\ny\nz", None, None, None), (1, "x\ny\nz", None, None, None), (1, None, None, None, None), (2, "", None, None, None), (3, "p\nq\nr", None, None, None), (3, "p\nq\nr", None, None, None)], DOCS)
    got = sorted(((r.doc_id, r.lines, r.lines_removed, r.text) for r in line_dedup.line_dedup(df).collect()), key=str)
    assert got == sorted([(None, 3, 0, "x\ny\nz"), (1, 3, 3, ""), (1, 0, 0, None), (2, 1, 0, ""), (3, 3, 0, "p\nq\nr"), (3, 3, 0, "p\nq\nr")], key=str)
    assert line_dedup.line_dedup(df.limit(0)).count() == 0


def targets_model(sizes):
    """Deals 1.5 times the total by weight, again and again, until no source is above twice its size."""
    names = sorted((n for n in sizes if n is not None)) + ([None] if None in sizes else [])
    weight = {n: (3, 1, 2)[i % 3] for i, n in enumerate(names)}
    left, full, target = 1.5 * sum(sizes.values()), set(), {}
    while True:
        free = [n for n in names if n not in full]
        rest = left - sum(2 * sizes[n] for n in full)
        target = {n: 2 * sizes[n] if n in full else rest * weight[n] / sum(weight[x] for x in free) for n in names}
        above = {n for n in free if target[n] > 2 * sizes[n] + 1e-9}
        if not above:
            return target
        full |= above


def test_targets_against_model(spark):
    draw = random.Random(5)
    for case in range(6):
        sizes = {f"s{i}": draw.choice([0, 1, 10, 500, 90000]) for i in range(draw.randint(1, 12))}
        if case % 2:
            sizes[None] = 70
        df = spark.createDataFrame([(k, v) for k, v in sizes.items()], "source string, size long")
        got = {r.source: r.target for r in mixing.source_targets(df).collect()}
        want = targets_model(sizes)
        assert got.keys() == want.keys()
        assert all(abs(got[k] - want[k]) <= 1e-6 * max(1, want[k]) for k in want), (sizes, got, want)


def test_mix_takes_what_it_says(spark):
    rows = [(i, "w " * (i % 30), f"s{i % 4}", "x", "y") for i in range(2000)] + [(None, "a b", None, "x", "y"), (None, None, None, "x", "y"), (7, "", "s1", "x", "y")]
    df = spark.createDataFrame(rows, DOCS)
    counted = mixing.mixed(df).select("doc_id", "text", "source", "source_size", "target", "copies", F.col("size").alias("n")).collect()
    assert len(counted) == len(rows) and max(r.copies for r in counted) <= 2
    taken, target = {}, {}
    for r in counted:
        taken[r.source] = taken.get(r.source, 0) + r.n * r.copies
        target[r.source] = r.target
    assert all(abs(taken[s] - target[s]) < 0.1 * target[s] for s in ("s0", "s1", "s2", "s3"))
    mix = mixing.mix(df)
    assert mix.columns == df.columns and mix.count() == sum(r.copies for r in counted)
    assert sorted(map(str, mix.collect())) == sorted(map(str, mixing.mix(df.repartition(5)).collect()))
    assert mixing.mix(df.limit(0)).count() == 0


def test_many_sources_go_by_shuffle(spark, monkeypatch):
    df = spark.createDataFrame([(i, "a b c", f"s{i % 5}", "x", "y") for i in range(300)], DOCS)
    small = sorted(map(str, mixing.mixed(df).collect()))
    monkeypatch.setattr("splicework.llm.common.BROADCAST_ROWS", 0)
    assert sorted(map(str, mixing.mixed(df).collect())) == small

"""Nearest neighbours against brute force; odd vectors; many copies of one vector."""

import tracemalloc

import numpy as np

from splicework.llm import ann


def brute(rows, query, k=10):
    own = np.array(query[1], dtype=np.float64)
    near = sorted((float(np.sqrt(((np.array(v, dtype=np.float64) - own) ** 2).sum())), i) for i, v in rows if i != query[0] and len(v) == len(own))
    return near[:k]


def test_recall_and_scores(spark):
    draw = np.random.default_rng(6)
    centres = draw.normal(size=(20, 24))
    rows = [(i, [float(np.float32(x)) for x in centres[i % 20] + draw.normal(size=24) * 0.6]) for i in range(1500)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in ann.nearest(df, df.where("vec_id % 50 = 0")).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hits = total = 0
    for q in rows[::50]:
        found, want = sorted(got[q[0]]), brute(rows, q)
        assert [rank for rank, _, _ in found] == list(range(1, len(found) + 1)) and [s for _, _, s in found] == sorted(s for _, _, s in found)
        exact = {i: d for d, i in brute(rows, q, len(rows))}
        assert all(abs(s - exact[i]) < 1e-9 for _, i, s in found)
        hits, total = hits + len({i for _, i, _ in found} & {i for _, i in want}), total + len(want)
    assert hits >= 0.9 * total


def test_copies_and_odd_vectors(spark):
    same, other = [1.0, 2.0, 0.5, 1.0], [1.0, 2.0, 0.5, 1.5]
    rows = [(i, same, "x") for i in range(400)] + [(1000, other, "x"), (1000, other, "x"), (1001, None, "x"), (1002, [0.0] * 4, "x"), (1003, [1.0, None, 1.0, 1.0], "x"), (1004, [float("nan"), 1.0, 1.0, 1.0], "x"), (1005, [float("inf"), 1.0, 1.0, 1.0], "x"), (1006, [1.0, 1.0], "x"), (None, same, "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rep string")
    got = ann.nearest(df, df.where("vec_id IN (3, 1000, 1001, 1002, 1003, 1004, 1005, 1006)")).collect()
    of = lambda q: [(r.rank, r.vec_id, r.score) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q]
    assert of(3) == [(n + 1, i, 0.0) for n, i in enumerate([0, 1, 2, 4, 5, 6, 7, 8, 9, 10])]
    assert of(1000) == [(n + 1, n, 0.5) for n in range(10)] and {r.query_id for r in got} == {3, 1000}
    assert ann.nearest(df.limit(0), df.limit(0)).count() == 0


def test_probes_of_many_vectors_take_little_memory(monkeypatch):
    """With three hashes a table, the probes are the least combinations of all axes; they were sorted among 262,144 for each query."""
    monkeypatch.setattr(ann, "TABLES", 48)
    hashes = ann.Hashes(64, 600_000)
    assert len(hashes.axes) == 3 and 1 < hashes.probes < ann.COMBINATIONS
    monkeypatch.setattr(ann, "TABLES", 1)
    vectors = np.random.default_rng(7).normal(size=(256, 64))
    tracemalloc.start()
    got = hashes.probed(vectors)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 200 << 20
    turned = hashes.rotations(hashes.unit(vectors[:3]), 0)
    for q in range(3):
        lists = []
        for seen in turned:
            signed = np.stack([seen[q], -seen[q]], axis=1).reshape(-1)
            order = np.argsort(-signed, kind="stable")[: ann.AXES]
            lists.append(((signed.max() - signed[order]) ** 2, order, len(signed)))
        (a, oa, n), (b, ob, _), (c, oc, _) = lists
        cost = ((a[:, None] + b[None, :])[:, :, None] + c).reshape(-1)
        buckets = ((oa[:, None] * n + ob[None, :])[:, :, None] * n + oc).reshape(-1)
        assert set(got[q, 0].tolist()) == set(buckets[np.argsort(cost, kind="stable")[: hashes.probes]].tolist())


def test_many_probes_are_not_sent_to_every_task(spark, monkeypatch):
    monkeypatch.setattr(ann, "BATCH_ROWS", 1000)
    draw = np.random.default_rng(8)
    df = spark.createDataFrame([(i, [float(x) for x in draw.normal(size=8)]) for i in range(300)], "vec_id long, embedding array<double>")
    asked = df.where("vec_id % 10 = 0")
    found = ann.nearest(df, asked)
    join = next(x for x in found._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join" in x and "bucket" in x)
    assert "merge" in join
    assert found.where("rank = 1").count() == 30

"""Closing reviews: commits on the right head, discards back to the baseline."""

import datetime
import json
import random

from pyspark.sql import functions as F

from splicework import session
from splicework.operators import replay
from splicework.operators import review as rv
from splicework.plans import catalog
from test_replay import KINDS, OP_COLS, frames, model, random_case


def test_reviews_are_settled(spark):
    rng = random.Random(31)
    cases = [random_case(rng, t, KINDS) for t in range(6)]
    clips, prepared = frames(spark, cases)
    names = [c.split()[0] for c in OP_COLS.split(", ")]
    plain = spark.createDataFrame([tuple(o[n] for n in names) for _, os in cases for o in os], OP_COLS)
    accepted = {(cs[0][0], o["op_idx"]): rng.random() < 0.6 for cs, os in cases for o in os}
    verdicts = spark.createDataFrame([(t, i, a) for (t, i), a in accepted.items()], "timeline_id bigint, op_idx bigint, accepted boolean")
    reviews = spark.createDataFrame(
        [(t, "discard" if t == 1 else "finish", "old" if t == 2 else None, "t9", "model" if t % 2 else "heuristics", "m", None) for t in range(5)],  # timeline 5 has no review
        "timeline_id bigint, action string, parent_id string, at string, by string, model string, summary string",
    )
    projects = spark.createDataFrame([(t, "new" if t == 2 else None, "t0", "kept") for t in range(6) if t != 4], "project_id bigint, head_revision_id string, updated_at string, name string")
    settled, revisions, after = rv.settle_reviews(projects, reviews, clips, prepared, plain, verdicts)
    assert settled.columns == ["timeline_id", "ord", "c"] and after.columns == projects.columns
    got, made, heads = {}, {r.project_id: r for r in revisions.collect()}, {r.project_id: r for r in after.collect()}
    for x in settled.select("timeline_id", "c.track_id", "ord", "c.clip_id", "c.source_in", "c.source_out").orderBy("track_id", "ord").collect():
        got.setdefault(x[0], []).append((x[1], x[3], x[4], x[5]))
    for cs, os in cases[:5]:
        t = cs[0][0]
        taken = [] if t == 1 else [o for o in os if accepted[t, o["op_idx"]]]
        want, bad = model(cs, taken)
        assert got.get(t, []) == [w[:4] for w in want]
        if t == 1:
            assert t not in made
            continue
        own = made[t]
        assert [o["op"] for o in json.loads(own.ops)] == [o["op"] for o in sorted(taken, key=lambda o: o["op_idx"]) if o["op_idx"] not in bad]
        assert {(v.op_idx, v.accepted) for v in own.verdicts} == {(i, a) for (u, i), a in accepted.items() if u == t}
        assert own.accepted == any(a for (u, _), a in accepted.items() if u == t) and own.model == ("m" if t % 2 else "local-heuristics")
        assert own.committed == (t not in (2, 4))  # another head, no project
        if t != 4:
            assert (heads[t].head_revision_id, heads[t].updated_at) == ((own.revision_id, "t9") if own.committed else ("new", "t0"))
    assert 5 not in got and heads[5].head_revision_id is None and heads[1].updated_at == "t0" and len(heads) == 5
    again = rv.settle_reviews(projects, reviews, clips, prepared, plain.repartition(3), verdicts)[1]
    assert {r.revision_id for r in again.collect()} == {r.revision_id for r in made.values()} and len({r.revision_id for r in made.values()}) == len(made)


def test_an_empty_batch_is_a_revision(spark):
    projects = spark.createDataFrame([(1, None, "t0")], "project_id bigint, head_revision_id string, updated_at string")
    batch = spark.createDataFrame([(1, None, "t1", "llm", None, None)], "timeline_id bigint, parent_id string, at string, by string, model string, summary string")
    ops = spark.createDataFrame([], "timeline_id bigint, op_idx bigint, op string")
    revisions, after = rv.commit_ops(projects, batch, ops, ops.select("timeline_id", "op_idx", F.lit("x").alias("message")))
    (row,) = revisions.collect()
    assert row.ops == "[]" and row.committed and row.accepted is None and after.first().head_revision_id == row.revision_id


def line_tables(spark):
    """Lines of forty orders, two of them without a row, and some recordings that are unknown."""
    rng = random.Random(5)
    lines = [(o, n, rng.randrange(1, 80), rng.randrange(1, 9), datetime.date(2024, 1, n), float(n), float(rng.randrange(1, 40)), 0.1 if rng.random() < 0.1 else 0.05, 0.08 if n % 2 else 0.02, rng.choice("RAN"))
             for o in range(40) for n in range(1, 8)]
    columns = "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_suppkey bigint, l_shipdate date, l_extendedprice double, l_quantity double, l_discount double, l_tax double, l_returnflag string"
    tables = {"lineitem": spark.createDataFrame(lines, columns), "orders": spark.createDataFrame([(o,) for o in range(38)], "o_orderkey bigint"),
              "part": spark.createDataFrame([(p, f"p{p}", 1 + p % 50) for p in range(1, 75)], "p_partkey bigint, p_name string, p_size int")}
    return lines, tables


def test_every_edit_is_previewed(spark, tmp_path):
    """One row per edit of any kind, those that cannot apply included; ``preview_ops`` once listed five kinds of fourteen."""
    import duckdb

    lines, tables = line_tables(spark)
    con = duckdb.connect()
    for name, df in tables.items():
        df.coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    query = catalog()["preview_ops"]
    df = query.run(spark, str(tmp_path))
    got = {(r.timeline_id, r.op_idx): tuple(r) for r in df.collect()}
    assert len(got) == len(lines) and {r[0] for r in got.values()} == set(range(40))
    cur = con.execute(query.sql)
    at = [[c[0] for c in cur.description].index(c) for c in df.columns]
    assert {(r[0], r[1]): r for r in (tuple(row[i] for i in at) for row in cur.fetchall())} == got


def test_light_timelines_stay_where_they_are(spark, tmp_path):
    """Where no timeline has many rows, clips and edits are dealt by timeline once; the rows are those of the plans for small tables."""
    lines, tables = line_tables(spark)
    again = tables["lineitem"].unionByName(tables["lineitem"].where("l_orderkey = 3"))
    for name, df in (tables | {"lineitem": again}).items():
        df.coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    limits = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    for k, v in limits.items():
        spark.conf.set(k, v)
    try:
        query, dealt = catalog()["preview_all"], lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
        df = query.run(spark, str(tmp_path))
        plain, want = dealt(df), sorted(map(str, df.collect()))
        spark.conf.set("spark.splicework.smallBytes", "0")
        df = query.run(spark, str(tmp_path))
        assert dealt(df) < plain and sorted(map(str, df.collect())) == want
    finally:
        for k in limits:
            spark.conf.unset(k)
        spark.conf.unset("spark.splicework.smallBytes")


def test_a_null_timeline_keeps_its_effects(spark):
    clips = spark.createDataFrame([(None, 0, 0, "a", 7, 0, 5, 0, 1.0), (1, 0, 0, "b", 7, 0, 5, 0, 1.0)], "timeline_id bigint, track_id bigint, ord bigint, clip_id string, source_id bigint, source_in bigint, source_out bigint, start bigint, speed double")
    keys = spark.createDataFrame([(t, c, f"fx_{c}", 0, "volume", True, 0, 0, 1.0, 0.0, 0.0, 0.0, "linear") for t, c in ((None, "a"), (1, "b"))],
                                 "timeline_id bigint, clip_id string, effect_id string, effect_ord bigint, type string, effect_enabled boolean, key_idx bigint, t bigint, scale double, x double, y double, rotation double, easing string")
    sources = spark.createDataFrame([(7, 9)], "source_id bigint, duration_us bigint")
    try:
        for rows in (clips, clips.where("timeline_id IS NOT NULL")):
            session.keep_places(spark, True)
            got = {r.clip_id: (r.n, r.source_len) for r in replay.prepare_clips(rows, sources, keys).select("c.clip_id", "c.source_len", F.size("c.effects").alias("n")).collect()}
            assert got == {r.clip_id: (1, 9) for r in rows.collect()}
    finally:
        session.forget_places(spark)

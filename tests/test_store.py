"""The bucketed table, and streams with timers against the same rules on tables."""

import os
import random

import pytest
from pyspark.sql import functions as F

from conftest import rows
from splicework.streaming import live, timing
from splicework.streaming.store import BucketedTable


def buckets_of(path, commit):
    folder = f"{path}/data/v{commit}"
    return sorted(x for x in os.listdir(folder) if x.startswith("bucket=")) if os.path.isdir(folder) else []


def test_a_batch_rewrites_its_buckets_only(spark, tmp_path):
    path = str(tmp_path / "t")
    table = BucketedTable(spark, path, ["k"], ["n"], buckets=16)
    assert table.read() is None and table.commits() == []
    first = spark.range(200).select((F.col("id") % 40).alias("k"), F.col("id").alias("n"), F.lit(None).cast("string").alias("note"))
    table.merge(0, first, lambda held: first if held is None else held)
    assert rows(table.read()) == rows(first) and len(buckets_of(path, 0)) > 10
    update = spark.createDataFrame([(7, 900, "new")], "k bigint, n bigint, note string")
    for _ in range(2):  # a batch that runs again changes nothing
        (bucket,) = table.merge(1, update, lambda held: held.unionByName(update))
        assert rows(table.read()) == rows(first.unionByName(update)) and buckets_of(path, 1) == [f"bucket={bucket}"]
    assert rows(table.read(0)) == rows(first)
    asked = table.read(buckets=[bucket])
    assert {r.k for r in asked.collect()} == {k for k in range(40) if spark.range(1).select(F.pmod(F.xxhash64(F.lit(k).cast("bigint")), F.lit(16))).first()[0] == bucket}
    assert all(f"bucket={bucket}/" in f for f in asked.inputFiles())


def test_emptied_buckets_and_old_commits_go(spark, tmp_path):
    path = str(tmp_path / "t")
    table = BucketedTable(spark, path, ["k"], buckets=4)
    table.write(spark.range(8).withColumnRenamed("id", "k"), 0)
    for number in range(1, 6):
        gone = spark.createDataFrame([(number,)], "k bigint")
        table.merge(number, gone, lambda held, number=number: held.where(F.col("k") != number))
    table.expire(2)
    assert table.commits() == [4, 5] and sorted(r.k for r in table.read().collect()) == [0, 6, 7] and sorted(r.k for r in table.read(4).collect()) == [0, 5, 6, 7]
    table.merge(6, spark.range(8).withColumnRenamed("id", "k"), lambda held: held.where("k < 0"))
    table.expire(1)
    assert table.read().count() == 0 and table.read().columns == ["k"] and not any(buckets_of(path, v) for v in range(7))


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def streamed(spark, tmp_path, df, name, run):
    """The rows of ``df`` in four files, each dealt at random, late rows among them; then one row far ahead of all."""
    folder = str(tmp_path / "rows")
    for part in range(4):
        df.where(F.col("part") == part).drop("part").coalesce(1).write.mode("append").parquet(folder)
    source = spark.readStream.schema(df.drop("part").schema).option("maxFilesPerTrigger", 1).parquet(folder)
    query = run(source).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    left = [s for p in query.recentProgress for s in p.stateOperators]
    return spark.table(name), left


def trail(seed, n):
    draw = random.Random(seed)
    at, out = {p: 1_700_000_000_000_000 for p in "abc"}, []
    for seq in range(n):
        p = draw.choice("abc")
        at[p] += draw.choice([1_000, 90_000, 200_000, 349_999, 350_000, 2_000_000])
        out.append((p, seq, at[p], min(3, max(0, seq * 4 // n + draw.choice([0, 0, 0, -1, 1])))))
    return out


@pytest.mark.usefixtures("rocks")
def test_quiet_gaps_of_a_stream(spark, tmp_path):
    own = trail(3, 300)
    df = spark.createDataFrame(own, "project_id string, seq bigint, at_us bigint, part int").withColumn("at", F.timestamp_micros("at_us"))
    want = rows(timing.quiet_gaps(df).select("project_id", "seq", "starts_us"))
    ahead = spark.createDataFrame([("z", -1, own[-1][2] + 10_000_000_000, 3)], "project_id string, seq bigint, at_us bigint, part int").withColumn("at", F.timestamp_micros("at_us"))
    got, state = streamed(spark, tmp_path, df.unionByName(ahead), "gaps", lambda s: live.quiet_gaps(s, "10 minutes"))
    assert rows(got.select("project_id", "seq", "starts_us")) == want
    assert state[-1].numRowsTotal < 10  # only the row far ahead is held


@pytest.mark.usefixtures("rocks")
def test_verdicts_of_a_stream(spark, tmp_path):
    draw = random.Random(5)
    own = [(p, seq, at, part, draw.choice(["llm.plan", "llm.review", *["llm.verdict"] * 5, "other"])) for p, seq, at, part in trail(4, 240)]
    own = [(*r, draw.randint(0, 4) if r[4] == "llm.plan" else None, draw.randint(0, 4), draw.random() < 0.2, draw.random() < 0.5) for r in own]
    schema = "project_id string, seq bigint, at_us bigint, part int, type string, ops bigint, index bigint, all_ops boolean, accepted boolean"
    df = spark.createDataFrame(own, schema).withColumn("at", F.timestamp_micros("at_us"))
    want = rows(timing.current_verdicts(df).select("project_id", "review_seq", "index", "accepted"))
    ahead = spark.createDataFrame([("z", -1, own[-1][2] + 10**12, 3, "llm.plan", 1, 0, False, False)], schema).withColumn("at", F.timestamp_micros("at_us"))
    got, state = streamed(spark, tmp_path, df.unionByName(ahead), "verdicts", lambda s: live.current_verdicts(s, "10 minutes", idle=3_600_000))
    assert rows(got.select("project_id", "review_seq", "index", "accepted")) == want and want
    assert state[-1].numRowsTotal < 10

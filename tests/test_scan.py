import random

import pytest
from pyspark.sql import functions as F

from conftest import rows
from splicework.operators import asof, intervals, stats
from splicework.operators import scan as sc


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(7)
    data = [("hot", i, rng.choice([None, *range(5)])) for i in range(60)] + [(f"k{j}", 0, j) for j in range(10)]
    rng.shuffle(data)
    return spark.createDataFrame(data, "k string, i bigint, x bigint")


def wanted():
    x = F.col("x")
    return dict(
        a=sc.running_sum(x), b=sc.sum_before(x), c=sc.max_before(x), d=sc.min_before(x), e=sc.last_known(x),
        f=sc.last_before(x), g=sc.next_known(x), h=sc.previous(x), j=sc.following(x),
    )


def test_split_scan_equals_plain(spark, skewed, request):
    plain = rows(sc.scan(skewed, ["k"], ["i"], ordinal="i", **wanted()))
    request.getfixturevalue("split")
    assert sc.has_heavy(skewed, ["k"], ["i"])
    assert rows(sc.scan(skewed, ["k"], ["i"], ordinal="i", **wanted())) == plain
    assert rows(sc.scan(skewed, ["k"], ["i"], coarse=F.call_function("div", F.col("i"), F.lit(7)), **wanted())) == plain


def test_lag_value_may_be_null(spark):
    df = spark.createDataFrame([("a", 0, None), ("a", 1, 3)], "k string, i bigint, x bigint")
    got = rows(sc.scan(df, ["k"], ["i"], ordinal="i", p=sc.previous(F.col("x"))).select("i", "p"))
    assert got == [(0, None), (1, None)]


def test_exact_statistics_when_split(spark, split):
    df = spark.createDataFrame([("a", float(v)) for v in [5, 1, 4, 2, 3, 9]] + [("b", 7.0)], "k string, v double")
    assert rows(stats.exact_median(df, ["k"], "v", "m")) == [("a", 3.5), ("b", 7.0)]
    assert rows(stats.percentile_lower(df, ["k"], "v", 0.5, "p")) == [("a", 4.0), ("b", 7.0)]


def test_asof_against_brute_force(spark, split):
    rng = random.Random(3)
    left = [(rng.choice("ab"), rng.randrange(100), n) for n in range(40)]
    right = [(rng.choice("ab"), rng.randrange(100), n) for n in range(30)]
    a = spark.createDataFrame(left, "k string, at bigint, id bigint")
    b = spark.createDataFrame(right, "k string, t bigint, v bigint")
    got = {r["id"]: r["match"]["v"] if r["match"] else None for r in asof.asof_backward(a, b, ["k"], "at", "t", ["v"], tie="v").collect()}
    for k, at, n in left:
        mine = sorted((t, v) for kk, t, v in right if kk == k)
        before = [v for t, v in mine if t <= at]
        assert got[n] == (before[-1] if before else mine[0][1] if mine else None)


def test_overlaps_come_once(spark):
    a = spark.createDataFrame([("s", 0, 95), ("s", 40, 41)], "k string, a0 bigint, a1 bigint")
    b = spark.createDataFrame([("s", 10, 90), ("s", 41, 50), ("s", 94, 94)], "k string, b0 bigint, b1 bigint")
    got = rows(intervals.overlapping(a, b, ["k"], ("a0", "a1"), ("b0", "b1"), width=7).select("a0", "b0"))
    assert got == [(0, 10), (0, 41), (40, 10)]


def test_cells_hold_every_pair_once(spark, monkeypatch):
    """Short, long and very long ranges on both sides of zero, repeated ones, empty ones and ones without key."""
    monkeypatch.setattr(intervals, "SIZES", 4)
    rng = random.Random(4)
    some = lambda n, longest: [(rng.choice(["s", "t", None]), a := rng.randint(-300, 300), a + rng.choice([0, 1, rng.randint(0, longest)]), i) for i in range(n)]
    many, few = some(120, 900), some(30, 60)
    many, few = many + many[:3], few + few[:3]
    a = spark.createDataFrame(many, "k string, a0 bigint, a1 bigint, i bigint")
    b = spark.createDataFrame(few, "k string, b0 bigint, b1 bigint, j bigint")
    got = rows(intervals.in_cells(a, b, ["k"], ("a0", "a1"), ("b0", "b1"), width=7).select("i", "j"))
    want = [(x[3], y[3]) for x in many for y in few if x[0] == y[0] is not None and max(x[1], y[1]) < min(x[2], y[2])]
    assert got == sorted(want, key=lambda r: tuple((False, str(v)) for v in r))


def test_counted_keys_are_not_counted_again(spark):
    df = spark.createDataFrame([("a", 0), ("a", 1), ("b", 0)], "k string, i bigint")
    spark.conf.set("spark.splicework.smallBytes", "0")
    try:
        placed = sc.ordinals(df, ["k"], ["i"], "n", coarse=F.col("i"))
        named = placed.select(F.col("k").alias("key"), "n").where("n >= 0").join(placed.select(F.col("k").alias("key")).distinct(), "key")
        assert sc.is_light(named, ["key", "n"]) and not sc.is_light(named, ["n"])
        assert sc._most(named, ["key", "n"], ["n"]) is None
        other = named.select(F.concat("key").alias("key"), "n")
        assert not sc.is_light(sc.stacked(named, other, ["key"]), ["key"]) and sc.is_light(sc.stacked(named, named, ["key"]), ["key"])
        spark.conf.set("spark.splicework.heavyRows", "100")  # no headroom left
        assert not sc.is_light(named, ["key"])
    finally:
        spark.conf.unset("spark.splicework.smallBytes")
        spark.conf.unset("spark.splicework.heavyRows")


def test_first_rows_come_from_the_same_pass(spark, skewed, request):
    """The first right row of a key, also where several share its instant."""
    first = dict(f=sc.first_known(F.col("x")))
    left = spark.createDataFrame([("hot", 0), ("hot", 5), ("hot", 40), (None, 5), ("none", 1)], "k string, at bigint")
    keys = spark.createDataFrame([("hot", 5, 0, 1.0, "hold"), ("hot", 5, 1, 2.0, "linear"), ("hot", 9, 2, 4.0, "linear"), ("hot", 30, 3, 6.0, "hold"), (None, 9, 0, 3.0, "hold")], "k string, t bigint, key_idx bigint, v double, easing string")
    valued = lambda: asof.asof_interpolate(left, keys, ["k"], "at", ["v"])
    plain, found = rows(sc.scan(skewed, ["k"], ["i"], ordinal="i", **first)), rows(valued())
    assert sorted(found, key=str) == sorted([("hot", 0, 1.0), ("hot", 5, 1.0), ("hot", 40, 6.0), (None, 5, 3.0), ("none", 1, None)], key=str)
    assert "Join" not in valued()._jdf.queryExecution().optimizedPlan().toString()
    request.getfixturevalue("split")
    assert rows(sc.scan(skewed, ["k"], ["i"], ordinal="i", **first)) == plain and rows(valued()) == found

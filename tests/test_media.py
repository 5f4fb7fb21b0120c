import random

import pytest
from pyspark.sql import functions as F

from conftest import rows
from splicework.operators import media


@pytest.fixture(scope="module")
def track(spark):
    rng, at, data = random.Random(9), 0, []
    for n in range(40):
        size = rng.choice([5, 20, 70])
        data.append((1, n, at, size))
        at += size + rng.choice([0, 3, 9, 30])
    return data, spark.createDataFrame(data, "track_id bigint, sample_no bigint, offset bigint, size bigint")


def reads(data, gap, span):
    out, opener, start, end = [], None, 0, 0
    for _, n, off, size in data:
        if opener is None or not 0 <= off - end <= gap or off + size - start > span:
            opener, start = n, off
        end = off + size
        out.append((n, opener))
    return out


def test_reads_are_batched(spark, track):
    data, df = track
    got = media.coalesce_reads(df, 10, 60).select("sample_no", "read_no")
    assert sorted(rows(got)) == reads(data, 10, 60)


def test_reads_by_jumps_equal_reads_by_fold(spark, track, split):
    data, df = track
    got = media.coalesce_reads(df, 1000, 60).select("sample_no", "read_no")
    assert sorted(rows(got)) == reads(data, 1000, 60)


def test_runs_expand_to_what_was_encoded(spark):
    rng = random.Random(2)
    values = [(1, i, rng.choice([10, 20])) for i in range(50)]
    df = spark.createDataFrame(values, "track_id bigint, sample_no bigint, delta bigint")
    sizes = spark.createDataFrame([(1, 50)], "track_id bigint, samples bigint")
    runs = media.rle_encode(df, ["track_id"], "sample_no", "delta")
    assert rows(media.rle_expand(runs, sizes, ["track_id"])) == rows(df)
    longer = media.rle_expand(runs, sizes.withColumn("samples", F.lit(53).cast("bigint")), ["track_id"])
    assert longer.where("sample_no >= 50").select("value").distinct().count() == 1 and longer.count() == 53

from pyspark.sql import functions as F

from conftest import rows
from splicework.functions import digest, easing, frames, numeric, rational, timecode


def one(spark, *cols):
    return tuple(spark.range(1).select(*cols).first())


def test_halves_round_up(spark):
    assert one(spark, *[numeric.js_round(F.lit(x)) for x in (-2.5, -2.4, 2.5, 0.5)]) == (-2, -2, 3, 1)
    assert one(spark, numeric.js_round_ratio(F.lit(-5), F.lit(2)), numeric.ceil_div(F.lit(7), F.lit(2)), numeric.floor_div(F.lit(-7), F.lit(2))) == (-2, 4, -4)


def test_frames_round_trip_at_ntsc(spark):
    df = spark.range(0, 5000).select("id", frames.micros_to_frame(frames.frame_to_micros("id", F.lit(30000), F.lit(1001)), F.lit(30000), F.lit(1001)).alias("back"))
    assert df.where("id <> back").count() == 0


def test_timecodes(spark):
    t = timecode
    assert one(spark, t.format_timecode(F.lit(83_500_000)), t.format_timecode(F.lit(83_500_000), compact=True), t.format_timecode(F.lit(-1_500_000))) == ("00:01:23.500", "1:23.500", "-00:00:01.500")
    texts = ["00:01:23.500", "1:23", "7", "0:00:01:12", "x", "1:2:3:4:5"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in texts], "s string").select(t.parse_timecode("s", F.lit(24), F.lit(1))).collect()]
    assert got == [83_500_000, 83_000_000, 7_000_000, 1_500_000, None, None]
    assert one(spark, t.parse_timecode(F.lit("0:00:01:12"))) == (None,)


def key(t, v, e="linear"):
    return f"named_struct('t', {t}L, 'scale', {v}D, 'x', 0D, 'y', 0D, 'rotation', 0D, 'easing', '{e}')"


def test_keys_are_sampled_split_and_moved(spark):
    keys = F.expr(f"array({key(0, 1)}, {key(100, 2)})")
    at = lambda t: easing.sample_keys(keys, F.lit(t))["scale"]
    assert one(spark, at(-5), at(0), at(25), at(100), at(900)) == (1.0, 1.0, 1.25, 2.0, 2.0)
    halves = easing.split_keys(keys, F.lit(40))
    left, right = one(spark, halves["left"], halves["right"])
    assert [(k["t"], k["scale"]) for k in left] == [(0, 1.0), (40, 1.4)]
    assert [(k["t"], k["scale"]) for k in right] == [(0, 1.4), (60, 2.0)]
    (moved,) = one(spark, easing.retime_keys(keys, F.lit(-50.0), F.lit(30)))
    assert [(k["t"], k["scale"]) for k in moved] == [(0, 1.5), (30, 1.8)]
    (held,) = one(spark, easing.sample_keys(F.expr(f"array({key(0, 1, 'hold')}, {key(10, 2)})"), F.lit(9))["scale"])
    assert held == 1.0


def fnv(codes, high=0x811C9DC5, low=0x811C9DC5):
    for i, c in codes:
        high = ((high ^ c) * 0x01000193) & 0xFFFFFFFF
        low = ((low ^ (c + i)) * 0x01000193) & 0xFFFFFFFF
    return high, low


def test_digest_lanes(spark):
    for text in ("", "a", '{"a":1,"b":[2,"é"]}'):
        high, low = fnv([(i, ord(c)) for i, c in enumerate(text)])
        assert one(spark, digest.digest(F.lit(text))) == (f"{high:08x}{low:08x}",)
    assert one(spark, digest.canonical_map(F.expr("map('b', 1, 'a', 2)"))) == ('{"a":2,"b":1}',)


def test_fingerprint_reads_both_ends(spark):
    data = bytes(range(256)) * 3
    ends = [(i, b) for i, b in enumerate(data)] * 2
    high, low = fnv(ends, low=0x811C9DC5 ^ len(data))
    df = spark.createDataFrame([(bytearray(data),)], "b binary")
    assert df.select(digest.fingerprint_exact("b")).first()[0] == f"{len(data):012x}{high:08x}{low:08x}"
    long = [(bytearray(b"x" * 200_000),), (bytearray(b"x" * 100_000 + b"y" + b"x" * 99_999),), (bytearray(b"x" * 199_999 + b"y"),)]
    assert spark.createDataFrame(long, "b binary").select(digest.fingerprint("b")).distinct().count() == 2


def test_rationals(spark):
    (r,) = one(spark, rational.reduced(F.lit(30000), F.lit(2002)))
    assert tuple(r) == (15000, 1001)
    assert rows(spark.range(1).select(rational.gcd(F.lit(0), F.lit(0)))) == [(1,)]

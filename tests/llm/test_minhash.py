"""Near-duplicate classes against all pairs, the banded distance against the whole table."""

import random

import numpy as np
import pytest

from splicework.llm import minhash


def distance(a, b):
    before = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(before[j] + 1, now[-1] + 1, before[j - 1] + (x != y)))
        before = now
    return before[-1]


def test_banded_distance():
    draw = random.Random(1)
    for case in range(4000):
        a = [draw.choice("abcd") for _ in range(draw.randint(0, 14))]
        b = [draw.choice("abcd") for _ in range(draw.randint(0, 14))] if case % 2 else [c for c in a if draw.random() < 0.9] + ["a"] * draw.randint(0, 2)
        most = draw.randint(0, 14)
        assert minhash.banded_distance(a, b, most) == min(distance(a, b), most + 1)


def classes(texts):
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(texts):
        for j in range(i):
            if minhash.similar(a, texts[j]):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [find(i) for i in range(len(texts))]


def family(draw):
    """Originals, copies, near copies and a chain of small edits."""
    words, texts = [f"w{i}" for i in range(300)], []
    for _ in range(30):
        own = [draw.choice(words) for _ in range(draw.choice([1, 3, 6, 12, 40, 120, 300]))]
        texts.append(" ".join(own))
        for _ in range(draw.randint(0, 4)):
            near = [draw.choice(words) if draw.random() < 0.05 else w for w in own]
            if draw.random() < 0.5:
                del near[len(near) // 2]
            texts.append(" ".join(near))
        texts.append(" ".join(own))
    return texts


def test_classes_against_all_pairs(spark, monkeypatch):
    texts = family(random.Random(8))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = classes(texts)
    for small in (minhash.SMALL_BUCKET, 2):
        monkeypatch.setattr(minhash, "SMALL_BUCKET", small)
        got = {r.doc_id: r.class_id for r in minhash.near_duplicates(df).collect()}
        assert [got[i] for i in range(len(texts))] == want


def test_large_family_is_one_class(spark):
    draw = random.Random(9)
    own = [f"x{draw.randint(0, 500)}" for _ in range(150)]
    rows = [(i, " ".join(w if draw.random() > 0.02 else "y" for w in own)) for i in range(400)]
    found = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.class_id for r in found} == {0} and sum(r.links for r in found) / 2 < 400 * 100


@pytest.mark.parametrize("words", [5, 6, 10, 30, 64, 65, 72, 80, 100, 200, 500, 2000])
def test_scattered_edits_share_a_sketch(words):
    """Of pairs with edits at random places nearly all meet, also at the least similarity."""
    draw = np.random.default_rng(words)
    hashes = lambda n: draw.integers(1, 1 << 62, n).astype(np.uint64)
    for least in (0.8, 0.82, 0.85):
        met = 0
        for _ in range(150):
            a = hashes(words)
            b, at = a.copy(), draw.choice(words, int(words * (1 - least) + 1e-9), replace=False)
            b[at] = hashes(len(at))
            met += bool(np.intersect1d(*minhash.sketches_of([a, b])).size)
        assert met >= 0.96 * 150


def test_lengths_around_the_run_switch_meet():
    draw = np.random.default_rng(4)
    met = 0
    for _ in range(100):
        a = draw.integers(1, 1 << 62, 72).astype(np.uint64)
        met += bool(np.intersect1d(*minhash.sketches_of([a, np.delete(a, draw.choice(72, 12, replace=False))])).size)
    assert met >= 97


def test_large_buckets_lose_no_pair(spark, monkeypatch):
    """A wide family, whose copies are like the original only, and pairs that share a frame with all others."""
    draw = random.Random(12)
    new = lambda n: [f"n{draw.randrange(1 << 40)}" for _ in range(n)]
    spoilt = lambda own, n: [new(1)[0] if i in at else w for at in [set(draw.sample(range(len(own)), n))] for i, w in enumerate(own)]
    own = new(200)
    wide = [" ".join(own)] + [" ".join(spoilt(own, 26)) for _ in range(60)]
    frame = new(120)
    framed = [" ".join(frame + spoilt(body, n)) for body in (new(80) for _ in range(40)) for n in (0, 4)]
    df = spark.createDataFrame(list(enumerate(wide + framed)), "doc_id long, text string")
    want = classes(wide + framed)
    assert len(set(want)) == 41
    for block in (minhash.BLOCK, 7):
        monkeypatch.setattr(minhash, "BLOCK", block)
        got = {r.doc_id: r.class_id for r in minhash.near_duplicates(df).collect()}
        assert [got[i] for i in range(len(want))] == want


def test_components(spark):
    draw = random.Random(7)
    links = [(bytes([draw.randint(0, 120)]), bytes([draw.randint(0, 120)])) for _ in range(90)] + [(bytes([150 + i]), bytes([151 + i])) for i in range(60)]
    got = {bytes(r.node): bytes(r.root) for r in minhash.components(spark.createDataFrame(links, "a binary, b binary")).collect()}
    root = {x: x for link in links for x in link if link[0] != link[1]}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        if a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    assert got.keys() == root.keys()
    assert len({(got[x], find(x)) for x in root}) == len({got[x] for x in root}) == len({find(x) for x in root})


def test_odd_rows(spark):
    text = " ".join(f"t{i}" for i in range(50))
    rows = [(1, text), (None, text), (1, text), (4, None), (5, None), (6, ""), (7, " \n"), (8, text + " more"), (9, "ab"), (10, "ab"), (11, "ab  "), (12, "long " * 120000), (13, "long " * 120001)]
    df = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, node string")
    got = sorted(((r.doc_id, r.class_id) for r in minhash.near_duplicates(df).collect()), key=str)
    assert got == sorted([(1, 1), (None, 1), (1, 1), (4, 4), (5, 5), (6, 6), (7, 6), (8, 1), (9, 9), (10, 9), (11, 9), (12, 12), (13, 12)], key=str)
    kept = minhash.one_of_each(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [1, 4, 5, 6, 9, 12]
    assert minhash.near_duplicates(df.limit(0)).count() == 0 and minhash.one_of_each(df.limit(0)).count() == 0


def test_candidates_grow_with_the_bucket(spark):
    """A bucket of twelve texts gives each of them a few pairs, not one with every other."""
    rows = [(7, i, 20, (1, 20), 12) for i in range(1, 13)]
    members = spark.createDataFrame(rows, "sketch long, id long, n int, low struct<id:long,n:int>, size long")
    assert 11 <= minhash.candidates(members).count() <= 12 * minhash.CENTRES


def test_across_looks_at_other_classes_only(spark):
    """Pairs within a class, of lengths too far apart and of other words are not listed, however long the texts are."""
    draw = np.random.default_rng(5)
    words = lambda n: draw.integers(1, 1 << 62, n).astype(np.uint64)
    long, short = words(70000), words(300)
    texts = [(1, 1, long), (2, 2, np.r_[long[:69000], words(900)]), (3, 3, np.full(70000, 9, dtype=np.uint64)), (4, 4, short), (5, 4, short[:290]), (6, 4, short[:280]), (7, 5, np.r_[short[:270], words(20)]), (8, 6, words(300))]
    members = spark.createDataFrame([(7, i, len(t), (1, 70000), 8) for i, _, t in texts], "sketch long, id long, n int, low struct<id:long,n:int>, size long")
    kins = spark.createDataFrame([(i, k) for i, k, _ in texts], "id long, kin long")
    counters = spark.createDataFrame([(i, bytearray(minhash.word_counts(t)), [7] * minhash.SKETCHES) for i, _, t in texts], "id long, bins binary, sketches array<long>")
    assert sorted(map(tuple, minhash.across(members, kins, counters).collect())) == [(1, 2), (4, 7), (5, 7), (6, 7)]


def test_counts_are_the_same_however_many_counters():
    draw = np.random.default_rng(6)
    tokens = draw.choice(draw.integers(1, 1 << 62, 900).astype(np.uint64), 5000, p=np.r_[0.5, np.full(899, 0.5 / 899)])
    fine = minhash.folded([minhash.word_counts(tokens)], minhash.BINS)[0]
    assert (fine == np.minimum(np.bincount((tokens % np.uint64(minhash.BINS)).astype(int), minlength=minhash.BINS), 255)).all() and fine.max() == 255

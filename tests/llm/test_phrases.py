"""Phrases against a plain count of everything."""

import random
import re
from collections import Counter

import pytest

from splicework.llm import phrases
from splicework.session import checkpoint


def plain(rows, support, top, longest=5):
    f, n, out = Counter(), Counter(), []
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            f.update((lang, tuple(words[i : i + k])) for k in range(1, longest + 1) for i in range(len(words) - k + 1))
    found = {(lang, p): a for (lang, p), a in f.items() if a >= support and len(p) > 1}
    for (lang, p), a in found.items():
        inside = lambda q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
        if any(g == lang and len(q) > len(p) and b >= a and inside(q) for (g, q), b in found.items()):
            continue
        score, k = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        out.append((lang, -score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]], n[lang]))
    ranked, place = [], Counter()
    for lang, score, a, p, left, right, total in sorted(out):
        place[lang] += 1
        if place[lang] <= top:
            ranked.append((lang, place[lang], p.decode(), -a, left, right, total, -score))
    return ranked


def drawn(seed, texts):
    draw = random.Random(seed)
    stock = ["new york city hall", "at the end of the day", "öl und gas", "of the", "NEW york", "a b a b a b"]
    piece = lambda: " ".join(draw.choice([draw.choice(stock), draw.choice(["the", "of", "x", f"w{draw.randrange(60)}"])]) for _ in range(draw.randrange(9)))
    return [(draw.choice(["", " ", "\n"]) + draw.choice([". ", "\n", ",\t", " ! "]).join(piece() for _ in range(draw.randrange(6))), draw.choice(["en", "en", "de", None])) for _ in range(texts)]


@pytest.mark.parametrize(("support", "shards", "bits"), [(12, 1, 1 << 20), (12, 16, 1 << 20), (3, 3, 64)])
def test_against_plain_counts(spark, monkeypatch, support, shards, bits):
    """In one shard, in several, and with filters that are nearly full."""
    monkeypatch.setattr(phrases, "LEAST_BITS", bits)
    monkeypatch.setattr(phrases, "MOST_BITS", bits)
    monkeypatch.setattr(phrases, "STRETCH", 64)
    monkeypatch.setattr(phrases, "AT_ONCE", 200)
    rows = drawn(2, 400)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "text string, lang string, phrase string, n int").repartition(3)
    got = [tuple(r) for r in phrases.collocations(df, support, top=25, shards=shards).orderBy("lang", "rank").collect()]
    assert got == plain(rows, support, 25) and got


def test_shards_report_only_what_is_frequent_in_them(spark):
    rows = [("a b c", "en")] * 50 + [(f"u{i} v{i}", "en") for i in range(50)]
    coded = checkpoint(phrases.encoded(spark.createDataFrame(rows, "text string, lang string").coalesce(1)))
    common = coded.where("word IS NOT NULL")
    every = [phrases.known(common, common.count())]
    totals = spark.createDataFrame([("en", 250)], "lang string, n long")
    stretches = coded.where("tokens IS NOT NULL")
    limits = checkpoint(phrases.limits_of(stretches, totals, 20))
    assert [tuple(r) for r in limits.collect()] == [("en", 0, 20)]
    reports = phrases.reported(phrases.counts_of_shards(stretches, every), limits)
    kept_back = checkpoint(spark.createDataFrame([("en", 19)], "lang string, most long"))
    assert [r.spare for r in reports.collect()] == [31, 31]
    assert phrases.candidates(reports, kept_back, 50).count() == 2 and phrases.candidates(reports, kept_back, 51).count() == 0


def test_odd_rows(spark):
    odd = [(None, None), ("", "en"), ("one", None), ("q r " * 200000, "de"), (" ,;\t.\n", "en"), ("NUL\x00 in it " * 120, "fr")]
    df = spark.createDataFrame(odd, "text string, lang string")
    assert [tuple(r) for r in phrases.collocations(df).orderBy("lang", "rank").collect()] == plain(odd, 100, 2000)
    assert phrases.collocations(df.limit(0)).count() == 0


def test_products_of_more_than_64_bits(spark, monkeypatch):
    found = spark.createDataFrame([("en", "a b", 3 * 10**12), ("en", "a", 4 * 10**12), ("en", "b", 5 * 10**12)], "lang string, phrase string, f long")
    totals = spark.createDataFrame([("en", 10**14)], "lang string, n long")
    monkeypatch.setattr(phrases, "frequent_phrases", lambda *_: (found, checkpoint(totals)))
    row = phrases.collocations(found).collect()[0]
    assert row.score == 1000 * 3 * 10**12 * 10**14 // (20 * 10**24) and (row.l, row.r) == (4 * 10**12, 5 * 10**12)


def test_only_frequent_phrases_reach_the_last_count(spark, monkeypatch):
    """What one shard reports but all shards together have too seldom is gone before phrases are counted by their words."""
    seen = []
    counts = phrases.exact_counts
    monkeypatch.setattr(phrases, "exact_counts", lambda docs, filters: seen.append(filters) or counts(docs, filters))
    lines = [["often seen"] * 8 + ["a b"] * 10 * (i == 0) + [f"u{i} v{k}" for k in range(40)] for i in range(3)]
    df = spark.createDataFrame([("\n".join(x), "en") for x in lines], "text string, lang string").repartitionByRange(3, "text")
    found, _ = phrases.frequent_phrases(df, 20, shards=3)
    numbers = phrases.Numbers()
    h = lambda p: list(phrases.run_hashes(numbers.of(p.split()), "en", 2))[1]
    assert seen[0][1].has(h(b"often seen")).all() and not seen[0][1].has(h(b"a b")).any()
    assert {(r.phrase, r.f) for r in found.collect() if " " in r.phrase} == {("often seen", 24)}

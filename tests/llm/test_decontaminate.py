"""Spaced seeds and overlaps against a plain search."""

import numpy as np

from splicework.llm import decontaminate as de

WORDS = [f"w{i}" for i in range(400)]


def longest(same):
    best = 0
    for i in np.flatnonzero(same):
        for j in np.flatnonzero(same):
            if j >= i and same[i : j + 1].sum() >= de.AGREE * (j - i + 1) - 1e-9:
                best = max(best, j - i + 1)
    return best


def test_best_overlap():
    draw = np.random.default_rng(0)
    for _ in range(400):
        same = draw.random(draw.integers(0, 30)) < draw.random()
        agree, first, last = de.best_overlap(same)
        assert last - first == longest(same) and agree == same[first:last].sum()


def test_against_plain_search(spark):
    draw = np.random.default_rng(1)
    item = [list(draw.choice(WORDS, size=n)) for n in (9, 16, 40, 60, 5, 25)]
    docs, want = [], set()
    for i in range(300):
        words, b = list(draw.choice(WORDS, size=draw.integers(0, 80))), int(draw.integers(0, len(item)))
        start = int(draw.integers(0, max(1, len(item[b]) - 13)))
        part = list(item[b][start : start + int(draw.integers(5, 40))])
        for k in range(len(part)):
            if draw.random() < 0.05:
                part[k] = "other"
        docs.append((i, " ".join(words[:20] + part + words[20:])))
    for i, text in docs:
        w = text.split()
        for b, theirs in enumerate(item):
            for d in range(-len(theirs) + 8, len(w) - 7):
                s, e = max(0, d), min(len(w), d + len(theirs))
                same = np.array([w[p] == theirs[p - d] for p in range(s, e)], dtype=bool)
                if same.sum() >= 7 and longest(same) >= max(8, min(13, len(theirs))):
                    want.add((i, b))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([(b, "... ".join(t).upper()) for b, t in enumerate(item)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in de.contaminated(df, bench).collect()}
    assert got <= want and len(got) >= 0.9 * len(want)  # a seed needs six or seven unspoilt places
    whole = {i for i, text in docs for t in item[:4] if " ".join(t) in text}
    assert whole <= {i for i, _ in got}
    assert {(r.doc_id, r.item_id) for r in de.contaminated(df, bench, size=200).collect()} == got
    assert {r.doc_id for r in de.clean(df, bench).collect()} == {i for i, _ in docs} - {i for i, _ in got}


def test_odd_rows(spark):
    passage = " ".join(WORDS[:20])
    df = spark.createDataFrame([(None, passage, 1), (1, None, 1), (2, "", 1), (3, passage, 1), (3, passage, 1), (4, "filler " * 50000 + passage, 1)], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(7, passage), (8, None), (9, ""), (10, "short item here"), (7, passage)], "item_id long, text string")
    got = sorted(((r.doc_id, r.item_id, r.first_word, r.words) for r in de.contaminated(df, bench).collect()), key=str)
    assert got == sorted([(None, 7, 0, 20), (3, 7, 0, 20), (3, 7, 0, 20), (4, 7, 50000, 20)], key=str)
    kept = de.clean(df, bench)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2]
    assert de.clean(df, bench.limit(0)).count() == 6 and de.contaminated(df.limit(0), bench).count() == 0

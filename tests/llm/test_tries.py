"""Tries and the audit against plain loops."""

import itertools
import random
import re

import pytest

from splicework.llm import tries


def plain_mask(text, copy):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), "D": bool(re.search(r"[#$%&*|]", text)), "E": copy}
    return sum(tries.BIT[f] for f in fails if fails[f])


def plain_masks(rows):
    texts = [t or "" for _, t, _ in rows]
    return sorted(
        (str(i), part or "", plain_mask(t, i is not None and any(j is not None and j < i and u == t for (j, _, _), u in zip(rows, texts))))
        for (i, _, part), t in zip(rows, texts)
    )


def drawn(seed, n):
    draw = random.Random(seed)
    heads = ["", "a", "ab" * 40, "ab" * 40 + "c" * 300, "é" * 20, "Ünder | "]
    return [(draw.choice([None, *range(n)]), draw.choice([None, *[draw.choice(heads) + " ".join(draw.choice("xyzAB") for _ in range(draw.choice([0, 1, 3, 250]))) for _ in range(6)]]), draw.choice(["en", None, ""])) for _ in range(n)]


def test_trie_keeps_the_least_of_each_text():
    draw, trie, seen, gone = random.Random(3), tries.TextTrie(), {}, set()
    for row in range(3000):
        text, id_ = "".join(draw.choice("ab") for _ in range(draw.randint(0, 7))).encode() * draw.choice([1, 1, 50]), draw.randint(0, 200)
        gone |= set(trie.insert(text, id_, row))
        seen.setdefault(text, []).append((id_, row))
    least = {t: sorted(r for i, r in own if i == min(own)[0]) for t, own in seen.items()}
    assert {t: sorted(r) for t, r in trie.texts()} == least
    assert gone == {r for t, own in seen.items() for _, r in own} - {r for own in least.values() for r in own}


@pytest.mark.parametrize("smallest", [tries.SMALLEST, 40])
def test_masks_against_all_pairs(spark, monkeypatch, smallest):
    rows = drawn(5, 160) + [(500 + i, "head " * 60 + str(i % 7), "en") for i in range(60)]
    monkeypatch.setattr(tries, "SMALLEST", smallest)
    df = spark.createDataFrame([(*r, "m", "p") for r in rows], "doc_id long, text string, lang string, mask string, prefix string").repartition(7)
    got = sorted((str(r.doc_id), r.part, r["mask"]) for r in tries.masks(df).collect())
    assert got == plain_masks(rows)


def test_small_tries_are_emptied(spark, monkeypatch):
    monkeypatch.setattr(tries, "HELD", 300)
    rows = drawn(6, 150)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(2)
    assert sorted((str(r.doc_id), r.part, r["mask"]) for r in tries.masks(df).collect()) == plain_masks(rows)


def test_orders_against_a_loop(spark):
    draw = random.Random(1)
    docs = [(i, draw.choice(["en", "de"]), draw.randrange(32)) for i in range(300)]
    labels = [(i, draw.choice([0, 1, None]), draw.choice([0, 1, None])) for i in range(0, 400, 2)] + [(0, 1, 1), (0, 0, 0), (None, 1, 1)]
    good, toxic = {i for i, q, _ in labels if q == 1}, {i for i, _, t in labels if t == 1}
    counted = tries.masks_counted(spark.createDataFrame(docs, "doc_id long, part string, mask int"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in tries.interactions(counted).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley").collect()}
    want, shapley = {}, {}
    for part in ("en", "de"):
        own = [(i, m) for i, p, m in docs if p == part]
        for order in map("".join, itertools.permutations("ABCDE")):
            left = own
            for step, f in enumerate(order, 1):
                out = [(i, m) for i, m in left if m & tries.BIT[f]]
                left = [x for x in left if x not in out]
                fails = sum(1 for _, m in own if m & tries.BIT[f])
                shapley[part, f] = shapley.get((part, f), 0) + len(out)
                want[part, order, step] = (len(left), len(out), fails - len(out), sum(m == tries.BIT[f] for _, m in own), sum(i in good for i, _ in out), sum(i in toxic for i, _ in out))
    assert got == {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in want.items()} and len(got) == 1200


def test_odd_rows(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    df = spark.createDataFrame([(1, "x " * 400000, None), (2, "x " * 400000, ""), (None, None, "en"), (3, "", "en"), (3, "", "en"), (4, None, "en")], "doc_id long, text string, lang string")
    got = sorted((str(r.doc_id), r.part, r["mask"]) for r in tries.masks(df).collect())
    assert got == [("1", "", 2), ("2", "", 18), ("3", "en", 1), ("3", "en", 1), ("4", "en", 17), ("None", "en", 1)]
    assert tries.audit(df, labels).count() == 1200 and tries.audit(df.limit(0), labels).count() == 0

"""The classifier on labels that it has not seen, and against compression one text at a time."""

import math
import zlib

import zstandard

from splicework.llm import quality

SF = "/root/testdata/sf0.1"


def test_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.learn(docs, labels)
    assert model == quality.learn(docs.repartition(5), labels.repartition(3))
    found = {r.doc_id: r for r in quality.score(docs, model).collect()}
    assert len(found) == docs.count() and all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for i, r in found.items())
    seen = [(found[r.doc_id], r.quality) for r in labels.collect() if found[r.doc_id].held_out]
    good, bad = ([x.score for x, q in seen if q == k] for k in (1, 0))
    above = sum((g > b) + (g == b) / 2 for g in good for b in bad) / len(good) / len(bad)
    right = sum(x.predicted == q for x, q in seen) / len(seen)
    assert above > 0.97 and right > 0.95, (above, right)
    assert abs(sum(x.score for x, _ in seen) / len(seen) - len(good) / len(seen)) < 0.03  # calibrated
    for r in docs.orderBy("doc_id").limit(40).collect():
        text = (r.text or "").encode()
        sizes = []
        for known in (model.good, model.bad):
            squeeze = zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(known), write_checksum=False, write_content_size=False)
            sizes.append(sum(len(squeeze.compress(text[i : i + quality.PIECE])) for i in range(0, len(text), quality.PIECE)))
        odds = model.base + model.slope * ((sizes[1] - sizes[0]) / len(text) if text else 0)
        assert abs(found[r.doc_id].score - 1 / (1 + math.exp(-max(-30, min(30, odds))))) < 1e-9


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, "good words here", "x"), (2, None, "y"), (None, "", "z"), (3, "bad " * 300000, "s"), (3, "bad " * 300000, "s")], "doc_id long, text string, score string")
    none = spark.createDataFrame([(None, 1), (1, None), (2, 7)], "doc_id long, quality int")
    assert {(r.score, r.predicted) for r in quality.score(docs, quality.learn(docs, none)).collect()} == {(0.5, 1)}
    few = spark.createDataFrame([(i, int(i != 3)) for i in (1, 2, 3)] * 2, "doc_id long, quality int")
    found = quality.score(docs, quality.learn(docs, few))
    assert found.columns == ["doc_id", "held_out", "score", "predicted"] and found.count() == 5 and found.where("doc_id IS NULL AND held_out").count() == 0
    assert quality.score(docs.limit(0), quality.learn(docs.limit(0), few)).count() == 0

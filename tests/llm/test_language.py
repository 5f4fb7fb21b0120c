"""Language labels: held-out accuracy, spans of mixed text, Viterbi against a plain loop, odd rows."""

import zlib

import numpy as np
from pyspark.sql import functions as F

from splicework.llm import language

SF = "/root/testdata/sf0.001"


def viterbi_model(scores, switch):
    value, back = scores[0].copy(), []
    for row in scores[1:]:
        best = value.argmax()
        stay = value >= value[best] - switch
        back.append(np.where(stay, np.arange(len(row)), best))
        value = np.maximum(value, value[best] - switch) + row
    path = [value.argmax()]
    for step in reversed(back):
        path.append(step[path[-1]])
    return path[::-1]


def test_viterbi_against_loop():
    draw = np.random.default_rng(2)
    sizes = [1, 7, 3, 30, 2, 7]
    owner = np.repeat(np.array([0, 1, 4, 5, 7, 9]), sizes)
    scores = draw.normal(size=(len(owner), 3)) * 3
    got = language.viterbi(scores, owner, 2.0)
    want = np.concatenate([viterbi_model(scores[owner == o], 2.0) for o in np.unique(owner)])
    assert (got == want).all()


def test_words_and_scripts():
    words = language.Words(["Ab cd", None, "", "12 - !", "привет мир9x"])
    assert words.owner.tolist() == [0, 0, 4, 4, 4] and words.length.tolist() == [2, 2, 6, 3, 1] and words.offset.tolist() == [0, 3, 0, 7, 11]
    assert [language.SCRIPT_NAMES[s - 1] for s in words.script] == ["latin", "latin", "cyrillic", "cyrillic", "latin"]


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = language.op5_language(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(found) == docs.count() and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in found)
    apart = [r for r in found if r.held_out]
    assert sum(r.lang == r.lang_pred for r in apart) >= 0.97 * len(apart) and all(0 <= r.score <= 1 for r in found)


def test_spans_and_odd_rows(spark):
    rows = [(i, text, lang) for i, (text, lang) in enumerate([("the cat and the house of the man", "en"), ("der Hund und die Katze nicht das Haus", "de"), ("привет мир и дом", "ru")] * 30)]
    model = language.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    asked = [(1, "the man and the cat der Hund und das Haus nicht"), (2, None), (3, ""), (4, "123 !?"), (5, "мир"), (None, "the " * 60000), (5, "мир"), (6, "漢字")]
    df = spark.createDataFrame([(*a, 0) for a in asked], "doc_id long, text string, score int")
    got = language.label(df, model, spans=True).collect()
    assert [r.lang_pred for r in got[1:7]] == ["und", "und", "und", "ru", "en", "ru"] and got[7].lang_pred in model.langs
    first = [(s.lang, asked[0][1][s.start : s.end]) for s in got[0].spans]
    assert first == [("en", "the man and the cat"), ("de", "der Hund und das Haus nicht")]
    kept = language.confident(df, model)
    assert kept.columns == df.columns and kept.where("doc_id IN (2, 3, 4)").count() == 0 and kept.where("doc_id = 5").count() == 2
    nothing = language.learn(df.select("doc_id", "text", F.lit(None).cast("string").alias("lang")))
    assert {r.lang_pred for r in language.label(df, nothing).collect()} == {"und"} and language.label(df.limit(0), model).count() == 0

"""The stages on the smallest table, each held against a plain form of its rule on its own input."""

import sys
from pathlib import Path

from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline  # noqa: E402

from splicework.llm import decontaminate, language, minhash  # noqa: E402
from test_lines_and_mix import dedup_model  # noqa: E402
from test_minhash import classes  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("row", F.lit("further"))
    kept, names = [docs], docs.columns
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, kept[-1], SF).write.parquet(f"{tmp_path}/{i}")
        kept.append(spark.read.parquet(f"{tmp_path}/{i}"))
        assert kept[-1].columns == names
    texts = [{r.doc_id: r.text for r in df.collect()} for df in kept]
    labels = {r.doc_id: r for r in language.label(docs, language.learn(docs)).collect()}
    assert set(texts[1]) == {i for i in texts[0] if labels[i].lang_pred != "und" and labels[i].score >= 0.5}
    cut = dedup_model(texts[1].items())
    assert texts[2] == {i: t for i, (_, gone, t) in cut.items() if not gone or t.split()}
    ids = sorted(texts[2])
    assert sorted(texts[3]) == sorted({ids[c] for c in classes([texts[2][i] for i in ids])})
    leaks = {r.doc_id for r in decontaminate.contaminated(kept[3], spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert leaks and set(texts[4]) == set(texts[3]) - leaks
    assert set(texts[5]) <= set(texts[4]) and kept[5].groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 2
    assert minhash.one_of_each(kept[3]).count() == kept[3].count()


def test_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0

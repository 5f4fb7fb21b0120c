"""Quality classifier by compression: a text is like the dictionary, of good or of bad texts, that shortens it more."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .registry import corpus_query

#: Bytes that are compressed by themselves, bytes of a dictionary, level of compression.
PIECE, DICTIONARY, LEVEL = 2048, 112 << 10, 3
#: The bounded samples that are learned from: labelled documents and pieces per class for a dictionary, documents for the calibration.
SAMPLED, PIECES, CALIBRATED = 4_000, 4_000, 20_000
#: Of the labels to learn from, those with this remainder calibrate; they are not in the dictionaries.
FOLDS, HELD_OUT, ASIDE = 5, 0, 4
GOOD_FROM = 0.3


def fold(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string")) % FOLDS


def pieces(text: bytes) -> list[bytes]:
    """The whole text in pieces, so that its own words don't take the dictionary's place."""
    return [text[i : i + PIECE] for i in range(0, len(text), PIECE)]


@dataclass(frozen=True)
class Quality:
    """A dictionary per class, and the line that turns a difference into log odds."""

    good: bytes
    bad: bytes
    slope: float = 0.0
    base: float = 0.0

    def differences(self, texts: list[bytes]) -> np.ndarray:
        """Bytes that the good dictionary saves over the bad one, per byte of text; 0 for an empty text."""
        squeeze = [compressor(d).compress for d in (self.good, self.bad)]
        out = np.zeros(len(texts))
        for i, text in enumerate(texts):
            if text:
                by_good, by_bad = (sum(len(f(p)) for p in pieces(text)) for f in squeeze)
                out[i] = (by_bad - by_good) / len(text)
        return out

    def scores(self, texts: list[bytes]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.base + self.slope * self.differences(texts), -30, 30)))


def compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    known = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_checksum=False, write_content_size=False)


def dictionary(sample: list[bytes]) -> bytes:
    """A dictionary of the pieces; of too few to train one, the pieces themselves."""
    try:
        return zstandard.train_dictionary(DICTIONARY, sample).as_bytes()
    except zstandard.ZstdError:
        return b"".join(sample)[-DICTIONARY:]


def line(model: Quality, x: np.ndarray, good: np.ndarray) -> Quality:
    """The model with the logistic line through labelled differences; without both classes, with their smoothed share."""
    share = np.log((good.sum() + 1) / ((1 - good).sum() + 1))
    if good.all() or not good.any():
        return Quality(model.good, model.bad, 0.0, float(share))
    width = x.std() or 1.0
    rows, found = np.c_[x / width, np.ones(len(x))], np.array([0.0, share])
    penalty = np.diag([1e-2, 1e-4])
    for _ in range(50):  # Newton's method
        chance = 1 / (1 + np.exp(-np.clip(rows @ found, -30, 30)))
        slope = rows.T @ (chance - good) + penalty @ found
        step = np.linalg.solve(rows.T @ (rows * (chance * (1 - chance))[:, None]) + penalty, slope)
        found = found - step
        if np.abs(step).max() < 1e-9:
            break
    return Quality(model.good, model.bad, float(found[0] / width), float(found[1]))


def _texts(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """(text in bytes, quality, at) of the ``rows`` labelled documents whose ids come first by hash: at most so many are broadcast."""
    asked = labels.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(rows)
    named = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    return named.join(F.broadcast(asked), "doc_id").select("text", "quality", F.xxhash64("doc_id", "text").alias("at"))


def learn(docs: DataFrame, labels: DataFrame) -> Quality:
    """(doc_id, text), (doc_id, quality) -> the model. Labels of the held-out fold, null ids, and qualities other than 0 and 1 are left out;
    a document with two labels is learned from under both.

    It sees at most SAMPLED documents and PIECES pieces of each class for the dictionaries and CALIBRATED others for the
    calibration, drawn by hash, so what comes to the driver has a fixed bound: 2 * PIECES * PIECE bytes, then one number per document.
    """
    known = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").select("doc_id", F.col("quality").cast("int").alias("quality")).where(fold() != HELD_OUT)
    found = {}
    for quality in (0, 1):
        sample = _texts(docs, known.where((fold() != ASIDE) & (F.col("quality") == quality)), SAMPLED)
        cut = sample.select("at", F.expr(f"explode(transform(sequence(0, greatest(octet_length(text) - 1, 0), {PIECE}), i -> substring(text, i + 1, {PIECE})))").alias("piece"))
        first = cut.where("octet_length(piece) > 0").orderBy(F.xxhash64("at", "piece"), "piece").limit(PIECES)
        found[quality] = dictionary([bytes(r.piece) for r in first.collect()])
    model = Quality(found[1], found[0])
    aside = _texts(docs, known.where(fold() == ASIDE), CALIBRATED)

    def differ(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("at"), pa.array(model.differences(batch.column("text").to_pylist())), batch.column("quality")], ["at", "x", "quality"])

    seen = aside.mapInArrow(differ, "at long, x double, quality int").orderBy("at", "x", "quality").toArrow()
    return line(model, seen.column("x").to_numpy(), seen.column("quality").to_numpy().astype(float))


def score(docs: DataFrame, model: Quality) -> DataFrame:
    """(doc_id, text) -> doc_id, held_out, score, predicted, a row per row. Every byte of a text counts; a null text is an empty one, and
    an empty one gets the score of no difference. Without labels of both classes all texts get the share of the
    good ones. A null id is not held out. Other columns are not read."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = model.scores(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(found), pa.array((found >= GOOD_FROM).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    asked = docs.select("doc_id", F.coalesce(fold() == HELD_OUT, F.lit(False)).alias("held_out"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    return asked.mapInArrow(work, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")


@corpus_query("op13_quality")
def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, learn(docs, table(spark, sf_dir, "labels")))

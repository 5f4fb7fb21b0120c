"""Language ID: scripts narrow the candidates, character models score words, Viterbi labels spans."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .registry import corpus_query

# First and last code point of script ranges; letters outside them are of script 0.
SCRIPTS = (
    ("latin", 0x0041, 0x024F), ("greek", 0x0370, 0x03FF), ("cyrillic", 0x0400, 0x052F), ("armenian", 0x0530, 0x058F), ("hebrew", 0x0590, 0x05FF),
    ("arabic", 0x0600, 0x077F), ("devanagari", 0x0900, 0x097F), ("bengali", 0x0980, 0x09FF), ("gurmukhi", 0x0A00, 0x0A7F), ("gujarati", 0x0A80, 0x0AFF),
    ("tamil", 0x0B80, 0x0BFF), ("telugu", 0x0C00, 0x0C7F), ("kannada", 0x0C80, 0x0CFF), ("malayalam", 0x0D00, 0x0D7F), ("thai", 0x0E00, 0x0E7F),
    ("georgian", 0x10A0, 0x10FF), ("latin", 0x1E00, 0x1EFF), ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x9FFF), ("hangul", 0xAC00, 0xD7A3),
)
SCRIPT_NAMES = tuple(dict.fromkeys(name for name, _, _ in SCRIPTS))
#: Counters of runs of three characters per language; the model's size doesn't depend on the corpus.
COUNTERS = 1 << 15
#: Natural-log cost of changing the language between two words, and the part of a language's
#: letters that a script must make up for the language to be a candidate in it.
SWITCH, IN_SCRIPT = 6.0, 0.001
#: Characters that are scored together, and words whose labels are found together.
AT_ONCE = 1 << 20
UNKNOWN = "und"


@cache
def letters() -> np.ndarray:
    """By code point: 0 no letter, else 1 + the place of its script (0: of none of the ranges)."""
    kind = np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), dtype=np.int8, count=sys.maxunicode + 1)
    for name, first, last in SCRIPTS:
        kind[first : last + 1] *= SCRIPT_NAMES.index(name) + 2
    return kind


@cache
def lower() -> np.ndarray:
    """By code point: its lower case where that is one character."""
    return np.fromiter((ord(low) if len(low := chr(c).lower()) == 1 else c for c in range(sys.maxunicode + 1)), dtype=np.uint32, count=sys.maxunicode + 1)


class Words:
    """The words (runs of letters) of several texts: hashed runs of three characters, scripts, owners."""

    def __init__(self, texts: list[str | None]):
        joined = "\n".join(t or "" for t in texts)
        codes = np.frombuffer(("\n" + joined + "\n").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        kind = letters()[codes]
        inside = kind > 0
        edge = np.diff(inside.view(np.int8))
        self.start, end = np.flatnonzero(edge == 1) + 1, np.flatnonzero(edge == -1) + 1
        self.length = end - self.start
        ends = np.cumsum([len(t or "") + 1 for t in texts])
        self.owner = np.searchsorted(ends, self.start - 1, side="right")
        # each letter with the two characters before it in its word, and the word's end with its last two
        plain = np.where(inside, lower()[codes], 0).astype(np.uint32)
        twice = np.r_[np.uint32(0), plain[:-1]]
        thrice = np.r_[np.uint32(0), twice[:-1]]
        thrice[twice == 0] = 0
        mixed = plain * np.uint32(2654435761) ^ twice * np.uint32(2246822519) ^ thrice * np.uint32(3266489917)
        mixed ^= mixed >> np.uint32(15)
        mixed *= np.uint32(668265263)
        at = np.flatnonzero(inside | np.r_[False, inside[:-1]])
        self.runs = (mixed[at] >> np.uint32(17)).astype(np.int32)
        # a word's runs stand together: its letters and its end
        self.first_run = np.concatenate([[0], np.cumsum(self.length + 1)])[:-1].astype(np.int64)
        self.script = kind[self.start].astype(np.int64) - 1
        self.offset = self.start - 1 - np.concatenate([[0], ends])[self.owner]

    def __len__(self) -> int:
        return len(self.start)


def pieces(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about AT_ONCE characters together; a longer text is a range of its own."""
    start = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text or "") > AT_ONCE:
            yield start, i
            start, size = i, 0
        size += len(text or "") + 1
    if start < len(texts):
        yield start, len(texts)


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning; a null id is not held out, yet nothing is learned from it."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


class Model:
    """What was learned: languages, per-run log chances and the scripts that each language is written in."""

    def __init__(self, counts: list[tuple[str, int, int]]):
        self.langs = sorted({lang for lang, _, _ in counts})
        place = {lang: i for i, lang in enumerate(self.langs)}
        runs = np.zeros((len(self.langs), COUNTERS))
        scripts = np.zeros((len(self.langs), len(SCRIPT_NAMES) + 1))
        for lang, key, n in counts:
            (runs if key >= 0 else scripts)[place[lang], key if key >= 0 else -1 - key] += n
        if self.langs:
            self.chance = np.log((runs + 0.5) / (runs.sum(1, keepdims=True) + 0.5 * COUNTERS)).astype(np.float32)
            self.fits = scripts >= np.maximum(scripts.sum(1, keepdims=True), 1) * IN_SCRIPT

    def scores(self, words: Words) -> np.ndarray:
        """Log chance of each word in each language; one in a script of other languages is out of the question."""
        out = np.empty((len(words), len(self.langs)))
        for i, chance in enumerate(self.chance):
            out[:, i] = np.add.reduceat(chance[words.runs], words.first_run) if len(words) else 0
        fits = self.fits[:, words.script].T
        return np.where(fits | ~fits.any(1, keepdims=True), out, out - 1000.0)


def viterbi(scores: np.ndarray, owner: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best language of each word, texts side by side: step t takes the t-th word of every text that has one."""
    if not len(owner):
        return np.empty(0, dtype=np.int64)
    _, first, size = np.unique(owner, return_index=True, return_counts=True)
    order = np.argsort(-size, kind="stable")
    first, size = first[order], size[order]
    active = np.searchsorted(-size, -np.arange(size[0]), side="left")  # texts of more than t words
    stays = np.empty(scores.shape, dtype=bool)
    came = np.zeros(len(owner), dtype=np.int64)  # the best language of the word before
    value = scores[first].copy()
    for t in range(1, size[0]):
        at, old = first[: active[t]] + t, value[: active[t]]
        best = old.argmax(1)
        changed = old[np.arange(len(at)), best][:, None] - switch
        stays[at] = old >= changed
        came[at] = best
        value[: active[t]] = np.maximum(old, changed) + scores[at]
    out = np.empty(len(owner), dtype=np.int64)
    state = value.argmax(1)
    for t in range(size[0] - 1, -1, -1):
        at = first[: active[t]] + t
        out[at] = state[: active[t]]
        if t:
            state[: active[t]] = np.where(stays[at, state[: active[t]]], state[: active[t]], came[at])
    return out


def learn(docs: DataFrame) -> Model:
    """Counts runs and scripts of every labelled document that isn't held out, in the tasks that read them.

    A task returns at most one row per language and counter, so the shuffle and the model are
    bounded by the number of languages.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            texts, langs = batch.column("text").to_pylist(), batch.column("lang").to_pylist()
            for start, end in pieces(texts):
                words = Words(texts[start:end])
                if not len(words):
                    continue
                names = sorted(set(langs[start:end]))
                own = np.array([names.index(x) for x in langs[start:end]])[words.owner]
                per_run = np.repeat(own, words.length + 1)
                for i, name in enumerate(names):
                    runs, scripts = seen.setdefault(name, (np.zeros(COUNTERS, np.int64), np.zeros(len(SCRIPT_NAMES) + 1, np.int64)))
                    runs += np.bincount(words.runs[per_run == i], minlength=COUNTERS)
                    scripts += np.bincount(words.script[own == i], weights=words.length[own == i], minlength=len(scripts)).astype(np.int64)
        for name, (runs, scripts) in seen.items():
            keys = np.r_[np.arange(COUNTERS), -1 - np.arange(len(scripts))]
            counts = np.r_[runs, scripts]
            some = counts > 0
            yield pa.RecordBatch.from_arrays([pa.array([name] * int(some.sum())), pa.array(keys[some]), pa.array(counts[some])], ["lang", "key", "n"])

    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("text", "lang")
    counts = labelled.mapInArrow(work, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n"))
    return Model([tuple(r) for r in counts.collect()])


def labelled_words(texts: list[str | None], model: Model) -> Iterator[tuple[int, int, Words, np.ndarray, np.ndarray]]:
    """For ranges of the texts: start, end, words, the words' languages, and letters per text and language."""
    for start, end in pieces(texts) if model.langs else ():
        words = Words(texts[start:end])
        path = viterbi(model.scores(words), words.owner)
        cells = (end - start) * len(model.langs)
        weight = np.bincount(words.owner * len(model.langs) + path, weights=words.length, minlength=cells)
        yield start, end, words, path, weight.reshape(end - start, len(model.langs))


SPANS = pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def label(docs: DataFrame, model: Model, spans: bool = False) -> DataFrame:
    """(doc_id, text) -> doc_id, lang_pred, score and, if asked for, spans array<struct<lang, start, end>>.

    Words get the language of the best path: their scores, less a penalty at each change. The
    text's language is that of most letters (ties: the first by name) and the score its share of
    them. A text that is null or has no letter is ``und`` with score 0, as is every text where
    nothing was learned. Spans run from the first to the last word of one language, in code
    points, end exclusive. Texts are labelled whole in the task that reads them.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            names, scores, found = [UNKNOWN] * len(texts), np.zeros(len(texts)), [[] for _ in texts]
            for start, _, words, path, weight in labelled_words(texts, model):
                total, most = weight.sum(1), weight.argmax(1)
                for i in np.flatnonzero(total):
                    names[start + i] = model.langs[most[i]]
                    scores[start + i] = weight[i, most[i]] / total[i]
                if spans and len(words):
                    fresh = np.r_[True, (path[1:] != path[:-1]) | (words.owner[1:] != words.owner[:-1])]
                    begin = np.flatnonzero(fresh)
                    last = np.r_[begin[1:], len(words)] - 1
                    for b, e in zip(begin, last, strict=True):
                        found[start + words.owner[b]].append({"lang": model.langs[path[b]], "start": int(words.offset[b]), "end": int(words.offset[e] + words.length[e])})
            columns = [batch.column("doc_id"), pa.array(names), pa.array(scores)] + ([pa.array(found, SPANS)] if spans else [])
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "lang_pred", "score"] + ["spans"] * spans)

    asked = docs.select("doc_id", "text")
    kind = asked.schema["doc_id"].dataType.simpleString()
    return asked.mapInArrow(work, f"doc_id {kind}, lang_pred string, score double" + ", spans array<struct<lang: string, start: long, end: long>>" * spans)


def confident(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The documents, all columns, that are mostly of one language: neither ``und`` nor scored under ``least``."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, kept = batch.column("text").to_pylist(), np.zeros(batch.num_rows, dtype=bool)
            for start, end, _, _, weight in labelled_words(texts, model):
                kept[start:end] = weight.max(1) >= np.maximum(weight.sum(1) * least, 1)
            yield batch.filter(pa.array(kept))

    return docs.mapInArrow(work, docs.schema)


@corpus_query("op5_language")
def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = label(docs, learn(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")

"""Benchmark decontamination: spaced seeds find shared passages, an ungapped overlap around them decides."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .registry import corpus_query

#: Fixed masks over consecutive words: only positions with a 1 are compared, so a seed survives
#: substituted words at the others.
MASKS = ("1101011011", "1110010111", "1011100111", "11101101")
#: Fewest words of an overlap (or of a whole shorter item, down to FEWEST), and the part of them that must agree.
OVERLAP, FEWEST, AGREE = 13, 8, 0.8
#: Bytes of benchmark text that one pass over the documents looks for; a larger benchmark takes more passes.
BLOCK_BYTES = 32 << 20
#: Words of one piece of a benchmark text, so that no item is larger than a block.
PIECE_WORDS = 20_000
_TOKEN = re.compile(r"\w+")


def tokens(text: str | None, remembered: dict[str, int]) -> np.ndarray:
    """Hashes of the words of a text, without case and punctuation."""
    words = _TOKEN.findall(text.lower()) if text else []
    if len(remembered) > 1 << 20:
        remembered.clear()
    for word in set(words).difference(remembered):
        remembered[word] = xxhash.xxh64_intdigest(word) | 1
    return np.fromiter(map(remembered.__getitem__, words), dtype=np.uint64, count=len(words))


def seeds(words: np.ndarray, mask: str) -> np.ndarray:
    """The hash of every window under a mask."""
    out = np.full(max(0, len(words) - len(mask) + 1), int(mask, 2), dtype=np.uint64)
    for k, used in enumerate(mask):
        if used == "1":
            out = (out ^ words[k : k + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
    return out


class Block:
    """The seeds of some benchmark texts, sorted, with where each stands."""

    def __init__(self, items: list[tuple[int, str]]):
        remembered: dict[str, int] = {}
        self.ids, self.words = [i for i, _ in items], [tokens(t, remembered) for _, t in items]
        self.index = []
        for mask in MASKS:
            own = [seeds(w, mask) for w in self.words]
            hashes = np.concatenate([*own, np.empty(0, np.uint64)])
            item = np.repeat(np.arange(len(own)), [len(x) for x in own])
            at = np.concatenate([*[np.arange(len(x)) for x in own], np.empty(0, np.int64)]).astype(np.int64)
            order = np.argsort(hashes, kind="stable")
            self.index.append((hashes[order], item[order], at[order]))

    def hits(self, words: np.ndarray) -> set[tuple[int, int]]:
        """(item, diagonal) of every seed that a text shares with an item; diagonal: position in the text less that in the item."""
        out: set[tuple[int, int]] = set()
        for mask, (hashes, item, at) in zip(MASKS, self.index, strict=True):
            own = seeds(words, mask)
            if not len(own) or not len(hashes):
                continue
            low = np.searchsorted(hashes, own, side="left")
            found = np.flatnonzero(hashes[np.minimum(low, len(hashes) - 1)] == own)
            if not len(found):
                continue
            low, high = low[found], np.searchsorted(hashes, own[found], side="right")
            many = high - low
            entry = np.repeat(low - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(many.sum())
            out |= set(zip(item[entry].tolist(), (np.repeat(found, many) - at[entry]).tolist(), strict=True))
        return out


def best_overlap(same: np.ndarray, least: float = AGREE) -> tuple[int, int, int]:
    """(words that agree, first, last + 1) of the longest stretch that begins and ends in agreement
    and agrees in at least ``least`` of its words."""
    at = np.flatnonzero(same)
    if not len(at):
        return 0, 0, 0
    # stretch from i to j agrees in j - i + 1 of at[j] - at[i] + 1 words: enough where gain[j] >= gain[i] - (1 - least)
    gain = np.arange(len(at)) - least * at
    need = gain - (1 - least) - 1e-9
    lowest = np.minimum.accumulate(need)  # the earliest start that allows an end is the first to come down to it
    first = np.searchsorted(-lowest, -gain, side="left")
    long = at - at[first]
    end = int(long.argmax())
    start = int(first[end])
    return end - start + 1, int(at[start]), int(at[end]) + 1


def overlaps(words: np.ndarray, block: Block) -> list[tuple[object, int, int, int]]:
    """(item_id, first, last + 1, words that agree) of the verified overlaps of one text, the longest per item."""
    found: dict[object, tuple[object, int, int, int]] = {}
    for place, diagonal in sorted(block.hits(words)):
        item, theirs = block.ids[place], block.words[place]
        start, end = max(0, diagonal), min(len(words), diagonal + len(theirs))
        agree, first, last = best_overlap(words[start:end] == theirs[start - diagonal : end - diagonal])
        if last - first >= max(FEWEST, min(OVERLAP, len(theirs))) and (item not in found or (agree, -start - first) > (found[item][3], -found[item][1])):
            found[item] = (item, start + first, start + last, agree)
    return list(found.values())


def blocks(benchmark: DataFrame, size: int = BLOCK_BYTES) -> Iterator[Block]:
    """The benchmark (item_id, text) in blocks of about ``size`` bytes, each read when it is asked for."""
    pieces = (
        benchmark.where("text IS NOT NULL").select("item_id", F.split("text", r"\s+").alias("w"))
        .select("item_id", F.explode(F.expr(f"transform(sequence(0, size(w) - 1, {PIECE_WORDS}), i -> array_join(slice(w, greatest(i - {OVERLAP * 4}, 0) + 1, {PIECE_WORDS + OVERLAP * 4}), ' '))")).alias("text"))
        .distinct()
    )
    total = pieces.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = 1 + total // size
    for i in range(count):
        part = pieces.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == i)
        yield Block([(r.item_id, r.text) for r in part.collect()])


def contaminated(docs: DataFrame, benchmark: DataFrame, size: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, text), (item_id, text) -> one row per document and benchmark item that share a passage:
    doc_id, item_id, first_word, words, agreeing (of the longest such overlap).

    A passage is a stretch of at least 13 words, or of all words of an item of 8 to 12, in which
    four fifths agree word by word. It is looked for around every hit of a spaced seed. Words are
    runs of letters, digits and underscores in lower case. Null and empty texts share nothing;
    items of fewer than eight words are not looked for; equal items are reported each; a document
    that repeats is reported each time; an item of over 20,000 words may be reported once for
    each piece of that many. Each text is compared whole, in the task that reads it,
    with one block of the benchmark at a time; a benchmark of any size is so many passes.
    """
    kind, item_kind = (df.schema[c].dataType.simpleString() for df, c in ((docs, "doc_id"), (benchmark, "item_id")))
    out = None
    for block in blocks(benchmark, size):
        found = _against(docs.select("doc_id", "text"), block, f"doc_id {kind}, item_id {item_kind}, first_word long, words long, agreeing long")
        out = found if out is None else out.unionByName(found)
    return out


def _against(docs: DataFrame, block: Block, schema: str) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remembered: dict[str, int] = {}
        for batch in batches:
            ids, rows = batch.column("doc_id"), []
            for i, text in enumerate(batch.column("text").to_pylist()):
                rows += [(i, item, first, last - first, agree) for item, first, last, agree in overlaps(tokens(text, remembered), block)]
            if rows:
                at, items, *numbers = zip(*rows, strict=True)
                columns = [ids.take(pa.array(at)), pa.array(items), *[pa.array(n, pa.int64()) for n in numbers]]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "item_id", "first_word", "words", "agreeing"])

    return docs.mapInArrow(work, schema)


def clean(docs: DataFrame, benchmark: DataFrame, size: int = BLOCK_BYTES) -> DataFrame:
    """The documents, all columns, that share no passage with the benchmark."""

    def pass_over(part: DataFrame, block: Block) -> DataFrame:
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            remembered: dict[str, int] = {}
            for batch in batches:
                keep = [not overlaps(tokens(text, remembered), block) for text in batch.column("text").to_pylist()]
                yield batch.filter(pa.array(keep, pa.bool_()))

        return part.mapInArrow(work, part.schema)

    for block in blocks(benchmark, size):
        docs = pass_over(docs, block)
    return docs


@corpus_query("op8_decontaminate")
def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))

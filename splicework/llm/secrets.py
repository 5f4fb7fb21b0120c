"""Secret scans: an Aho-Corasick pass over keywords, anchored patterns near its hits, checksums."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .registry import corpus_query

# The base kinds, in the order in which ties are listed, with the words that a
# match starts with, its pattern, and the fewest characters of a group.
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_LEAST, ACCESS_LEAST = 6, 20
# Further kinds, whose last six characters are a CRC-32 in base 62.
CHECKED_WORDS = {"ghp_": "github", "gho_": "github", "ghu_": "github", "ghs_": "github", "ghr_": "github", "npm_": "npm"}
CHECKED = re.compile(r"(?:gh[pousr]|npm)_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
KINDS = ("assign", "access", "hex", "github", "npm")
SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def crc_base62(body: str) -> str:
    """The CRC-32 of ``body`` as six base-62 digits, as token issuers append it."""
    left, digits = zlib.crc32(body.encode()), ""
    for _ in range(6):
        left, digit = divmod(left, 62)
        digits = BASE62[digit] + digits
    return digits


def keyword_automaton() -> tuple[ahocorasick.Automaton, ahocorasick.Automaton]:
    """One automaton for words in either case (run over lowered text), one for exact words."""
    either, exact = ahocorasick.Automaton(), ahocorasick.Automaton()
    for word in ASSIGN_WORDS:
        either.add_word(word, len(word))
    for word in ("AKIA", *CHECKED_WORDS):
        exact.add_word(word, (word, len(word)))
    either.make_automaton()
    exact.make_automaton()
    return either, exact


_ASCII_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def lowered(text: str) -> str:
    """Lower case in which every character keeps its place."""
    low = text.lower()
    return low if len(low) == len(text) else text.translate(_ASCII_LOWER)


def find_spans(text: str, either: ahocorasick.Automaton, exact: ahocorasick.Automaton) -> list[tuple[int, int, int]]:
    """All spans of one text as (start, place of the kind in KINDS, end).

    A pattern is tried only where its keyword stands, anchored there and not before the end of
    the kind's previous match, which finds the leftmost non-overlapping matches: every match
    begins with a keyword. A match that then fails a length test still uses up its characters.
    Runs of hex digits have no keyword; their one-class pattern is its own prefilter.
    """
    spans: list[tuple[int, int, int]] = []
    end = 0
    for start in sorted(last - size + 1 for last, size in either.iter(lowered(text))):
        if start >= end and (found := ASSIGN.match(text, start)):
            end = found.end()
            if len(found.group(2)) >= ASSIGN_LEAST:
                spans.append((start, 0, end))
    end = checked_end = 0
    for last, (word, size) in exact.iter(text):
        start = last - size + 1
        if word == "AKIA":
            if start >= end and (found := ACCESS.match(text, start)):
                end = found.end()
                if end - start >= ACCESS_LEAST:
                    spans.append((start, 1, end))
        elif start >= checked_end and (found := CHECKED.match(text, start)) and crc_base62(found.group(1)) == found.group(2):
            checked_end = found.end()
            spans.append((start, KINDS.index(CHECKED_WORDS[word]), checked_end))
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(spans)


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> doc_id and its spans, array<struct<kind, start, end>>, by start, then kind.

    Positions are code points, the end exclusive. A null or empty text has no spans; repeated
    rows are scanned each; other columns are not read. Each text is scanned whole in the task
    that reads it, so nothing is shuffled.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        either, exact = keyword_automaton()
        for batch in batches:
            found = [find_spans(text, either, exact) if text else [] for text in batch.column("text").to_pylist()]
            named = [[{"kind": KINDS[kind], "start": start, "end": end} for start, kind, end in spans] for spans in found]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(named, SPANS)], ["doc_id", "spans"])

    asked = docs.select("doc_id", "text")
    kind = asked.schema["doc_id"].dataType.simpleString()
    return asked.mapInArrow(work, f"doc_id {kind}, spans array<struct<kind: string, start: int, end: int>>")


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digests(found: DataFrame) -> DataFrame:
    """Spans per document -> counts of the base kinds, the digest of the base spans, all spans as text."""
    base, spans = KINDS[:3], F.col("spans")
    counts = [F.expr(f"cast(size(filter(spans, s -> s.kind = '{kind}')) AS bigint) AS n_{kind}") for kind in base]
    digest = F.sha2(listed(F.filter(spans, lambda s: s["kind"].isin(*base))), 256).alias("base_sha256")
    return found.select("doc_id", *counts, digest, listed(spans).alias("spans"))


@corpus_query("op10_secrets")
def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(scan(table(spark, sf_dir, "documents")))

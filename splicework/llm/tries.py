"""Filter interaction audit: exact copies found in radix tries, and what every order of the filters removes."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, counted, lookup, small_or_spread, table
from .registry import corpus_query

FILTERS = "ABCDE"
#: Bits of a document's mask: the filters that it fails.
BIT = {name: 1 << i for i, name in enumerate(FILTERS)}
#: Fewest words (A), least percentage of different words (B), largest percentage of capitals (C), characters that fail (D).
FEWEST, DIFFERENT, CAPITALS, SIGNS = 200, 50, 3, b"#$%&*|"
#: Bytes of text a task's first tries hold before they are emptied; largest and smallest bytes of texts that share a prefix.
HELD, LARGEST, SMALLEST = 32 << 20, 64 << 20, 64 << 10
#: Bytes that a text takes in a trie besides its own.
NODE = 64
#: Bytes of the first prefix, and how many times longer the next one is.
PREFIX, LONGER = 8, 4
_CAPITALS, _INSIDE = bytes(range(65, 91)), bytes(range(0x80, 0xC0))


def failing(text: bytes) -> int:
    """Bits of the filters A to D that a text in UTF-8 fails."""
    words = text.split()  # of bytes: splits at the six ASCII blanks only
    return (
        BIT["A"] * (len(words) < FEWEST)
        | BIT["B"] * (100 * len(set(words)) < DIFFERENT * len(words))
        | BIT["C"] * (100 * (len(text) - len(text.translate(None, _CAPITALS))) > CAPITALS * len(text.translate(None, _INSIDE)))
        | BIT["D"] * (len(text.translate(None, SIGNS)) < len(text))
    )


class TextTrie:
    """A compressed trie of whole texts that keeps, at the end of each, the rows of the least id.

    An edge is labelled with all bytes up to the next branching, so the trie is no larger than its
    different texts; an inner node has a branch for each byte that follows.
    """

    def __init__(self) -> None:
        self.root: list = [{}, None]  # branches by first byte: [label, node]; least id and rows of a text that ends here
        self.size = 0

    def _end(self, text: bytes) -> list:
        node, at = self.root, 0
        while at < len(text):
            branch = node[0].get(text[at])
            if branch is None:
                leaf: list = [{}, None]
                node[0][text[at]] = [text[at:], leaf]
                self.size += len(text) - at + NODE
                return leaf
            label, below = branch
            if not text.startswith(label, at):
                same = _common(label, text, at)
                between: list = [{label[same]: [label[same:], below]}, None]
                branch[:] = [label[:same], between]
                label, below = branch
            node, at = below, at + len(label)
        return node

    def insert(self, text: bytes, id_: object, row: int) -> list[int]:
        """Puts a row in; returns the rows that now are known to have a smaller id with the same text."""
        end = self._end(text)
        if end[1] is None or id_ < end[1][0]:
            gone = [] if end[1] is None else end[1][1]
            end[1] = (id_, [row])
            return gone
        if id_ == end[1][0]:
            end[1][1].append(row)
            return []
        return [row]

    def texts(self) -> Iterator[tuple[bytes, list[int]]]:
        """Every text with the rows of its least id, branch by branch."""
        waiting = [(b"", self.root)]
        while waiting:
            text, (branches, end) = waiting.pop()
            if end is not None:
                yield text, end[1]
            waiting += [(text + label, below) for label, below in branches.values()]


def _common(label: bytes, text: bytes, at: int) -> int:
    """Number of first bytes of a label that the text has at a place; halves the stretch in question."""
    low, high = 0, min(len(label), len(text) - at)
    while low < high:
        middle = (low + high + 1) // 2
        if text.startswith(label[low:middle], at + low):
            low = middle
        else:
            high = middle - 1
    return low


def _rows(kept: list[tuple], kind: pa.DataType, texts: list[bytes | None]) -> pa.RecordBatch:
    ids, parts, masks = zip(*kept, strict=True) if kept else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(parts, pa.string()), pa.array(masks, pa.int32()), pa.array(texts, pa.binary())], ["doc_id", "part", "mask", "text"])


def first_tries(docs: DataFrame) -> DataFrame:
    """(doc_id, text, lang) -> doc_id, part, mask, text: a row each, tried against the rows of the same task.

    ``mask`` has the filters A to D; with E and a null text a row is settled, as the task has a smaller id with
    its text. Rows without an id are settled too. Of the others a task hands on one text per trie, so
    a group of copies travels about once for each task that holds some.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, held, of, next_row = TextTrie(), {}, None, 0
        for batch in batches:
            of, settled = batch.schema.field("doc_id").type, []
            for id_, text, part in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "part")), strict=True):
                mask = failing(text)
                if id_ is None:
                    settled.append((id_, part, mask))
                    continue
                held[next_row] = (id_, part, mask)
                for gone in trie.insert(text, id_, next_row):
                    *own, mask = held.pop(gone)
                    settled.append((*own, mask | BIT["E"]))
                next_row += 1
            yield _rows(settled, of, [None] * len(settled))
            if trie.size > HELD:
                yield from _emptied(trie, held, of)
                trie, held = TextTrie(), {}
        if held:
            yield from _emptied(trie, held, of)

    asked = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"), F.coalesce("lang", F.lit("")).alias("part"))
    return asked.mapInArrow(work, f"doc_id {kind}, part string, mask int, text binary")


def _emptied(trie: TextTrie, held: dict[int, tuple], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    rows, texts, size = [], [], 0
    for text, own in trie.texts():
        rows += [held[r] for r in own]
        texts += [text] * len(own)
        size += len(text) * len(own)
        if size > HELD // 4:
            yield _rows(rows, kind, texts)
            rows, texts, size = [], [], 0
    yield _rows(rows, kind, texts)


def with_prefix(texts: DataFrame, most: int) -> DataFrame:
    """Adds ``prefix``: the first bytes of the text, as many as it takes until texts of a common prefix have
    at most ``most`` bytes together, or the whole text where it ends before.

    Prefixes that are still too heavy are counted again at four times the length: a round reads only what
    is in question, and there are as many rounds as the longest shared beginning has digits to base four.
    """
    length, out = PREFIX, texts.withColumn("prefix", F.substring("text", 1, PREFIX))
    asked = out
    while True:
        sizes = asked.groupBy("prefix").agg(F.sum(F.octet_length("text") + NODE).alias("__bytes"), F.max(F.octet_length("text")).alias("__longest"))
        heavy, rows = counted(sizes.where((F.col("__bytes") > most) & (F.col("__longest") > length)).select("prefix", F.lit(True).alias("__heavy")))
        if not rows:
            return out
        length *= LONGER
        longer = F.when(F.col("__heavy"), F.substring("text", 1, length)).otherwise(F.col("prefix"))
        out = small_or_spread(out, heavy, ["prefix"], ["doc_id"], "left").withColumn("prefix", longer).drop("__heavy")
        asked = out.where(F.octet_length("prefix") > length // LONGER)


def last_tries(texts: DataFrame, parts: int) -> DataFrame:
    """(doc_id, part, mask, text, prefix), of one row per task and text -> doc_id, part, mask with E where another row has a smaller id.

    Each task has a range of prefixes and puts its texts into one trie. What a smaller id displaces goes
    out at once, so a task holds its different texts only.
    """
    kind = texts.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, held, of, next_row = TextTrie(), {}, None, 0
        for batch in batches:
            of, settled = batch.schema.field("doc_id").type, []
            for id_, text, part, mask in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "part", "mask")), strict=True):
                held[next_row] = (id_, part, mask)
                for gone in trie.insert(text, id_, next_row):
                    *own, mask = held.pop(gone)
                    settled.append((*own, mask | BIT["E"]))
                next_row += 1
            yield _rows(settled, of, [None] * len(settled)).select(["doc_id", "part", "mask"])
        if held:
            yield _rows([held[r] for _, own in trie.texts() for r in own], of, [None] * len(held)).select(["doc_id", "part", "mask"])

    ranged = texts.repartitionByRange(parts, "prefix").select("doc_id", "part", "mask", "text")
    return ranged.mapInArrow(work, f"doc_id {kind}, part string, mask int")


def masks(docs: DataFrame) -> DataFrame:
    """(doc_id, text, lang) -> a row per row: doc_id, part (lang, '' for null), mask (bits of the filters that the text fails).

    A null text is an empty one. E holds for a row if any row of the table has the same text and a
    smaller id; rows that repeat an id don't fail it for each other, and a null id is
    neither smaller nor greater than another. Texts are compared whole, byte by byte. Other columns are not read.
    """
    first = checkpoint(first_tries(docs))
    left = first.where("text IS NOT NULL")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = left.agg(F.sum(F.octet_length("text") + NODE)).first()[0] or 0
    parts = max(parts, -(-size // LARGEST))
    most = min(LARGEST, max(SMALLEST, size // (2 * parts)))
    return first.where("text IS NULL").select("doc_id", "part", "mask").unionByName(last_tries(with_prefix(left, most), parts))


def masks_counted(masked: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, good, toxic, docs: documents by what they fail and how ``labels`` (doc_id, quality, toxic) has them.

    A document with several labels is good if one says quality = 1, toxic if one says toxic = 1.
    """
    is_one = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)))
    marks = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(is_one("quality").alias("good"), is_one("toxic").alias("toxic"))
    known = lookup(masked, marks, ["doc_id"], ["part", "mask"], "left")
    no = F.lit(False)
    return known.groupBy("part", "mask", F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic")).agg(F.count("*").alias("docs"))


def interactions(groups: DataFrame) -> DataFrame:
    """Counts of ``masks_counted`` -> one row per part, order of the filters and step: part, filter_order, step, kept, removed,
    redundant, unique_fails, good_lost, toxic_lost, shapley.

    Documents never take part: a part has at most 128 groups, each of which meets the 600 steps.
    """
    steps = [
        (order, i + 1, sum(BIT[f] for f in order[:i]), BIT[order[i]])
        for order in map("".join, itertools.permutations(FILTERS)) for i in range(len(FILTERS))
    ]
    every = groups.sparkSession.createDataFrame(steps, "filter_order string, step int, before int, own int").agg(F.collect_list(F.struct("*")).alias("steps"))
    groups = groups.groupBy("part", "mask").agg(F.sum("docs").alias("docs"), *[F.sum(F.when(F.col(c), F.col("docs")).otherwise(0)).alias(c) for c in ("good", "toxic")])
    met = groups.withColumn("s", F.explode(every.scalar())).select("*", "s.*")
    fails, spared = F.col("mask").bitwiseAND(F.col("own")) != 0, F.col("mask").bitwiseAND(F.col("before")) == 0
    total = lambda where, value="docs": F.sum(F.when(where, F.col(value)).otherwise(0)).cast("long")
    # of the 120 orders, each filter of a mask comes before the others of the mask in equally many
    share = F.lit(120) / F.greatest(F.bit_count("mask"), F.lit(1))
    return met.groupBy("part", "filter_order", "step").agg(
        total(spared & ~fails).alias("kept"), total(spared & fails).alias("removed"), total(~spared & fails).alias("redundant"), total(F.col("mask") == F.col("own")).alias("unique_fails"),
        total(spared & fails, "good").alias("good_lost"), total(spared & fails, "toxic").alias("toxic_lost"), F.sum(F.when(fails, F.col("docs") * share.cast("long")).otherwise(0)).cast("long").alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """What each filter removes, finds removed already and alone would remove, in all orders, per language."""
    return interactions(checkpoint(masks_counted(masks(docs), labels)))


def _sql() -> str:
    orders = ", ".join(f"('{''.join(p)}')" for p in itertools.permutations(FILTERS))
    bit = "CASE f " + " ".join(f"WHEN '{f}' THEN {b}" for f, b in BIT.items()) + " END"
    word = r"[^\x20\x09-\x0D]+"
    return f"""
WITH texts AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{word}') AS w FROM documents),
marked AS (SELECT part, doc_id, (len(w) < {FEWEST})::INT * {BIT['A']} + (100 * len(list_distinct(w)) < {DIFFERENT} * len(w))::INT * {BIT['B']}
    + (100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > {CAPITALS} * length(t))::INT * {BIT['C']} + regexp_matches(t, '[#$%&*|]')::INT * {BIT['D']}
    + coalesce(min(doc_id) OVER (PARTITION BY t) < doc_id, false)::INT * {BIT['E']} AS mask FROM texts),
known AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
groups AS (SELECT part, mask, count(*) AS docs, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM marked LEFT JOIN known USING (doc_id) GROUP BY ALL),
steps AS (SELECT filter_order, unnest(range(1, 6)) AS step FROM (VALUES {orders}) o(filter_order)),
each AS (SELECT filter_order, step, substr(filter_order, step, 1) AS f, ({bit}) AS own,
    list_sum(list_transform(range(1, step), lambda i: 1 << (ascii(substr(filter_order, i, 1)) - 65)))::INT AS earlier FROM steps),
met AS (SELECT part, filter_order, step, mask, own, docs, good, toxic, (mask & own) <> 0 AS fails, (mask & coalesce(earlier, 0)) = 0 AS spared FROM groups, each),
counts AS (SELECT part, filter_order, step, any_value(own) AS own, CAST(coalesce(sum(docs) FILTER (WHERE spared AND NOT fails), 0) AS BIGINT) AS kept, CAST(coalesce(sum(docs) FILTER (WHERE spared AND fails), 0) AS BIGINT) AS removed,
    CAST(coalesce(sum(docs) FILTER (WHERE fails AND NOT spared), 0) AS BIGINT) AS redundant, CAST(coalesce(sum(docs) FILTER (WHERE mask = own), 0) AS BIGINT) AS unique_fails,
    CAST(coalesce(sum(good) FILTER (WHERE spared AND fails), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(toxic) FILTER (WHERE spared AND fails), 0) AS BIGINT) AS toxic_lost FROM met GROUP BY part, filter_order, step)
SELECT * EXCLUDE (own), CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM counts
"""


@corpus_query("op11_filter_audit", sql=_sql())
def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))

"""Near-dedup by Order MinHash: sketches that keep the order of sampled word runs, checked by banded alignment."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPREAD, boxed, checkpoint, counted, lookup, release, small_or_spread, table, unboxed
from .registry import corpus_query

#: Words of a run, runs kept by a sketch, sketches of a text, least similarity (1 - edits / longer length, in words).
RUN, KEPT, SKETCHES, LEAST = 3, 2, 48, 0.8
#: Texts of at most SHORT words are sketched by runs of two, longer ones by runs of three; up to BOTH words, which a text similar to a short one may have, by both.
#: BOTH holds for any least similarity of LEAST or more.
SHORT, SHORT_RUN, BOTH = 64, 2, 80
#: Texts of fewer words are similar only if their words are equal: one edit is more than a fifth.
TINY = 5
#: In buckets of up to this many texts all pairs are compared; in larger ones each with a few of its buckets' centres, then texts of different classes.
SMALL_BUCKET, CENTRES = 4, 4
#: Texts of a large bucket that are compared at once with as many others, and fewest and most counters of a text's words for it.
BLOCK, BINS, MOST_BINS = 1024, 128, 4096
#: Word hashes a task remembers before it starts anew, and words of the texts that are sketched at once.
REMEMBERED, AT_ONCE = 1 << 18, 1 << 16
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64-bit numbers over all of them."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def run_hashes(tokens: np.ndarray, run: int) -> np.ndarray:
    """Hash of each run of ``run`` consecutive words."""
    out = np.zeros(max(0, len(tokens) - run + 1), dtype=np.uint64)
    for k in range(run):
        out = mix(out * _ODD + tokens[k : k + len(out)])
    return out


def labelled(runs: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Hash of each run together with how often it occurred before in its text (``text``: the text's number, ascending)."""
    order = np.lexsort((runs, text))
    ranked, owner = runs[order], text[order]
    place = np.arange(len(runs))
    fresh = np.r_[True, (ranked[1:] != ranked[:-1]) | (owner[1:] != owner[:-1])]
    seen = place - np.maximum.accumulate(np.where(fresh, place, 0))
    out = np.empty_like(runs)
    out[order] = mix(ranked + seen.astype(np.uint64) * _ODD)
    return out


def order_sketches(tokens: np.ndarray, lengths: np.ndarray, run: int, sketches: int = SKETCHES) -> np.ndarray:
    """A row per text (the next ``lengths`` of the ``tokens``, at least run + 1 each) and a column per random order: the hash,
    in text order, of the two labelled runs that come first in it.

    The runs of all texts lie in one array. An order multiplies their hashes by an odd number; the lowest bits give
    way to the run's place, so that the least number of a text's stretch says where it stands as well.
    """
    n = lengths - run + 1
    first = np.r_[0, np.cumsum(n)[:-1]]
    text = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(text)) - first[text]
    at = place + (np.r_[0, np.cumsum(lengths)[:-1]])[text]
    runs = run_hashes(tokens, run)[at]
    marks = labelled(runs, text)
    low = np.uint64(1 << int(place.max()).bit_length()) - np.uint64(1)
    place, high = place.astype(np.uint64), ~low
    out = np.empty((len(n), sketches), dtype=np.uint64)
    seeds = mix(np.arange(1, sketches + 1, dtype=np.uint64) * _ODD + np.uint64(run))
    for k, (seed, start) in enumerate(zip(seeds, seeds * _ODD, strict=True)):
        drawn = marks * (seed | np.uint64(1))
        drawn &= high
        drawn |= place
        one = (np.minimum.reduceat(drawn, first) & low).astype(np.int64) + first
        drawn[one] = ~np.uint64(0)
        two = (np.minimum.reduceat(drawn, first) & low).astype(np.int64) + first
        hashed = mix(start + runs[np.minimum(one, two)])
        out[:, k] = mix(hashed * _ODD + runs[np.maximum(one, two)])
    return out


def sketches_of(texts: list[np.ndarray]) -> list[np.ndarray]:
    """All sketches of each text's word hashes: by short runs, then by longer ones, in the order of their seeds."""
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    own: list[list[np.ndarray]] = [[] for _ in texts]
    for run, fits in ((SHORT_RUN, (lengths >= TINY) & (lengths <= BOTH)), (RUN, lengths > SHORT)):
        chosen = np.flatnonzero(fits)
        if len(chosen):
            for i, found in zip(chosen, order_sketches(np.concatenate([texts[i] for i in chosen]), lengths[chosen], run), strict=True):
                own[i].append(found)
    for i in np.flatnonzero(lengths < TINY):
        n = len(texts[i])
        own[i].append(mix(run_hashes(np.r_[texts[i], np.uint64(n)], n + 1)))
    return [np.concatenate(x) for x in own]


def word_counts(tokens: np.ndarray) -> bytes:
    """How many words, up to 255, fall into each of some counters, about as many as there are words."""
    size = min(MOST_BINS, max(BINS, 1 << max(0, len(tokens) - 1).bit_length()))
    return np.minimum(np.bincount((tokens % np.uint64(size)).astype(np.int64), minlength=size), 255).astype(np.uint8).tobytes()


def folded(counts: list[bytes], size: int) -> np.ndarray:
    """A row of ``size`` counters per text, up to 255 each, from those of ``word_counts``: the same as if these had been as few."""
    out, lengths = np.zeros((len(counts), size), dtype=np.int16), np.array([len(x) for x in counts])
    for length in np.unique(lengths):
        at = np.flatnonzero(lengths == length)
        own = np.frombuffer(b"".join([counts[i] for i in at]), dtype=np.uint8).reshape(len(at), -1, size)
        out[at] = np.minimum(own.sum(1, dtype=np.int32), 255)
    return out


def sketched(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> doc_id, node (digest of the text, null for a null text), n_words, bins (word_counts), sketches.

    A text of fewer than five words is one run: a single edit in it is already more than a
    fifth of the text, so only those of equal words are similar.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remembered: dict[str, int] = {}
        for batch in batches:
            counts, bins, found, waiting, held = [], [], [], [], 0
            for text in batch.column("text").to_pylist():
                words = [] if text is None else text.split()
                counts.append(len(words))
                if text is None:
                    bins.append(None)
                    continue
                if len(remembered) > REMEMBERED:
                    remembered.clear()
                for word in set(words).difference(remembered):
                    remembered[word] = xxhash.xxh64_intdigest(word)
                tokens = np.fromiter(map(remembered.__getitem__, words), dtype=np.uint64, count=len(words))
                bins.append(word_counts(tokens))
                waiting.append(tokens)
                held += len(tokens)
                if held > AT_ONCE:
                    found += sketches_of(waiting)
                    waiting, held = [], 0
            each = iter(found + sketches_of(waiting))
            found = [[] if b is None else next(each).view(np.int64) for b in bins]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("node"), pa.array(counts, pa.int64()), pa.array(bins, pa.binary()), pa.array(found, pa.list_(pa.int64()))],
                ["doc_id", "node", "n_words", "bins", "sketches"],
            )

    asked = docs.select("doc_id", "text", node_of("text").alias("node"))
    kind = asked.schema["doc_id"].dataType.simpleString()
    return asked.mapInArrow(work, f"doc_id {kind}, node binary, n_words long, bins binary, sketches array<long>")


def node_of(text: str) -> Column:
    """The key of a text: 128 bits of digest."""
    return F.unhex(F.md5(F.col(text)))


def brief(node: str) -> Column:
    """A short form of a node for candidates; where two nodes share it, both are compared."""
    return F.xxhash64(F.col(node))


def buckets(texts: DataFrame) -> DataFrame:
    """A row (sketch, id, n, low, size) for each text (brief node id, n words) of a sketch that others have too.

    ``low`` is the least text of the bucket. Buckets are counted over pieces first; no task holds one.
    """
    who = F.struct("id", "n")
    rows = texts.select(brief("node").alias("id"), F.col("n_words").cast("int").alias("n"), F.explode("sketches").alias("sketch")).withColumn("piece", F.pmod("id", F.lit(SPREAD)).cast("int"))
    pieces = rows.groupBy("sketch", "piece").agg(F.min(who).alias("near"), F.count("*").cast("int").alias("here"))
    same = Window.partitionBy("sketch")
    whole = pieces.select("sketch", "piece", F.min("near").over(same).alias("low"), F.sum("here").over(same).alias("size")).where("size > 1")
    return rows.join(whole, ["sketch", "piece"]).drop("piece")


def candidates(members: DataFrame, least: float = LEAST) -> DataFrame:
    """Pairs (a, b) of brief nodes that share a bucket and whose lengths allow the similarity.

    A small bucket gives all its pairs. In large ones a text is paired with the least texts of its buckets, the
    CENTRES lowest of them, so a family of any size gives at most so many pairs for each of its texts; most of
    its texts have the same few centres. ``across`` finds what these pairs leave.
    """
    who = F.struct("id", "n")
    small = members.where(F.col("size") <= SMALL_BUCKET).groupBy("sketch").agg(F.collect_list(who).alias("all"))
    one = small.select(F.explode("all").alias("x"), "all")
    within = one.select("x", F.explode(F.filter("all", lambda y: y["id"] > F.col("x.id"))).alias("y"))
    large = members.where((F.col("size") > SMALL_BUCKET) & (F.col("low.id") != F.col("id"))).groupBy(who.alias("y")).agg(F.collect_set("low").alias("lows"))
    large = large.select(F.explode(F.slice(F.array_sort("lows"), 1, CENTRES)).alias("x"), "y")
    fits = F.least("x.n", "y.n") >= F.greatest("x.n", "y.n") * F.lit(least)
    return within.unionByName(large).where(fits).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()


def across(members: DataFrame, kins: DataFrame, counters: DataFrame, least: float = LEAST) -> DataFrame:
    """Pairs (a, b) of brief nodes that share a large bucket, are in different classes so far and may be similar.

    ``kins`` has (id, kin: hash of the class), ``counters`` (id, bins, sketches). Every pair of a large bucket is
    looked at, in blocks of BLOCK by BLOCK texts, unless both are in one class already or their lengths are too
    far apart: a text stands under its band of lengths and, if the bucket has texts there, under the next, as
    similar ones are at most one band apart. Texts that meet no other class are gone before counters are
    looked up, once per text. A pair is left out only where the counts of words prove too many edits, and comes from
    the bucket of its first common sketch only; if that is a small one, its pairs were compared before.
    """
    width = math.log(1 / least) * 1.0001 if least < 0.99 else 0.01
    band = F.floor(F.log(F.greatest("n", F.lit(1)).cast("double")) / F.lit(width)).cast("int")
    each = members.where(F.col("size") > SMALL_BUCKET).groupBy("id", "n").agg(F.collect_set("sketch").alias("of")).join(kins, "id")
    rows = each.select("id", "n", "kin", band.alias("band"), F.pmod("id", F.lit(SPREAD)).cast("int").alias("piece"), F.explode("of").alias("sketch"))
    pieces = rows.groupBy("sketch", "band", "piece").agg(F.min("kin").alias("low"), F.max("kin").alias("high"), F.count("*").alias("here"))
    same = Window.partitionBy("sketch", "at")
    whole = pieces.select("*", F.explode(F.array(F.col("band"), F.col("band") + 1)).alias("at")).select(
        "sketch", "band", "piece", "at", F.min("low").over(same).alias("low"), F.max("high").over(same).alias("high"), F.max(F.col("band") == F.col("at")).over(same).alias("own"), F.ceil(F.sum("here").over(same) / BLOCK).cast("int").alias("blocks")
    )
    asked = whole.where("own AND low != high").groupBy("sketch", "band", "piece").agg(F.collect_list(F.struct("at", "blocks")).alias("stands"))
    mixed = rows.join(asked, ["sketch", "band", "piece"]).groupBy("id", "kin").agg(F.collect_list(F.struct("sketch", "band", "n", "stands")).alias("of")).join(counters, "id")
    stands = mixed.select("id", "kin", "bins", "sketches", F.explode("of").alias("x")).select("id", "kin", "bins", "sketches", "x.sketch", "x.band", "x.n", F.explode("x.stands").alias("x"))
    stands = stands.select("sketch", "x.at", "x.blocks", "id", "n", "kin", "bins", "sketches", (F.col("band") == F.col("x.at")).alias("here"))
    cells = stands.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = cells.select("sketch", "at", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "id", "n", "kin", "bins", "sketches", "here", "block")

    def work(cell: pa.Table) -> pa.Table:
        ids, n, kin, here, block = (cell.column(c).to_numpy() for c in ("id", "n", "kin", "here", "block"))
        own = cell.column("bins").to_pylist()
        counts = [folded(own, BINS), folded(own, min(map(len, own)))]  # few counters first, all of them for what is left

        def possible(x: int, y: np.ndarray, longest: np.ndarray, counted: np.ndarray) -> np.ndarray:
            gap = counted[y] - counted[x]
            edits = (np.abs(gap).sum(1, dtype=np.int64) + np.abs(gap.sum(1, dtype=np.int64))) // 2  # the larger of words only here and only there
            return edits <= np.floor(longest * (1 - least) + 1e-9)

        i, j, sketch = (cell.column(c)[0].as_py() for c in ("i", "j", "sketch"))
        held = [np.array(x, dtype=np.int64) for x in cell.column("sketches").to_pylist()]
        sketches = np.zeros((len(held), 2 * SKETCHES), dtype=np.int64)  # by random order: those of short runs, then the others
        for row, own_sketches, words in zip(sketches, held, n, strict=True):
            row[SKETCHES * int(words > BOTH) :][: len(own_sketches)] = own_sketches
        second, left, right = np.flatnonzero(block == j), [], []
        for place, x in enumerate(np.flatnonzero(block == i)):
            y = second[place + 1 :] if i == j else second
            y = y[(kin[y] != kin[x]) & (here[y] | here[x])]
            longest = np.maximum(n[y], n[x])
            y, longest = (v[np.minimum(n[y], n[x]) >= longest * least] for v in (y, longest))
            for k, some in enumerate(counts):
                fits = possible(x, y, longest, some)
                y, longest = y[fits], longest[fits]
                if k == 0 and len(y):
                    used = np.flatnonzero(sketches[x])
                    first = sketches[x, used][(sketches[y][:, used] == sketches[x, used]).argmax(1)]
                    y, longest = y[first == sketch], longest[first == sketch]
            left.append(np.minimum(ids[x], ids[y]))
            right.append(np.maximum(ids[x], ids[y]))
        empty = np.empty(0, dtype=np.int64)
        return pa.table({"a": np.concatenate([empty, *left]), "b": np.concatenate([empty, *right])})

    return cells.groupBy("sketch", "at", "i", "j").applyInArrow(work, "a long, b long").distinct()


def banded_distance(a: list[str], b: list[str], most: int) -> int:
    """Edits in words from ``a`` to ``b``, or most + 1 if there are more than ``most``.

    Only cells within ``most`` of the diagonal are kept: a column of the band is a number whose
    bits say where the distance rises or falls from row to row, and the band moves down a row
    with each word of ``b``.
    """
    if abs(len(a) - len(b)) > most:
        return most + 1
    start = 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        start += 1
    end = 0
    while end < min(len(a), len(b)) - start and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[start : len(a) - end], b[start : len(b) - end]
    if not a or not b:
        return min(max(len(a), len(b)), most + 1)
    reach = min(most, max(len(a), len(b)))
    where: dict[str, int] = {}
    for i, word in enumerate(a):
        where[word] = where.get(word, 0) | 1 << i
    band, top = 2 * reach + 1, 2 * reach
    full = (1 << band) - 1
    rising, falling = (full >> reach) << reach, 0
    rows, distance = len(a), min(len(a), reach)
    for j in range(1, len(b) + 1):
        at, same = j - reach - 1, where.get(b[j - 1], 0)
        same = (same >> at if at >= 0 else same << -at) & full
        level = ((((same & rising) + rising) ^ rising) | same | falling) & full
        right_up, right_down = falling | (full & ~(level | rising)), level & rising
        if j + reach <= rows:  # the band's last row goes along a diagonal until it is the last row of all
            distance += not level >> top
        else:
            bit = rows - j + reach
            distance += (right_up >> bit & 1) - (right_down >> bit & 1)
        down = level >> 1
        rising, falling = right_down | (full & ~(down | right_up)), down & right_up
    return distance if distance <= most else most + 1


def similar(a: str, b: str, least: float = LEAST) -> bool:
    """Whether two texts differ by at most 1 - ``least`` of the longer one's words."""
    a, b = a.split(), b.split()
    longest = max(len(a), len(b))
    most = int(longest * (1 - least) + 1e-9)
    common = sum((Counter(a) & Counter(b)).values())
    return longest - common <= most and banded_distance(a, b, most) <= most


def verified(pairs: DataFrame, texts: DataFrame, least: float = LEAST) -> DataFrame:
    """Links (a, b) of nodes: the pairs of brief nodes whose texts (node, packed) are similar.

    A centre stands in ``a`` of as many pairs as its bucket has texts, so the first text is
    looked up over pieces; ``b`` stands in a few pairs for each of its sketches.
    """
    named = lambda n: texts.select(brief("node").alias(n), F.col("node").alias(f"node_{n}"), F.col("packed").alias(f"packed_{n}"))
    both = lookup(pairs.join(named("b"), "b"), named("a"), ["a"], ["b"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            keep = [
                similar(unpack(x.as_buffer()).decode(), unpack(y.as_buffer()).decode(), least)
                for x, y in zip(batch.column("packed_a"), batch.column("packed_b"), strict=True)
            ]
            found = batch.select(["node_a", "node_b"]).filter(pa.array(keep, pa.bool_()))
            yield found.rename_columns(["a", "b"])

    return both.select("node_a", "node_b", "packed_a", "packed_b").mapInArrow(work, "a binary, b binary")


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b); the root is some node of its component.

    In each round every node hooks onto that neighbour which a hash drawn anew puts first, or stays
    if it comes first itself; the links move to what their ends hooked onto, and links within one
    node go. A component loses a share of its nodes in every round, whatever its shape. Then the
    hooks are followed back.
    """
    hooks, (left, rows) = [], counted(links.select("a", "b").where("a != b").distinct())
    while rows:
        place = lambda n, number=len(hooks): F.struct(F.xxhash64(F.lit(number), n).alias("drawn"), F.col(n).alias("node"))
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = both.groupBy("a").agg(F.min(place("b")).alias("to"))
        hook, nodes = counted(first.select(F.col("a").alias("node"), F.least("to", place("a"))["node"].alias("to")))
        hooks.append((hook, nodes))
        as_of = lambda n, hook=hook: hook.select(F.col("node").alias(n), F.col("to").alias(f"to_{n}"))
        moved = small_or_spread(small_or_spread(left, as_of("a"), ["a"], ["b"], rows=nodes), as_of("b"), ["b"], ["a"], rows=nodes)
        before = left
        left, rows = counted(moved.select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).where("a != b").distinct())
        release(before)
    release(left)
    if not hooks:
        return links.select(F.col("a").alias("node"), F.col("a").alias("root")).limit(0)
    roots, nodes = hooks.pop()
    while hooks:
        (first, rows), later = hooks.pop(), roots
        followed = small_or_spread(first, later.select(F.col("node").alias("to"), F.col("to").alias("root")), ["to"], ["node"], "left", rows=nodes)
        roots, nodes = checkpoint(followed.select("node", F.coalesce("root", "to").alias("to"))), rows
        release(first, later)
    return roots.select("node", F.col("to").alias("root"))


def near_duplicates(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """(doc_id, text) -> one row per row: doc_id, node, root (of its class), class_id (least doc_id of its class) and
    links (similar pairs of different texts in which its text was found).

    Equal texts are one node; nodes join when a shared sketch and an alignment say that their
    edit distance in words is at most a fifth of the longer text; classes are the connected
    nodes. A null text is in a class of its own (node null, class_id its doc_id); texts without
    words are similar to each other. Rows that repeat an id are rows like others; a class
    without any id has a null class_id. Other columns are not read.
    """
    every = docs.select("doc_id", node_of("text").alias("node"))
    nodes = sketched(docs).where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("first_id"), F.first("n_words").alias("n_words"), F.first("bins").alias("bins"), F.first("sketches").alias("sketches"))
    nodes = checkpoint(nodes)

    def linked(pairs: DataFrame) -> DataFrame:
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct().join(nodes.select("node", "first_id", brief("node").alias("id")), "id")
        texts = checkpoint(texts_of(docs, wanted))
        found = checkpoint(verified(pairs, texts, least))
        release(pairs, texts)
        return found

    members = checkpoint(buckets(nodes))
    links = linked(checkpoint(candidates(members, least)))
    roots = components(links)
    kins = nodes.select("node").join(roots, "node", "left").select(brief("node").alias("id"), F.xxhash64(F.coalesce("root", "node")).alias("kin"))
    further, rows = counted(across(members, kins, nodes.select(brief("node").alias("id"), "bins", "sketches"), least))
    release(members)
    if rows:
        more, at = linked(further), roots.select("node", "root")
        for n in "ab":  # what the new links join are classes
            more = lookup(more, at.select(F.col("node").alias(n), F.col("root").alias(f"root_{n}")), [n], ["b" if n == "a" else "a"], "left")
        more = checkpoint(more)
        joined = components(more.select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))).withColumnRenamed("root", "of_all")
        alone = joined.select("node", F.col("node").alias("root")).join(roots, "node", "left_anti")
        over = lookup(roots.unionByName(alone), joined.withColumnRenamed("node", "root"), ["root"], ["node"], "left")
        roots = checkpoint(over.select("node", F.coalesce("of_all", "root").alias("root")))
        links = links.unionByName(more.select("a", "b"))
    rooted = nodes.select("node", "first_id").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least_id = rooted.groupBy("root").agg(F.min("first_id").alias("class_id"))
    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("links"))
    classed = lookup(rooted.select("node", "root"), least_id, ["root"], ["node"]).select("node", "root", "class_id").join(degree, "node", "left")
    found = lookup(every, classed, ["node"], ["doc_id"], "left")
    alone = F.col("node").isNull()
    return found.select("doc_id", "node", "root", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("links"))


def texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, packed) for the wanted nodes, each from the document of its first_id; copies stay behind.

    Texts are compressed where they are read, for they move several times before they are compared.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            packed = pa.array([None if t is None else pack(t.encode()) for t in batch.column("text").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("first_id"), batch.column("node"), packed], ["first_id", "node", "packed"])

    asked = docs.select(F.col("doc_id").alias("first_id"), node_of("text").alias("node"), "text")
    packed = asked.mapInArrow(work, f"first_id {asked.schema['first_id'].dataType.simpleString()}, node binary, packed binary")
    same = (packed["node"] == wanted["node"]) & packed["first_id"].eqNullSafe(wanted["first_id"])
    return packed.join(wanted, same, "left_semi").groupBy("node").agg(F.first("packed").alias("packed"))


def one_of_each(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """The documents, all columns, less those whose class has another: the row of least doc_id stays,
    among rows of that id the one of least digest, of rows equal in both one.

    Null texts have no class and all stay. A class without any id keeps one row.
    """
    found = near_duplicates(docs, least)
    classed = found.where("node IS NOT NULL").select("class_id", "root", "doc_id", "node")
    stays = classed.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "node")).alias("x")).select("x.doc_id", "x.node")
    named = boxed(docs, "doc_id", node_of("text").alias("node"))
    same = (named["node"] == stays["node"]) & named["doc_id"].eqNullSafe(stays["doc_id"])
    kept = named.join(stays, same, "left_semi")
    once = kept.withColumn("at", F.row_number().over(Window.partitionBy("doc_id", "node").orderBy("node"))).where("at = 1")
    return once.select(*unboxed(docs.columns)).unionByName(docs.where("text IS NULL"))


@corpus_query("op2_minhash")
def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "class_id", "links")

"""Phrase collocations by SON: shards are mined completely at lowered support, the union of what they find is counted exactly."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpoint, counted, release, small_or_spread, table
from .registry import corpus_query

#: Longest phrase in words, fewest occurrences of a phrase, phrases reported per language.
LONGEST, SUPPORT, TOP = 5, 100, 2000
#: Shards of the table; words of a stored stretch of one language, words whose phrases a task counts at once, and different
#: words or phrases that it counts before it hands them on.
SHARDS, STRETCH, AT_ONCE, COUNTED = 16, 1 << 16, 1 << 19, 1 << 17
#: Bits of the filter for each candidate, and its smallest and largest size in bits (a power of two). A filter that is too small lets more
#: phrases through to the exact counts; it loses none.
BITS, LEAST_BITS, MOST_BITS = 64, 1 << 20, 1 << 27
_ODD = np.uint64(0x9E3779B97F4A7C15)
_UPPER, _LOWER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"
_ENDS = b".,;:!?\x0A\x0B\x0C\x0D"
_PLAIN = bytes.maketrans(_UPPER + _ENDS, _LOWER + b"\n" * len(_ENDS))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def words_of(text: bytes) -> list[bytes]:
    """The words of a text, A to Z in lower case, with an empty one after each piece."""
    out: list[bytes] = []
    for piece in text.translate(_PLAIN).split(b"\n"):
        if words := piece.split():  # of bytes without line ends: splits at blanks and tabs only
            out += words
            out.append(b"")
    return out


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, str]]:
    """(text, lang) of each row, a few texts at a time, so that a batch is not in memory twice."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            yield from zip(part.column("text").to_pylist(), part.column("lang").to_pylist(), strict=True)


class Numbers(dict):
    """A number of 32 bits for each word, and 0 for the empty one. Words that share one only let more candidates through to the exact counts."""

    def __missing__(self, word: bytes) -> int:
        number = self[word] = xxhash.xxh32_intdigest(word) | 1 if word else 0
        return number

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > COUNTED:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def seed_of(lang: str) -> np.uint64:
    return np.uint64(xxhash.xxh64_intdigest(lang.encode(), 1))


def run_hashes(tokens: np.ndarray, lang: str, longest: int = LONGEST) -> Iterator[np.ndarray]:
    """For 1, 2, ... words: the hash of the phrase that begins at each place, 0 where a piece ends before it does."""
    out = np.full(len(tokens), seed_of(lang))
    for k in range(longest):
        ahead = tokens[k:]
        out = out[: len(ahead)]
        inside = (ahead != 0) & (out != 0)
        out = np.where(inside, mixed(out * _ODD + ahead) | np.uint64(1), np.uint64(0))
        yield out


#: Lowest bits of a hash that are not stored; phrases that then look equal only let more candidates through to the exact counts.
UNSTORED = np.uint64(24)
#: Where in a stored hash the places of its two bits begin.
PROBES = (0, 13)


def stored(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> UNSTORED).view(np.int64)


class Known:
    """A filter of phrases: two bits each at places that their hash gives."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.low = bits, np.uint64(len(bits) * 64 - 1)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        found, hashes = np.ones(len(hashes), dtype=bool), hashes >> UNSTORED
        for shift in PROBES:
            at = (hashes >> np.uint64(shift)) & self.low
            found &= (self.bits[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) != 0
        return found


def known(found: DataFrame, rows: int) -> Known:
    """The filter of the phrases' hashes (``h``), its words gathered over the table; at most MOST_BITS whatever the table."""
    size = LEAST_BITS
    while size < min(MOST_BITS, rows * BITS):
        size *= 2
    at = F.col("place")
    places = found.select(F.explode(F.array(*[F.shiftrightunsigned("h", shift).bitwiseAND(F.lit(size - 1)) for shift in PROBES])).alias("place"))
    words = places.select(F.shiftright(at, 6).alias("at"), F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(63).cast("int")).alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bits"))
    got, bits = words.toArrow(), np.zeros(size // 64, dtype=np.uint64)
    bits[got.column("at").to_numpy()] = got.column("bits").to_numpy().view(np.uint64)
    return Known(bits)


def encoded(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(text, lang) -> rows of two kinds: stretches of a language (lang, shard, words, tokens: packed numbers of words) and counts of
    a word in a task (lang, word, h, count). A stretch ends with a text; those of a task are of one shard."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = Numbers()
        counts: dict[str, Counter] = defaultdict(Counter)
        held: dict[str, list[np.ndarray]] = defaultdict(list)
        size: Counter = Counter()
        shard = TaskContext.get().partitionId() % shards

        def stretch(lang: str) -> pa.RecordBatch:
            tokens = np.concatenate(held.pop(lang))
            size.pop(lang)
            return batch_of(lang=[lang], shard=[shard], words=[int((tokens != 0).sum())], tokens=[tokens.astype(np.uint32).tobytes()], word=[None], h=[None], count=[None])

        def counted_words() -> Iterator[pa.RecordBatch]:
            for lang, own in counts.items():
                own.pop(b"", None)
                hashes, none = stored(next(run_hashes(numbers.of(list(own)), lang, 1))), [None] * len(own)
                yield batch_of(lang=[lang] * len(own), shard=none, words=none, tokens=none, word=[w.decode(errors="replace") for w in own], h=hashes, count=list(own.values()))
            counts.clear()

        for text, lang in rows_of(batches):
            if not (words := words_of(text)):
                continue
            counts[lang].update(words)
            held[lang].append(numbers.of(words))
            size[lang] += len(words)
            if size[lang] > STRETCH:
                yield stretch(lang)
            if sum(map(len, counts.values())) > COUNTED:
                yield from counted_words()
        for lang in list(held):
            yield stretch(lang)
        yield from counted_words()

    asked = docs.select(F.coalesce("text", F.lit("")).cast("binary").alias("text"), F.coalesce("lang", F.lit("und")).alias("lang"))
    return asked.mapInArrow(work, "lang string, shard long, words long, tokens binary, word string, h long, count long")


_KINDS = {"lang": pa.string(), "words": pa.int64(), "tokens": pa.binary(), "word": pa.string(), "h": pa.int64(), "count": pa.int64(), "shard": pa.int64(), "phrase": pa.string()}


def batch_of(**columns: object) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v, _KINDS[k]) for k, v in columns.items()], list(columns))


def counts_of_shards(stretches: DataFrame, filters: list[Known], chosen: Known | None = None) -> DataFrame:
    """Phrases of len(filters) + 1 words with their counts in some stretches of a shard: lang, shard, h, count.

    Only phrases are tried whose two parts of one word less passed the ``filters`` of the rounds before, and of these only the ``chosen``, if given.
    """
    k = len(filters) + 1

    def counted_in(lang: str, shard: int, parts: list[np.ndarray]) -> pa.RecordBatch:
        tokens, before = np.concatenate(parts).astype(np.uint64), None
        for size, hashes in enumerate(run_hashes(tokens, lang, k), 1):
            if size == k:
                own = hashes[(hashes != 0) & before[: len(hashes)] & before[1 : len(hashes) + 1]]
            else:
                fits = (hashes != 0) & filters[size - 1].has(hashes)
                before = fits if before is None else fits & before[: len(fits)] & before[1 : len(fits) + 1]
        found, count = np.unique(stored(own if chosen is None else own[chosen.has(own)]), return_counts=True)
        return batch_of(lang=pa.repeat(lang, len(found)), shard=np.full(len(found), shard), h=found, count=count)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], list[np.ndarray]] = defaultdict(list)
        size: Counter = Counter()
        for batch in batches:
            for i in range(batch.num_rows):
                key = batch.column("lang")[i].as_py(), batch.column("shard")[i].as_py()
                held[key].append(np.frombuffer(batch.column("tokens")[i].as_buffer(), dtype=np.uint32).copy())
                size[key] += len(held[key][-1])
                if size[key] > AT_ONCE:
                    yield counted_in(*key, held.pop(key))
                    size.pop(key)
        for key, parts in held.items():
            yield counted_in(*key, parts)

    return stretches.select("lang", "shard", "tokens").mapInArrow(work, "lang string, shard long, h long, count long")


def limits_of(stretches: DataFrame, totals: DataFrame, support: int) -> DataFrame:
    """(lang, shard, least): a shard with w of the language's n words reports what it has at least ``support`` * w / n times, rounded up.

    A phrase that no shard reports then has fewer than ``support`` in all.
    """
    words = stretches.groupBy("lang", "shard").agg(F.sum("words").alias("words")).join(totals, "lang")
    return words.select("lang", "shard", F.greatest(F.call_function("div", F.col("words") * F.lit(support) + F.col("n") - 1, F.col("n")), F.lit(1)).cast("long").alias("least"))


def reported(counts: DataFrame, limits: DataFrame) -> DataFrame:
    """(lang, h, spare) of the phrases that a shard has often enough; ``spare``: how far beyond what it might have kept back."""
    sums = counts.groupBy("lang", "shard", "h").agg(F.sum("count").alias("count"))
    return small_or_spread(sums, limits, ["lang", "shard"], ["h"]).where("count >= least").select("lang", "h", (F.col("count") - F.col("least") + 1).alias("spare"))


def candidates(reports: DataFrame, kept_back: DataFrame, support: int) -> DataFrame:
    """(lang, h) that may be frequent: what shards reported and what all may have kept back (lang, most) reach the support."""
    sums = reports.groupBy("lang", "h").agg(F.sum("spare").alias("sure"))
    return small_or_spread(sums, kept_back, ["lang"], ["h"]).where(F.col("sure") + F.col("most") >= support).select("lang", "h")


def exact_counts(docs: DataFrame, filters: list[Known]) -> DataFrame:
    """(lang, phrase, f) of all phrases that pass the filters of their length, counted by their words in the texts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = Numbers()
        counts: dict[str, Counter] = defaultdict(Counter)
        held: dict[str, list[bytes]] = defaultdict(list)

        def count(lang: str) -> None:
            words = held.pop(lang)
            before = None
            for k, hashes in enumerate(run_hashes(numbers.of(words), lang, len(filters)), 1):
                fits = (hashes != 0) & filters[k - 1].has(hashes)
                before = fits if before is None else fits & before[: len(fits)] & before[1 : len(fits) + 1]
                if k > 1:
                    counts[lang].update(b" ".join(words[at : at + k]) for at in np.flatnonzero(before).tolist())

        for text, lang in rows_of(batches):
            held[lang] += words_of(text)
            if len(held[lang]) > STRETCH:
                count(lang)
            if sum(map(len, counts.values())) > COUNTED:
                yield from handed_on(counts)
        for lang in list(held):
            count(lang)
        yield from handed_on(counts)

    def handed_on(counts: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
        for lang, own in counts.items():
            yield batch_of(lang=[lang] * len(own), phrase=[p.decode(errors="replace") for p in own], count=list(own.values()))
        counts.clear()

    asked = docs.select(F.coalesce("text", F.lit("")).cast("binary").alias("text"), F.coalesce("lang", F.lit("und")).alias("lang"))
    return asked.mapInArrow(work, "lang string, phrase string, count long").groupBy("lang", "phrase").agg(F.sum("count").alias("f"))


def frequent_phrases(docs: DataFrame, support: int = SUPPORT, longest: int = LONGEST, shards: int = SHARDS) -> tuple[DataFrame, DataFrame]:
    """(text, lang) -> the phrases of 1 to ``longest`` words with at least ``support`` occurrences (lang, phrase, f), and (lang, n) of all words.

    Words are counted by themselves. For each further length the shards are mined; the union of what they report,
    less what cannot reach the support, is counted over all shards by its hashes, and what has the support passes on as a filter.
    Then one pass over the texts counts all candidates by their words, so that neither equal hashes nor a full filter change a result.
    """
    coded = checkpoint(encoded(docs, shards))
    stretches = coded.where("tokens IS NOT NULL")
    words = checkpoint(coded.where("word IS NOT NULL").groupBy("lang", "word", "h").agg(F.sum("count").alias("f")))
    totals = checkpoint(words.groupBy("lang").agg(F.sum("f").alias("n")))
    limits = checkpoint(limits_of(stretches, totals, support))
    kept_back = checkpoint(limits.groupBy("lang").agg(F.sum(F.col("least") - 1).alias("most")))
    common, rows = counted(words.where(F.col("f") >= support))
    release(words)
    filters, frames = [known(common, rows)], []
    for _ in range(2, longest + 1):
        found, rows = counted(candidates(reported(counts_of_shards(stretches, filters), limits), kept_back, support))
        union = known(found, rows)
        release(found)
        if rows:
            sums = counts_of_shards(stretches, filters, union).groupBy("lang", "h").agg(F.sum("count").alias("f"))
            found, rows = counted(sums.where(F.col("f") >= support).select("lang", "h"))
            union = known(found, rows)
            release(found)
        filters.append(union)
        if not rows:
            break
    release(coded)
    frames = common.select("lang", F.col("word").alias("phrase"), "f")
    if len(filters) > 1:
        frames = frames.unionByName(exact_counts(docs, filters).where(F.col("f") >= support))
    out = checkpoint(frames)
    release(common)
    return out, totals


def collocations(docs: DataFrame, support: int = SUPPORT, longest: int = LONGEST, top: int = TOP, shards: int = SHARDS) -> DataFrame:
    """(text, lang) -> the first ``top`` collocations per language: lang, rank, phrase, a, l, r, n, score.

    Texts in lower case (A to Z only) are cut at sentence marks and line ends, the pieces into words at blanks and tabs; a null
    text is empty, a null lang ``und``. Candidates are phrases of 2 to ``longest`` words with a = f(phrase) >= ``support``. The
    cut into two parts that scores lowest counts, the earlier of equal ones: floor(1000 * a * n / (l * r)), l and r the parts'
    counts, in whole numbers of 38 digits. A candidate within a longer one that is as frequent goes. Repeated rows
    count each time; other columns are not read.
    """
    phrases, totals = frequent_phrases(docs, support, longest, shards)
    split = phrases.withColumn("w", F.split("phrase", " ")).where(F.size("w") > 1)
    cuts = split.select("lang", "phrase", F.col("f").alias("a"), "w", F.explode(F.expr("sequence(1, size(w) - 1)")).alias("k"))
    part = lambda value, name, to: value.select("lang", F.col("phrase").alias(to), F.col("f").alias(name))
    both = cuts.select("lang", "phrase", "a", "k", F.array_join(F.expr("slice(w, 1, k)"), " ").alias("left"), F.array_join(F.expr("slice(w, k + 1, size(w))"), " ").alias("right"))
    both = both.join(part(phrases, "l", "left"), ["lang", "left"]).join(part(phrases, "r", "right"), ["lang", "right"])
    scored = small_or_spread(both, totals, ["lang"], ["phrase", "k"]).withColumn("score", F.expr("cast(1000 * cast(a AS decimal(38,0)) * n AS decimal(38,0)) div cast(cast(l AS decimal(38,0)) * r AS decimal(38,0))"))
    lowest = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("x")).select("lang", "phrase", "a", "x.l", "x.r", "n", "x.score")
    inner = split.select("lang", F.col("f").alias("longer"), F.explode(F.expr(
        "array_distinct(flatten(transform(sequence(2, greatest(size(w) - 1, 2)), s -> transform(sequence(1, greatest(size(w) - s + 1, 1)), i -> array_join(slice(w, i, s), ' ')))))"
    )).alias("phrase"), F.size("w").alias("words")).where("words > size(split(phrase, ' '))")
    held = inner.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    stays = lowest.join(held, ["lang", "phrase"], "left").where("longer IS NULL OR longer < a")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return stays.withColumn("rank", rank).where(F.col("rank") <= top).withColumn("rank", F.col("rank").cast("long")).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _sql(support: int = SUPPORT, top: int = TOP) -> str:
    return rf"""
WITH cut AS (SELECT coalesce(lang, 'und') AS lang, regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER.decode()}', '{_LOWER.decode()}'), '[.,;:!?\x0A-\x0D]') AS parts FROM documents),
pieces AS (SELECT lang, regexp_extract_all(unnest(parts), '[^\x20\x09]+') AS w FROM cut),
runs AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM pieces),
phrases AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f FROM runs, range(1, 6) s(k) WHERE i + k - 1 <= len(w) GROUP BY ALL),
totals AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM phrases WHERE k = 1 GROUP BY lang),
found AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM phrases WHERE f >= {support}),
cuts AS (SELECT *, unnest(range(1, k)) AS p FROM found WHERE k > 1),
scored AS (SELECT c.lang, c.phrase, c.k, c.a, c.p, l.a AS l, r.a AS r, n, CAST((1000::HUGEINT * c.a * n) // (l.a::HUGEINT * r.a) AS BIGINT) AS score FROM cuts c
    JOIN found l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:c.p], ' ') JOIN found r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[c.p + 1:], ' ') JOIN totals t ON t.lang = c.lang),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, p) = 1),
stays AS (SELECT * FROM lowest o WHERE NOT EXISTS (SELECT 1 FROM found b WHERE b.lang = o.lang AND b.k > o.k AND b.a >= o.a AND contains(' ' || b.phrase || ' ', ' ' || o.phrase || ' '))),
ranked AS (SELECT lang, CAST(row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS BIGINT) AS rank, phrase, a, l, r, n, score FROM stays)
SELECT * FROM ranked WHERE rank <= {top}
"""


@corpus_query("op12_phrases", sql=_sql())
def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents").select("text", "lang"))

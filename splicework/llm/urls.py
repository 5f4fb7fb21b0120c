"""URL filters: rules first, then the ratio of two character models learned from what the rules judged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import boxed, checkpoint, table, unboxed
from .registry import corpus_query

#: The rules of the registered query: (host and path, verdict).
RULES = (
    ("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"),
)
#: Longest run of characters counted, counters per length, and the weight of a shorter context.
ORDER, COUNTERS, BACKOFF = 4, 1 << 16, 4
#: Multipliers of a character and of those before it, for the number of its counter.
STEPS = (1, 8191, 27644437, 479001599)
#: URLs whose MD5 starts with one of these digits set the threshold and are not learned from.
CALIBRATION = "012"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ADDRESS = "://([^/?#]*)([^?#]*)"


def parse(urls: DataFrame) -> DataFrame:
    """Adds host and path: both empty for a null url or one without ``://``."""
    part = lambda n: F.coalesce(F.regexp_extract("url", ADDRESS, n), F.lit(""))
    return urls.withColumn("host", F.translate(part(1), UPPER, LOWER)).withColumn("path", part(2))


def longest_rule(rules: tuple[tuple[str, str], ...]) -> Column:
    """The longest rule that fits host and path, as struct<rule, verdict>, else null.

    A rule given twice with both verdicts blocks. Rules are a list in the query, so they are for
    tens to hundreds of entries.
    """
    out = F.lit(None).cast("struct<rule: string, verdict: string>")
    for rule, verdict in sorted(set(rules), key=lambda r: (len(r[0]), r[0], r[1])):
        host, slash, rest = rule.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(slash + rest)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _slot(order: int, at: str) -> str:
    terms = " + ".join(f"codes[{at} - {back}] * {STEPS[back]}L" for back in range(order))
    return f"cast({(order - 1) * COUNTERS} + pmod({terms}, {COUNTERS}L) AS int)"


def with_slots(parsed: DataFrame) -> DataFrame:
    """Adds ``slots``: for the start and each character of host and path, its counter in each order."""
    codes = F.expr(f"concat(array_repeat(1L, {ORDER}), transform(filter(split(concat(host, path), ''), c -> c <> ''), c -> cast(ascii(c) AS bigint)))")
    each = ", ".join(_slot(k, "j") for k in range(1, ORDER + 1))
    return parsed.withColumn("codes", codes).withColumn("slots", F.expr(f"transform(sequence({ORDER - 1}, size(codes) - 1), j -> array({each}))")).drop("codes")


def counters(labelled: DataFrame) -> DataFrame:
    """One row: ``allowed`` and ``blocked``, counts by slot, and the number of characters at the end.

    Runs of characters share counters by hash, so the model has the same size for any corpus.
    """
    slots = labelled.select("verdict", F.explode(F.flatten("slots")).alias("slot"))
    counts = slots.groupBy("slot").agg(*[F.count(F.when(F.col("verdict") == v, 1)).alias(n) for v, n in (("allow", "a"), ("block", "b"))])
    every = labelled.sparkSession.range(ORDER * COUNTERS).select(F.col("id").cast("int").alias("slot"))
    dense = every.join(counts, "slot", "left").select("slot", *[F.coalesce(c, F.lit(0)).cast("double").alias(c) for c in ("a", "b")])
    rows = dense.agg(F.array_sort(F.collect_list(F.struct("slot", "a", "b"))).alias("rows"))
    whole = "aggregate(slice(transform(rows, r -> r.{0}), 1, {1}), 0D, (s, x) -> s + x)"
    return rows.select(*[
        F.concat(F.expr(f"transform(rows, r -> r.{c})"), F.array(F.expr(whole.format(c, COUNTERS)))).alias(name) for c, name in (("a", "allowed"), ("b", "blocked"))
    ])


def _chance(counts: str) -> str:
    """Probability of a character after those before it: each order leans on the next shorter one by
    BACKOFF, so the longest context that was seen decides."""
    out = f"(({counts}[slots[j][0]] + 0.5D) / ({counts}[{ORDER * COUNTERS}] + 128D))"
    for k in range(1, ORDER):
        out = f"(({counts}[slots[j][{k}]] + {BACKOFF}D * {out}) / ({counts}[slots[j - 1][{k - 1}]] + {BACKOFF}D))"
    return out


def scored(slotted: DataFrame, model: DataFrame) -> DataFrame:
    """Adds ``score``: millionths of the mean log ratio per character, positive like allowed URLs; null without characters."""
    held = slotted.withColumn("__allowed", model.select("allowed").scalar()).withColumn("__blocked", model.select("blocked").scalar())
    total = f"aggregate(sequence(1, size(slots) - 1), 0D, (s, j) -> s + ln({_chance('__allowed')}) - ln({_chance('__blocked')}))"
    return held.withColumn("score", F.expr(f"CASE WHEN size(slots) > 1 THEN cast(round({total} / (size(slots) - 1) * 1000000D) AS bigint) END")).drop("__allowed", "__blocked")


def calibrated(held_out: DataFrame) -> DataFrame:
    """One row with ``threshold``: where both classes' scores lie equally many deviations away; 0 if one has none.

    Sums are of whole numbers, so they don't depend on the order of rows.
    """
    exact = F.col("score").cast("decimal(38,0)")
    of = lambda v, x: F.sum(F.when(F.col("verdict") == v, x)).cast("double")
    some = F.when(F.col("score").isNotNull(), 1)  # in the sums, as a filter would be pushed below the score and compute it again
    sums = held_out.agg(*[of(v, x).alias(f"{v}_{n}") for v in ("allow", "block") for n, x in (("n", some), ("s", exact), ("q", exact * exact))])
    mean = {v: f"{v}_s / {v}_n" for v in ("allow", "block")}
    width = {v: f"sqrt(greatest({v}_q / {v}_n - pow({v}_s / {v}_n, 2), 0D)) + 1D" for v in mean}
    return sums.select(F.coalesce(F.expr(f"({mean['allow']} * ({width['block']}) + {mean['block']} * ({width['allow']})) / ({width['allow']} + {width['block']})"), F.lit(0.0)).alias("threshold"))


def judged(urls: DataFrame, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """Adds host, path, rule, verdict and score to rows that have a ``url``.

    The rule's verdict stands where one fits. All others get the models' verdict: allow where
    the mean log ratio per character reaches the threshold. Without blocked URLs to learn from
    everything else is allowed, without allowed ones everything else is blocked; a URL of no
    host and path that no rule judges is blocked. Repeated rows count each time; columns of
    these names are replaced, others pass through.
    """
    plain = parse(boxed(urls, "url"))
    ruled = plain.withColumn("__rule", longest_rule(rules)).withColumn("rule", F.col("__rule.rule")).withColumn("verdict", F.col("__rule.verdict")).drop("__rule")
    labelled = with_slots(ruled.where("verdict IS NOT NULL").select("url", "host", "path", "verdict"))
    aside = F.substring(F.md5("url"), 1, 1).isin(*CALIBRATION)
    model = checkpoint(counters(labelled.where(~aside)))
    threshold = checkpoint(calibrated(scored(labelled.where(aside), model)))
    out = scored(with_slots(ruled), model).withColumn("__known", F.struct(*[model.select(F.element_at(c, -1)).scalar().alias(c[0]) for c in ("allowed", "blocked")]))
    method = (
        F.when(F.size("slots") <= 1, "block").when(F.col("__known.b") == 0, "allow").when(F.col("__known.a") == 0, "block")
        .when(F.col("score") >= threshold.scalar(), "allow").otherwise("block")
    )
    return out.select(*unboxed(urls.columns, host=F.col("host"), path=F.col("path"), rule=F.col("rule"), verdict=F.coalesce("verdict", method), score=F.col("score")))


def _sql() -> str:
    fits = lambda rule: f"(host = '{rule.partition('/')[0]}' OR ends_with(host, '.{rule.partition('/')[0]}')) AND starts_with(path, '/{rule.partition('/')[2]}')"
    longest = sorted(RULES, key=lambda r: -len(r[0]))
    case = lambda n: "CASE " + " ".join(f"WHEN {fits(r[0])} THEN '{r[n]}'" for r in longest) + " END"
    slot = lambda k: f"{(k - 1) * COUNTERS} + (" + " + ".join(f"CAST(codes[j - {b}] AS BIGINT) * {STEPS[b]}" for b in range(k)) + f") % {COUNTERS}"
    slots = ", ".join(f"{slot(k)} AS s{k}" for k in range(1, ORDER + 1))
    joins = "".join(f" LEFT JOIN counts c{k} ON c{k}.slot = g.s{k} LEFT JOIN counts h{k} ON h{k}.slot = g.p{k}" for k in range(1, ORDER + 1))

    def chance(c: str) -> str:
        out = f"((coalesce(c1.{c}, 0) + 0.5::DOUBLE) / ((SELECT {c} FROM known) + 128))"
        for k in range(2, ORDER + 1):
            out = f"((coalesce(c{k}.{c}, 0) + {BACKOFF}::DOUBLE * {out}) / (coalesce(h{k - 1}.{c}, 0) + {BACKOFF}))"
        return out

    width = lambda v: f"(sqrt(greatest({v}_q / {v}_n - pow({v}_s / {v}_n, 2), 0)) + 1)"
    sums = ", ".join(f"CAST(sum({x}) FILTER (WHERE verdict = '{v}') AS DOUBLE) AS {v}_{n}" for v in ("allow", "block") for n, x in (("n", "1"), ("s", "score"), ("q", "CAST(score AS HUGEINT) * score")))
    return f"""
WITH parsed AS (SELECT page_id, url, translate(coalesce(regexp_extract(url, '{ADDRESS}', 1), ''), '{UPPER}', '{LOWER}') AS host,
    coalesce(regexp_extract(url, '{ADDRESS}', 2), '') AS path FROM pages),
ruled AS (SELECT *, {case(0)} AS rule, {case(1)} AS known FROM parsed),
coded AS (SELECT *, list_concat([1, 1, 1, 1], list_transform(string_split(host || path, ''), lambda c: unicode(c))) AS codes,
    CASE WHEN known IS NULL THEN 'none' WHEN substr(md5(url), 1, 1) IN ('0', '1', '2') THEN 'aside' ELSE 'learned' END AS part FROM ruled),
positions AS (SELECT page_id, part, known, codes, unnest(range({ORDER}, len(codes) + 1)) AS j FROM coded),
grams AS (SELECT page_id, part, known, j, {slots} FROM positions),
counts AS (SELECT slot, CAST(count(*) FILTER (WHERE known = 'allow') AS DOUBLE) AS a, CAST(count(*) FILTER (WHERE known = 'block') AS DOUBLE) AS b
    FROM (SELECT known, unnest([s1, s2, s3, s4]) AS slot FROM grams WHERE part = 'learned') GROUP BY slot),
known AS (SELECT coalesce(sum(a), 0) AS a, coalesce(sum(b), 0) AS b FROM counts WHERE slot < {COUNTERS}),
beside AS (SELECT g.*, p.s1 AS p1, p.s2 AS p2, p.s3 AS p3, p.s4 AS p4 FROM grams g JOIN grams p ON p.page_id = g.page_id AND p.j = g.j - 1),
scores AS (SELECT page_id, CAST(round(sum(ln({chance('a')}) - ln({chance('b')})) / count(*) * 1000000) AS BIGINT) AS score FROM beside g{joins} GROUP BY page_id),
sums AS (SELECT {sums} FROM coded JOIN scores USING (page_id), LATERAL (SELECT known AS verdict) v WHERE part = 'aside'),
threshold AS (SELECT coalesce((allow_s / allow_n * {width('block')} + block_s / block_n * {width('allow')}) / ({width('allow')} + {width('block')}), 0) AS t FROM sums)
SELECT page_id, host, path, rule, coalesce(known, CASE WHEN score IS NULL THEN 'block' WHEN (SELECT b FROM known) = 0 THEN 'allow' WHEN (SELECT a FROM known) = 0 THEN 'block'
    WHEN score >= (SELECT t FROM threshold) THEN 'allow' ELSE 'block' END) AS verdict FROM coded LEFT JOIN scores USING (page_id)
"""


@corpus_query("op9_urls", sql=_sql())
def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")

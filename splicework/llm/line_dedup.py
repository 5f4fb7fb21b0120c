"""Line dedup: windows of three lines that occurred before, anywhere in the corpus, are cut out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPREAD, boxed, table, unboxed
from .registry import corpus_query

#: Lines of a window.
SPAN = 3


def _lines(text: str = "text") -> Column:
    return F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)


def _who(docs: DataFrame) -> DataFrame:
    """Adds __who, a document's place in the order of occurrences: its id, then its text's digest."""
    return docs.withColumn("__who", F.struct(F.col("doc_id").alias("doc_id"), F.md5(F.coalesce("text", F.lit(""))).alias("digest")))


def windows(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """One row per window of ``span`` consecutive lines that are not all blank: __who, position of its
    first line, and a hash of 128 bits in two halves."""
    lane = lambda n: F.expr(f"transform(__lines, l -> xxhash64({n}, l))")
    at = ", ".join(f"h[i + {k}]" for k in range(span))
    blank = " AND ".join(f"trim(__lines[i + {k}]) = ''" for k in range(span))
    hashed = docs.select("__who", _lines().alias("__lines")).where(F.size("__lines") >= span).select("__who", "__lines", lane(1).alias("a"), lane(2).alias("b"))
    each = F.expr(
        f"filter(transform(sequence(0, size(__lines) - {span}), i -> CASE WHEN NOT ({blank}) THEN struct(i AS at, "
        f"xxhash64(1, {at.replace('h[', 'a[')}) AS a, xxhash64(2, {at.replace('h[', 'b[')}) AS b) END), w -> w IS NOT NULL)"
    )
    return hashed.select("__who", F.explode(each).alias("w")).select("__who", "w.at", "w.a", "w.b")


def repeats(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """(__who, starts): where windows begin that occurred before, in order.

    Occurrences are dealt over pieces by document. The first of each (window, piece) is found
    where it is read, the first of all among at most SPREAD rows of a window, and each piece's
    occurrences then meet that one row, so a window that a third of the corpus holds is no
    task's burden.
    """
    every = windows(_who(docs.select("doc_id", "text")), span).withColumn("piece", F.pmod(F.xxhash64("__who"), F.lit(SPREAD)).cast("int"))
    place = F.struct("__who", "at")
    pieces = every.groupBy("a", "b", "piece").agg(F.min(place).alias("first"), F.count("*").alias("n"))
    same = Window.partitionBy("a", "b")
    known = pieces.withColumn("first", F.min("first").over(same)).withColumn("n", F.sum("n").over(same)).where("n > 1").select("a", "b", "piece", "first")
    later = every.join(known, ["a", "b", "piece"]).where(place > F.col("first"))
    return later.groupBy("__who").agg(F.array_sort(F.collect_set("at")).alias("starts"))


def line_dedup(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """Adds lines and lines_removed and cuts the covered lines out of ``text``.

    Windows of ``span`` lines that have an earlier occurrence (order: doc_id with null first,
    then the text's digest, then position) cover their lines; covered lines go, the first
    occurrence of a window stays unless another window covers it. Lines are compared as they
    are and end at a line feed. Windows of nothing but blank lines never count. A null text stays
    null (0 lines); an empty text is one empty line; rows that repeat a document's id and text
    share its fate. Other columns pass through; lines and lines_removed are replaced.
    """
    base = _who(boxed(docs, "doc_id", "text", without=["text"]))
    joined = base.join(repeats(docs, span), "__who", "left").withColumn("__all", _lines())
    runs = (
        joined.withColumn("starts", F.coalesce("starts", F.array().cast("array<int>")))
        .withColumn("__from", F.expr(f"filter(starts, (s, i) -> i = 0 OR s - starts[i - 1] > {span})"))
        .withColumn("__to", F.expr(f"transform(filter(starts, (s, i) -> i = size(starts) - 1 OR starts[i + 1] - s > {span}), s -> s + {span})"))
    )
    # what stays: before the first run, between runs, after the last
    kept = F.expr(
        "flatten(transform(sequence(0, size(__from)), i -> slice(__all, CASE WHEN i = 0 THEN 1 ELSE __to[i - 1] + 1 END, "
        "CASE WHEN i = size(__from) THEN size(__all) ELSE __from[i] END - CASE WHEN i = 0 THEN 0 ELSE __to[i - 1] END)))"
    )
    cut = runs.withColumn("__kept", F.when(F.size("starts") > 0, kept).otherwise(F.col("__all")))
    whole = cut.withColumn("lines", F.when(F.col("text").isNull(), 0).otherwise(F.size("__all"))).withColumn("lines_removed", F.size("__all") - F.size("__kept"))
    text = F.when(F.col("lines_removed") > 0, F.array_join("__kept", "\n")).otherwise(F.col("text"))
    return whole.select(*unboxed(docs.columns, text=text, lines=F.col("lines"), lines_removed=F.col("lines_removed")))


LINES_SQL = """
WITH split AS (SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS all_lines FROM documents),
numbered AS (SELECT doc_id, unnest(all_lines) AS line, unnest(range(len(all_lines))) AS pos FROM split),
windowed AS (SELECT doc_id, pos, line AS l0, lead(line, 1) OVER w AS l1, lead(line, 2) OVER w AS l2 FROM numbered WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
repeated AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY l0, l1, l2 ORDER BY doc_id, pos) AS n FROM windowed
    WHERE l2 IS NOT NULL AND NOT (trim(l0) = '' AND trim(l1) = '' AND trim(l2) = '')),
covered AS (SELECT DISTINCT doc_id, pos + k AS pos FROM repeated, (SELECT unnest([0, 1, 2]) AS k) WHERE n > 1),
kept AS (SELECT n.doc_id, string_agg(line, chr(10) ORDER BY n.pos) AS text, count(*) AS stays FROM numbered n ANTI JOIN covered c ON n.doc_id = c.doc_id AND n.pos = c.pos GROUP BY n.doc_id)
SELECT s.doc_id, CASE WHEN s.text IS NULL THEN 0 ELSE len(all_lines) END AS lines, len(all_lines) - coalesce(stays, 0) AS lines_removed,
    CASE WHEN s.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text FROM split s LEFT JOIN kept k USING (doc_id)
"""


@corpus_query("op1_line_dedup", sql=LINES_SQL)
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "lines", "lines_removed", "text")

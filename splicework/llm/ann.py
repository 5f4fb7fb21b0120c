"""Approximate nearest neighbours: cross-polytope hashing with multiprobe tables and exact reranking."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, checkpoint, table
from .registry import corpus_query

#: Hash tables, and index rows that a query asks for: ROWS * N ** POWER over all tables, of N different vectors.
TABLES, ROWS, POWER = 48, 64.0, 0.375
#: Rows that a probed bucket holds, times the mean bucket: queries probe where vectors are dense.
DENSITY = 1.55
#: Axes of one hash that probes are made of, and probes at most.
AXES, COMBINATIONS = 64, 4096
#: Rows that a task hands over at once, about.
BATCH_ROWS = 1 << 20
#: Pieces over which copies of one vector are dealt before the least ids among them are taken.
PIECES = 16
QUERY_EVERY, NEAREST = 100, 10


def rotated(unit: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Three rounds of random signs and a Hadamard transform: close to a random rotation in n log n steps."""
    out = unit
    for flip in signs:
        out, half = out * flip, 1
        while half < out.shape[1]:
            pairs = out.reshape(len(out), -1, 2, half)
            out = np.concatenate([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(len(out), -1)
            half *= 2
        out = out / np.sqrt(out.shape[1])
    return out


class Hashes:
    """The tables for vectors of one length: how many axes each hash of a table has, and how many buckets a query probes."""

    def __init__(self, dim: int, n: int):
        self.dim, self.full = dim, 1 << max(1, (dim - 1).bit_length())
        self.axes = [self.full]
        while 2 * self.full * self.buckets() <= 8 * n and len(self.axes) < 4:  # whole hashes until there are enough buckets
            self.axes.append(self.full)
        if len(self.axes) == 1 or self.buckets() < n // 8:
            self.axes.append(min(self.full, 1 << max(0, (n // self.buckets()).bit_length() - 1)))
        wanted = ROWS * n**POWER
        self.probes = int(min(max(1, round(wanted * self.buckets() / (n * TABLES * DENSITY))), self.buckets(), COMBINATIONS))

    def buckets(self) -> int:
        return int(np.prod([2 * a for a in self.axes]))

    def unit(self, vectors: np.ndarray) -> np.ndarray:
        out = np.zeros((len(vectors), self.full))
        out[:, : self.dim] = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        return out

    def rotations(self, unit: np.ndarray, number: int) -> list[np.ndarray]:
        """The vectors as each hash of a table sees them."""
        draw = np.random.default_rng([number, self.dim])
        return [rotated(unit, draw.choice([-1.0, 1.0], size=(3, self.full)))[:, :axes] for axes in self.axes]

    def places(self, vectors: np.ndarray) -> np.ndarray:
        """The bucket of each vector in each table: of every hash the nearest signed axis."""
        unit, out = self.unit(vectors), np.zeros((len(vectors), TABLES), dtype=np.int64)
        for number in range(TABLES):
            for seen in self.rotations(unit, number):
                axis = np.abs(seen).argmax(1)
                out[:, number] = out[:, number] * 2 * seen.shape[1] + 2 * axis + (seen[np.arange(len(seen)), axis] < 0)
        return out

    def combined(self, many: int, axes: int) -> tuple[np.ndarray, np.ndarray]:
        """Which of ``many`` combinations and of a further hash's ``axes``, both in order of their cost, may be among the probes together.

        The i-th with the j-th costs no less than the (i + 1)(j + 1) - 1 pairs before both, so it is left out where these fill the probes.
        """
        pairs = [(i, j) for i in range(min(many, self.probes)) for j in range(min(axes, self.probes // (i + 1)))]
        left, right = np.array(pairs, dtype=np.int64).T
        return left, right

    def probed(self, vectors: np.ndarray) -> np.ndarray:
        """The buckets that each vector asks in each table: those whose axes it is least farther from than from the nearest."""
        unit, out = self.unit(vectors), np.empty((len(vectors), TABLES, self.probes), dtype=np.int64)
        for number in range(TABLES):
            bucket, cost = np.zeros((len(vectors), 1), dtype=np.int64), np.zeros((len(vectors), 1))
            for seen in self.rotations(unit, number):
                signed = np.stack([seen, -seen], axis=2).reshape(len(seen), -1)
                order = np.argsort(-signed, axis=1, kind="stable")[:, :AXES]
                gap = (signed.max(1, keepdims=True) - np.take_along_axis(signed, order, 1)) ** 2
                left, right = self.combined(cost.shape[1], gap.shape[1])
                cost, bucket = cost[:, left] + gap[:, right], bucket[:, left] * signed.shape[1] + order[:, right]
                best = np.argsort(cost, axis=1, kind="stable")[:, : self.probes]
                cost, bucket = np.take_along_axis(cost, best, 1), np.take_along_axis(bucket, best, 1)
            out[:, number, : bucket.shape[1]] = bucket
            out[:, number, bucket.shape[1] :] = -1
        return out


def valid(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding, dim) of the vectors that take part: not null, no null or non-finite part, not zero."""
    parts = F.col("embedding")
    good = F.forall(parts, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(parts, lambda x: x != 0)
    return vectors.where(parts.isNotNull() & F.col("vec_id").isNotNull()).where(good).select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), F.size(parts).alias("dim"))


def _hashed(vectors: DataFrame, sizes: dict[int, int], queries: bool) -> DataFrame:
    """(vec_id, dim, number, bucket): a row per table for the index, a row per probe for queries."""
    probes = max((Hashes(dim, n).probes for dim, n in sizes.items()), default=1) if queries else 1
    step = max(1, min(256 if queries else 4096, BATCH_ROWS // (TABLES * probes)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, Hashes] = {}
        for whole in batches:
            for start in range(0, whole.num_rows, step):
                batch = whole.slice(start, step)
                dims = batch.column("dim").to_numpy(zero_copy_only=False)
                for dim in np.unique(dims).tolist():
                    hashes = known.setdefault(dim, Hashes(dim, sizes[dim]))
                    rows = np.flatnonzero(dims == dim)
                    own = batch.take(pa.array(rows))
                    data = own.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(len(rows), dim)
                    found = hashes.probed(data) if queries else hashes.places(data)[:, :, None]
                    many = found.shape[2]
                    number = np.tile(np.repeat(np.arange(TABLES, dtype=np.int32), many), len(rows))
                    ids = np.repeat(own.column("vec_id").to_numpy(zero_copy_only=False), TABLES * many)
                    flat = found.reshape(-1)
                    yield pa.RecordBatch.from_arrays([pa.array(x[flat >= 0]) for x in (ids, np.full(len(flat), dim, np.int32), number, flat)], ["vec_id", "dim", "number", "bucket"])

    return vectors.select("vec_id", "embedding", "dim").mapInArrow(work, "vec_id long, dim int, number int, bucket long")


def _least_ids(vectors: DataFrame, keep: int) -> DataFrame:
    """(embedding, dim, vec_id, rep): of each different vector the ``keep`` least ids, and the least of all.

    Further copies can't be among anything's nearest: ties go to smaller ids. Copies are dealt
    over pieces, so that none of a common vector's copies meet in one task before they are few.
    """
    dealt = vectors.withColumn("piece", F.pmod(F.xxhash64("vec_id"), F.lit(PIECES)))
    few = dealt.withColumn("at", F.row_number().over(Window.partitionBy("embedding", "piece").orderBy("vec_id"))).where(F.col("at") <= keep)
    same = Window.partitionBy("embedding")
    return few.withColumn("at", F.row_number().over(same.orderBy("vec_id"))).withColumn("rep", F.min("vec_id").over(same)).where(F.col("at") <= keep).drop("piece", "at")


def _by_distance() -> Column:
    squares = F.zip_with("embedding", "asked", lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = NEAREST) -> DataFrame:
    """(vec_id, embedding), queries (vec_id, embedding) -> query_id, rank, vec_id, score.

    The ``k`` nearest found of each query by Euclidean distance in double precision, ties to the
    smaller vec_id; a row of the query's own id is not found. Vectors that are null, without id,
    zero or have a null or non-finite part take no part, as index or as query; vectors are only
    compared with those of their length. All different vectors are in every table; a query's
    probes choose candidates by direction, which are then measured on the original vectors.
    Rows that repeat an id and vector are found once; an id with several vectors stands for each.
    Other columns are not read.
    """
    every = valid(vectors)
    known = checkpoint(_least_ids(every.distinct(), k + 1))
    reps = known.where("vec_id = rep").select("vec_id", "embedding", "dim").distinct()
    sizes = {r.dim: r.n for r in reps.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    asking = checkpoint(valid(queries).distinct())
    asking = asking.join(F.broadcast(asking.sparkSession.createDataFrame([(d,) for d in sizes] or [(-1,)], "dim int")), "dim", "left_semi")
    index = _hashed(reps, sizes, False)
    many = asking.count()
    pieces = many * TABLES * max((Hashes(dim, n).probes for dim, n in sizes.items()), default=1) // BATCH_ROWS
    probes = _hashed(asking.repartition(pieces, "vec_id") if pieces > 1 else asking, sizes, True).withColumnRenamed("vec_id", "query_id")
    if pieces:
        probes = probes.hint("merge")  # the optimizer takes them for as few as their queries, and would send them all to every task
    pairs = probes.join(index, ["dim", "number", "bucket"]).select("query_id", F.col("vec_id").alias("rep"), "dim").distinct()
    asked = asking.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("asked"), "dim")
    with_vectors = pairs.join(reps.withColumnRenamed("vec_id", "rep"), ["rep", "dim"])
    small = many <= BROADCAST_ROWS
    scored = with_vectors.join(F.broadcast(asked) if small else asked, ["query_id", "dim"]).select("query_id", "rep", "dim", _by_distance().alias("score"))
    first = Window.partitionBy("query_id").orderBy("score", "rep")
    best = scored.withColumn("at", F.row_number().over(first)).where(F.col("at") <= k + 1).drop("at")
    rows = best.join(known.select("rep", "vec_id", "dim"), ["rep", "dim"]).where("vec_id != query_id")
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


@corpus_query("op7_ann")
def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(vectors, vectors.where(F.col("vec_id") % QUERY_EVERY == 0))

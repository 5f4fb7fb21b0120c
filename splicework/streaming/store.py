"""A table in buckets by key, of which a commit rewrites only those it touches."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Buckets of a new table, and commits whose files stay for readers that began earlier.
BUCKETS, KEPT = 256, 3


class BucketedTable:
    """Rows by the hash of their key, and for each commit a manifest that names the files of every bucket.

    A commit writes the buckets it touches into a folder of its own and then its manifest; readers see the
    newest finished manifest, so never half a commit. Commits are numbered by their batch: one that runs
    again starts from the commit before it and writes the same once more. A bucket is what one
    batch of one key reads and writes; more buckets suit a larger table, and a table keeps the number it began with.
    """

    def __init__(self, spark: SparkSession, path: str, keys: Iterable[str], order: Iterable[str] = (), buckets: int = BUCKETS):
        self.spark, self.path, self.keys, self.order, self.buckets = spark, path, list(keys), list(order), buckets
        self._root = spark._jvm.org.apache.hadoop.fs.Path(path)
        self._fs = self._root.getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self, pattern: str) -> list[str]:
        found = self._fs.globStatus(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{pattern}"))
        return [f.getPath().toString() for f in found or []]

    def _remove(self, path: str) -> None:
        self._fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(path), True)

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def commits(self) -> list[int]:
        """Numbers of the finished commits, ascending."""
        return sorted(int(p.rpartition("/manifest/v")[2].partition("/")[0]) for p in self._names("manifest/v*/_SUCCESS"))

    def _manifest(self, commit: int) -> tuple[StructType, dict[int, int]]:
        """The schema, and the commit that wrote each bucket: at most a row per bucket."""
        rows = self.spark.read.schema("bucket int, version bigint, schema string").json(f"{self.path}/manifest/v{commit}").collect()
        return StructType.fromJson(json.loads(rows[0]["schema"])), {r["bucket"]: r["version"] for r in rows if r["bucket"] is not None}

    def read(self, commit: int | None = None, buckets: Iterable[int] | None = None) -> DataFrame | None:
        """The table, or some of its buckets, as of a commit; None before the first one."""
        known = self.commits()
        if commit is None and known:
            commit = known[-1]
        if commit not in known:
            return None
        schema, written = self._manifest(commit)
        wanted = written if buckets is None else {b: written[b] for b in buckets if b in written}
        paths = [f"{self.path}/data/v{v}/bucket={b}" for b, v in sorted(wanted.items())]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def before(self, commit: int) -> int | None:
        return max((c for c in self.commits() if c < commit), default=None)

    def merge(self, commit: int, touched: DataFrame, change: Callable[[DataFrame | None], DataFrame]) -> list[int]:
        """Replace the buckets that hold the keys of ``touched`` by what ``change`` makes of their rows; returns them.

        ``change`` gets the rows of those buckets as of the commit before, other keys' rows among them, or None
        if there is no such commit, and returns all rows that the buckets shall have.
        """
        # At most one small row per bucket comes to the driver.
        asked = sorted(r["b"] for r in touched.select(self.bucket().alias("b")).distinct().collect())
        base = self.before(commit)
        self._write(commit, base, asked, change(None if base is None else self.read(base, asked)))
        return asked

    def write(self, df: DataFrame, commit: int) -> None:
        """A commit of the whole table."""
        self._write(commit, None, list(range(self.buckets)), df)

    def _write(self, commit: int, base: int | None, asked: list[int], rows: DataFrame) -> None:
        folder = f"{self.path}/data/v{commit}"
        placed = rows.withColumn("bucket", self.bucket())
        if asked:
            placed.repartitionByRange("bucket", *self.keys, *self.order).sortWithinPartitions("bucket", *self.keys, *self.order).write.mode("overwrite").partitionBy("bucket").parquet(folder)
        written = {} if base is None else self._manifest(base)[1]
        filled = {int(p.rpartition("bucket=")[2]) for p in self._names(f"data/v{commit}/bucket=*")}
        written = {b: v for b, v in written.items() if b not in asked} | {b: commit for b in asked if b in filled}
        schema = rows.schema.json()
        listed = [(b, v, schema) for b, v in sorted(written.items())] or [(None, None, schema)]
        self.spark.createDataFrame(listed, "bucket int, version bigint, schema string").coalesce(1).write.mode("overwrite").json(f"{self.path}/manifest/v{commit}")

    def expire(self, keep: int = KEPT) -> None:
        """Remove all but the last ``keep`` commits, and the files that none of those names."""
        known = self.commits()
        if len(known) <= keep:
            return
        kept = known[-keep:]
        used = {(v, b) for c in kept for b, v in self._manifest(c)[1].items()}
        for c in known[:-keep]:
            self._remove(f"{self.path}/manifest/v{c}")
        for p in self._names("data/v*/bucket=*"):
            version, bucket = p.rpartition("/data/v")[2].split("/bucket=")
            if int(version) < kept[0] and (int(version), int(bucket)) not in used:
                self._remove(p)

"""Session defaults, and the two settings every job reads from the running session."""

from __future__ import annotations

import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Rows one key may hold before its ordered work is split over several tasks.
HEAVY_ROWS = 4_000_000
#: One row in this many is looked at when hunting for heavy keys.
HEAVY_SAMPLE = 64
#: Inputs up to this many bytes on disk are never split; any key of theirs fits in a task.
SMALL_BYTES = 256 << 20
#: Rows of one key that share a segment when a dense ordinal is stored with the data.
SEGMENT_ROWS = 1_000_000


def build(master: str = "local[*]", app: str = "splicework", **conf: str) -> SparkSession:
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def setting(spark: SparkSession, name: str, default: int) -> int:
    return int(spark.conf.get(f"spark.splicework.{name}", str(default)))


def heavy_rows(spark: SparkSession) -> int:
    return setting(spark, "heavyRows", HEAVY_ROWS)


def heavy_sample(spark: SparkSession) -> int:
    return setting(spark, "heavySample", HEAVY_SAMPLE)


def segment_rows(spark: SparkSession) -> int:
    return setting(spark, "segmentRows", SEGMENT_ROWS)


#: Folder of each frame that ``checkpoint`` has written and that is still in use.
_WRITTEN: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which all executors share; a local one only on one machine."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        shared = context.getConf().get("spark.checkpoint.dir")
        if not shared and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="splicework-ckpt-"))
    return context._jsc.sc().getCheckpointDir().get()


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder below the checkpoint folder; it goes when the session's JVM ends."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return path.toString()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage through a table in the shared checkpoint folder, written and read again.

    Unlike a frame of ``DataFrame.checkpoint``, which keeps the size estimate of the plan it came
    from, the result is as large for the optimizer as its files are, so estimates don't grow from
    round to round of a loop.
    """
    path = scratch(df.sparkSession, "table")
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _WRITTEN[out] = path
    return out


def counted(df: DataFrame) -> tuple[DataFrame, int]:
    """``checkpoint``, and the number of rows, counted while they were written."""
    seen = Observation()
    out = checkpoint(df.observe(seen, F.count(F.lit(1)).alias("rows")))
    return out, seen.get["rows"]


def release(*frames: DataFrame) -> None:
    """Remove what ``checkpoint`` wrote for these frames; nothing may read them any more."""
    for df in frames:
        if found := _WRITTEN.pop(df, None):
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(found)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


#: Sessions in which a key of too many rows to stay in one place was met since ``forget_places``.
_SPREAD: weakref.WeakSet[SparkSession] = weakref.WeakSet()
_ALL_KEYS = "spark.sql.requireAllClusterKeysForCoPartition"


def forget_places(spark: SparkSession) -> None:
    """Joins are planned as Spark does by itself, until ``keep_places`` says otherwise."""
    _SPREAD.discard(spark)
    spark.conf.unset(_ALL_KEYS)


def keep_places(spark: SparkSession, light: bool) -> None:
    """Whether rows that are dealt by some of a join's keys may stay where they are.

    By itself, Spark deals both sides of a join once more unless they lie by all of its keys, lest a common key's rows meet in
    one task. Where rows were counted and no key has many, that only costs shuffles. One key with many rules it out.
    """
    if not light:
        _SPREAD.add(spark)
    spark.conf.set(_ALL_KEYS, "false" if light and spark not in _SPREAD else "true")


def places_kept(spark: SparkSession) -> bool:
    return spark.conf.get(_ALL_KEYS, "true") == "false"


def small_bytes(spark: SparkSession) -> int:
    return setting(spark, "smallBytes", SMALL_BYTES)

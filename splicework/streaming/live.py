"""The same rules on unbounded input: ingest with quarantine, bursts, keyed state, timeline upkeep."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.replay import replay_ops
from ..sources.eventlog import good_events, parse_events, upsert_events
from .store import BucketedTable
from .timing import BURST_US, MAX_HOLD_US, MAX_INTERVAL_MS, MIN_INTERVAL_MS, QUIET_US, SCRUB_LOG_US, STALE_US


def event_table(spark: SparkSession, store: str) -> BucketedTable:
    """The log that ``ingest_events`` keeps."""
    return BucketedTable(spark, f"{store}/events", ["project_id"], ["seq"])


def ingest_events(spark: SparkSession, folder: str, store: str, checkpoint: str, max_files: int = 1000, trigger: dict | None = None) -> StreamingQuery:
    """Read JSON lines as they arrive into a log where a sequence number has one row, the last written.

    No event is too late: rows are merged by their number, in the order of their files' times, names
    and lines, and nothing is dropped by a watermark. Bad lines go to ``store/skipped``, by batch, so
    that a batch that runs again writes them once. ``store/events`` is a ``BucketedTable`` by project: a batch reads and
    rewrites the buckets of its own projects only. ``trigger`` is passed on; by default what is there is read
    and the query ends.
    """
    place = ("file_modification_time", "file_path", "file_block_start")
    lines = spark.readStream.option("maxFilesPerTrigger", max_files).text(folder).select("value", *[F.col(f"_metadata.{c}").alias(c) for c in place])
    table = event_table(spark, store)

    def merge(batch: DataFrame, number: int) -> None:
        parsed = parse_events(batch.withColumn("line", F.monotonically_increasing_id())).persist()
        try:
            parsed.where("error is not null").select("raw", "error").write.mode("overwrite").json(f"{store}/skipped/batch={number}")
            arrived = good_events(parsed, F.struct(*place, "line").alias("arrived"))
            table.merge(number, arrived.select("project_id"), lambda held: upsert_events(held, arrived, "arrived"))
        finally:
            parsed.unpersist()
        table.expire()

    return lines.writeStream.foreachBatch(merge).option("checkpointLocation", f"{checkpoint}/events").trigger(**trigger or {"availableNow": True}).start()


def coalesce_bursts(events: DataFrame, late: str = "1 minute") -> DataFrame:
    """The last state of each burst of a project, once the watermark has passed it."""
    gap = f"{BURST_US // 1000} milliseconds"
    kept = F.max_by(F.struct("seq", "type", "at_us"), F.struct("at_us", "seq")).alias("last")
    return events.withWatermark("at", late).groupBy("project_id", F.session_window("at", gap)).agg(kept).select("project_id", "last.*")


def _in_order(batches) -> pd.DataFrame:
    return pd.concat(list(batches), ignore_index=True).sort_values(["at_us", "seq"], kind="stable")


def _throttled(key, batches, state: GroupState):
    rows = _in_order(batches)
    last = state.get[0] if state.exists else None
    keep = []
    for at, kind in zip(rows.at_us, rows.type):
        hit = kind == "playback.seek" or last is None or at - last >= SCRUB_LOG_US
        last = at if hit else last
        keep.append(hit)
    state.update((int(last),))
    yield rows[keep]


def throttle(events: DataFrame) -> DataFrame:
    """Scrub rows at most once per interval, every seek; the state is one time per project."""
    picked = events.where(F.col("type").isin("playback.scrub", "playback.seek")).select("project_id", "seq", "at_us", "type")
    return picked.groupBy("project_id").applyInPandasWithState(
        _throttled, "project_id bigint, seq bigint, at_us bigint, type string", "last bigint", "append", GroupStateTimeout.NoTimeout
    )


def _paced(key, batches, state: GroupState):
    rows = _in_order(batches)
    x = state.get[0] if state.exists else MIN_INTERVAL_MS
    out = []
    for cost in rows.cost_ms:
        x = min(MAX_INTERVAL_MS, max(MIN_INTERVAL_MS, x * 0.6 + max(0.0, cost) * 0.4))
        out.append(x)
    state.update((float(x),))
    yield rows[["project_id", "seq"]].assign(interval_ms=out)


def adaptive_interval(costs: DataFrame) -> DataFrame:
    """The seek interval after each landed seek; the state is one number per project."""
    return costs.select("project_id", "seq", "at_us", "cost_ms").groupBy("project_id").applyInPandasWithState(
        _paced, "project_id bigint, seq bigint, interval_ms double", "interval double", "append", GroupStateTimeout.NoTimeout
    )


def _opened(key, batches, state: GroupState):
    rows = _in_order(batches)
    at, step, runs = state.get if state.exists else (None, None, 0)
    out = []
    for seq, now, kind in zip(rows.seq, rows.at_us, rows.step):
        if kind == "open":
            failed = step is not None and step != "finish" and now - at < STALE_US
            runs = runs + 1 if failed else 0
            out.append((key[0], seq, now, failed, step if failed else None, runs))
        at, step = int(now), kind
    state.update((at, step, int(runs)))
    yield pd.DataFrame(out, columns=["project_id", "seq", "at_us", "failed", "stage", "runs"])


def failed_opens(events: DataFrame) -> DataFrame:
    """Opens that found an unfinished one before them; the state is the last step per project."""
    return events.select("project_id", "seq", "at_us", "step").groupBy("project_id").applyInPandasWithState(
        _opened, "project_id bigint, seq bigint, at_us bigint, failed boolean, stage string, runs bigint",
        "at bigint, step string, runs bigint", "append", GroupStateTimeout.NoTimeout,
    )


def stream_replay(ops: DataFrame, clips: BucketedTable, checkpoint: str) -> StreamingQuery:
    """Keep timelines current from streamed edits: each batch reads, replays and rewrites only the buckets of the timelines it names.

    ``ops`` are prepared edit rows (``timeline_id, e``); the table holds prepared clips
    (``timeline_id, ord, c``) by timeline and has a first commit, numbered below 0.
    """

    def advance(batch: DataFrame, number: int) -> None:
        def replayed(held: DataFrame | None) -> DataFrame:
            if held is None:
                raise ValueError("stream_replay needs a first version of the clips")
            named = batch.select("timeline_id").distinct()
            done = replay_ops(held.join(named, "timeline_id", "left_semi"), batch).clips
            kind = held.schema["c"].dataType
            renewed = done.select("timeline_id", "ord", F.struct(*kind.fieldNames()).cast(kind).alias("c"))
            return held.join(named, "timeline_id", "left_anti").unionByName(renewed)

        batch.persist()
        try:
            clips.merge(number, batch.select("timeline_id"), replayed)
        finally:
            batch.unpersist()
        clips.expire()

    return ops.writeStream.foreachBatch(advance).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class _Waiting(StatefulProcessor):
    """Holds events until the watermark has passed all that can matter to them, then says when their work starts."""

    def __init__(self, gap_us: int, hold_us: int):
        self.gap, self.hold = gap_us, hold_us

    def init(self, handle) -> None:
        self.handle = handle
        self.events = handle.getListState("events", "at_us bigint, seq bigint")
        self.due = handle.getValueState("due", "at_ms bigint")

    def _wake(self, first_us: int) -> None:
        at = -(-(first_us + self.hold) // 1000)
        if not self.due.exists() or at < self.due.get()[0]:
            if self.due.exists():
                self.handle.deleteTimer(self.due.get()[0])
            self.handle.registerTimer(at)
            self.due.update((at,))

    def handleInputRows(self, key, rows, timerValues):
        first = None
        for part in rows:
            self.events.appendList(list(part[["at_us", "seq"]].itertuples(index=False, name=None)))
            first = int(part.at_us.min()) if first is None else min(first, int(part.at_us.min()))
        if first is not None:
            self._wake(first)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        held = np.array(sorted(self.events.get()), dtype=np.int64).reshape(-1, 2)
        at = held[:, 0]
        calm = np.where(np.r_[at[1:], np.iinfo(np.int64).max] - at >= self.gap, at + self.gap, np.iinfo(np.int64).max)
        starts = np.minimum(np.minimum.accumulate(calm[::-1])[::-1], at + self.hold)
        ready = at + self.hold <= timerValues.getCurrentWatermarkInMs() * 1000
        self.due.clear()
        if ready.all():
            self.events.clear()
        else:
            self.events.put([tuple(map(int, x)) for x in held[~ready]])
            self._wake(int(at[~ready][0]))
        yield pd.DataFrame({"project_id": key[0], "seq": held[ready, 1], "starts_us": starts[ready]})

    def close(self) -> None:
        pass


def quiet_gaps(events: DataFrame, late: str = "1 minute", gap_us: int = QUIET_US, hold_us: int = MAX_HOLD_US) -> DataFrame:
    """``timing.quiet_gaps`` on a stream (project_id, seq, at, at_us): when work asked for at each event starts.

    An event goes out once the watermark, ``late`` behind, has passed its longest wait, with whatever came late until then; only
    the events of the last ``hold_us`` and ``late`` are held. Needs the RocksDB state store.
    """
    rows = events.select("project_id", "seq", "at", "at_us").withWatermark("at", late)
    kind = events.schema["project_id"].dataType.simpleString()
    return rows.groupBy("project_id").transformWithStateInPandas(_Waiting(gap_us, hold_us), f"project_id {kind}, seq bigint, starts_us bigint", "append", "eventTime")


class _Reviewed(StatefulProcessor):
    """The verdicts of a project's open review, in the order of their numbers, until it closes or nobody touches it any more."""

    def __init__(self, idle_ms: int):
        self.idle = idle_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", "seq bigint, at_ms bigint, type string, ops bigint, index bigint, all_ops boolean, accepted boolean")
        self.open = handle.getValueState("open", "review_seq bigint, at_ms bigint, accepted array<boolean>")

    def handleInputRows(self, key, rows, timerValues):
        for part in rows:
            part = part.assign(at_ms=-(-part.at_us // 1000))[["seq", "at_ms", "type", "ops", "index", "all_ops", "accepted"]]
            whole = part.astype({"ops": "Int64", "index": "Int64"}).astype(object)  # a column with nulls comes as floats
            self.rows.appendList([tuple(None if pd.isna(x) else x for x in r) for r in whole.itertuples(index=False, name=None)])
            for at in part.at_ms.unique():
                self.handle.registerTimer(int(at))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        passed = timerValues.getCurrentWatermarkInMs()
        held = sorted((tuple(r) for r in self.rows.get()), key=lambda r: r[0])
        ready, left = [r for r in held if r[1] <= passed], [r for r in held if r[1] > passed]
        self.rows.clear()
        if left:
            self.rows.put(left)
        review, at, accepted = self.open.get() if self.open.exists() else (None, None, None)
        done = []
        for seq, now, kind, ops, index, every, said in ready:
            if kind != "llm.verdict":
                if review is not None:
                    done.append((review, accepted))
                review, accepted = (seq, [False] * int(ops or 0)) if kind == "llm.plan" else (None, None)
            elif review is not None:
                accepted = [bool(said) if every or i == index else x for i, x in enumerate(accepted)]
            at = now
        if review is not None and not ready and at + self.idle <= passed:
            done.append((review, accepted))
            review = None
        if review is None:
            self.open.clear()
        else:
            self.open.update((int(review), int(at), list(accepted)))
            self.handle.registerTimer(int(at) + self.idle)
        out = [(key[0], r, i, x) for r, own in done for i, x in enumerate(own)]
        if out:
            yield pd.DataFrame(out, columns=["project_id", "review_seq", "index", "accepted"])

    def close(self) -> None:
        pass


def current_verdicts(events: DataFrame, late: str = "1 minute", idle: int = 24 * 3_600_000) -> DataFrame:
    """``timing.current_verdicts`` on a stream (project_id, seq, at, at_us, type, ops, index, all_ops, accepted).

    A review's verdicts go out when the row that ends it is behind the watermark, or when nothing has been said in it for
    ``idle`` milliseconds of event time; the state holds one open review per project and the rows that may still be overtaken.
    """
    picked = events.where(F.col("type").isin("llm.plan", "llm.verdict", "llm.review"))
    rows = picked.select("project_id", "seq", "at", "at_us", "type", F.col("ops").cast("bigint"), F.col("index").cast("bigint"), "all_ops", "accepted").withWatermark("at", late)
    kind = events.schema["project_id"].dataType.simpleString()
    return rows.groupBy("project_id").transformWithStateInPandas(_Reviewed(idle), f"project_id {kind}, review_seq bigint, index bigint, accepted boolean", "append", "eventTime")

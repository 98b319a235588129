"""Keyed state: claims of queued work, a watcher that closes maintenance, and a cache of failures.

Each is a `transformWithState` operator. State is kept per key by the state store and committed with
the batch, so a stream that is stopped and resumed goes on where it was, and a batch that is run again
decides the same.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..session import ship

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def state_store(spark: SparkSession):
    """The state store that such operators need, while a stream is started; what was set before comes back."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def started(stream: DataFrame, path: str, checkpoint: str, **trigger):
    """Starts a stream into Parquet files, once per row, and gives its query. Without a trigger it takes what there is and ends."""
    spark = stream.sparkSession
    with state_store(spark):
        return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or {"availableNow": True})).start()


class Claims(StatefulProcessor):
    """queued: claimed, if it is not already or ready; failed: free again; finished: ready for good."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.status = handle.getValueState("status", "status string, times long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        status, times = self.status.get() if self.status.exists() else ("free", 0)
        out = []
        events = pd.concat(list(rows)).sort_values("seq", kind="stable")
        for seq, kind in zip(events["seq"], events["kind"], strict=True):
            if kind == "queued" and status == "free":
                status, times = "claimed", times + 1
                out.append((key[0], int(seq), times))
            elif status == "claimed" and kind in ("finished", "failed"):
                status = "ready" if kind == "finished" else "free"
        self.status.update((status, times))
        yield pd.DataFrame(out, columns=["folder", "seq", "attempt"])

    def close(self) -> None:
        pass


def claims(events: DataFrame) -> DataFrame:
    """Claims (folder, seq, attempt) of queue events (folder, seq, kind: queued, finished or failed): each folder once, until it fails.

    `seq` orders the events of a folder; events of a batch are sorted by it, and batches must come in that order.
    """
    ship(events.sparkSession)
    rows = events.selectExpr("cast(folder as string) as folder", "cast(seq as long) as seq", "cast(kind as string) as kind").filter("folder IS NOT NULL")
    return rows.groupBy("folder").transformWithStateInPandas(Claims(), "folder string, seq long, attempt long", "append", "none")


class Watcher(StatefulProcessor):
    """Counts the active work of a maintenance run; a timer closes it when none has been active for a while."""

    def __init__(self, grace_ms: int):
        self.grace = grace_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", "active long, done long, last_ms long, timer_ms long, closed boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        active, done, last, timer, closed = self.run.get() if self.run.exists() else (0, 0, 0, 0, False)
        for batch in rows:
            active += int(batch["change"].sum())
            done += int((batch["change"] < 0).sum())
            last = max(last, int(batch["ts"].max().timestamp() * 1000))
        if timer:
            self.handle.deleteTimer(timer)
            timer = 0
        if active == 0 and not closed:
            # Not before the watermark, or the timer would never fire.
            timer = max(last + self.grace, timerValues.getCurrentWatermarkInMs() + 1)
            self.handle.registerTimer(timer)
        self.run.update((active, done, last, timer, closed))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        active, done, last, _, closed = self.run.get()
        out = []
        if active == 0 and not closed:
            out.append((key[0], last, done))
        self.run.update((active, done, last, 0, closed or bool(out)))
        yield pd.DataFrame(out, columns=["maintenance_id", "last_ms", "done"])

    def close(self) -> None:
        pass


def closed_maintenance(events: DataFrame, grace_seconds: int = 60, late: str = "0 seconds") -> DataFrame:
    """Maintenance runs (maintenance_id, completed_at, done), once each, when no work of theirs has been active for `grace_seconds`.

    Events are (maintenance_id, ts, change): 1 for work that is queued, -1 for work that is over. Time
    is that of the events: a run closes as soon as the watermark, `late` behind them, has passed its last event by the grace.
    """
    ship(events.sparkSession)
    rows = events.selectExpr("cast(maintenance_id as long) as maintenance_id", "cast(ts as timestamp) as ts", "cast(change as int) as change").filter("maintenance_id IS NOT NULL AND ts IS NOT NULL")
    kept = rows.withWatermark("ts", late).groupBy("maintenance_id")
    closed = kept.transformWithStateInPandas(Watcher(grace_seconds * 1000), "maintenance_id long, last_ms long, done long", "append", "eventTime")
    return closed.selectExpr("maintenance_id", "timestamp_millis(last_ms) as completed_at", "done")


class Cache(StatefulProcessor):
    """A success is remembered for good, a failure as long as the store keeps it."""

    def __init__(self, ttl_ms: int):
        self.ttl = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.good = handle.getValueState("good", "steps string")
        self.bad = handle.getValueState("bad", "seq long", ttlDurationMs=self.ttl)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events, out = pd.concat(list(rows)).sort_values("seq", kind="stable"), []
        for seq, steps in zip(events["seq"], events["steps"], strict=True):
            if self.good.exists():
                out.append((key[0], int(seq), "cached", self.good.get()[0]))
            elif self.bad.exists():
                out.append((key[0], int(seq), "held", None))
            else:
                if steps:
                    self.good.update((steps,))
                else:
                    self.bad.update((int(seq),))
                out.append((key[0], int(seq), "fetched", steps or None))
        yield pd.DataFrame(out, columns=["run_str", "seq", "answer", "steps"])

    def close(self) -> None:
        pass


def cached_listings(asked: DataFrame, ttl_seconds: float = 60) -> DataFrame:
    """Asks (run_str, seq, steps) with what a fetch would give (null or empty: a failure), and the answer: fetched, cached or held.

    Its clock goes on without input, so its stream needs a trigger by processing time, and a stop. A run that failed isn't fetched again while the state store keeps its failure, by the clock; one that succeeded never is.
    """
    ship(asked.sparkSession)
    rows = asked.selectExpr("cast(run_str as string) as run_str", "cast(seq as long) as seq", "cast(steps as string) as steps").filter("run_str IS NOT NULL")
    return rows.groupBy("run_str").transformWithStateInPandas(Cache(round(ttl_seconds * 1000)), "run_str string, seq long, answer string, steps string", "append", "processingTime")

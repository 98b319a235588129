"""Streams: job progress, the work queue and its watchers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import catalog


def parsed(lines: DataFrame) -> DataFrame:
    """Lines (key, seq, line) that report progress, with stage, detail and percent; all others are dropped."""
    return lines.withColumn("p", text.progress_parts("line")).filter("p is not null").select("key", "seq", "p.stage", "p.detail", "p.percent")


def latest(lines: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """The last report of each key, of registered keys only if they are given. Works on a stream in update or complete mode."""
    reports = parsed(lines)
    if known is not None:
        reports = reports.join(known.select("key"), "key", "left_semi")
    return reports.groupBy("key").agg(F.max_by(F.struct("stage", "detail", "percent"), "seq").alias("r")).select("key", "r.stage", "r.detail", "r.percent")


def tee(lines: DataFrame, path: str, checkpoint: str):
    """Writes all lines to text files as they come."""
    return lines.select(F.concat_ws("\t", "key", "line").alias("value")).writeStream.format("text").option("path", path).option("checkpointLocation", checkpoint)


def drain(pending: DataFrame, work: Callable[[DataFrame], None], checkpoint: str):
    """Runs `work` once for each micro-batch of queued rows; with AvailableNow it ends when the queue is empty.

    A batch that is run again after a failure meets rows that its first run has finished, so `work`
    should leave those alone (`catalog.claim` takes only pending rows).
    """
    return pending.writeStream.foreachBatch(lambda batch, _: work(batch)).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def close_maintenance(finished: DataFrame, load: Callable[[], tuple[DataFrame, DataFrame]], save: Callable[[DataFrame], None], now: Callable[[], object], checkpoint: str):
    """After each batch of finished tasks, closes maintenance rows without active sets. `load` gives (maintenance, tilesets)."""

    def check(batch: DataFrame, _: int) -> None:
        maintenance, tilesets = load()
        save(catalog.completed(maintenance, tilesets, F.lit(now()).cast("timestamp")))

    return finished.writeStream.foreachBatch(check).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def cadence(events: DataFrame, time: str = "ts", watermark: str = "3 hours") -> DataFrame:
    """Events counted by three-hour run, on a stream or a table."""
    timed = events.withWatermark(time, watermark) if events.isStreaming else events
    return timed.groupBy(F.window(time, "3 hours").alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("run_ts"), "n")

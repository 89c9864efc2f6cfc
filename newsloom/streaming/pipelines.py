"""Micro-batch pipelines: candidates, feed health, wire snapshots. All take their clock from the data.

Each runs with ``trigger(availableNow=True)`` where the reference schedule is a cron job, and keeps its
state in the checkpoint, so a restart goes on where it stopped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from newsloom.functions.urls import url_key
from newsloom.operators.archive import DEAD_AFTER

HEALTH = "feed string, total_runs long, consecutive_failures long, last_ok timestamp, last_error string, dead boolean"
STATE = "total long, streak long, last_ok timestamp, last_error string"


def first_seen(items: DataFrame, delay: str = "20 days", time_col: str = "published_at") -> DataFrame:
    """The first arrival of each URL; keys are forgotten behind the watermark."""
    return items.withColumn("url_key", url_key(F.col("url"))).where("url_key <> ''").withWatermark(time_col, delay).dropDuplicatesWithinWatermark(["url_key"])


def _update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    total, streak, last_ok, last_error = state.get if state.exists else (0, 0, None, None)
    for pdf in frames:
        for at, ok, error in pdf.sort_values("run_at")[["run_at", "ok", "error"]].itertuples(index=False):
            total += 1
            streak = 0 if ok else streak + 1
            last_ok, last_error = (at, last_error) if ok else (last_ok, error)
    state.update((total, streak, last_ok, last_error))
    yield pd.DataFrame({"feed": [key[0]], "total_runs": [total], "consecutive_failures": [streak], "last_ok": [last_ok], "last_error": [last_error], "dead": [streak >= DEAD_AFTER]})


def feed_health(runs: DataFrame) -> DataFrame:
    """Running health of each feed: feed, run_at, ok, error in; one row a feed and batch out."""
    return runs.groupBy("feed").applyInPandasWithState(_update, HEALTH, STATE, "update", GroupStateTimeout.NoTimeout)


class FeedWatch(StatefulProcessor):
    """A feed's totals, streak and last run, with a timer behind its last run: first it is silent, later forgotten."""

    def __init__(self, silence_ms: int, forget_ms: int, dead_after: int):
        self.silence_ms, self.forget_ms, self.dead_after = silence_ms, forget_ms, dead_after

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("feed", "total long, streak long, last_ok long, last_error string, last_run long, silent boolean")

    def _row(self, feed: str) -> pd.DataFrame:
        total, streak, last_ok, last_error, last_run, silent = self.state.get()
        return pd.DataFrame({"feed": [feed], "total_runs": [total], "consecutive_failures": [streak], "last_ok": pd.array([last_ok], "Int64"), "last_error": [last_error], "last_run": [last_run], "silent": [silent], "dead": [silent or streak >= self.dead_after]})

    def _timer(self, at: int) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(at)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        total, streak, last_ok, last_error, last_run, _ = self.state.get() if self.state.exists() else (0, 0, None, None, 0, False)
        runs = pd.concat(list(rows)).sort_values("at")  # one feed's runs of one batch
        for at, ok, error in runs[["at", "ok", "error"]].itertuples(index=False):
            total, streak, last_run = total + 1, 0 if ok else streak + 1, max(last_run, int(at))
            last_ok, last_error = (int(at), last_error) if ok else (last_ok, error)
        self.state.update((total, streak, last_ok, last_error, last_run, False))
        self._timer(last_run + self.silence_ms)
        yield self._row(key[0])

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.state.exists():
            return
        held = self.state.get()
        if held[5]:
            self.state.clear()
            return
        self.state.update((*held[:5], True))
        self.handle.registerTimer(held[4] + self.forget_ms)
        yield self._row(key[0])

    def close(self) -> None:
        pass


def feed_watch(runs: DataFrame, silence_hours: float = 24, forget_hours: float = 24 * 14, delay: str = "1 hour", dead_after: int = DEAD_AFTER) -> DataFrame:
    """Health of each feed with silence counted: feed, run_at, ok, error in; a row a feed and batch, and one when it falls silent.

    A feed that has not reported for ``silence_hours`` behind its last run, by the watermark of all feeds, is dead; after ``forget_hours`` its
    state goes, and a feed that comes back then starts anew. Needs the state store that keeps timers, which is set here.
    """
    runs.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    told = runs.withWatermark("run_at", delay).withColumn("at", F.unix_millis("run_at"))
    watch = FeedWatch(int(silence_hours * 3.6e6), int(forget_hours * 3.6e6), dead_after)
    found = told.groupBy("feed").transformWithStateInPandas(watch, "feed string, total_runs long, consecutive_failures long, last_ok long, last_error string, last_run long, silent boolean, dead boolean", "Update", "EventTime")
    return found.withColumns({c: F.timestamp_millis(c) for c in ("last_ok", "last_run")})


def windowed_counts(events: DataFrame, length: str = "6 hours", delay: str = "1 hour", time_col: str = "ts", by: str = "event_type") -> DataFrame:
    """Items of each cadence window by kind, once the watermark has passed the window."""
    return events.withWatermark(time_col, delay).groupBy(F.window(time_col, length), by).agg(F.count("*").alias("n"))


def run_once(df: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None], mode: str = "append") -> StreamingQuery:
    """Process what has arrived, batch by batch, and stop."""
    query = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start()
    query.awaitTermination()
    return query


def snapshot_sink(path: str, date_col: str = "date") -> Callable[[DataFrame, int], None]:
    """A sink that replaces the dates of each batch; writing a batch twice changes nothing."""

    def write(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(date_col).parquet(path)

    return write


def read_new(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    """A folder of landed Parquet files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)

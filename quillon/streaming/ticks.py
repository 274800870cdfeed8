"""Structured Streaming forms of the tick operators: minute bars, streak sessions, running means, upserts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def event_stream(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files).parquet(path)


def minute_bars(events: DataFrame, late: str = "10 minutes", size: str = "1 minute") -> DataFrame:
    """Bars per user and window; a window closes when the watermark passes it, so that state is bounded by lateness."""
    w = F.window("ts", size)
    order = F.struct("ts", "event_id")
    return events.withWatermark("ts", late).groupBy("user_id", w).agg(
        F.min_by("value", order).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", order).alias("close"), F.count("*").alias("n"), F.sum("value").alias("total")
    ).select("user_id", F.col("window.start").alias("minute"), "open", "high", "low", "close", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Runs of events of a user with no pause longer than ``gap``."""
    w = F.session_window("ts", gap)
    return events.withWatermark("ts", late).groupBy("user_id", w).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("stop"), "n", "total")


def running_mean(events: DataFrame, alpha: float) -> DataFrame:
    """Exponentially weighted mean per user with one number of state; a row per event, in order within each batch."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (y,) = state.get if state.exists else (None,)
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        out = []
        for i, v in zip(rows["event_id"], rows["value"], strict=True):
            y = float(v) if y is None else (1 - alpha) * y + alpha * float(v)
            out.append((i, key[0], y))
        state.update((y,))
        yield pd.DataFrame(out, columns=["event_id", "user_id", "ewm"])

    return events.groupBy("user_id").applyInPandasWithState(step, "event_id bigint, user_id bigint, ewm double", "y double", "append", GroupStateTimeout.NoTimeout)


STREAK = "user_id bigint, event_id bigint, ts timestamp, up int, down int"


class Streaks(StatefulProcessor):
    """How many of a user's last events in a row rose, or fell, each above or below the one before.

    State is the last value, its time and the two counts. A pause longer than
    ``idle`` starts anew, so a timer drops the state of a user who has been idle
    for as long: what is kept is bounded by the users of the last ``idle``.
    """

    def __init__(self, idle: pd.Timedelta):
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "value double, at timestamp, up int, down int")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        own = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        value, at, up, down = self.last.get() if self.last.exists() else (None, None, 0, 0)
        out = []
        for i, ts, v in zip(own["event_id"], own["ts"], own["value"], strict=True):
            if value is None or ts - pd.Timestamp(at) > self.idle:
                up = down = 0
            else:
                up, down = (up + 1 if v > value else 0), (down + 1 if v < value else 0)
            value, at = float(v), ts
            out.append((key[0], i, ts, up, down))
        self.last.update((value, at.to_pydatetime(), up, down))
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(int(at.timestamp() * 1000) + int(self.idle.total_seconds() * 1000) + 1)
        yield pd.DataFrame(out, columns=["user_id", "event_id", "ts", "up", "down"]).astype({"up": "int32", "down": "int32"})

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def streaks(events: DataFrame, idle: str = "12 hours", late: str = "1 hour") -> DataFrame:
    """A row per event with its streaks. Events come in order of time from batch to batch; within one in any order.

    Needs the RocksDB state store, which this sets for the session's next streams.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return events.select("user_id", "event_id", "ts", "value").withWatermark("ts", late).groupBy("user_id").transformWithStateInPandas(Streaks(pd.Timedelta(idle)), STREAK, "Append", "EventTime")


def collect_once(stream: DataFrame, checkpoint: str, path: str) -> None:
    """Runs over what is there now and stops; started again with the same checkpoint, it takes only what is new."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start().awaitTermination()

"""Debouncing with named state variables, timers and times to live, in a RocksDB state store."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from .events import with_event_time

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def large_state(spark: SparkSession):
    """Streams started inside keep their state on the executors' disks, with
    changes in the checkpoint, so that state may outgrow memory."""
    was = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, was)


class Debouncer(StatefulProcessor):
    """Per key the time of the last event kept and how many were kept.

    State goes ``forget_ms`` of event time after the last event kept, by a
    timer; or, if ``ttl_ms`` is set, so long after it was last written by the
    clock, as the store's own time to live."""

    def __init__(self, gap_micros: int, forget_ms: int, ttl_ms: int | None):
        self.gap, self.forget, self.ttl = gap_micros, max(forget_ms, -(-gap_micros // 1000)), ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "t bigint", self.ttl)
        self.kept = handle.getValueState("kept", "n bigint", self.ttl)

    def _hold(self, last: int, kept: int, now_ms: int) -> None:
        self.last.update((last,))
        self.kept.update((kept,))
        if self.ttl is None:
            for timer in self.handle.listTimers():
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(max(last // 1000, now_ms) + self.forget)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        self._hold(int(initialState["t"].max()), int(initialState["n"].sum()), 0 if self.ttl else timerValues.getCurrentWatermarkInMs())

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values(["t", "o"])
        last = self.last.get()[0] if self.last.exists() else None
        n = self.kept.get()[0] if self.kept.exists() else 0
        out = []
        for t, o in frame[["t", "o"]].itertuples(index=False):
            if last is None or t - last >= self.gap:
                last, n = int(t), n + 1
                out.append((key[0], int(o), n))
        self._hold(int(last), n, 0 if self.ttl else timerValues.getCurrentWatermarkInMs())
        yield pd.DataFrame(out, columns=["k", "o", "n"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        self.kept.clear()
        yield pd.DataFrame([], columns=["k", "o", "n"]).astype({"k": str, "o": "int64", "n": "int64"})

    def close(self) -> None:
        pass


def debounce(events: DataFrame, key: str, ts: str, order: str, gap_micros: int, forget_ms: int = 5000, ttl_ms: int | None = None, initial: DataFrame | None = None) -> DataFrame:
    """``(key, order, kept_no)``: the events at least ``gap_micros`` after the last one
    kept for their key, and the number of events kept for it since its state began.

    ``initial`` (key, t in microseconds, n) is where keys start from, for
    instance what an earlier stream had kept. Inside a micro-batch events go by
    time. Start the stream inside ``large_state``. With ``ttl_ms`` the clock may
    always call for another batch: give such a stream a trigger of its own
    (``once`` or an interval), as "all there is" does not end.
    """
    timed = with_event_time(events, ts).select(F.col(key).cast("string").alias("k"), F.unix_micros(ts).alias("t"), F.col(order).cast("long").alias("o"), ts)
    start = None if initial is None else initial.select(F.col(key).cast("string").alias("k"), F.col("t").cast("long"), F.col("n").cast("long")).groupBy("k")
    mode = "EventTime" if ttl_ms is None else "ProcessingTime"
    out = timed.groupBy("k").transformWithStateInPandas(Debouncer(gap_micros, forget_ms, ttl_ms), "k string, o bigint, n bigint", "append", mode, start)
    return out.select(F.col("k").alias(key), F.col("o").alias(order), F.col("n").alias("kept_no"))

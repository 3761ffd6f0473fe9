"""Streams whose events come in any order, and anomalies against the mean of a closed window."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class OrderedPairs(StatefulProcessor):
    """Holds the events of a series until the watermark has passed them, then pairs states ``tau`` events apart.

    ``waiting`` has (at, tie, state) of events that earlier ones may still precede, ``past`` the last ``tau`` states that
    went out. A timer at the first waiting event lets series without further input go on as well.
    """

    def __init__(self, tau: int):
        self.tau = tau

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, tie long, state long")
        self.past = handle.getListState("past", "state long")

    def released(self, fresh: list[tuple[int, int, int]], watermark: int) -> Iterator[pd.DataFrame]:
        """Pairs of what lies at or before the watermark (ms); later rows at or before it do not come any more."""
        held = sorted([tuple(r) for r in self.waiting.get()] + fresh) if self.waiting.exists() else sorted(fresh)
        ready = [r for r in held if r[0] <= watermark * 1000]
        rest = held[len(ready) :]
        if ready:
            past = [r[0] for r in self.past.get()] if self.past.exists() else []
            seen = past + [r[2] for r in ready]
            self.past.put([(s,) for s in seen[-self.tau :]])
            if len(seen) > self.tau:
                yield pd.DataFrame({"i": seen[: -self.tau], "j": seen[self.tau :]}, dtype="int64")
        if rest:
            self.waiting.put(rest)
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(-(-rest[0][0] // 1000))
        elif self.waiting.exists():
            self.waiting.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fresh = [(int(a), int(b), int(c)) for pdf in rows for a, b, c in zip(pdf["at"], pdf["tie"], pdf["state"], strict=True)]
        yield from self.released(fresh, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self.released([], timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def transition_pairs(events: DataFrame, delay: str, tau: int = 1, by: str = "series", time: str = "ts", tie: str = "event_id", state: str = "mem") -> DataFrame:
    """(i, j) of a stream whose events come in any order: states ``tau`` events apart in a series, ordered by ``time``, then
    ``tie``. An event counts once the watermark, ``delay`` behind the latest time, has reached it; events that come later
    than that are left out, as are those without time or state. Needs the RocksDB state store, which this sets."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    rows = events.filter(F.col(time).isNotNull() & F.col(state).isNotNull()).withWatermark(time, delay)
    rows = rows.select(F.col(by).cast("long").alias("series"), time, F.unix_micros(time).alias("at"), F.col(tie).cast("long").alias("tie"), F.col(state).cast("long").alias("state"))
    return rows.groupBy("series").transformWithStateInPandas(OrderedPairs(tau), "i long, j long", "append", "EventTime")


def anomalies(events: DataFrame, window: str, delay: str, by: str = "node", time: str = "ts", value: str = "value") -> DataFrame:
    """The rows of a stream with ``anomaly``, the value less the mean of its window (and ``by``), once that is closed: a join
    of the stream with its own windowed means, both under one watermark, so that neither side is held longer than that."""
    rows = events.withWatermark(time, delay).withColumn("window", F.window(time, window))
    means = events.select(by, time, value).withWatermark(time, delay).groupBy(F.window(time, window).alias("window"), by).agg(F.avg(value).alias("mean"))
    return rows.join(means, ["window", by]).withColumn("anomaly", F.col(value) - F.col("mean")).drop("window", "mean")

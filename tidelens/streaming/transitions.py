"""Streaming forms: transition pairs with per-series state, and windowed anomalies."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidelens.functions.storage import WRITTEN, checkpoint_dir


def transition_pairs(events: DataFrame, tau: int = 1, by: str = "series", order: str = "t", state: str = "mem") -> DataFrame:
    """(i, j) of a stream: states ``tau`` events apart in a series; the last tau states of each series are its state.

    Events of a series must arrive in order from one micro-batch to the next; within one they are sorted.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(order, kind="stable")
        past = list(held.get[0]) if held.exists else []
        seen = past + [int(x) for x in rows[state]]
        held.update((seen[-tau:],))
        yield pd.DataFrame({"i": seen[:-tau], "j": seen[tau:]}, dtype="int64")

    rows = events.select(F.col(by).cast("long").alias(by), F.col(order).alias(order), F.col(state).cast("long").alias(state)).filter(f"{state} is not null")
    return rows.groupBy(by).applyInPandasWithState(run, "i long, j long", "past array<long>", "append", GroupStateTimeout.NoTimeout)


def windowed_anomaly(events: DataFrame, window: str = "6 hours", delay: str = "1 hour", by: str = "node", time: str = "ts", value: str = "value") -> DataFrame:
    """(start, node, mean, n): means of closed windows of a stream, late rows beyond ``delay`` left out; the anomaly of a
    row is its value less the mean of its window."""
    w = events.withWatermark(time, delay).groupBy(F.window(time, window), by).agg(F.avg(value).alias("mean"), F.count("*").alias("n"))
    return w.select(F.col("window.start").alias("start"), by, "mean", "n")


def run_available(stream: DataFrame, schema: str, name: str) -> DataFrame:
    """All that is available now, through a parquet sink in the shared folder, read back."""
    spark = stream.sparkSession
    root = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    WRITTEN.add(root)
    stream.writeStream.format("parquet").option("path", f"{root}/data").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(schema).parquet(f"{root}/data")

"""Totals per key and window of time, kept in state of our own."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from larkbeam.functions.times import utc_wall

_STATE = "n bigint, cents bigint, top_cents bigint, hours int"


def _add(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    name, window_end, shard = key
    n, cents, top, hours = state.get if state.exists else (0, 0, 0, 0)
    if state.hasTimedOut:
        state.remove()
        row = (name, window_end, shard, n, cents, top, hours)
        names = ["key", "window_end", "shard", "n", "cents", "top_cents", "hours"]
        yield pd.DataFrame([row], columns=names)
        return
    for batch in batches:
        n += len(batch)
        cents += int(batch["cents"].sum())
        top = max(top, int(batch["cents"].max()))
        hours |= int(np.bitwise_or.reduce(batch["hour_bit"].to_numpy()))
    state.update((n, cents, top, hours))
    state.setTimeoutTimestamp(int(window_end))


def totals_per_window(
    events: DataFrame, key: str, window: str, delay: str, shards: int
) -> DataFrame:
    """Count, cents, top value and busy hours per key and window, once it is over.

    The state of a key and window is kept in ``shards`` parts, so that a key
    with much of the stream does not load one task; ``merge_shards`` joins the
    parts. The state is a few numbers however many rows there are, and rows are
    taken in batch by batch.
    """
    rows = events.withWatermark("ts", delay).select(
        F.col(key).alias("key"),
        F.unix_millis(F.window("ts", window)["end"]).alias("window_end"),
        F.pmod("event_id", F.lit(shards)).cast("int").alias("shard"),
        F.round(F.col("value") * 100).cast("bigint").alias("cents"),
        F.call_function("shiftleft", F.lit(1), F.hour(utc_wall(F.col("ts")))).alias("hour_bit"),
        "ts",
    )
    output = f"key {events.schema[key].dataType.simpleString()}, window_end bigint, shard int, {_STATE}"
    return rows.groupBy("key", "window_end", "shard").applyInPandasWithState(
        _add, output, _STATE, "append", GroupStateTimeout.EventTimeTimeout
    )


def merge_shards(parts: DataFrame, key: str) -> DataFrame:
    window_end = F.timestamp_millis("window_end").alias("window_end")
    return parts.groupBy(F.col("key").alias(key), window_end).agg(
        F.sum("n").alias("n"),
        F.sum("cents").alias("cents"),
        F.max("top_cents").alias("top_cents"),
        F.bit_or("hours").alias("hours"),
    )

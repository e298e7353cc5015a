"""Streams over the event table, run until the table is used up.

A stream appends a window once the watermark has passed its end, so the last
windows of the table stay in state. The oracles leave these out too, but for the
queries that add what is in state at the end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkbeam.functions.money import money
from larkbeam.functions.times import utc_wall
from larkbeam.plans.registry import query
from larkbeam.session import scratch_path, setting
from larkbeam.sources.tables import table
from larkbeam.streaming.jobs import drained, event_stream, left_open
from larkbeam.streaming.totals import merge_shards, totals_per_window

VALUE = "CAST(value AS DECIMAL(12,2))"
_CLOSED = "(SELECT max(ts) FROM events) - INTERVAL 1 HOUR"


def _total():
    return F.sum(money("value")).cast("double").alias("total")


@query(
    "stream_tumbling",
    f"""
    SELECT * FROM (
      SELECT event_type, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS window_start,
        count(*) AS n, CAST(sum({VALUE}) AS DOUBLE) AS total
      FROM events GROUP BY ALL)
    WHERE window_start + INTERVAL 6 HOUR <= {_CLOSED}
    """,
)
def tumbling(spark: SparkSession, d: str) -> DataFrame:
    windows = (
        event_stream(spark, d)
        .withWatermark("ts", "1 hour")
        .groupBy(F.window("ts", "6 hours"), "event_type")
        .agg(F.count("*").alias("n"), _total())
    )
    rows = drained(windows, "tumbling")
    return rows.select(
        "event_type", utc_wall(F.col("window.start")).alias("window_start"), "n", "total"
    )


@query(
    "stream_sliding",
    f"""
    SELECT * FROM (
      SELECT first + INTERVAL 6 HOUR * CAST(k AS INTEGER) AS window_start, count(*) AS n,
        CAST(sum({VALUE}) AS DOUBLE) AS total
      FROM (SELECT *, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') - INTERVAL 18 HOUR
              AS first FROM events), range(4) AS t(k)
      GROUP BY ALL)
    WHERE window_start + INTERVAL 1 DAY <= {_CLOSED}
    """,
)
def sliding(spark: SparkSession, d: str) -> DataFrame:
    windows = (
        event_stream(spark, d)
        .withWatermark("ts", "1 hour")
        .groupBy(F.window("ts", "1 day", "6 hours"))
        .agg(F.count("*").alias("n"), _total())
    )
    rows = drained(windows, "sliding")
    return rows.select(utc_wall(F.col("window.start")).alias("window_start"), "n", "total")


@query(
    "stream_sessions",
    f"""
    WITH gaps AS (
      SELECT *, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS gap FROM events),
    numbered AS (
      SELECT *, sum(CASE WHEN gap < INTERVAL 6 HOUR THEN 0 ELSE 1 END)
        OVER (PARTITION BY user_id ORDER BY ts) AS session_no FROM gaps)
    SELECT user_id, min(ts) AS session_start, max(ts) AS last_event, count(*) AS n,
      CAST(sum({VALUE}) AS DOUBLE) AS total
    FROM numbered GROUP BY user_id, session_no
    HAVING max(ts) + INTERVAL 6 HOUR <= {_CLOSED}
    """,
)
def user_sessions(spark: SparkSession, d: str) -> DataFrame:
    windows = (
        event_stream(spark, d)
        .withWatermark("ts", "1 hour")
        .groupBy("user_id", F.session_window("ts", "6 hours"))
        .agg(F.count("*").alias("n"), _total(), F.max("ts").alias("last_event"))
    )
    # rows of a session are merged before the shuffle, as one user may have very many
    with setting(spark, "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true"):
        rows = drained(windows, "sessions")
    return rows.select(
        "user_id",
        utc_wall(F.col("session_window.start")).alias("session_start"),
        utc_wall(F.col("last_event")).alias("last_event"),
        "n",
        "total",
    )


@query("stream_deduplicated", "SELECT event_id, ts, user_id, event_type, value FROM events")
def events_delivered_twice(spark: SparkSession, d: str) -> DataFrame:
    columns = ["event_id", "ts", "user_id", "event_type", "value"]
    twice = event_stream(spark, d).union(event_stream(spark, d)).select(*columns)
    once = twice.withWatermark("ts", "1 hour").dropDuplicatesWithinWatermark(["event_id"])
    return drained(once, "deduplicated").withColumn("ts", utc_wall(F.col("ts")))


@query(
    "stream_table_join",
    f"""
    SELECT * FROM (
      SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS window_start, c_mktsegment, count(*) AS n,
        CAST(sum({VALUE}) AS DOUBLE) AS total
      FROM events JOIN customer ON user_id = c_custkey GROUP BY ALL)
    WHERE window_start + INTERVAL 1 DAY <= {_CLOSED}
    """,
)
def events_by_customer_segment(spark: SparkSession, d: str) -> DataFrame:
    customers = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    windows = (
        event_stream(spark, d)
        .withWatermark("ts", "1 hour")
        .join(customers, F.col("user_id") == F.col("c_custkey"))
        .groupBy(F.window("ts", "1 day"), "c_mktsegment")
        .agg(F.count("*").alias("n"), _total())
    )
    rows = drained(windows, "segments")
    return rows.select(
        utc_wall(F.col("window.start")).alias("window_start"), "c_mktsegment", "n", "total"
    )


@query(
    "stream_stream_join",
    """
    SELECT p.event_id AS purchase_id, e.event_id AS error_id, p.user_id
    FROM events p JOIN events e ON p.user_id = e.user_id
      AND e.ts >= p.ts AND e.ts < p.ts + INTERVAL 6 HOUR
    WHERE p.event_type = 'purchase' AND e.event_type = 'error'
    """,
)
def errors_after_purchase(spark: SparkSession, d: str) -> DataFrame:
    purchases = (
        event_stream(spark, d)
        .where(F.col("event_type") == "purchase")
        .select(F.col("event_id").alias("purchase_id"), "user_id", F.col("ts").alias("bought"))
        .withWatermark("bought", "1 hour")
    )
    errors = (
        event_stream(spark, d)
        .where(F.col("event_type") == "error")
        .select(F.col("event_id").alias("error_id"), F.col("user_id").alias("by"), F.col("ts").alias("failed"))
        .withWatermark("failed", "1 hour")
    )
    after = (
        (F.col("user_id") == F.col("by"))
        & (F.col("failed") >= F.col("bought"))
        & (F.col("failed") < F.col("bought") + F.expr("INTERVAL 6 HOURS"))
    )
    pairs = purchases.join(errors, after)
    return drained(pairs.select("purchase_id", "error_id", "user_id"), "pairs")


@query(
    "stream_own_state",
    f"""
    SELECT * FROM (
      SELECT event_type, time_bucket(INTERVAL 12 HOUR, ts, TIMESTAMP '1970-01-01') + INTERVAL 12 HOUR
          AS window_end, count(*) AS n, CAST(sum(round(value * 100)) AS BIGINT) AS cents,
        CAST(max(round(value * 100)) AS BIGINT) AS top_cents,
        CAST(count(DISTINCT hour(ts)) AS INTEGER) AS busy_hours
      FROM events GROUP BY ALL)
    WHERE window_end <= {_CLOSED}
    """,
)
def totals_in_own_state(spark: SparkSession, d: str) -> DataFrame:
    shards = spark.sparkContext.defaultParallelism  # as many tasks as a single key may load
    parts = totals_per_window(event_stream(spark, d), "event_type", "12 hours", "1 hour", shards)
    totals = merge_shards(drained(parts, "totals"), "event_type")
    return totals.select(
        "event_type",
        utc_wall(F.col("window_end")).alias("window_end"),
        "n",
        "cents",
        "top_cents",
        F.bit_count("hours").alias("busy_hours"),
    )


@query(
    "stream_tumbling_whole",
    f"""
    SELECT event_type, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS window_start,
      count(*) AS n, CAST(sum({VALUE}) AS DOUBLE) AS total,
      time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') + INTERVAL 6 HOUR > {_CLOSED} AS still_open
    FROM events GROUP BY ALL
    """,
)
def tumbling_with_open_windows(spark: SparkSession, d: str) -> DataFrame:
    """Windows that are over, as appended, and those still open, from the state of the stream."""
    windows = (
        event_stream(spark, d)
        .withWatermark("ts", "1 hour")
        .groupBy(F.window("ts", "6 hours"), "event_type")
        .agg(F.count("*").alias("n"), F.sum(money("value")).alias("total"))
    )
    path = scratch_path(spark, "tumbling")
    over = drained(windows, "tumbling", path).select("event_type", "window.start", "n", "total", F.lit(False).alias("still_open"))
    held = left_open(spark, path).select(
        "key.event_type", "key.window.start", F.col("value.count").alias("n"), F.col("value.sum").alias("total"), F.lit(True)
    )
    return over.union(held).select(
        "event_type", utc_wall(F.col("start")).alias("window_start"), "n", F.col("total").cast("double").alias("total"), "still_open"
    )


@query(
    "stream_sessions_whole",
    f"""
    WITH gaps AS (
      SELECT *, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS gap FROM events),
    numbered AS (
      SELECT *, sum(CASE WHEN gap < INTERVAL 6 HOUR THEN 0 ELSE 1 END)
        OVER (PARTITION BY user_id ORDER BY ts) AS session_no FROM gaps)
    SELECT user_id, min(ts) AS session_start, max(ts) AS last_event, count(*) AS n,
      CAST(sum({VALUE}) AS DOUBLE) AS total, max(ts) + INTERVAL 6 HOUR > {_CLOSED} AS still_open
    FROM numbered GROUP BY user_id, session_no
    """,
)
def sessions_with_open_ones(spark: SparkSession, d: str) -> DataFrame:
    """Sessions that are over, and those still open at the end of the table."""
    windows = (
        event_stream(spark, d)
        .withWatermark("ts", "1 hour")
        .groupBy("user_id", F.session_window("ts", "6 hours"))
        .agg(F.count("*").alias("n"), F.sum(money("value")).alias("total"), F.max("ts").alias("last_event"))
    )
    path = scratch_path(spark, "sessions")
    with setting(spark, "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true"):
        over = drained(windows, "sessions", path)
    over = over.select("user_id", "session_window.start", "last_event", "n", "total", F.lit(False).alias("still_open"))
    held = left_open(spark, path).select(
        "value.user_id", "value.session_window.start", F.col("value.max").alias("last_event"),
        F.col("value.count").alias("n"), F.col("value.sum").alias("total"), F.lit(True),
    )
    return over.union(held).select(
        "user_id", utc_wall(F.col("start")).alias("session_start"), utc_wall(F.col("last_event")).alias("last_event"),
        "n", F.col("total").cast("double").alias("total"), "still_open",
    )

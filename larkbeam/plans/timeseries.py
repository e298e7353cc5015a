"""Events in time: windows, sessions and gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkbeam.functions.money import money
from larkbeam.operators import timeseries
from larkbeam.operators.sessions import sessions
from larkbeam.plans.registry import query
from larkbeam.sources.tables import table

VALUE = "CAST(value AS DECIMAL(12,2))"
_HOUR = 3600
_DAY = 24 * _HOUR


def _measures():
    return {"n": ("sum", F.lit(1).cast("bigint")), "total": ("sum", money("value"))}


def _plain(df: DataFrame) -> DataFrame:
    return df.withColumn("total", F.col("total").cast("double"))


@query(
    "time_tumbling",
    f"""
    SELECT event_type, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS window_start,
      count(*) AS n, CAST(sum({VALUE}) AS DOUBLE) AS total
    FROM events GROUP BY ALL
    """,
)
def tumbling(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events")
    return _plain(timeseries.tumbling(events, ["event_type"], "ts", 6 * _HOUR, _measures()))


@query(
    "time_sliding",
    f"""
    SELECT event_type, first + INTERVAL 6 HOUR * CAST(k AS INTEGER) AS window_start, count(*) AS n,
      CAST(sum({VALUE}) AS DOUBLE) AS total
    FROM (SELECT *, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') - INTERVAL 18 HOUR AS first
          FROM events), range(4) AS t(k)
    GROUP BY ALL
    """,
)
def sliding(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events")
    return _plain(timeseries.sliding(events, ["event_type"], "ts", _DAY, 6 * _HOUR, _measures()))


@query(
    "time_sessions",
    f"""
    WITH gaps AS (
      SELECT *, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS gap FROM events),
    numbered AS (
      SELECT *, sum(CASE WHEN gap <= INTERVAL 6 HOUR THEN 0 ELSE 1 END)
        OVER (PARTITION BY user_id ORDER BY ts) AS session_no FROM gaps)
    SELECT user_id, CAST(session_no AS BIGINT) AS session_no, min(ts) AS session_start,
      max(ts) AS session_end, count(*) AS n, CAST(sum({VALUE}) AS DOUBLE) AS total
    FROM numbered GROUP BY user_id, session_no
    """,
)
def user_sessions(spark: SparkSession, d: str) -> DataFrame:
    return _plain(sessions(table(spark, d, "events"), ["user_id"], "ts", 6 * _HOUR, _measures()))


@query(
    "time_filled_gaps",
    f"""
    WITH hours AS (
      SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01') AS window_start,
        count(*) AS n, sum({VALUE}) AS total FROM events GROUP BY ALL),
    span AS (SELECT event_type, unnest(generate_series(min(window_start), max(window_start),
               INTERVAL 1 HOUR)) AS window_start FROM hours GROUP BY event_type)
    SELECT event_type, window_start, coalesce(n, 0) AS n, CAST(coalesce(total, 0) AS DOUBLE) AS total
    FROM span LEFT JOIN hours USING (event_type, window_start)
    """,
)
def hours_without_gaps(spark: SparkSession, d: str) -> DataFrame:
    hours = timeseries.tumbling(table(spark, d, "events"), ["event_type"], "ts", _HOUR, _measures())
    filled = timeseries.fill_gaps(hours, ["event_type"], "window_start", _HOUR, ["n", "total"])
    return _plain(filled)

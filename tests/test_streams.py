"""Streams over several files, with rows out of order and too late."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from check import connect, difference
from larkbeam.plans import all_queries
from larkbeam.session import scratch_path, setting
from larkbeam.sources.tables import SCHEMAS
from larkbeam.streaming.jobs import LateRows, drained, event_stream, left_open
from larkbeam.streaming.totals import merge_shards, totals_per_window

START = dt.datetime(2024, 3, 1)


def deliver(spark, folder, *deliveries):
    """Write one file per delivery; each event is (minute, user, kind, value)."""
    number = 0
    os.makedirs(f"{folder}/events.parquet")
    for i, events in enumerate(deliveries):
        rows = []
        for minute, user, kind, value in events:
            rows.append((number, START + dt.timedelta(minutes=minute), user, kind, value, "{}"))
            number += 1
        part = spark.createDataFrame(rows, SCHEMAS["events"]).coalesce(1)
        part.toPandas().astype({"ts": "datetime64[us]"}).to_parquet(
            f"{folder}/events.parquet/part-{i}.parquet", index=False
        )
        os.utime(f"{folder}/events.parquet/part-{i}.parquet", (1000 + i, 1000 + i))
    return str(folder)


def hours(spark, folder):
    counts = (
        event_stream(spark, folder, files_per_batch=1)
        .withWatermark("ts", "30 minutes")
        .groupBy(F.window("ts", "1 hour"))
        .agg(F.count("*").alias("n"))
    )
    start = F.date_format("window.start", "HH")
    return {r.h: r.n for r in drained(counts, "hours", late="drop").select(start.alias("h"), "n").collect()}


def test_late_rows(spark, tmp_path):
    folder = deliver(
        spark,
        tmp_path,
        [(10, 1, "view", 1.0), (70, 1, "view", 1.0)],
        [(50, 1, "view", 1.0), (65, 1, "view", 1.0)],  # late, but within the watermark
        [(200, 1, "view", 1.0)],
        [(201, 1, "view", 1.0)],  # rows are late by the watermark of the batch before
        [(55, 1, "view", 1.0)],  # its window is over: left out
        [(195, 1, "view", 1.0), (400, 1, "view", 1.0)],
    )
    assert hours(spark, folder) == {"00": 2, "01": 2, "03": 3}


def test_a_stream_goes_on_where_it_ended(spark, tmp_path):
    first = [(10, 1, "view", 1.0), (70, 1, "view", 1.0)]
    second = [(75, 1, "view", 1.0), (300, 1, "view", 1.0)]
    folder = deliver(spark, tmp_path / "a", first, second)
    held_back = tmp_path / "a/events.parquet/part-1.parquet"
    later = held_back.read_bytes()
    held_back.unlink()
    path = scratch_path(spark, "resumed")

    def run():
        counts = (
            event_stream(spark, folder)
            .withWatermark("ts", "5 minutes")
            .groupBy(F.window("ts", "1 hour"))
            .agg(F.count("*").alias("n"))
        )
        return sorted(r.n for r in drained(counts, "resumed", path).collect())

    assert run() == [1]
    assert run() == [1]
    held_back.write_bytes(later)
    assert run() == [1, 2]


def test_open_windows_are_given_out_and_go_on(spark, tmp_path):
    folder = deliver(spark, tmp_path / "b", [(10, 1, "view", 1.0), (70, 1, "view", 2.0)], [(75, 1, "view", 4.0), (300, 1, "view", 8.0)])
    held_back = tmp_path / "b/events.parquet/part-1.parquet"
    later = held_back.read_bytes()
    held_back.unlink()
    path = scratch_path(spark, "open")

    def run():
        stream = event_stream(spark, folder).withWatermark("ts", "5 minutes")
        over = drained(stream.groupBy(F.window("ts", "1 hour")).agg(F.count("*").alias("n")), "open", path)
        held = left_open(spark, path).select("key.window", F.col("value.count").alias("n"))
        return [sorted(r.n for r in df.collect()) for df in (over, held)]

    assert run() == [[1], [1]]
    assert run() == [[1], [1]]
    held_back.write_bytes(later)
    assert run() == [[1, 2], [1]]


def test_own_state_over_batches_and_shards(spark, tmp_path):
    folder = deliver(
        spark,
        tmp_path,
        [(1, 1, "view", 1.25), (2, 1, "view", 2.0), (3, 2, "click", 3.0)],
        [(50, 1, "view", 0.5), (59, 1, "view", 0.25), (61, 1, "view", 9.0)],
        [(300, 1, "error", 1.0)],
        [(302, 1, "error", 1.0)],
        [(5, 1, "view", 100.0)],  # too late: left out
        [(301, 1, "error", 1.0)],
    )
    parts = totals_per_window(
        event_stream(spark, folder, files_per_batch=1), "event_type", "1 hour", "10 minutes", 3
    )
    rows = merge_shards(drained(parts, "totals", late="drop"), "event_type").collect()
    got = {(r.event_type, r.window_end.hour): (r.n, r.cents, r.top_cents) for r in rows}
    assert got[("click", 1)] == (1, 300, 300)
    assert got[("view", 2)] == (1, 900, 900)
    assert got[("view", 1)] == (4, 400, 200)
    assert ("error", 6) not in got


def test_stream_reads_a_single_file_too(spark, small):
    assert drained(event_stream(spark, small).select("event_id"), "ids").count() == 1000


@pytest.mark.parametrize("zone", ["America/New_York", "Asia/Kolkata"])
def test_results_do_not_depend_on_the_time_zone(spark, small, zone):
    duck = connect(small)
    names = ["stream_tumbling", "stream_own_state", "time_sliding", "time_sessions", "win_lag_lead"]
    with setting(spark, "spark.sql.session.timeZone", zone):
        for name in names:
            query = all_queries()[name]
            got = query.plan(spark, small).toPandas()
            assert difference(got, duck.execute(query.oracle).df()) is None, name


def test_late_rows_are_reported_and_file_order_does_not_matter(spark, tmp_path):
    # the newest file comes first; two files more are behind its watermark
    folder = deliver(
        spark, tmp_path, [(600, 1, "view", 1.0)], [(601, 1, "view", 1.0)], [(5, 1, "view", 1.0)], [(700, 1, "view", 1.0)]
    )

    def counted(files_per_batch):
        stream = event_stream(spark, folder, files_per_batch).withWatermark("ts", "30 minutes")
        return stream.groupBy(F.window("ts", "1 hour")).count()

    assert drained(counted(None), "whole").agg(F.sum("count")).first()[0] == 3
    with pytest.raises(LateRows, match="1 rows"):
        drained(counted(1), "pieces")
    assert drained(counted(1), "pieces", late="drop").agg(F.sum("count")).first()[0] == 2

import pandas as pd
import pytest
from pyspark.sql import functions as F

from larkbeam.functions.batches import Words, aggregate_batches, compound, title
from larkbeam.functions.money import hundredths, money, revenue, revenue_units, scaled, taxed_units, total
from larkbeam.functions.times import utc_instant, utc_wall, wall_micros
from larkbeam.operators import timeseries
from larkbeam.session import setting


def test_column_functions(spark):
    df = spark.createDataFrame([(100.0, 0.1, 2.0, "two words")], "a double, r double, y double, t string")
    row = df.select(compound("a", "r", "y").alias("c"), title("t").alias("t")).first()
    assert row.c == pytest.approx(121.0)
    assert row.t == "Two Words"
    texts = [(1, "two words"), (2, None), (3, ""), (4, "one"), (5, "a  b")]
    words = Words(spark.createDataFrame(texts, "k bigint, t string").coalesce(1).asTable()).collect()
    assert sorted(map(tuple, words)) == [
        (1, 0, "two"), (1, 1, "words"), (3, 0, ""), (4, 0, "one"), (5, 0, "a"), (5, 1, ""), (5, 2, "b")
    ]


def test_batch_aggregate_sees_every_batch(spark):
    def spread(batch: pd.DataFrame) -> pd.DataFrame:
        return batch.groupby("g", as_index=False).agg(low=("id", "min"), n=("id", "size"))

    df = spark.range(10_000, numPartitions=4).select((F.col("id") % 3).alias("g"), "id")
    with setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", "100"):
        got = aggregate_batches(
            df, ["g"], spread, "g bigint, low bigint, n bigint", {"low": F.min, "n": F.sum}
        )
        assert sorted(map(tuple, got.collect())) == [(0, 0, 3334), (1, 1, 3333), (2, 2, 3333)]


def test_money_is_exact(spark):
    rows = [(x / 100, d / 100, t / 100) for x in (1, 29, 57, 115, 10_499_999) for d in range(11) for t in range(9)]
    df = spark.createDataFrame(rows, "l_extendedprice double, l_discount double, l_tax double")
    price = F.col("l_extendedprice").cast("decimal(12,2)")
    less = 1 - F.col("l_discount").cast("decimal(3,2)")
    more = 1 + F.col("l_tax").cast("decimal(3,2)")
    wrong = df.where(
        (money("l_extendedprice") != price)
        | (revenue() != price * less)
        | (scaled(taxed_units(), 13, 6) != price * less * more)
    )
    assert wrong.count() == 0
    sums = df.agg(
        total(revenue_units(), 4).alias("a"),
        F.sum(price * less).alias("b"),
        total(-hundredths("l_extendedprice"), 2).alias("c"),
        F.sum(-price).alias("d"),
    ).first()
    assert sums.a == sums.b and sums.c == sums.d


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Australia/Lord_Howe"])
def test_times_do_not_depend_on_the_zone(spark, zone):
    text = ["1969-12-31 23:59:59.999999", "2024-03-10 02:30:00", "2024-11-03 01:30:00.000001"]
    df = spark.createDataFrame([(t,) for t in text], "t string")
    with setting(spark, "spark.sql.session.timeZone", zone):
        ts = F.col("t").cast("timestamp_ntz")
        got = df.select(wall_micros(ts).alias("m"), timeseries.pane(ts, 3600).cast("string").alias("p"))
        want = [int(pd.Timestamp(t).value // 1000) for t in text]
        assert [r.m for r in got.collect()] == want
        same = df.select(utc_wall(utc_instant(F.col("t").cast("timestamp_ntz"))).alias("w"), "t")
        assert same.where(F.col("w") != F.col("t").cast("timestamp_ntz")).count() == 0


def test_fill_gaps_in_stretches(spark, monkeypatch):
    monkeypatch.setattr(timeseries, "PANES_PER_TASK", 4)
    rows = [("a", "2024-01-01 00:00:00", 3), ("a", "2024-01-01 21:00:00", 5), ("b", "2024-01-02 00:00:00", 1)]
    panes = spark.createDataFrame(rows, "k string, t string, n bigint")
    panes = panes.withColumn("t", F.col("t").cast("timestamp_ntz"))
    filled = timeseries.fill_gaps(panes, ["k"], "t", 3600, ["n"])
    got = {(r.k, r.t.day, r.t.hour): r.n for r in filled.collect()}
    assert len(got) == 22 + 1 and sum(got.values()) == 9
    assert got[("a", 1, 0)] == 3 and got[("a", 1, 7)] == 0 and got[("a", 1, 21)] == 5

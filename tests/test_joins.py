"""Joins against brute force on small tables, with and without hot keys."""

import pytest
from pyspark.sql import functions as F

from larkbeam.operators.joins import asof_join, range_join, salted_join, sum_in_range

LIMITS = [20, 1_000_000]


def bag(df):
    return sorted(map(repr, df.select(*sorted(df.columns)).collect()))


def key(i):
    """Null for a few rows, 0 for a third."""
    return F.when(i % 3 == 0, 0).when(i % 25 == 1, None).otherwise(i % 9).cast("int")


@pytest.fixture(scope="module")
def points(spark):
    i = F.col("id")
    df = spark.range(300, numPartitions=4)
    return df.select(key(i).alias("k"), i.alias("p"), ((i * 37) % 211).cast("int").alias("at")).cache()


@pytest.fixture(scope="module")
def ranges(spark):
    i = F.col("id")
    start = ((i * 53) % 200).cast("int")
    length = F.when(i % 10 == 0, 150).when(i % 11 == 0, 0).when(i % 13 == 0, -4).otherwise(i % 8)
    return (
        spark.range(90, numPartitions=3)
        .select(key(i).alias("k"), i.alias("r"), start.alias("lo"), (start + length.cast("int")).alias("hi"))
        .cache()
    )


@pytest.mark.parametrize("limit", LIMITS)
@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join(points, ranges, how, limit):
    want = points.join(ranges, ["k"], how)
    assert bag(salted_join(points, ranges, ["k"], how, limit)) == bag(want)


def test_salted_join_spreads_equal_rows(spark):
    copies = spark.range(1000, numPartitions=8).select(F.lit(1).alias("k"))
    one = spark.range(1).select(F.lit(1).alias("k"), F.lit("x").alias("v"))
    assert salted_join(copies, one, ["k"], "inner", 100).count() == 1000


def test_salted_join_refuses_sides_it_would_copy(points, ranges):
    with pytest.raises(ValueError):
        salted_join(points, ranges, ["k"], "full")


@pytest.mark.parametrize("limit", LIMITS)
def test_range_join(points, ranges, limit):
    got = range_join(points, ranges, ["k"], "at", "lo", "hi", limit)
    want = points.join(ranges, ["k"]).where("lo <= at AND at < hi")
    assert want.count() > 100
    assert bag(got) == bag(want)


@pytest.mark.parametrize("limit", LIMITS)
def test_range_join_without_key(points, ranges, limit):
    right = ranges.withColumnRenamed("k", "rk")
    got = range_join(points, right, [], "at", "lo", "hi", limit)
    assert bag(got) == bag(points.join(right, F.expr("lo <= at AND at < hi")))


@pytest.mark.parametrize("limit", LIMITS)
def test_sum_in_range(points, ranges, limit):
    marks = ranges.where("lo <= hi")
    sums = {"n": F.lit(1).cast("bigint"), "s": F.col("p").cast("decimal(10,1)")}
    got = sum_in_range(
        marks, points, ["k"], "r", F.col("lo"), F.col("hi"), "at", sums, limit
    ).withColumn("s", F.col("s").cast("double"))
    same = (points.k == marks.k) & (points["at"] >= marks.lo) & (points["at"] < marks.hi)
    want = marks.join(points, same, "left").groupBy("r")
    assert bag(got) == bag(
        want.agg(F.count("p").alias("n"), F.coalesce(F.sum("p"), F.lit(0)).cast("double").alias("s"))
    )


@pytest.mark.parametrize("limit", LIMITS)
@pytest.mark.parametrize("on", [["k"], []])
def test_asof_join(points, ranges, on, limit):
    marks = ranges.dropDuplicates([*on, "lo"]) if on else ranges.dropDuplicates(["lo"])
    marks = marks.cache()
    got = asof_join(points, marks, on, "at", "lo", {"mark": "r", "since": "lo"}, limit)
    a, b = points.toPandas(), marks.toPandas()
    want = []
    for row in a.itertuples():
        fit = b[b.lo <= row.at]
        if on:
            fit = fit[fit.k == row.k]
        best = fit.sort_values("lo").tail(1)
        want.append((row.p, None, None) if best.empty else (row.p, best.r.iloc[0], best.lo.iloc[0]))
    rows = [(r.p, r.mark, r.since) for r in got.collect()]
    assert sorted(rows, key=str) == sorted(want, key=str)


def test_range_join_keeps_short_and_open_intervals(spark):
    from larkbeam.operators.joins import range_join

    big = 2**53 + 4
    points = spark.createDataFrame([(1, float(x), x) for x in (5, 7, big)], "k int, at double, whole long")
    open_ = spark.createDataFrame([(1, float("-inf"), 6.0), (1, 6.0, float("inf"))], "k int, start double, stop double")
    got = range_join(points, open_, ["k"], "at", "start", "stop").select("at", "start").collect()
    assert sorted((r.at, r.start) for r in got) == [(5.0, float("-inf")), (7.0, 6.0), (float(big), 6.0)]
    short = spark.createDataFrame([(1, big, big + 1)], "k int, start long, stop long")
    assert range_join(points, short, ["k"], "whole", "start", "stop").count() == 1

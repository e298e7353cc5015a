import numpy as np
import pytest
from pyspark.sql import functions as F

from larkbeam.operators import sets
from larkbeam.operators.aggregates import (
    cube_sets,
    distinct_counts,
    grouping_sets,
    latest,
    most_frequent,
    percentiles,
    rollup_sets,
)
from larkbeam.operators.sessions import sessions


def bag(df):
    return sorted(map(repr, df.select(*sorted(df.columns)).collect()))


@pytest.fixture(scope="module")
def rows(spark):
    i = F.col("id")
    return (
        spark.range(900, numPartitions=4)
        .select(
            i,
            F.when(i % 3 == 0, 0).when(i % 40 == 1, None).otherwise(i % 5).cast("int").alias("g"),
            F.when(i % 17 == 3, None).otherwise((i * 7919) % 503 / 4).alias("x"),
            (i % 4).alias("h"),
        )
        .cache()
    )


@pytest.mark.parametrize("limit", [30, 1_000_000])
def test_percentiles(rows, limit):
    shares = {"p0": 0.0, "p10": 0.1, "p50": 0.5, "p99": 0.99, "p100": 1.0}
    got = {r.g: r for r in percentiles(rows, ["g"], "x", shares, limit).collect()}
    data = rows.toPandas()
    assert len(got) == 6
    for g, row in got.items():
        x = data[data.g.isna() if g is None else data.g == g].x.dropna()
        for name, share in shares.items():
            assert row[name] == pytest.approx(np.quantile(x, share), abs=1e-9)


def test_percentiles_of_the_whole_table(rows):
    row = percentiles(rows, [], "x", {"m": 0.5}, 30).first()
    assert row.m == pytest.approx(rows.toPandas().x.median())


def test_grouping_sets_equal_the_built_in_ones(rows):
    measures = {"s": ("sum", F.col("id")), "hi": ("max", F.col("x")), "n": ("sum", F.lit(1))}
    built = [F.sum("id").alias("s"), F.max("x").alias("hi"), F.count("*").alias("n")]
    set_id = F.grouping_id().cast("bigint").alias("set_id")
    dims = ["g", "h"]
    assert bag(grouping_sets(rows, cube_sets(dims), measures)) == bag(rows.cube(*dims).agg(set_id, *built))
    assert bag(grouping_sets(rows, rollup_sets(dims), measures)) == bag(
        rows.rollup(*dims).agg(set_id, *built)
    )


def test_latest_and_most_frequent(rows):
    got = {r.h: (r.id, r.x) for r in latest(rows, ["h"], ["id"]).collect()}
    want = rows.toPandas().sort_values("id").groupby("h").tail(1)
    assert {h: r[0] for h, r in got.items()} == dict(zip(want.h, want.id))
    modes = {r.h: (r.g, r.n) for r in most_frequent(rows.where("g IS NOT NULL"), ["h"], "g").collect()}
    assert all(g == 0 for g, _ in modes.values())


@pytest.mark.parametrize("chunk", [3, 100_000])
def test_set_operations(spark, chunk, monkeypatch):
    monkeypatch.setattr(sets, "COPIES_PER_TASK", chunk)
    i = F.col("id")
    value = F.when(i % 3 == 0, 0).when(i % 20 == 1, None).otherwise(i % 30).alias("v")
    a, b = spark.range(200).select(value), spark.range(50, 170).select(value)
    assert bag(sets.union_distinct(a, b)) == bag(a.union(b).distinct())
    assert bag(sets.intersect_distinct(a, b)) == bag(a.intersect(b))
    assert bag(sets.except_distinct(a, b)) == bag(a.subtract(b))
    assert bag(sets.intersect_all(a, b)) == bag(a.intersectAll(b))
    assert bag(sets.except_all(a, b)) == bag(a.exceptAll(b))


@pytest.mark.parametrize("limit", [25, 1_000_000])
def test_sessions(spark, limit):
    i = F.col("id")
    seconds = (i * i * 13) % 90_000
    ts = (F.timestamp_seconds(seconds)).cast("timestamp_ntz")
    key = F.when(i % 3 == 0, 0).otherwise(i % 6).cast("int").alias("k")
    events = spark.range(400, numPartitions=4).select(key, ts.alias("ts"), seconds.alias("s"), i).cache()
    measures = {"n": ("sum", F.lit(1).cast("bigint")), "top": ("max", F.col("id"))}
    got = sessions(events, ["k"], "ts", 300, measures, limit)
    want = []
    for k, group in events.toPandas().sort_values("s").groupby("k"):
        number, last = 0, None
        for row in group.itertuples():
            if last is None or row.s - last > 300:
                number += 1
                want.append([k, number, row.ts, row.ts, 0, 0])
            want[-1][3], want[-1][4] = row.ts, want[-1][4] + 1
            want[-1][5], last = max(want[-1][5], row.id), row.s
    rows = [(r.k, r.session_no, r.session_start, r.session_end, r.n, r.top) for r in got.collect()]
    assert sorted(rows) == sorted(tuple(w) for w in want)


def test_percentiles_keep_groups_without_values(spark):
    from larkbeam.operators.aggregates import percentiles

    rows = [("a", 1.0), ("a", 3.0), ("a", None), ("b", None)]
    df = spark.createDataFrame(rows, "g string, x double")
    for rows_per_group in (None, 1):
        got = percentiles(df, ["g"], "x", {"half": 0.5}, rows_per_group).collect()
        assert sorted((r.g, r.half) for r in got) == [("a", 2.0), ("b", None)]


def test_distinct_counts(spark):
    rows = [(0, 1, "a"), (0, 1, "b"), (0, None, "b"), (None, 2, None), (None, 2, "c"), (1, None, None)]
    df = spark.createDataFrame(rows, "k int, x int, y string")
    got = distinct_counts(df, ["k"], {"xs": "x", "ys": "y"}, "n")
    assert sorted(map(tuple, got.collect()), key=repr) == [(0, 3, 1, 2), (1, 1, 0, 0), (None, 2, 1, 1)]
    assert distinct_counts(df, [], {"xs": "x"}).collect() == [(2,)]
    assert distinct_counts(df.limit(0), ["k"], {"xs": "x"}, "n").count() == 0

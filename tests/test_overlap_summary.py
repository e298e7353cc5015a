"""Figures over overlapping intervals against the pairs themselves."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from larkbeam.operators.overlap import overlap_summary
from larkbeam.plans import all_queries

INF, NAN = float("inf"), float("nan")


def intervals(rnd, n, kind):
    out = []
    for i in range(n):
        s, size = rnd.randint(0, 60), rnd.choice([0, 1, 1, 3, 10, 80])
        user, value = rnd.choice([None, 1, 1, 1, 2, 3, 4]), rnd.choice([None, -5, rnd.randint(-9, 99)])
        if kind == "double":
            s, e = rnd.choice([s / 4, s / 4, -0.0, -INF, None]), rnd.choice([(s + size) / 4, 0.0, INF, NAN])
        elif kind == "date":
            s, e = dt.date(2020, 1, 1) + dt.timedelta(s), dt.date(2020, 1, 1) + dt.timedelta(s + size)
        else:
            s, e = 2**60 + s, 2**60 + s + size
        out.append((i, s, e, user, value))
    return out


def expected(a, b):
    met = a.join(b, F.expr("s < e AND t < f AND s < f AND t < e"))
    return met.groupBy("a").agg(F.count("*"), F.countDistinct("user"), F.countDistinct("value"), F.max("value"))


@pytest.mark.parametrize("kind", ["double", "date", "bigint"])
@pytest.mark.parametrize("piece, group", [(None, None), (7, None), (40, 3)])
def test_against_pairs(spark, kind, piece, group):
    rnd = random.Random(f"{kind}{piece}")
    left = [r[:3] for r in intervals(rnd, 60, kind)]
    right = intervals(rnd, 90, kind)
    right += right[:9]
    a = spark.createDataFrame(left, f"a int, s {kind}, e {kind}").repartition(3)
    b = spark.createDataFrame(right, f"b int, t {kind}, f {kind}, user int, value int").repartition(2)
    got = overlap_summary(a, b, "a", "s", "e", "t", "f", "n", {"users": "user", "values": "value"}, {"top": "value"}, piece, group)
    assert got.columns == ["a", "n", "users", "values", "top"]
    rows = sorted(map(tuple, got.collect()))
    assert rows and rows == sorted(map(tuple, expected(a, b).collect()))


@pytest.mark.parametrize("empty", [0, 1])
def test_empty_sides(spark, empty):
    sides = [spark.createDataFrame([(1, 1, 5)], "a int, s int, e int"), spark.createDataFrame([(1, 2, 3)], "b int, t int, f int")]
    sides[empty] = sides[empty].limit(0)
    assert overlap_summary(*sides, "a", "s", "e", "t", "f", "n", {}, {"top": "b"}).collect() == []


def test_the_query_makes_no_pairs(spark, tmp_path):
    """3,000 errors at the same time as 3,000 purchases: nine million pairs, which no operator may give out."""
    when = dt.datetime(2024, 1, 1)
    rows = [(i, when, i % 100, ("error", "purchase")[i % 2], 5.0, "") for i in range(6000)]
    spark.createDataFrame(rows, "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    found = all_queries()["join_overlap_no_key"].plan(spark, str(tmp_path))
    assert {tuple(r)[1:] for r in found.collect()} == {(3000, 50, 5999)} and found.count() == 3000
    plan = found._jdf.queryExecution().executedPlan()
    assert "_start" in plan.toString() and "user_id" not in plan.toString()

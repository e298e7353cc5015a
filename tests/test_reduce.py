"""Filters of bounded size before a semi join."""

import pytest
from pyspark.sql import functions as F

from larkbeam.operators.reduce import bloom, maybe_in, reduced_anti_join, reduced_semi_join


@pytest.fixture(scope="module")
def sides(spark):
    # one key holds a third of the rows; some are null
    rows = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 50 == 1, None).otherwise(F.col("id")).alias("k"),
        F.col("id").alias("_key"), F.lit("x").alias("_word"),
    )
    keys = spark.range(0, 30_000, 100).select((F.col("id") + 7).alias("wanted")).union(spark.range(1).select(F.lit(None)))
    return rows, keys


def ids(df):
    return sorted(r["_key"] for r in df.collect())


@pytest.mark.parametrize("words", [1, 64, 1 << 20])
def test_reduced_semi_join_is_the_plain_one(sides, words):
    rows, keys = sides
    want = ids(rows.join(keys, rows.k == keys.wanted, "left_semi"))
    got = reduced_semi_join(rows, keys, "k", "wanted", words)
    assert got.columns == rows.columns
    assert ids(got) == want
    others = ids(rows.join(keys.where("wanted IS NOT NULL"), rows.k == keys.wanted, "left_anti"))
    assert ids(reduced_anti_join(rows, keys, "k", "wanted", words)) == others


def test_filter_loses_no_key_and_drops_most_others(sides):
    rows, keys = sides
    found = bloom(keys, "wanted")
    passed, stopped = maybe_in(rows, "k", found), maybe_in(rows, "k", found, negate=True)
    assert passed.count() + stopped.count() == rows.count()
    assert stopped.join(keys, F.col("k") == F.col("wanted")).isEmpty()
    assert passed.where("k != 7").count() < 600
    assert bloom(keys, "wanted", 64).count() <= 64


def test_strings_and_empty_sides(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "k string, n int")
    keys = spark.createDataFrame([("b",)], "s string")
    assert [r.n for r in reduced_semi_join(rows, keys, "k", "s").collect()] == [2]
    assert reduced_semi_join(rows, keys.limit(0), "k", "s").count() == 0
    assert reduced_semi_join(rows.limit(0), keys, "k", "s").count() == 0

"""Windows in pieces must equal plain windows, however the rows are spread."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from larkbeam.operators.skew import apart, hot_groups, segmented
from larkbeam.operators.windows import framed, ntile, ranks, row_numbers, running


def skewed(spark, n=2000):
    """A third of the rows in group 0, a third of those at one time, some nulls and NaN."""
    i = F.col("id")
    return spark.range(n, numPartitions=5).select(
        i.alias("row"),
        F.when(i % 3 == 0, 0).when(i % 50 == 1, None).otherwise(i % 7).cast("int").alias("g"),
        F.when(i % 9 == 0, 500.0)
        .when(i % 101 == 2, None)
        .when(i % 211 == 0, float("nan"))
        .otherwise((i * 7919) % 1000)
        .cast("double")
        .alias("x"),
        ((i * 31) % 17 - 5).alias("v"),
    )


def bag(df):
    return sorted(map(repr, df.select(*sorted(df.columns)).collect()))


@pytest.mark.parametrize("keys", [["g"], []])
@pytest.mark.parametrize("order", [["x", "row"], ["-x", "row"], ["-x", "-row"], ["row"], ["-row"]])
def test_running_in_pieces(spark, keys, order):
    df = skewed(spark)
    columns = {
        "n": ("sum", F.lit(1).cast("bigint")),
        "s": ("sum", F.col("v").cast("decimal(10,2)")),
        "lo": ("min", F.col("v")),
        "hi": ("max", F.col("v")),
        "all": ("total", F.col("v")),
    }
    hot = hot_groups(df, keys, 60)
    assert hot is not None
    cut = running(df, keys, order, columns, hot)
    plain = running(df, keys, order, columns)
    assert cut.dtypes == plain.dtypes
    assert bag(cut) == bag(plain)


def test_running_last_in_pieces(spark):
    df = skewed(spark).withColumn("seen", F.when(F.col("row") % 40 == 0, F.struct("row", "v")))
    columns = {"last": ("last", F.col("seen"))}
    cut = running(df, ["g"], ["x", "row"], columns, hot_groups(df, ["g"], 50))
    assert bag(cut) == bag(running(df, ["g"], ["x", "row"], columns))
    descending = running(df, ["g"], ["-x", "row"], columns, hot_groups(df, ["g"], 50))
    assert bag(descending) == bag(running(df, ["g"], ["-x", "row"], columns))


def test_segments_bound_the_rows_of_a_task(spark):
    df = skewed(spark, 6000)
    cold, rows, hot = apart(df, ["g"], hot_groups(df, ["g"], 200))
    assert cold.count() + rows.count() == 6000
    assert {r.g for r in cold.groupBy("g").count().collect()} == {
        r.g for r in df.groupBy("g").count().collect() if r["count"] <= 200
    }
    pieces = segmented(rows, ["x", "row"], hot).groupBy("_seg").count()
    assert pieces.agg(F.max("count")).first()[0] <= 2 * 200
    assert pieces.count() <= 3 * hot.segments()


def test_frequent_values_are_cut_by_the_second_column(spark):
    df = skewed(spark, 6000).where("x = 500.0 OR row % 2 = 0")
    pieces = segmented(df, ["x", "row"], hot_groups(df, [], 200)).where("x = 500.0").groupBy("_seg")
    assert pieces.count().agg(F.max("count")).first()[0] <= 2 * 200


def test_no_hot_group_leaves_a_plain_window(spark):
    df = skewed(spark)
    assert hot_groups(df, ["g"], 1000) is None


@pytest.mark.parametrize("keys", [["g"], []])
def test_frames_in_pieces(spark, keys):
    df = skewed(spark)

    def build(w):
        return {
            "before": F.lag("v", 2).over(w),
            "after": F.lead("row", 1).over(w),
            "moving": F.sum("v").over(w.rowsBetween(-6, 1)),
        }

    cut = framed(df, keys, ["-x", "row"], 6, 1, build, hot_groups(df, keys, 40))
    assert bag(cut) == bag(framed(df, keys, ["-x", "row"], 6, 1, build))
    far = framed(df, keys, ["row"], 41, 0, lambda w: {"far": F.lag("v", 41).over(w)}, hot_groups(df, keys, 40))
    assert bag(far) == bag(framed(df, keys, ["row"], 41, 0, lambda w: {"far": F.lag("v", 41).over(w)}))


def test_row_numbers_match_the_window_function(spark):
    df = skewed(spark)
    ours = row_numbers(df, ["g"], ["x", "row"], "n", hot_groups(df, ["g"], 30))
    theirs = df.withColumn("n", F.row_number().over(Window.partitionBy("g").orderBy("x", "row")))
    assert bag(ours) == bag(theirs.withColumn("n", F.col("n").cast("bigint")))


@pytest.mark.parametrize("keys", [["g"], []])
def test_ranks_in_pieces(spark, keys):
    df = skewed(spark)
    cut = ranks(df, keys, "x", "row", hot_groups(df, keys, 60))
    plain = ranks(df, keys, "x", "row")
    assert cut.dtypes == plain.dtypes
    assert bag(cut) == bag(plain)


def test_ntile(spark):
    w = Window.partitionBy("g").orderBy("row")
    df = skewed(spark, 300).withColumn("want", F.ntile(4).over(w))
    df = df.union(df.where("row < 5").withColumn("g", F.lit(99)).withColumn("want", F.lit(None)))
    df = df.withColumn("want", F.ntile(4).over(w))
    columns = {"p": ("sum", F.lit(1)), "size": ("total", F.lit(1))}
    got = running(df, ["g"], ["row"], columns).withColumn("got", ntile(4, F.col("p"), F.col("size")))
    assert got.where("got IS DISTINCT FROM want").count() == 0

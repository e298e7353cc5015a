"""Random small tables: pieces and plain windows must agree whatever the data."""

import datetime as dt
from decimal import Decimal

from hypothesis import HealthCheck, example, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from larkbeam.operators.joins import asof_join, range_join
from larkbeam.operators.skew import hot_groups
from larkbeam.operators.windows import framed, ranks, running

FEW = settings(
    max_examples=8,
    deadline=None,
    suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow],
)
NUMBERS = st.one_of(
    st.none(),
    st.sampled_from([0.0, -0.0, 1.0, float("inf"), float("-inf"), float("nan"), 1e300, -1e300]),
    st.integers(-3, 3).map(float),
)
ROWS = st.lists(st.tuples(st.sampled_from([0, 0, 0, 1, 2, None]), NUMBERS), min_size=1, max_size=60)


def bag(df):
    return sorted(map(repr, df.select(*sorted(df.columns)).collect()))


def frame(spark, rows):
    numbered = [(i, g, x, i % 5 - 2) for i, (g, x) in enumerate(rows)]
    return spark.createDataFrame(numbered, "row bigint, g int, x double, v int").repartition(3).cache()


@FEW
@example(rows=[(0, None), (0, -0.0), *[(0, None)] * 9, (0, 0.0)], descending=True, limit=1)
@given(rows=ROWS, descending=st.booleans(), limit=st.integers(1, 9))
def test_windows(spark, rows, descending, limit):
    df = frame(spark, rows)
    order = ["-x" if descending else "x", "row"]
    hot = hot_groups(df, ["g"], limit)
    columns = {"s": ("sum", F.col("v")), "all": ("total", F.col("v")), "hi": ("max", F.col("row"))}
    assert bag(running(df, ["g"], order, columns, hot)) == bag(running(df, ["g"], order, columns))

    def build(w):
        return {"before": F.lag("row").over(w), "near": F.sum("v").over(w.rowsBetween(-1, 1))}

    assert bag(framed(df, ["g"], order, 1, 1, build, hot)) == bag(framed(df, ["g"], order, 1, 1, build))


WORDS = st.one_of(st.none(), st.sampled_from(["", "a", "B", "b", "é", "漢", "aa"]))
AMOUNTS = st.one_of(st.none(), st.integers(-(10**29), 10**29).map(lambda n: Decimal(n).scaleb(-4)), st.sampled_from([Decimal("0.0001"), Decimal(2**53), Decimal(2**53 + 1)]))


@FEW
@given(
    rows=st.lists(st.tuples(st.sampled_from([0, 0, 0, 1, None]), WORDS, AMOUNTS), min_size=1, max_size=40),
    order=st.sampled_from([["w", "row"], ["-w", "-row"], ["a", "row"], ["-a", "row"], ["w", "-a", "row"]]),
    limit=st.integers(1, 9),
)
def test_pieces_in_any_order(spark, rows, order, limit):
    numbered = [(i, *r, None if i % 3 else i) for i, r in enumerate(rows)]
    df = spark.createDataFrame(numbered, "row bigint, g int, w string, a decimal(38,4), v int").repartition(3).cache()
    hot = hot_groups(df, ["g"], limit)
    columns = {"s": ("sum", F.col("v")), "lately": ("last", F.col("v")), "low": ("min", F.col("w")), "all": ("total", F.col("v"))}
    assert bag(running(df, ["g"], order, columns, hot)) == bag(running(df, ["g"], order, columns))

    def build(w):
        return {"far": F.sum("v").over(w.rowsBetween(-12, 3)), "next": F.lead("row", 2).over(w)}

    assert bag(framed(df, ["g"], order, 12, 3, build, hot)) == bag(framed(df, ["g"], order, 12, 3, build))


@FEW
@given(rows=ROWS, limit=st.integers(1, 9))
def test_ranks(spark, rows, limit):
    df = frame(spark, rows)
    assert bag(ranks(df, ["g"], "x", "row", hot_groups(df, ["g"], limit))) == bag(
        ranks(df, ["g"], "x", "row")
    )


TIMES = st.integers(-5_000, 5_000).map(lambda s: dt.datetime(1970, 1, 1) + dt.timedelta(seconds=s))
KEYS = st.sampled_from([0, 0, 0, 1, None])


@FEW
@given(
    left=st.lists(st.tuples(KEYS, TIMES), min_size=1, max_size=40),
    right=st.lists(st.tuples(KEYS, TIMES), max_size=40, unique=True),
    limit=st.integers(2, 100),
)
def test_asof_join(spark, left, right, limit):
    a = spark.createDataFrame([(i, k, t) for i, (k, t) in enumerate(left)], "i int, k int, t timestamp_ntz")
    b = spark.createDataFrame([(j, k, t) for j, (k, t) in enumerate(right)], "j int, k int, u timestamp_ntz")
    got = {r.i: r.found for r in asof_join(a, b, ["k"], "t", "u", {"found": "j"}, limit).collect()}
    for i, (k, t) in enumerate(left):
        fits = [(u, j) for j, (other, u) in enumerate(right) if k is not None and other == k and u <= t]
        assert got[i] == (max(fits)[1] if fits else None)


@FEW
@given(
    points=st.lists(st.integers(-40, 40), max_size=40),
    ranges=st.lists(st.tuples(st.integers(-40, 40), st.integers(-2, 70)), max_size=30),
    limit=st.integers(2, 100),
)
def test_range_join(spark, points, ranges, limit):
    p = spark.createDataFrame([(i, x / 4) for i, x in enumerate(points)], "p int, at double")
    r = spark.createDataFrame(
        [(j, lo / 4, (lo + n) / 4) for j, (lo, n) in enumerate(ranges)], "r int, lo double, hi double"
    )
    got = sorted((row.p, row.r) for row in range_join(p, r, [], "at", "lo", "hi", limit).collect())
    assert got == sorted(
        (i, j)
        for i, x in enumerate(points)
        for j, (lo, n) in enumerate(ranges)
        if lo <= x < lo + n
    )


ENDS = st.sampled_from([-1.0, 0.0, 2.5, float("inf"), float("-inf"), float("nan"), None])


@FEW
@example(points=[float("inf"), 1.0], ranges=[(float("-inf"), float("inf"))])
@example(points=[float("-inf"), float("nan")], ranges=[(float("-inf"), float("nan"))])
@given(points=st.lists(ENDS, max_size=12), ranges=st.lists(st.tuples(ENDS, ENDS), max_size=20))
def test_range_join_with_infinite_ends(spark, points, ranges):
    p = spark.createDataFrame(list(enumerate(points)), "p int, at double")
    r = spark.createDataFrame([(j, lo, hi) for j, (lo, hi) in enumerate(ranges)], "r int, lo double, hi double")
    got = sorted((row.p, row.r) for row in range_join(p, r, [], "at", "lo", "hi").collect())
    plain = p.join(r, F.expr("lo < hi AND lo <= at AND at < hi")).collect()
    assert got == sorted((row.p, row.r) for row in plain)

"""Kinds of aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkbeam.functions.money import hundredths, revenue, total
from larkbeam.operators.aggregates import (
    cube_sets,
    distinct_counts,
    grouping_sets,
    latest,
    most_frequent,
    percentiles,
    rollup_sets,
)
from larkbeam.operators.frequent import frequent
from larkbeam.plans.registry import query
from larkbeam.plans.star import PRICE, REVENUE
from larkbeam.sources.tables import table

VALUE = "CAST(value AS DECIMAL(12,2))"
TYPES = ["click", "error", "purchase", "signup", "view"]


@query(
    "agg_group_by",
    f"""
    SELECT event_type, count(*) AS n, CAST(sum({VALUE}) AS DOUBLE) AS total, min(value) AS low,
      max(value) AS high, CAST(sum({VALUE}) AS DOUBLE) / count(*) AS mean,
      count(*) FILTER (WHERE value > 50) AS n_large,
      bool_and(value > 0) AS all_positive, bool_or(value > 400) AS any_huge
    FROM events GROUP BY event_type
    """,
)
def event_totals(spark: SparkSession, d: str) -> DataFrame:
    sum_of_values = total(hundredths("value"), 2).cast("double")
    value = F.col("value")
    return (
        table(spark, d, "events")
        .groupBy("event_type")
        .agg(
            F.count("*").alias("n"),
            sum_of_values.alias("total"),
            F.min("value").alias("low"),
            F.max("value").alias("high"),
            (sum_of_values / F.count("*")).alias("mean"),
            F.count_if(value > 50).alias("n_large"),
            F.bool_and(value > 0).alias("all_positive"),
            F.bool_or(value > 400).alias("any_huge"),
        )
    )


@query(
    "agg_having",
    """
    SELECT user_id, count(*) AS n, max(value) AS high FROM events
    GROUP BY user_id HAVING count(*) > 65 AND max(value) > 100
    """,
)
def busy_users(spark: SparkSession, d: str) -> DataFrame:
    totals = (
        table(spark, d, "events")
        .groupBy("user_id")
        .agg(F.count("*").alias("n"), F.max("value").alias("high"))
    )
    return totals.where((F.col("n") > 65) & (F.col("high") > 100))


_SALES = f"""
    SELECT l_returnflag, l_linestatus, CAST(year(l_shipdate) AS INTEGER) AS ship_year,
      {PRICE} AS price, {REVENUE} AS amount FROM lineitem
"""


def _grouping_sql(sets: str) -> str:
    return f"""
    SELECT coalesce(l_returnflag, 'all') AS l_returnflag, coalesce(l_linestatus, 'all') AS l_linestatus,
      coalesce(ship_year, 0) AS ship_year,
      CAST(grouping(l_returnflag, l_linestatus, ship_year) AS BIGINT) AS set_id,
      count(*) AS n, CAST(sum(amount) AS DOUBLE) AS revenue, CAST(max(price) AS DOUBLE) AS top_price
    FROM ({_SALES}) GROUP BY {sets}
    """


def _sales_by(spark: SparkSession, d: str, sets: list[list[str]]) -> DataFrame:
    sales = table(spark, d, "lineitem").withColumn("ship_year", F.year("l_shipdate").cast("int"))
    measures = {
        "n": ("sum", F.lit(1).cast("bigint")),
        "revenue": ("sum", revenue()),
        "top_price": ("max", F.col("l_extendedprice")),
    }
    totals = grouping_sets(sales, sets, measures)
    return totals.withColumn("revenue", F.col("revenue").cast("double")).fillna(
        {"l_returnflag": "all", "l_linestatus": "all", "ship_year": 0}
    )


_DIMS = ["l_returnflag", "l_linestatus", "ship_year"]


@query("agg_rollup", _grouping_sql("ROLLUP (l_returnflag, l_linestatus, ship_year)"))
def sales_rollup(spark: SparkSession, d: str) -> DataFrame:
    return _sales_by(spark, d, rollup_sets(_DIMS))


@query("agg_cube", _grouping_sql("CUBE (l_returnflag, l_linestatus, ship_year)"))
def sales_cube(spark: SparkSession, d: str) -> DataFrame:
    return _sales_by(spark, d, cube_sets(_DIMS))


@query(
    "agg_grouping_sets",
    _grouping_sql(
        "GROUPING SETS ((l_returnflag, l_linestatus, ship_year), (ship_year), (l_linestatus), ())"
    ),
)
def sales_grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    return _sales_by(spark, d, [_DIMS, ["ship_year"], ["l_linestatus"], []])


@query(
    "agg_count_distinct",
    """
    SELECT l_returnflag, count(DISTINCT l_orderkey) AS n_orders, count(DISTINCT l_partkey) AS n_parts,
      count(DISTINCT l_suppkey) AS n_suppliers, count(*) AS n_lines
    FROM lineitem GROUP BY l_returnflag
    """,
)
def distinct_keys(spark: SparkSession, d: str) -> DataFrame:
    counted = {"n_orders": "l_orderkey", "n_parts": "l_partkey", "n_suppliers": "l_suppkey"}
    return distinct_counts(table(spark, d, "lineitem"), ["l_returnflag"], counted, "n_lines")


@query(
    "agg_approx_distinct",
    """
    SELECT l_returnflag, count(DISTINCT l_orderkey) AS n_orders, true AS sketch_fits,
      true AS merged_sketch_fits FROM lineitem GROUP BY l_returnflag
    """,
)
def sketched_distinct_keys(spark: SparkSession, d: str) -> DataFrame:
    """Exact counts, and whether estimates are within three standard errors.

    A sketch per year that is merged later has an error of 0.8 %, the built-in
    estimate one of 5 %.
    """
    per_year = (
        table(spark, d, "lineitem")
        .groupBy("l_returnflag", F.year("l_shipdate").alias("ship_year"))
        .agg(F.hll_sketch_agg("l_orderkey", 14).alias("sketch"))
    )
    merged = per_year.groupBy("l_returnflag").agg(
        F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("merged")
    )
    flags = table(spark, d, "lineitem").groupBy("l_returnflag")
    # apart from the sketch, so that no sketch is kept per distinct key
    exact = flags.agg(F.countDistinct("l_orderkey").alias("n_orders"))
    direct = flags.agg(F.approx_count_distinct("l_orderkey").alias("direct"))

    def fits(estimate: str, error: float):
        return F.abs(F.col(estimate) / F.col("n_orders") - 1) <= 3 * error

    return exact.join(direct, "l_returnflag").join(merged, "l_returnflag").select(
        "l_returnflag",
        "n_orders",
        fits("direct", 0.05).alias("sketch_fits"),
        fits("merged", 0.008).alias("merged_sketch_fits"),
    )


@query(
    "agg_percentiles",
    """
    SELECT l_returnflag, quantile_cont(l_extendedprice, 0.5) AS median,
      quantile_cont(l_extendedprice, 0.9) AS p90, quantile_cont(l_extendedprice, 0.25) AS p25
    FROM lineitem GROUP BY l_returnflag
    """,
)
def price_percentiles(spark: SparkSession, d: str) -> DataFrame:
    shares = {"median": 0.5, "p90": 0.9, "p25": 0.25}
    return percentiles(table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", shares)


@query(
    "agg_percentiles_of_table",
    "SELECT median(o_totalprice) AS median, quantile_cont(o_totalprice, 0.75) AS p75 FROM orders",
)
def order_price_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return percentiles(table(spark, d, "orders"), [], "o_totalprice", {"median": 0.5, "p75": 0.75})


@query(
    "agg_approx_percentile",
    "SELECT event_type, true AS within_rank_error FROM events GROUP BY event_type",
)
def sketched_medians(spark: SparkSession, d: str) -> DataFrame:
    """Whether the approximate median lies within 1 % of the rows from the middle."""
    events = table(spark, d, "events")
    medians = events.groupBy("event_type").agg(
        F.percentile_approx("value", 0.5, 1000).alias("median")
    )
    near = percentiles(events, ["event_type"], "value", {"p49": 0.49, "p51": 0.51})
    fits = F.col("median").between(F.col("p49"), F.col("p51"))
    return medians.join(near, "event_type").select("event_type", fits.alias("within_rank_error"))


@query(
    "agg_statistics",
    """
    SELECT l_returnflag, round(stddev_samp(l_quantity), 6) AS sd, round(var_pop(l_discount), 8) AS var,
      round(corr(l_quantity, l_extendedprice), 6) AS r,
      round(covar_pop(l_quantity, l_tax), 6) AS cov,
      round(regr_slope(l_extendedprice, l_quantity), 4) AS slope
    FROM lineitem GROUP BY l_returnflag
    """,
)
def line_statistics(spark: SparkSession, d: str) -> DataFrame:
    return (
        table(spark, d, "lineitem")
        .groupBy("l_returnflag")
        .agg(
            F.round(F.stddev_samp("l_quantity"), 6).alias("sd"),
            F.round(F.var_pop("l_discount"), 8).alias("var"),
            F.round(F.corr("l_quantity", "l_extendedprice"), 6).alias("r"),
            F.round(F.covar_pop("l_quantity", "l_tax"), 6).alias("cov"),
            F.round(F.regr_slope("l_extendedprice", "l_quantity"), 4).alias("slope"),
        )
    )


@query(
    "agg_most_frequent",
    """
    SELECT user_id, event_type, n FROM (
      SELECT user_id, event_type, count(*) AS n,
        row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS place
      FROM events GROUP BY user_id, event_type) WHERE place = 1
    """,
)
def favourite_event_type(spark: SparkSession, d: str) -> DataFrame:
    return most_frequent(table(spark, d, "events"), ["user_id"], "event_type")


@query(
    "agg_latest_row",
    """
    SELECT user_id, event_id, ts, event_type, value, props FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1
    """,
)
def latest_event_per_user(spark: SparkSession, d: str) -> DataFrame:
    return latest(table(spark, d, "events"), ["user_id"], ["ts", "event_id"])


@query(
    "agg_first_and_last",
    """
    SELECT user_id, arg_min(event_type, event_id) AS first_type, arg_max(event_type, event_id) AS last_type,
      min(ts) AS first_ts, max(ts) AS last_ts FROM events GROUP BY user_id
    """,
)
def first_and_last_event(spark: SparkSession, d: str) -> DataFrame:
    return (
        table(spark, d, "events")
        .groupBy("user_id")
        .agg(
            F.min_by("event_type", "event_id").alias("first_type"),
            F.max_by("event_type", "event_id").alias("last_type"),
            F.min("ts").alias("first_ts"),
            F.max("ts").alias("last_ts"),
        )
    )


@query(
    "agg_pivot",
    "SELECT user_id, "
    + ", ".join(f"count(*) FILTER (WHERE event_type = '{t}') AS n_{t}" for t in TYPES)
    + " FROM events GROUP BY user_id",
)
def events_per_user_and_type(spark: SparkSession, d: str) -> DataFrame:
    wide = table(spark, d, "events").groupBy("user_id").pivot("event_type", TYPES).count()
    return wide.select("user_id", *[F.coalesce(t, F.lit(0)).alias(f"n_{t}") for t in TYPES])


@query(
    "agg_unpivot",
    """
    WITH t AS (SELECT l_returnflag, count(*) AS lines, count(DISTINCT l_suppkey) AS suppliers,
                 CAST(sum(l_linenumber) AS BIGINT) AS numbers FROM lineitem GROUP BY l_returnflag)
    SELECT l_returnflag, 'lines' AS measure, lines AS amount FROM t
    UNION ALL SELECT l_returnflag, 'suppliers', suppliers FROM t
    UNION ALL SELECT l_returnflag, 'numbers', numbers FROM t
    """,
)
def measures_as_rows(spark: SparkSession, d: str) -> DataFrame:
    totals = (
        table(spark, d, "lineitem")
        .groupBy("l_returnflag")
        .agg(
            F.count("*").alias("lines"),
            F.countDistinct("l_suppkey").alias("suppliers"),
            F.sum("l_linenumber").alias("numbers"),
        )
    )
    return totals.unpivot("l_returnflag", ["lines", "suppliers", "numbers"], "measure", "amount")


@query(
    "agg_histogram",
    """
    SELECT CAST(floor(o_totalprice / 25000) AS INTEGER) AS bucket, count(*) AS n,
      min(o_totalprice) AS low, max(o_totalprice) AS high FROM orders GROUP BY 1
    """,
)
def price_histogram(spark: SparkSession, d: str) -> DataFrame:
    return (
        table(spark, d, "orders")
        .groupBy(F.floor(F.col("o_totalprice") / 25000).cast("int").alias("bucket"))
        .agg(
            F.count("*").alias("n"),
            F.min("o_totalprice").alias("low"),
            F.max("o_totalprice").alias("high"),
        )
    )


@query(
    "agg_joined_text",
    """
    SELECT o_custkey, string_agg(DISTINCT o_orderpriority, ', ' ORDER BY o_orderpriority) AS priorities
    FROM orders GROUP BY o_custkey
    """,
)
def priorities_per_customer(spark: SparkSession, d: str) -> DataFrame:
    # a set of priorities has five members at most, however many orders there are
    used = F.array_sort(F.collect_set("o_orderpriority"))
    return (
        table(spark, d, "orders")
        .groupBy("o_custkey")
        .agg(F.array_join(used, ", ").alias("priorities"))
    )


@query(
    "agg_distinct_rows",
    "SELECT DISTINCT o_custkey, o_orderstatus, o_orderpriority FROM orders",
)
def distinct_rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_custkey", "o_orderstatus", "o_orderpriority").distinct()


@query(
    "agg_frequent",
    """
    SELECT event_type, user_id, n, n_rows FROM (
      SELECT event_type, user_id, count(*) AS n, CAST(sum(count(*)) OVER (PARTITION BY event_type) AS BIGINT) AS n_rows
      FROM events GROUP BY event_type, user_id)
    WHERE 1000 * n > 8 * n_rows
    """,
)
def frequent_users(spark: SparkSession, d: str) -> DataFrame:
    """Users with more than 8 of 1,000 events of a type."""
    return frequent(table(spark, d, "events"), ["event_type"], "user_id", (8, 1000))

"""Kinds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkbeam.functions.money import money, revenue
from larkbeam.functions.times import wall_micros
from larkbeam.operators.joins import asof_join, range_join, salted_join, sum_in_range
from larkbeam.operators.overlap import overlap_join, overlap_summary
from larkbeam.plans.registry import query
from larkbeam.plans.star import REVENUE
from larkbeam.sources.tables import table


@query(
    "join_semi",
    """
    SELECT o_orderkey, o_custkey, o_totalprice FROM orders
    WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')
    """,
)
def orders_with_returns(spark: SparkSession, d: str) -> DataFrame:
    returned = (
        table(spark, d, "lineitem").where(F.col("l_returnflag") == "R").select("l_orderkey").distinct()
    )
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return orders.join(returned, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi")


@query(
    "join_anti",
    """
    SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders
    WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)
    """,
)
def orders_without_lines(spark: SparkSession, d: str) -> DataFrame:
    present = table(spark, d, "lineitem").select("l_orderkey").distinct()
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return orders.join(present, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti")


@query(
    "join_left_outer",
    """
    SELECT p_partkey, p_brand, count(l_partkey) AS n_lines,
      CAST(coalesce(sum(CAST(l_quantity AS DECIMAL(12,2))), 0) AS DOUBLE) AS quantity
    FROM part LEFT JOIN lineitem ON p_partkey = l_partkey AND l_quantity > 48
    GROUP BY p_partkey, p_brand
    """,
)
def bulk_lines_per_part(spark: SparkSession, d: str) -> DataFrame:
    bulk = (
        table(spark, d, "lineitem")
        .where(F.col("l_quantity") > 48)
        .groupBy("l_partkey")
        .agg(F.count("*").alias("n"), F.sum(money("l_quantity")).alias("q"))
    )
    parts = table(spark, d, "part").select("p_partkey", "p_brand")
    return parts.join(bulk, F.col("p_partkey") == F.col("l_partkey"), "left").select(
        "p_partkey",
        "p_brand",
        F.coalesce("n", F.lit(0)).cast("bigint").alias("n_lines"),
        F.coalesce(F.col("q").cast("double"), F.lit(0.0)).alias("quantity"),
    )


@query(
    "join_full_outer",
    """
    WITH a AS (SELECT o_custkey, sum(CAST(o_totalprice AS DECIMAL(12,2))) AS spent FROM orders
               WHERE year(o_orderdate) = 1996 GROUP BY o_custkey),
         b AS (SELECT o_custkey, sum(CAST(o_totalprice AS DECIMAL(12,2))) AS spent FROM orders
               WHERE year(o_orderdate) = 2000 GROUP BY o_custkey)
    SELECT coalesce(a.o_custkey, b.o_custkey) AS custkey,
      CAST(a.spent AS DOUBLE) AS spent_1996, CAST(b.spent AS DOUBLE) AS spent_2000
    FROM a FULL JOIN b ON a.o_custkey = b.o_custkey
    """,
)
def spending_in_two_years(spark: SparkSession, d: str) -> DataFrame:
    def spent(year: int) -> DataFrame:
        first, after = F.lit(f"{year}-01-01"), F.lit(f"{year + 1}-01-01")
        orders = table(spark, d, "orders").where(
            (F.col("o_orderdate") >= first.cast("timestamp_ntz"))
            & (F.col("o_orderdate") < after.cast("timestamp_ntz"))
        )
        return orders.groupBy(F.col("o_custkey").alias("custkey")).agg(
            F.sum(money("o_totalprice")).cast("double").alias(f"spent_{year}")
        )

    return spent(1996).join(spent(2000), "custkey", "full")


@query(
    "join_skewed_keys",
    f"""
    SELECT s_nationkey, count(*) AS n_lines, CAST(sum({REVENUE}) AS DOUBLE) AS revenue,
      CAST(max(s_acctbal) AS DOUBLE) AS best_balance
    FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey GROUP BY s_nationkey
    """,
)
def lines_per_supplier_nation(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").withColumnRenamed("l_suppkey", "suppkey")
    suppliers = table(spark, d, "supplier").withColumnRenamed("s_suppkey", "suppkey")
    return (
        salted_join(lines, suppliers, ["suppkey"], "left")
        .groupBy("s_nationkey")
        .agg(
            F.count("*").alias("n_lines"),
            F.sum(revenue()).cast("double").alias("revenue"),
            F.max("s_acctbal").alias("best_balance"),
        )
    )


@query(
    "join_asof",
    """
    WITH clicks AS (SELECT user_id, ts, event_id, value FROM events WHERE event_type = 'click')
    SELECT p.event_id, p.user_id, p.value, coalesce(c.event_id, -1) AS click_id, c.ts AS click_ts,
      c.value AS click_value
    FROM (SELECT * FROM events WHERE event_type = 'purchase') p
    ASOF LEFT JOIN clicks c ON p.user_id = c.user_id AND p.ts >= c.ts
    """,
)
def purchase_with_latest_click(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events")
    purchases = events.where(F.col("event_type") == "purchase")
    clicks = events.where(F.col("event_type") == "click")
    matched = asof_join(
        purchases.select("event_id", "user_id", "value", "ts"),
        clicks,
        ["user_id"],
        "ts",
        "ts",
        {"click_id": "event_id", "click_ts": "ts", "click_value": "value"},
    )
    return matched.drop("ts").fillna(-1, ["click_id"])


@query(
    "join_asof_without_key",
    """
    WITH signups AS (SELECT ts, event_id, user_id FROM events WHERE event_type = 'signup')
    SELECT e.event_id, coalesce(s.event_id, -1) AS signup_id,
      coalesce(s.user_id, -1) AS signup_user
    FROM (SELECT * FROM events WHERE event_type = 'error') e
    ASOF LEFT JOIN signups s ON e.ts >= s.ts
    """,
)
def error_with_latest_signup(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events")
    matched = asof_join(
        events.where(F.col("event_type") == "error").select("event_id", "ts"),
        events.where(F.col("event_type") == "signup"),
        [],
        "ts",
        "ts",
        {"signup_id": "event_id", "signup_user": "user_id"},
    )
    return matched.drop("ts").fillna(-1, ["signup_id", "signup_user"])


@query(
    "join_range",
    """
    SELECT p.event_id AS purchase_id, e.event_id AS error_id, p.user_id,
      CAST(epoch_us(e.ts) - epoch_us(p.ts) AS BIGINT) AS micros_after
    FROM events p JOIN events e ON p.user_id = e.user_id
      AND e.ts >= p.ts AND e.ts < p.ts + INTERVAL 6 HOUR
    WHERE p.event_type = 'purchase' AND e.event_type = 'error'
    """,
)
def errors_after_purchase(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events")
    purchases = events.where(F.col("event_type") == "purchase").select(
        F.col("event_id").alias("purchase_id"),
        "user_id",
        F.col("ts").alias("start"),
        (F.col("ts") + F.expr("INTERVAL 6 HOURS")).alias("stop"),
    )
    errors = events.where(F.col("event_type") == "error").select(
        F.col("event_id").alias("error_id"), "user_id", "ts"
    )
    return range_join(errors, purchases, ["user_id"], "ts", "start", "stop").select(
        "purchase_id",
        "error_id",
        "user_id",
        (wall_micros(F.col("ts")) - wall_micros(F.col("start"))).alias("micros_after"),
    )


@query(
    "join_range_sums",
    """
    SELECT p.event_id, count(c.event_id) AS n_views,
      CAST(coalesce(sum(CAST(c.value AS DECIMAL(12,2))), 0) AS DOUBLE) AS view_value
    FROM events p LEFT JOIN events c ON p.user_id = c.user_id AND c.event_type = 'view'
      AND c.ts >= p.ts - INTERVAL 3 DAY AND c.ts < p.ts
    WHERE p.event_type = 'purchase' GROUP BY p.event_id
    """,
)
def views_before_purchase(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events")
    sums = sum_in_range(
        events.where(F.col("event_type") == "purchase"),
        events.where(F.col("event_type") == "view"),
        ["user_id"],
        "event_id",
        F.col("ts") - F.expr("INTERVAL 3 DAYS"),
        F.col("ts"),
        "ts",
        {"n_views": F.lit(1).cast("bigint"), "view_value": money("value")},
    )
    return sums.withColumn("view_value", F.col("view_value").cast("double"))


@query(
    "join_overlap",
    """
    WITH open AS (
        SELECT o_custkey, o_orderkey, o_orderdate AS s, o_orderdate + to_days(CAST(5 + o_orderkey % 60 AS INTEGER)) AS e
        FROM orders
    )
    SELECT a.o_custkey AS custkey, a.o_orderkey AS first_order, b.o_orderkey AS second_order,
           greatest(a.s, b.s) AS both_from, least(a.e, b.e) AS both_to
    FROM open a JOIN open b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey AND a.s < b.e AND b.s < a.e
    """,
)
def orders_open_together(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of orders of a customer that are open at the same time, each for 5 to 64 days."""
    until = F.expr("o_orderdate + make_dt_interval(cast(5 + o_orderkey % 60 AS int))")
    open_ = table(spark, d, "orders").select(F.col("o_custkey").alias("custkey"), "o_orderkey", "o_orderdate", until.alias("o_until"))
    one = open_.select("custkey", F.col("o_orderkey").alias("first_order"), F.col("o_orderdate").alias("s"), F.col("o_until").alias("e"))
    two = open_.select("custkey", F.col("o_orderkey").alias("second_order"), F.col("o_orderdate").alias("t"), F.col("o_until").alias("f"))
    pairs = overlap_join(one, two, ["custkey"], "s", "e", "t", "f").where("first_order < second_order")
    return pairs.select("custkey", "first_order", "second_order", F.greatest("s", "t").alias("both_from"), F.least("e", "f").alias("both_to"))


@query(
    "join_overlap_no_key",
    """
    WITH busy AS (
        SELECT event_id, user_id, event_type, ts AS s, ts + to_seconds(CAST(60 * floor(value) AS BIGINT)) AS e
        FROM events WHERE value >= 1
    )
    SELECT a.event_id AS error_id, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT b.user_id) AS BIGINT) AS users,
           max(b.event_id) AS last_purchase
    FROM busy a JOIN busy b ON a.event_type = 'error' AND b.event_type = 'purchase' AND a.s < b.e AND b.s < a.e
    GROUP BY a.event_id
    """,
)
def purchases_during_errors(spark: SparkSession, d: str) -> DataFrame:
    """For each error, what is bought while it lasts; errors and purchases last minutes to hours."""
    until = F.expr("ts + make_dt_interval(0, 0, cast(floor(value) AS int))")
    busy = table(spark, d, "events").where("value >= 1").select("event_id", "user_id", "event_type", "ts", until.alias("until"))
    errors = busy.where("event_type = 'error'").select(F.col("event_id").alias("error_id"), F.col("ts").alias("s"), F.col("until").alias("e"))
    bought = busy.where("event_type = 'purchase'").select("event_id", "user_id", F.col("ts").alias("t"), F.col("until").alias("f"))
    last, users = {"last_purchase": "event_id"}, {"users": "user_id"}
    return overlap_summary(errors, bought, "error_id", "s", "e", "t", "f", "n", users, last)

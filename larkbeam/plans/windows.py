"""Window functions, sorting and top-k."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkbeam.functions.money import money
from larkbeam.functions.times import wall_micros
from larkbeam.operators.joins import sum_in_range
from larkbeam.operators.patterns import attempts
from larkbeam.operators.skew import hot_groups
from larkbeam.operators.windows import framed, ntile, ranks, row_numbers, running
from larkbeam.plans.registry import query
from larkbeam.sources.tables import table

VALUE = "CAST(value AS DECIMAL(12,2))"


@query(
    "win_top_per_group",
    """
    SELECT o_custkey, o_orderkey, o_totalprice, CAST(place AS INTEGER) AS place FROM (
      SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place
      FROM orders) WHERE place <= 3
    """,
)
def top_orders_per_customer(spark: SparkSession, d: str) -> DataFrame:
    # Spark keeps three rows per customer and task before the shuffle (WindowGroupLimit)
    by_price = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return (
        table(spark, d, "orders")
        .select("o_custkey", "o_orderkey", "o_totalprice", F.row_number().over(by_price).alias("place"))
        .where(F.col("place") <= 3)
    )


@query(
    "win_ranks",
    """
    SELECT o_orderkey, rank() OVER w AS rank, dense_rank() OVER w AS dense_rank,
      percent_rank() OVER w AS percent_rank, cume_dist() OVER w AS cume_dist
    FROM orders WINDOW w AS (PARTITION BY o_orderstatus, o_orderpriority ORDER BY o_orderdate)
    """,
)
def order_date_ranks(spark: SparkSession, d: str) -> DataFrame:
    keys = ["o_orderstatus", "o_orderpriority"]
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderdate", *keys)
    ranked = ranks(orders, keys, "o_orderdate", "o_orderkey", hot_groups(orders, keys))
    return ranked.drop("o_orderdate", *keys)


@query(
    "win_running_totals",
    f"""
    SELECT event_id, count(*) OVER w AS n, CAST(sum({VALUE}) OVER w AS DOUBLE) AS total,
      max(value) OVER w AS high,
      CAST({VALUE} AS DOUBLE) / CAST(sum({VALUE}) OVER (PARTITION BY user_id) AS DOUBLE) AS share
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)
    """,
)
def running_totals_per_user(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").select("event_id", "user_id", "ts", "value")
    columns = {
        "n": ("sum", F.lit(1).cast("bigint")),
        "total": ("sum", money("value")),
        "high": ("max", F.col("value")),
        "_all": ("total", money("value")),
    }
    totals = running(events, ["user_id"], ["ts", "event_id"], columns, hot_groups(events, ["user_id"]))
    return totals.select(
        "event_id",
        "n",
        F.col("total").cast("double").alias("total"),
        "high",
        (money("value").cast("double") / F.col("_all").cast("double")).alias("share"),
    )


@query(
    "win_lag_lead",
    """
    SELECT event_id, coalesce(lag(event_type) OVER w, 'none') AS previous_type,
      coalesce(lead(event_type, 2) OVER w, 'none') AS second_next_type,
      coalesce(CAST(epoch_us(ts) - epoch_us(lag(ts) OVER w) AS BIGINT), -1) AS micros_since
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
    """,
)
def neighbouring_events(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").select("event_id", "user_id", "ts", "event_type")
    micros = wall_micros(F.col("ts"))

    def build(w):
        return {
            "previous_type": F.coalesce(F.lag("event_type").over(w), F.lit("none")),
            "second_next_type": F.coalesce(F.lead("event_type", 2).over(w), F.lit("none")),
            "micros_since": F.coalesce(micros - F.lag(micros).over(w), F.lit(-1)),
        }

    hot = hot_groups(events, ["user_id"])
    return framed(events, ["user_id"], ["ts", "event_id"], 1, 2, build, hot).drop(
        "user_id", "ts", "event_type"
    )


@query(
    "win_moving_frame",
    f"""
    SELECT event_id, CAST(sum({VALUE}) OVER w AS DOUBLE) / count(*) OVER w AS moving_mean,
      min(value) OVER w AS low, max(value) OVER w AS high
    FROM events
    WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 6 PRECEDING AND 2 FOLLOWING)
    """,
)
def moving_mean_per_user(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").select("event_id", "user_id", "ts", "value")

    def build(w):
        near = w.rowsBetween(-6, 2)
        total = F.sum(money("value")).over(near).cast("double")
        return {
            "moving_mean": total / F.count("*").over(near),
            "low": F.min("value").over(near),
            "high": F.max("value").over(near),
        }

    hot = hot_groups(events, ["user_id"])
    return framed(events, ["user_id"], ["ts", "event_id"], 6, 2, build, hot).drop(
        "user_id", "ts", "value"
    )


@query(
    "win_time_frame",
    f"""
    SELECT event_id, count(*) OVER w AS n, CAST(sum({VALUE}) OVER w AS DOUBLE) AS total
    FROM events
    WINDOW w AS (PARTITION BY user_id ORDER BY ts
                 RANGE BETWEEN INTERVAL 24 HOURS PRECEDING AND CURRENT ROW)
    """,
)
def last_day_per_event(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").select("event_id", "user_id", "ts", "value")
    # the frame holds both ends, and times are whole microseconds
    after = F.col("ts") + F.expr("INTERVAL 0.000001 SECONDS")
    sums = {"n": F.lit(1).cast("bigint"), "total": money("value")}
    found = sum_in_range(
        events,
        events,
        ["user_id"],
        "event_id",
        F.col("ts") - F.expr("INTERVAL 24 HOURS"),
        after,
        "ts",
        sums,
        null_keys=True,
    )
    return found.withColumn("total", F.col("total").cast("double"))


@query(
    "win_ntile",
    """
    SELECT c_custkey, CAST(ntile(4) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey)
      AS INTEGER) AS quarter FROM customer
    """,
)
def balance_quarters(spark: SparkSession, d: str) -> DataFrame:
    customers = table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    keys = ["c_nationkey"]
    columns = {"_at": ("sum", F.lit(1).cast("bigint")), "_all": ("total", F.lit(1).cast("bigint"))}
    placed = running(customers, keys, ["c_acctbal", "c_custkey"], columns, hot_groups(customers, keys))
    return placed.select("c_custkey", ntile(4, F.col("_at"), F.col("_all")).alias("quarter"))


@query(
    "win_daily_trend",
    """
    WITH days AS (SELECT CAST(o_orderdate AS DATE) AS d,
                    sum(CAST(o_totalprice AS DECIMAL(12,2))) AS sales FROM orders GROUP BY 1)
    SELECT CAST(d AS TIMESTAMP) AS order_day, CAST(sales AS DOUBLE) AS sales,
      CAST(sum(sales) OVER (ORDER BY d) AS DOUBLE) AS sales_to_date,
      CAST(sum(sales) OVER (ORDER BY d ROWS 6 PRECEDING) AS DOUBLE) AS seven_days
    FROM days
    """,
)
def daily_sales_trend(spark: SparkSession, d: str) -> DataFrame:
    days = (
        table(spark, d, "orders")
        .groupBy(F.col("o_orderdate").cast("date").alias("day"))
        .agg(F.sum(money("o_totalprice")).alias("sales"))
    )
    # one row per calendar day is left, so one task may order them
    by_day = Window.orderBy("day")
    to_date = F.sum("sales").over(by_day.rowsBetween(Window.unboundedPreceding, 0))
    week = F.sum("sales").over(by_day.rowsBetween(-6, 0))
    return days.select(
        F.col("day").cast("timestamp_ntz").alias("order_day"),
        F.col("sales").cast("double").alias("sales"),
        to_date.cast("double").alias("sales_to_date"),
        week.cast("double").alias("seven_days"),
    )


@query(
    "sort_positions",
    """
    SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS place
    FROM orders
    """,
)
def orders_by_price(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    placed = row_numbers(
        orders, [], ["-o_totalprice", "o_orderkey"], "place", hot_groups(orders, [])
    )
    return placed.orderBy("place")


@query(
    "sort_top",
    """
    SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice, l_shipdate FROM lineitem
    ORDER BY l_extendedprice DESC, l_orderkey, l_partkey, l_suppkey, l_linenumber, l_shipdate LIMIT 50
    """,
)
def dearest_lines(spark: SparkSession, d: str) -> DataFrame:
    ties = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate"]
    return (
        table(spark, d, "lineitem")
        .select("l_extendedprice", *ties)
        .orderBy(F.desc("l_extendedprice"), *ties)
        .limit(50)
    )


@query(
    "sort_offset_page",
    """
    SELECT p_partkey, p_name, p_retailprice FROM part
    ORDER BY p_retailprice DESC, p_partkey LIMIT 25 OFFSET 50
    """,
)
def third_page_of_parts(spark: SparkSession, d: str) -> DataFrame:
    return (
        table(spark, d, "part")
        .select("p_partkey", "p_name", "p_retailprice")
        .orderBy(F.desc("p_retailprice"), "p_partkey")
        .offset(50)
        .limit(25)
    )


@query(
    "win_attempts",
    """
    WITH RECURSIVE numbered AS (
        SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn
        FROM events WHERE event_type IN ('view', 'click', 'purchase', 'error')
    ), walk AS (
        SELECT user_id, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS seen, CAST(NULL AS BIGINT) AS tried,
               CAST(0 AS BIGINT) AS nth, CAST(NULL AS BIGINT) AS over_seen, CAST(NULL AS BIGINT) AS over_tried,
               CAST(NULL AS BIGINT) AS over_bought
        FROM (SELECT DISTINCT user_id FROM numbered)
        UNION ALL
        SELECT w.user_id, n.rn,
               CASE WHEN n.event_type = 'error' OR (n.event_type = 'purchase' AND w.tried IS NOT NULL) THEN NULL
                    WHEN n.event_type = 'view' THEN coalesce(w.seen, n.event_id) ELSE w.seen END,
               CASE WHEN n.event_type = 'error' OR (n.event_type = 'purchase' AND w.tried IS NOT NULL) THEN NULL
                    WHEN n.event_type = 'click' AND w.seen IS NOT NULL THEN coalesce(w.tried, n.event_id) ELSE w.tried END,
               w.nth + CAST((n.event_type = 'error' AND w.seen IS NOT NULL) OR (n.event_type = 'purchase' AND w.tried IS NOT NULL) AS BIGINT),
               CASE WHEN n.event_type = 'error' OR (n.event_type = 'purchase' AND w.tried IS NOT NULL) THEN w.seen END,
               CASE WHEN n.event_type = 'error' OR (n.event_type = 'purchase' AND w.tried IS NOT NULL) THEN w.tried END,
               CASE WHEN n.event_type = 'purchase' AND w.tried IS NOT NULL THEN n.event_id END
        FROM walk w JOIN numbered n ON n.user_id IS NOT DISTINCT FROM w.user_id AND n.rn = w.rn + 1
    )
    SELECT user_id, nth, over_bought IS NOT NULL AS complete, over_seen AS seen, coalesce(over_tried, -1) AS tried,
           coalesce(over_bought, -1) AS bought
    FROM walk WHERE over_seen IS NOT NULL
    UNION ALL
    SELECT user_id, nth + 1, false, seen, coalesce(tried, -1), -1 FROM walk w
    WHERE seen IS NOT NULL AND rn = (SELECT max(rn) FROM numbered n WHERE n.user_id IS NOT DISTINCT FROM w.user_id)
    """,
)
def ways_to_a_purchase(spark: SparkSession, d: str) -> DataFrame:
    """Every attempt of a user to go from a view over a click to a purchase, which an error ends."""
    kind = F.col("event_type")
    steps = {"seen": kind == "view", "tried": kind == "click", "bought": kind == "purchase"}
    found = attempts(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], steps, "event_id", kind == "error")
    return found.fillna(-1, ["tried", "bought"])

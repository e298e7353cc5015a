"""Reports over the star schema: joins on keys, then aggregation.

Where a report needs only sums per join key, lines are summed before they are
joined. The sums need the same shuffle as the join, carry fewer rows through
it, and leave one row per key, so an order or part that holds much of the
table does not load one task. Other joins shuffle the lines as they are, and
adaptive execution splits the partitions that a hot key fills. No side is
broadcast by hint unless a limit bounds it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkbeam.functions.money import hundredths, money, revenue, revenue_units, taxed_units, total
from larkbeam.plans.registry import query
from larkbeam.sources.tables import table

PRICE = "CAST(l_extendedprice AS DECIMAL(12,2))"
REVENUE = f"{PRICE} * (1 - CAST(l_discount AS DECIMAL(3,2)))"


def _amount(value: Column | str) -> Column:
    return F.sum(value).cast("double")


def _day(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def _year(name: str) -> Column:
    return F.year(name).cast("int")


def _customer_places(spark: SparkSession, d: str) -> DataFrame:
    nation = table(spark, d, "nation")
    region = table(spark, d, "region")
    places = nation.join(region, nation.n_regionkey == region.r_regionkey)
    customer = table(spark, d, "customer")
    return customer.join(places, customer.c_nationkey == places.n_nationkey)


def _revenue_per_order(lines: DataFrame) -> DataFrame:
    return lines.groupBy("l_orderkey").agg(
        F.sum(revenue()).alias("order_revenue"), F.count("*").alias("order_lines")
    )


@query(
    "star_revenue_by_region",
    f"""
    SELECT r_name, CAST(sum({REVENUE}) AS DOUBLE) AS revenue, count(*) AS n_lines
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    JOIN region ON n_regionkey = r_regionkey GROUP BY r_name
    """,
)
def revenue_by_region(spark: SparkSession, d: str) -> DataFrame:
    per_order = _revenue_per_order(table(spark, d, "lineitem"))
    orders = table(spark, d, "orders").join(
        per_order, F.col("o_orderkey") == F.col("l_orderkey")
    )
    per_customer = orders.groupBy("o_custkey").agg(
        F.sum("order_revenue").alias("customer_revenue"), F.sum("order_lines").alias("lines")
    )
    places = _customer_places(spark, d).select("c_custkey", "r_name")
    return (
        per_customer.join(places, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy("r_name")
        .agg(_amount("customer_revenue").alias("revenue"), F.sum("lines").alias("n_lines"))
    )


@query(
    "star_pricing_summary",
    f"""
    SELECT l_returnflag, l_linestatus,
      CAST(sum(CAST(l_quantity AS DECIMAL(12,2))) AS DOUBLE) AS sum_qty,
      CAST(sum({PRICE}) AS DOUBLE) AS sum_base_price,
      CAST(sum({REVENUE}) AS DOUBLE) AS sum_disc_price,
      CAST(sum({REVENUE} * (1 + CAST(l_tax AS DECIMAL(3,2)))) AS DOUBLE) AS sum_charge,
      CAST(sum(CAST(l_quantity AS DECIMAL(12,2))) AS DOUBLE) / count(*) AS avg_qty,
      CAST(sum({PRICE}) AS DOUBLE) / count(*) AS avg_price,
      CAST(sum(CAST(l_discount AS DECIMAL(3,2))) AS DOUBLE) / count(*) AS avg_disc,
      count(*) AS count_order
    FROM lineitem WHERE l_shipdate <= TIMESTAMP '2001-09-02'
    GROUP BY l_returnflag, l_linestatus
    """,
)
def pricing_summary(spark: SparkSession, d: str) -> DataFrame:
    def amount(units: Column, scale: int) -> Column:
        return total(units, scale).cast("double")

    sums = (
        table(spark, d, "lineitem")
        .where(F.col("l_shipdate") <= _day("2001-09-02"))
        .groupBy("l_returnflag", "l_linestatus")
        .agg(
            amount(hundredths("l_quantity"), 2).alias("sum_qty"),
            amount(hundredths("l_extendedprice"), 2).alias("sum_base_price"),
            amount(revenue_units(), 4).alias("sum_disc_price"),
            amount(taxed_units(), 6).alias("sum_charge"),
            amount(hundredths("l_discount"), 2).alias("sum_disc"),
            F.count("*").alias("count_order"),
        )
    )
    return sums.select(
        *[c for c in sums.columns if c != "sum_disc"],
        (F.col("sum_qty") / F.col("count_order")).alias("avg_qty"),
        (F.col("sum_base_price") / F.col("count_order")).alias("avg_price"),
        (F.col("sum_disc") / F.col("count_order")).alias("avg_disc"),
    )


@query(
    "star_unshipped_orders_top10",
    f"""
    SELECT l_orderkey, CAST(sum({REVENUE}) AS DOUBLE) AS revenue, o_orderdate, o_orderpriority
    FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
    WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP '1998-03-15'
      AND l_shipdate > TIMESTAMP '1998-03-15'
    GROUP BY l_orderkey, o_orderdate, o_orderpriority
    ORDER BY revenue DESC, l_orderkey LIMIT 10
    """,
)
def unshipped_orders_top10(spark: SparkSession, d: str) -> DataFrame:
    cut = _day("1998-03-15")
    customer = table(spark, d, "customer").where(F.col("c_mktsegment") == "BUILDING")
    orders = table(spark, d, "orders").where(F.col("o_orderdate") < cut)
    chosen = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"), "left_semi")
    late = _revenue_per_order(table(spark, d, "lineitem").where(F.col("l_shipdate") > cut))
    return (
        late.join(chosen, F.col("l_orderkey") == F.col("o_orderkey"))
        .select(
            "l_orderkey",
            F.col("order_revenue").cast("double").alias("revenue"),
            "o_orderdate",
            "o_orderpriority",
        )
        .orderBy(F.desc("revenue"), "l_orderkey")
        .limit(10)
    )


@query(
    "star_priority_of_late_orders",
    """
    SELECT o_orderpriority, count(*) AS order_count FROM orders
    WHERE o_orderdate >= TIMESTAMP '1997-07-01' AND o_orderdate < TIMESTAMP '1998-07-01'
      AND EXISTS (SELECT 1 FROM lineitem
                  WHERE l_orderkey = o_orderkey AND l_shipdate > o_orderdate + INTERVAL 90 DAY)
    GROUP BY o_orderpriority
    """,
)
def priority_of_late_orders(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").where(
        (F.col("o_orderdate") >= _day("1997-07-01")) & (F.col("o_orderdate") < _day("1998-07-01"))
    )
    # the latest shipment decides, so one row per order is enough
    shipped = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("last"))
    late = (F.col("l_orderkey") == F.col("o_orderkey")) & (
        F.col("last") > F.col("o_orderdate") + F.expr("INTERVAL 90 DAYS")
    )
    return (
        orders.join(shipped, late, "left_semi")
        .groupBy("o_orderpriority")
        .agg(F.count("*").alias("order_count"))
    )


@query(
    "star_local_supplier_revenue",
    f"""
    SELECT n_name, CAST(sum({REVENUE}) AS DOUBLE) AS revenue
    FROM customer, orders, lineitem, supplier, nation, region
    WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_suppkey = s_suppkey
      AND c_nationkey = s_nationkey AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey
      AND r_name = 'ASIA' AND o_orderdate >= TIMESTAMP '1997-01-01'
      AND o_orderdate < TIMESTAMP '1999-01-01'
    GROUP BY n_name
    """,
)
def local_supplier_revenue(spark: SparkSession, d: str) -> DataFrame:
    customers = _customer_places(spark, d).where(F.col("r_name") == "ASIA")
    orders = table(spark, d, "orders").where(
        (F.col("o_orderdate") >= _day("1997-01-01")) & (F.col("o_orderdate") < _day("1999-01-01"))
    )
    placed = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
    per_supplier = (
        table(spark, d, "lineitem")
        .join(placed, F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy("l_suppkey", "c_nationkey", "n_name")
        .agg(F.sum(revenue()).alias("supplier_revenue"))
    )
    local = (F.col("l_suppkey") == F.col("s_suppkey")) & (
        F.col("c_nationkey") == F.col("s_nationkey")
    )
    return (
        per_supplier.join(table(spark, d, "supplier"), local)
        .groupBy("n_name")
        .agg(_amount("supplier_revenue").alias("revenue"))
    )


@query(
    "star_discount_forecast",
    f"""
    SELECT CAST(sum({PRICE} * CAST(l_discount AS DECIMAL(3,2))) AS DOUBLE) AS revenue
    FROM lineitem
    WHERE l_shipdate >= TIMESTAMP '1997-01-01' AND l_shipdate < TIMESTAMP '1998-01-01'
      AND CAST(l_discount AS DECIMAL(3,2)) BETWEEN 0.05 AND 0.07 AND l_quantity < 24
    """,
)
def discount_forecast(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").where(
        (F.col("l_shipdate") >= _day("1997-01-01"))
        & (F.col("l_shipdate") < _day("1998-01-01"))
        & (F.col("l_quantity") < 24)
        & F.col("l_discount").between(0.045, 0.075)  # 0.05 to 0.07, in whole hundredths
    )
    saved = hundredths("l_extendedprice") * hundredths("l_discount")
    return lines.agg(total(saved, 4).cast("double").alias("revenue"))


@query(
    "star_trade_between_nations",
    f"""
    SELECT s.n_name AS supp_nation, c.n_name AS cust_nation,
      CAST(year(l_shipdate) AS INTEGER) AS ship_year, CAST(sum({REVENUE}) AS DOUBLE) AS revenue
    FROM supplier JOIN lineitem ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey
    JOIN customer ON c_custkey = o_custkey JOIN nation s ON s_nationkey = s.n_nationkey
    JOIN nation c ON c_nationkey = c.n_nationkey
    GROUP BY ALL
    """,
)
def trade_between_nations(spark: SparkSession, d: str) -> DataFrame:
    nation = table(spark, d, "nation").select("n_nationkey", "n_name")
    customers = (
        table(spark, d, "customer")
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .select("c_custkey", F.col("n_name").alias("cust_nation"))
    )
    suppliers = (
        table(spark, d, "supplier")
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .select("s_suppkey", F.col("n_name").alias("supp_nation"))
    )
    orders = table(spark, d, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey"))
    per_supplier = (
        table(spark, d, "lineitem")
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy("l_suppkey", "cust_nation", _year("l_shipdate").alias("ship_year"))
        .agg(F.sum(revenue()).alias("supplier_revenue"))
    )
    return (
        per_supplier.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
        .groupBy("supp_nation", "cust_nation", "ship_year")
        .agg(_amount("supplier_revenue").alias("revenue"))
    )


@query(
    "star_market_share",
    f"""
    WITH sales AS (
      SELECT CAST(year(o_orderdate) AS INTEGER) AS order_year, p_type, {REVENUE} AS volume
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)
    SELECT order_year, CAST(sum(volume) FILTER (WHERE p_type = 'ECONOMY') AS DOUBLE)
      / CAST(sum(volume) AS DOUBLE) AS economy_share
    FROM sales GROUP BY order_year
    """,
)
def market_share(spark: SparkSession, d: str) -> DataFrame:
    per_part = (
        table(spark, d, "lineitem")
        .join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy("l_partkey", _year("o_orderdate").alias("order_year"))
        .agg(F.sum(revenue()).alias("volume"))
    )
    parts = table(spark, d, "part").select("p_partkey", "p_type")
    economy = F.when(F.col("p_type") == "ECONOMY", F.col("volume"))
    return (
        per_part.join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .groupBy("order_year")
        .agg((_amount(economy) / _amount("volume")).alias("economy_share"))
    )


@query(
    "star_returned_items_top20",
    f"""
    SELECT c_custkey, c_name, CAST(sum({REVENUE}) AS DOUBLE) AS revenue, c_acctbal, n_name
    FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
    JOIN nation ON c_nationkey = n_nationkey
    WHERE l_returnflag = 'R' AND o_orderdate >= TIMESTAMP '1997-10-01'
      AND o_orderdate < TIMESTAMP '1999-01-01'
    GROUP BY c_custkey, c_name, c_acctbal, n_name ORDER BY revenue DESC, c_custkey LIMIT 20
    """,
)
def returned_items_top20(spark: SparkSession, d: str) -> DataFrame:
    returned = _revenue_per_order(table(spark, d, "lineitem").where(F.col("l_returnflag") == "R"))
    orders = table(spark, d, "orders").where(
        (F.col("o_orderdate") >= _day("1997-10-01")) & (F.col("o_orderdate") < _day("1999-01-01"))
    )
    per_customer = (
        orders.join(returned, F.col("o_orderkey") == F.col("l_orderkey"))
        .groupBy("o_custkey")
        .agg(_amount("order_revenue").alias("revenue"))
    )
    # only the twenty customers of the report are looked up
    top = per_customer.orderBy(F.desc("revenue"), "o_custkey").limit(20)
    return (
        table(spark, d, "customer")
        .join(F.broadcast(top), F.col("c_custkey") == F.col("o_custkey"))
        .join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .select("c_custkey", "c_name", "revenue", "c_acctbal", "n_name")
        .orderBy(F.desc("revenue"), "c_custkey")
    )


@query(
    "star_lines_by_priority",
    """
    SELECT l_linestatus,
      count(*) FILTER (WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')) AS high_lines,
      count(*) FILTER (WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH')) AS low_lines
    FROM orders JOIN lineitem ON o_orderkey = l_orderkey
    WHERE l_shipdate > o_orderdate GROUP BY l_linestatus
    """,
)
def lines_by_priority(spark: SparkSession, d: str) -> DataFrame:
    urgent = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    after = (F.col("l_orderkey") == F.col("o_orderkey")) & (
        F.col("l_shipdate") > F.col("o_orderdate")
    )
    return (
        table(spark, d, "lineitem")
        .join(table(spark, d, "orders"), after)
        .groupBy("l_linestatus")
        .agg(
            F.count_if(urgent).alias("high_lines"),
            F.count_if(~urgent).alias("low_lines"),
        )
    )


@query(
    "star_orders_per_customer",
    """
    SELECT n_orders, count(*) AS n_customers FROM (
      SELECT c_custkey, count(o_orderkey) AS n_orders
      FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderpriority <> '5-LOW'
      GROUP BY c_custkey) GROUP BY n_orders
    """,
)
def orders_per_customer(spark: SparkSession, d: str) -> DataFrame:
    counts = (
        table(spark, d, "orders")
        .where(F.col("o_orderpriority") != "5-LOW")
        .groupBy("o_custkey")
        .agg(F.count("*").alias("n"))
    )
    return (
        table(spark, d, "customer")
        .join(counts, F.col("c_custkey") == F.col("o_custkey"), "left")
        .groupBy(F.coalesce("n", F.lit(0)).cast("bigint").alias("n_orders"))
        .agg(F.count("*").alias("n_customers"))
    )


@query(
    "star_promotion_effect",
    f"""
    SELECT CAST(sum({REVENUE}) FILTER (WHERE p_type = 'PROMO') AS DOUBLE) AS promo_revenue,
      CAST(sum({REVENUE}) AS DOUBLE) AS revenue
    FROM lineitem JOIN part ON l_partkey = p_partkey
    WHERE l_shipdate >= TIMESTAMP '1998-09-01' AND l_shipdate < TIMESTAMP '1998-10-01'
    """,
)
def promotion_effect(spark: SparkSession, d: str) -> DataFrame:
    per_part = (
        table(spark, d, "lineitem")
        .where(
            (F.col("l_shipdate") >= _day("1998-09-01")) & (F.col("l_shipdate") < _day("1998-10-01"))
        )
        .groupBy("l_partkey")
        .agg(F.sum(revenue()).alias("volume"))
    )
    promo = F.when(F.col("p_type") == "PROMO", F.col("volume"))
    return per_part.join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).agg(
        _amount(promo).alias("promo_revenue"), _amount("volume").alias("revenue")
    )


@query(
    "star_top_suppliers",
    f"""
    WITH revenue AS (
      SELECT l_suppkey, sum({REVENUE}) AS total FROM lineitem
      WHERE l_shipdate >= TIMESTAMP '1998-01-01' AND l_shipdate < TIMESTAMP '1998-04-01'
      GROUP BY l_suppkey)
    SELECT s_suppkey, s_name, CAST(total AS DOUBLE) AS total_revenue
    FROM supplier JOIN revenue ON s_suppkey = l_suppkey
    WHERE total = (SELECT max(total) FROM revenue)
    """,
)
def top_suppliers(spark: SparkSession, d: str) -> DataFrame:
    per_supplier = (
        table(spark, d, "lineitem")
        .where(
            (F.col("l_shipdate") >= _day("1998-01-01")) & (F.col("l_shipdate") < _day("1998-04-01"))
        )
        .groupBy("l_suppkey")
        .agg(F.sum(revenue()).alias("total"))
    )
    # each task passes on only its best suppliers (WindowGroupLimit)
    place = F.rank().over(Window.orderBy(F.desc("total")))
    return (
        per_supplier.withColumn("place", place)
        .where(F.col("place") == 1)
        .join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .select("s_suppkey", "s_name", F.col("total").cast("double").alias("total_revenue"))
    )


@query(
    "star_small_quantity_revenue",
    f"""
    SELECT CAST(sum({PRICE}) AS DOUBLE) / 7.0::DOUBLE AS avg_yearly
    FROM lineitem JOIN part ON l_partkey = p_partkey
    WHERE p_brand = 'Brand#3' AND l_quantity < (
      SELECT 0.4::DOUBLE * CAST(sum(CAST(l2.l_quantity AS DECIMAL(12,2))) AS DOUBLE) / count(*)
      FROM lineitem l2 WHERE l2.l_partkey = p_partkey)
    """,
)
def small_quantity_revenue(spark: SparkSession, d: str) -> DataFrame:
    # lines of one part and quantity are interchangeable: sum them before anything else
    per_quantity = (
        table(spark, d, "lineitem")
        .groupBy("l_partkey", "l_quantity")
        .agg(F.sum(money("l_extendedprice")).alias("price"), F.count("*").alias("n"))
    )
    parts = table(spark, d, "part").where(F.col("p_brand") == "Brand#3").select("p_partkey")
    chosen = per_quantity.join(parts, F.col("l_partkey") == F.col("p_partkey"), "left_semi")
    # a part has one row per quantity, of which there are few
    part = Window.partitionBy("l_partkey")
    quantity = F.sum(money("l_quantity") * F.col("n")).over(part).cast("double")
    limit = 0.4 * quantity / F.sum("n").over(part)
    return (
        chosen.withColumn("limit", limit)
        .where(F.col("l_quantity") < F.col("limit"))
        .agg((_amount("price") / 7.0).alias("avg_yearly"))
    )


@query(
    "star_large_orders_top100",
    """
    SELECT c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice,
      CAST(sum(CAST(l_quantity AS DECIMAL(12,2))) AS DOUBLE) AS sum_qty
    FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey
    GROUP BY ALL HAVING sum(CAST(l_quantity AS DECIMAL(12,2))) > 200
    ORDER BY o_totalprice DESC, o_orderkey LIMIT 100
    """,
)
def large_orders_top100(spark: SparkSession, d: str) -> DataFrame:
    large = (
        table(spark, d, "lineitem")
        .groupBy("l_orderkey")
        .agg(F.sum(money("l_quantity")).alias("quantity"))
        .where(F.col("quantity") > 200)
    )
    top = (
        table(spark, d, "orders")
        .join(large, F.col("o_orderkey") == F.col("l_orderkey"))
        .select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice", "quantity")
        .orderBy(F.desc("o_totalprice"), "o_orderkey")
        .limit(100)
    )
    return (
        table(spark, d, "customer")
        .join(F.broadcast(top), F.col("c_custkey") == F.col("o_custkey"))
        .select(
            "c_name",
            "c_custkey",
            "o_orderkey",
            "o_orderdate",
            "o_totalprice",
            F.col("quantity").cast("double").alias("sum_qty"),
        )
        .orderBy(F.desc("o_totalprice"), "o_orderkey")
    )


@query(
    "star_brand_quantity_revenue",
    f"""
    SELECT CAST(sum({REVENUE}) AS DOUBLE) AS revenue FROM lineitem
    JOIN part ON p_partkey = l_partkey
    WHERE (p_brand = 'Brand#12' AND l_quantity BETWEEN 1 AND 11 AND p_size BETWEEN 1 AND 15)
       OR (p_brand = 'Brand#23' AND l_quantity BETWEEN 10 AND 20 AND p_size BETWEEN 1 AND 30)
       OR (p_brand = 'Brand#4' AND l_quantity BETWEEN 20 AND 30 AND p_size BETWEEN 1 AND 50)
    """,
)
def brand_quantity_revenue(spark: SparkSession, d: str) -> DataFrame:
    choices = [("Brand#12", 1, 11, 15), ("Brand#23", 10, 20, 30), ("Brand#4", 20, 30, 50)]
    wanted, stocked = F.lit(False), F.lit(False)
    for brand, low, high, size in choices:
        of_brand = (F.col("p_brand") == brand) & F.col("p_size").between(1, size)
        stocked = stocked | of_brand
        wanted = wanted | (of_brand & F.col("l_quantity").between(low, high))
    per_quantity = (
        table(spark, d, "lineitem")
        .where(F.col("l_quantity").between(1, 30))
        .groupBy("l_partkey", "l_quantity")
        .agg(F.sum(revenue()).alias("volume"))
    )
    parts = table(spark, d, "part").where(stocked)
    return (
        per_quantity.join(parts, (F.col("l_partkey") == F.col("p_partkey")) & wanted)
        .agg(_amount("volume").alias("revenue"))
    )


@query(
    "star_idle_rich_customers",
    """
    SELECT c_nationkey, count(*) AS n_customers,
      CAST(sum(CAST(c_acctbal AS DECIMAL(12,2))) AS DOUBLE) AS total_balance
    FROM customer
    WHERE CAST(c_acctbal AS DECIMAL(12,2)) * 1000000 > (
        SELECT sum(CAST(c_acctbal AS DECIMAL(12,2))) * 1000000 / count(*)
        FROM customer WHERE c_acctbal > 0)
      AND NOT EXISTS (SELECT 1 FROM orders
                      WHERE o_custkey = c_custkey AND o_orderdate >= TIMESTAMP '2000-06-01')
    GROUP BY c_nationkey
    """,
)
def idle_rich_customers(spark: SparkSession, d: str) -> DataFrame:
    customer = table(spark, d, "customer")
    balance = money("c_acctbal")
    typical = customer.where(F.col("c_acctbal") > 0).agg(F.sum(balance) / F.count("*")).scalar()
    recent = (
        table(spark, d, "orders")
        .where(F.col("o_orderdate") >= _day("2000-06-01"))
        .select("o_custkey")
        .distinct()
    )
    return (
        customer.where(balance > typical)
        .join(recent, F.col("c_custkey") == F.col("o_custkey"), "left_anti")
        .groupBy("c_nationkey")
        .agg(F.count("*").alias("n_customers"), _amount(balance).alias("total_balance"))
    )

"""Tables written in other formats and layouts, and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkbeam.functions.money import money, revenue
from larkbeam.plans.registry import query
from larkbeam.plans.star import REVENUE
from larkbeam.sources.files import bucket_count, bucketed, rewritten
from larkbeam.sources.tables import SCHEMAS, table

_ORDERS = """
    SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders
"""


@query("source_csv", _ORDERS)
def orders_from_csv(spark: SparkSession, d: str) -> DataFrame:
    return rewritten(table(spark, d, "orders"), "csv", name="orders_csv")


@query("source_json", "SELECT event_id, ts, user_id, event_type, value, props FROM events")
def events_from_json(spark: SparkSession, d: str) -> DataFrame:
    return rewritten(table(spark, d, "events"), "json", name="events_json")


@query("source_xml", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def customers_from_xml(spark: SparkSession, d: str) -> DataFrame:
    return rewritten(table(spark, d, "customer"), "xml", name="customer_xml")


_DOCUMENTS = "SELECT doc_id, text, lang, source, n_chars FROM documents"


@query("source_csv_text", _DOCUMENTS)
def documents_from_csv(spark: SparkSession, d: str) -> DataFrame:
    """Texts with line breaks, quotes and padding through CSV."""
    return rewritten(table(spark, d, "documents"), "csv", name="documents_csv")


@query("source_xml_text", "SELECT page_id, url, html FROM pages")
def pages_from_xml(spark: SparkSession, d: str) -> DataFrame:
    """Pages, which are markup themselves, through XML."""
    return rewritten(table(spark, d, "pages"), "xml", name="pages_xml")


@query(
    "source_orc",
    """
    SELECT vec_id, label, len(embedding) AS n,
      CAST(list_sum(list_transform(embedding, lambda x, i: i * CAST(floor(1048576 * CAST(x AS DOUBLE)) AS BIGINT))) AS BIGINT) AS digest
    FROM embeddings
    """,
)
def vectors_from_orc(spark: SparkSession, d: str) -> DataFrame:
    """Vectors through ORC, and a number that depends on every component and its place."""
    vectors = rewritten(table(spark, d, "embeddings"), "orc", name="embeddings_orc")
    placed = F.transform("embedding", lambda x, i: (i + 1) * F.floor(1048576 * x.cast("double")))
    digest = F.aggregate(placed, F.lit(0).cast("bigint"), lambda a, b: a + b)
    return vectors.select("vec_id", "label", F.size("embedding").cast("bigint").alias("n"), digest.alias("digest"))


@query(
    "source_partitioned",
    f"""
    SELECT CAST(year(l_shipdate) AS INTEGER) AS ship_year, l_returnflag, count(*) AS n,
      CAST(sum({REVENUE}) AS DOUBLE) AS revenue
    FROM lineitem WHERE year(l_shipdate) IN (1997, 1998) GROUP BY ALL
    """,
)
def two_years_of_a_partitioned_table(spark: SparkSession, d: str) -> DataFrame:
    lines = (
        table(spark, d, "lineitem")
        .select("l_returnflag", "l_extendedprice", "l_discount", F.year("l_shipdate").alias("ship_year"))
    )
    stored = rewritten(lines, partition_by=["ship_year"], name="lineitem_by_year")
    return (
        stored.where(F.col("ship_year").isin(1997, 1998))
        .groupBy("ship_year", "l_returnflag")
        .agg(F.count("*").alias("n"), F.sum(revenue()).cast("double").alias("revenue"))
    )


@query(
    "source_bucketed",
    """
    SELECT o_orderkey, o_custkey, count(*) AS n_lines,
      CAST(sum(CAST(l_quantity AS DECIMAL(12,2))) AS DOUBLE) AS quantity
    FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey, o_custkey
    """,
)
def join_of_bucketed_tables(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    # one row per order on both sides, so no bucket holds much more than the others
    per_order = (
        table(spark, d, "lineitem")
        .groupBy("l_orderkey")
        .agg(F.count("*").alias("n_lines"), F.sum(money("l_quantity")).alias("quantity"))
    )
    buckets = bucket_count(orders.count())
    stored = bucketed(orders, "o_orderkey", buckets, "orders")
    sums = bucketed(per_order, "l_orderkey", buckets, "lines_per_order")
    return stored.join(sums, F.col("o_orderkey") == F.col("l_orderkey")).select(
        "o_orderkey", "o_custkey", "n_lines", F.col("quantity").cast("double").alias("quantity")
    )


@query(
    "source_sql_text",
    f"""
    SELECT n_name, count(DISTINCT o_orderkey) AS n_orders, CAST(sum({REVENUE}) AS DOUBLE) AS revenue
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey
    WHERE o_orderpriority = '1-URGENT' GROUP BY n_name
    """,
)
def urgent_orders_in_sql(spark: SparkSession, d: str) -> DataFrame:
    views = {name: table(spark, d, name) for name in SCHEMAS}
    return spark.sql(
        """
        WITH per_order AS (
          SELECT l_orderkey, sum(CAST(l_extendedprice AS DECIMAL(12,2))
                   * (1 - CAST(l_discount AS DECIMAL(3,2)))) AS revenue
          FROM {lineitem} GROUP BY l_orderkey)
        SELECT n_name, count(*) AS n_orders, CAST(sum(revenue) AS DOUBLE) AS revenue
        FROM per_order JOIN {orders} ON l_orderkey = o_orderkey
        JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey
        WHERE o_orderpriority = '1-URGENT' GROUP BY n_name
        """,
        **{name: views[name] for name in ("lineitem", "orders", "customer", "nation")},
    )

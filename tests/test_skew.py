"""All queries again, on tables where one key holds a third of the rows.

The limit of rows per group is set so low that every operator works in pieces,
and adaptive execution is made to split partitions of a few rows.
"""

from contextlib import ExitStack

import duckdb
import pytest

from check import connect, difference
from larkbeam.plans import all_queries
from larkbeam.session import setting
from larkbeam.sources.tables import SCHEMAS, table

# a third of the rows of a table get one value in these columns
HOT = {
    "orders": "o_custkey = CASE WHEN o_orderkey % 3 = 0 THEN 7 ELSE o_custkey END",
    "lineitem": (
        "l_orderkey = CASE WHEN l_partkey % 3 = 0 THEN 11 ELSE l_orderkey END, "
        "l_suppkey = CASE WHEN l_partkey % 3 = 1 THEN 3 ELSE l_suppkey END, "
        "l_partkey = CASE WHEN l_partkey % 3 = 2 THEN 5 ELSE l_partkey END"
    ),
    "events": "user_id = CASE WHEN event_id % 3 = 0 THEN 2 ELSE user_id END",
    "customer": "c_nationkey = CASE WHEN c_custkey % 3 = 0 THEN 4 ELSE c_nationkey END",
}
ADAPTIVE = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4KB",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.files.maxPartitionBytes": "32KB",
    "spark.sql.files.openCostInBytes": "0",
    "larkbeam.rowsPerGroup": "50",
}
QUERIES = all_queries()


@pytest.fixture(scope="module")
def skewed(small, tmp_path_factory):
    folder = tmp_path_factory.mktemp("skewed")
    con = duckdb.connect()
    for name in SCHEMAS:
        con.execute(f"CREATE TABLE {name} AS SELECT * FROM '{small}/{name}.parquet'")
        if name in HOT:
            con.execute(f"UPDATE {name} SET {HOT[name]}")
        # several row groups, for several tasks
        con.execute(f"COPY {name} TO '{folder}/{name}.parquet' (ROW_GROUP_SIZE 2048)")
    return str(folder)


@pytest.fixture(scope="module")
def duck(skewed):
    return connect(skewed)


@pytest.fixture()
def pieces(spark):
    with ExitStack() as stack:
        for key, value in ADAPTIVE.items():
            stack.enter_context(setting(spark, key, value))
        yield


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if not n.startswith(("fn_", "source_"))))
def test_query_on_skewed_tables(spark, skewed, duck, pieces, name):
    query = QUERIES[name]
    got = query.plan(spark, skewed).toPandas()
    assert difference(got, duck.execute(query.oracle).df()) is None


def test_adaptive_execution_splits_a_hot_key(spark, skewed, pieces):
    lines, orders = table(spark, skewed, "lineitem"), table(spark, skewed, "orders")
    joined = lines.join(orders, lines.l_orderkey == orders.o_orderkey)
    plan = joined.select("l_extendedprice", "o_orderdate")
    assert len(plan.collect()) == lines.count()
    assert "skew=true" in plan._jdf.queryExecution().executedPlan().toString()

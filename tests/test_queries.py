"""Every named query must give the rows of its oracle."""

import pytest

from check import connect, difference
from larkbeam.plans import all_queries
from larkbeam.sources.tables import SCHEMAS, table

QUERIES = all_queries()


@pytest.fixture(scope="module")
def duck(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_oracle(spark, small, duck, name):
    query = QUERIES[name]
    got = query.plan(spark, small).toPandas()
    assert len(got) > 0
    assert difference(got, duck.execute(query.oracle).df()) is None


@pytest.mark.parametrize("name", sorted(SCHEMAS))
def test_stated_schema_is_that_of_the_file(spark, small, name):
    stored = spark.read.parquet(f"{small}/{name}.parquet")
    assert stored.dtypes == table(spark, small, name).dtypes


def test_driver_contract(spark):
    import __spark_entry__ as contract

    assert contract.entry(spark).count() == 5
    assert set(QUERIES) <= set(contract.queries())
    assert set(QUERIES) <= set(contract.oracle_sql()) <= set(contract.queries())

"""Queries with Python functions over batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkbeam.functions.batches import Words, aggregate_batches, compound, title
from larkbeam.plans.registry import query
from larkbeam.sources.tables import table


@query(
    "py_pandas_udf",
    """
    SELECT l_orderkey, l_linenumber, l_partkey,
      round(l_extendedprice * power(1 + l_tax, l_linenumber + 0.5::DOUBLE), 4) AS grown
    FROM lineitem
    """,
)
def compounded_prices(spark: SparkSession, d: str) -> DataFrame:
    grown = compound(F.col("l_extendedprice"), F.col("l_tax"), F.col("l_linenumber") + 0.5)
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.round(grown, 4).alias("grown")
    )


@query(
    "py_arrow_udf",
    """
    SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '),
      lambda w: upper(w[1]) || w[2:]), ' ') AS title FROM part
    """,
)
def part_titles(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", title("p_name").alias("title"))


def _logs(batch: pd.DataFrame) -> pd.DataFrame:
    logs = np.log(batch["value"])
    groups = pd.DataFrame({"event_type": batch["event_type"], "log_sum": logs, "n": 1})
    return groups.groupby("event_type", as_index=False).sum()


@query(
    "py_batch_aggregate",
    """
    SELECT event_type, round(exp(sum(ln(value)) / count(*)), 6) AS geometric_mean, count(*) AS n
    FROM events GROUP BY event_type
    """,
)
def geometric_means(spark: SparkSession, d: str) -> DataFrame:
    sums = aggregate_batches(
        table(spark, d, "events").select("event_type", "value"),
        ["event_type"],
        _logs,
        "event_type string, log_sum double, n bigint",
        {"log_sum": F.sum, "n": F.sum},
    )
    mean = F.exp(F.col("log_sum") / F.col("n"))
    return sums.select("event_type", F.round(mean, 6).alias("geometric_mean"), "n")


@query(
    "py_table_function",
    """
    SELECT p_partkey, CAST(i - 1 AS INTEGER) AS position, word
    FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word,
            generate_subscripts(string_split(p_name, ' '), 1) AS i FROM part)
    """,
)
def words_with_positions(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part").select("p_partkey", "p_name")
    return Words(parts.asTable()).withColumnRenamed("key", "p_partkey")


def _large(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept = batch.filter(pc.greater(batch["value"], 100.0))
        cents = pc.cast(pc.round(pc.multiply(kept["value"], 100.0)), pa.int64())
        yield pa.RecordBatch.from_arrays([kept["event_id"], cents], names=["event_id", "cents"])


@query(
    "py_arrow_batches",
    """
    SELECT event_id, CAST(round(value * 100) AS BIGINT) AS cents FROM events WHERE value > 100
    """,
)
def large_values_in_cents(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").select("event_id", "value")
    return events.where("value > 100").mapInArrow(_large, "event_id bigint, cents bigint")

"""Set operations. Copies are merged before the shuffle, so they cannot pile up in a task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COPIES_PER_TASK = 100_000


def union_distinct(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).distinct()


def intersect_distinct(a: DataFrame, b: DataFrame) -> DataFrame:
    return _sides(a, b).where("_side = 3").drop("_side")


def except_distinct(a: DataFrame, b: DataFrame) -> DataFrame:
    return _sides(a, b).where("_side = 1").drop("_side")


def _sides(a: DataFrame, b: DataFrame) -> DataFrame:
    """Each different row once, with 1 if it is in ``a``, 2 if in ``b``, 3 if in both."""
    both = a.withColumn("_side", F.lit(1)).unionByName(b.withColumn("_side", F.lit(2)))
    return both.groupBy(*a.columns).agg(F.bit_or("_side").alias("_side"))


def intersect_all(a: DataFrame, b: DataFrame) -> DataFrame:
    return _copies(a, b, F.least("_in_a", "_in_b"))


def except_all(a: DataFrame, b: DataFrame) -> DataFrame:
    return _copies(a, b, F.col("_in_a") - F.col("_in_b"))


def _copies(a: DataFrame, b: DataFrame, wanted: Column) -> DataFrame:
    both = a.withColumn("_a", F.lit(1)).unionByName(b.withColumn("_a", F.lit(0)))
    counted = both.groupBy(*a.columns).agg(
        F.sum("_a").alias("_in_a"), F.sum(1 - F.col("_a")).alias("_in_b")
    )
    kept = counted.withColumn("_wanted", wanted).where(F.col("_wanted") > 0)
    # many copies of one row are written by many tasks
    last = F.floor((F.col("_wanted") - 1) / COPIES_PER_TASK)
    parts = kept.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("_part"))
    spread = parts.repartition("_part", *a.columns)
    here = F.least(F.lit(COPIES_PER_TASK), F.col("_wanted") - F.col("_part") * COPIES_PER_TASK)
    copies = F.explode(F.array_repeat(F.lit(1), here.cast("int"))).alias("_copy")
    return spread.select(*a.columns, copies).drop("_copy")

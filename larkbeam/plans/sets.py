"""Set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkbeam.operators import sets
from larkbeam.plans.registry import query
from larkbeam.sources.tables import table

_SIDES = {
    flag: f"SELECT l_partkey AS partkey FROM lineitem WHERE l_returnflag = '{flag}'" for flag in "AR"
}


def _parts(spark: SparkSession, d: str, flag: str) -> DataFrame:
    lines = table(spark, d, "lineitem").where(F.col("l_returnflag") == flag)
    return lines.select(F.col("l_partkey").alias("partkey"))


@query(
    "set_union_all",
    """
    SELECT 'customer' AS kind, c_custkey AS id, c_nationkey AS nationkey, c_acctbal AS balance FROM customer
    UNION ALL SELECT 'supplier', s_suppkey, s_nationkey, s_acctbal FROM supplier
    """,
)
def parties(spark: SparkSession, d: str) -> DataFrame:
    def party(name: str, letter: str) -> DataFrame:
        return table(spark, d, name).select(
            F.lit(name).alias("kind"),
            F.col(f"{letter}_{name[:4]}key").alias("id"),
            F.col(f"{letter}_nationkey").alias("nationkey"),
            F.col(f"{letter}_acctbal").alias("balance"),
        )

    return party("customer", "c").unionByName(party("supplier", "s"))


@query("set_union", f"{_SIDES['A']} UNION {_SIDES['R']}")
def parts_returned_or_accepted(spark: SparkSession, d: str) -> DataFrame:
    return sets.union_distinct(_parts(spark, d, "A"), _parts(spark, d, "R"))


@query("set_intersect", f"{_SIDES['A']} INTERSECT {_SIDES['R']}")
def parts_returned_and_accepted(spark: SparkSession, d: str) -> DataFrame:
    return sets.intersect_distinct(_parts(spark, d, "A"), _parts(spark, d, "R"))


@query("set_intersect_all", f"{_SIDES['A']} INTERSECT ALL {_SIDES['R']}")
def matched_returns(spark: SparkSession, d: str) -> DataFrame:
    return sets.intersect_all(_parts(spark, d, "A"), _parts(spark, d, "R"))


@query(
    "set_except",
    """
    SELECT l_partkey AS partkey, l_suppkey AS suppkey FROM lineitem WHERE l_returnflag = 'A'
    EXCEPT SELECT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R'
    """,
)
def pairs_never_returned(spark: SparkSession, d: str) -> DataFrame:
    def pairs(flag: str) -> DataFrame:
        lines = table(spark, d, "lineitem").where(F.col("l_returnflag") == flag)
        return lines.select(F.col("l_partkey").alias("partkey"), F.col("l_suppkey").alias("suppkey"))

    return sets.except_distinct(pairs("A"), pairs("R"))


@query("set_except_all", f"{_SIDES['A']} EXCEPT ALL {_SIDES['R']}")
def surplus_returns(spark: SparkSession, d: str) -> DataFrame:
    return sets.except_all(_parts(spark, d, "A"), _parts(spark, d, "R"))

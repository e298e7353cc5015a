"""Aggregations whose groups may be of any size."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkbeam.operators.skew import settled
from larkbeam.operators.windows import running

_MERGE = {"sum": F.sum, "min": F.min, "max": F.max}


def percentiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    shares: Mapping[str, float],
    rows_per_group: int | None = None,
) -> DataFrame:
    """Exact interpolated percentiles per group.

    The built-in exact percentile keeps all distinct values of a group in one
    task's memory. Here values are counted first, and running counts show
    which value holds each wanted position. A group without values has nulls.
    """
    # nulls count nothing, but keep their group
    counts = df.groupBy(*keys, value).agg(F.count(value).alias("_n"))
    counts, hot = settled(df, counts, keys, rows_per_group)
    placed = running(
        counts, keys, [value], {"_upto": ("sum", F.col("_n")), "_all": ("total", F.col("_n"))}, hot
    )
    first, last = F.col("_upto") - F.col("_n"), F.col("_upto") - 1

    def at(position: Column) -> Column:
        holds = (first <= position) & (position <= last)
        return F.max(F.when(holds, F.col(value).cast("double")))

    picks = []
    for name, share in shares.items():
        position = F.lit(share) * (F.col("_all") - 1)
        picks += [
            at(F.floor(position)).alias(f"_low_{name}"),
            at(F.ceil(position)).alias(f"_high_{name}"),
            F.max(position - F.floor(position)).alias(f"_part_{name}"),
        ]
    found = placed.groupBy(*keys).agg(*picks)
    return found.select(
        *keys,
        *[
            (
                F.col(f"_low_{name}")
                + (F.col(f"_high_{name}") - F.col(f"_low_{name}")) * F.col(f"_part_{name}")
            ).alias(name)
            for name in shares
        ],
    )


def most_frequent(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """The most frequent value per group and its count; the smallest on a tie."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("_n"))
    best = F.min_by(F.struct(F.col(value), F.col("_n")), F.struct(-F.col("_n"), F.col(value)))
    return (
        counts.groupBy(*keys)
        .agg(best.alias("_best"))
        .select(*keys, F.col(f"_best.{value}").alias(value), F.col("_best._n").alias("n"))
    )


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each group by ``order``; each task hands on one row per group."""
    rest = [c for c in df.columns if c not in keys]
    row = F.max_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(row.alias("_row")).select(*keys, "_row.*").select(*df.columns)


def grouping_sets(
    df: DataFrame,
    sets: Sequence[Sequence[str]],
    measures: Mapping[str, tuple[str, Column]],
) -> DataFrame:
    """Sums, minima and maxima for several sets of dimensions at once.

    The table is first aggregated by all dimensions together. The sets are
    then built from that smaller result, not from a copy of every row per set.
    A dimension that a set leaves out is null; ``set_id`` has one bit per
    dimension, set where it is left out, the first dimension highest.
    """
    dims = list(dict.fromkeys(d for s in sets for d in s))
    base = df.groupBy(*dims).agg(*[_MERGE[k](c).alias(name) for name, (k, c) in measures.items()])
    return base.groupingSets([[F.col(d) for d in s] for s in sets], *dims).agg(
        F.grouping_id().cast("bigint").alias("set_id"),
        *[
            # adding up sums must not widen a decimal
            _MERGE[kind](name).cast(base.schema[name].dataType).alias(name)
            for name, (kind, _) in measures.items()
        ],
    )


def rollup_sets(dims: Sequence[str]) -> list[list[str]]:
    return [list(dims[:n]) for n in range(len(dims), -1, -1)]


def cube_sets(dims: Sequence[str]) -> list[list[str]]:
    return [
        [d for i, d in enumerate(dims) if not mask >> (len(dims) - 1 - i) & 1]
        for mask in range(2 ** len(dims))
    ]


def distinct_counts(df: DataFrame, keys: Sequence[str], counted: Mapping[str, str], rows: str | None = None) -> DataFrame:
    """How many different values each column of ``counted`` has in each group, nulls left out; ``rows`` names a count of rows.

    Several distinct counts in one aggregation make Spark copy every row once for each. Here each column is
    read and made distinct alone, and only one row a group of each is joined.
    """
    out = df.groupBy(*keys).agg(F.count("*").alias(rows or "_rows"))
    for name, column in counted.items():
        own = df.where(F.col(column).isNotNull()).select(*[F.col(k).alias(f"_of_{k}") for k in keys], F.col(column).alias("_value"))
        found = own.distinct().groupBy(*[f"_of_{k}" for k in keys]).agg(F.count("*").alias("_found"))
        same = F.lit(True)
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
        out = out.join(found, same, "left").withColumn(name, F.coalesce("_found", F.lit(0))).drop("_found", *[f"_of_{k}" for k in keys])
    return out if rows else out.drop("_rows")

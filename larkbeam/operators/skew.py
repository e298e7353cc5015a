"""Groups too large for one task: finding them, and cutting them in order.

A window or an ordered scan puts all rows of a group in one task. Where a
group holds a large share of the table, that task decides the run time of the
whole job. ``hot_groups`` finds such groups, ``apart`` separates their rows from
the others, and ``segmented`` cuts them into consecutive ranges of the ordering,
each small enough for a task.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkbeam.functions.times import wall_micros
from larkbeam.sources.files import rewritten

ROWS_PER_GROUP = 5_000_000

_LOWEST = -math.inf


@dataclass(frozen=True)
class HotGroups:
    """The groups over the limit.

    ``keys`` has one row per hot group, so at most the rows of the table by ``rows_per_group``; None means
    that all groups are hot. ``rows`` is how many rows they have together, and
    ``largest`` how many the largest one has.
    """

    keys: DataFrame | None
    rows: int
    largest: int
    rows_per_group: int

    def segments(self) -> int:
        return _pieces(self.rows, self.rows_per_group)

    def salts(self) -> int:
        return _pieces(self.largest, self.rows_per_group)


def _pieces(rows: int, rows_per_piece: int) -> int:
    return max(2, math.ceil(rows / rows_per_piece))


def hot_groups(
    df: DataFrame, keys: Sequence[str], rows_per_group: int | None = None
) -> HotGroups | None:
    """The groups of ``df`` with more than ``rows_per_group`` rows, or None.

    Without a number, the session's ``larkbeam.rowsPerGroup`` or else
    ``ROWS_PER_GROUP`` counts. Runs a count, and a second, grouped one only if
    the table is larger than one group may be. Without ``keys`` the whole table
    is the group.

    A table of n rows has fewer than n / ``rows_per_group`` such groups: 200,000 for 10^12 rows and the
    number set here, so the result may be broadcast.
    """
    rows_per_group = rows_per_group or _default_rows(df)
    total = df.count()
    if total <= rows_per_group:
        return None
    if not keys:
        return HotGroups(None, total, total, rows_per_group)
    sizes = df.groupBy(*keys).agg(F.count("*").alias("_size")).where(F.col("_size") > rows_per_group)
    # a small table, written so that the rows are counted only once
    sizes = rewritten(sizes, name="hot")
    rows, largest = sizes.agg(F.sum("_size"), F.max("_size")).first()
    return HotGroups(sizes.select(*keys), rows, largest, rows_per_group) if rows else None


def _default_rows(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("larkbeam.rowsPerGroup", str(ROWS_PER_GROUP)))


def settled(
    source: DataFrame, derived: DataFrame, keys: Sequence[str], rows_per_group: int | None = None
) -> tuple[DataFrame, HotGroups | None]:
    """``derived``, which has no more rows than ``source``, and its hot groups.

    Looking for hot groups and cutting them reads a table several times. So a
    derived table that may have hot groups is written once and read from there.
    """
    rows_per_group = rows_per_group or _default_rows(source)
    if source.count() <= rows_per_group:
        return derived, None
    stored = rewritten(derived, name="settled")
    return stored, hot_groups(stored, keys, rows_per_group)


def flag_hot(df: DataFrame, keys: Sequence[str], hot: HotGroups) -> DataFrame:
    """``df`` with a boolean ``_hot``. Null keys form a group like any other."""
    small, same = _hot_keys(keys, hot)
    flagged = df.join(small.withColumn("_hot", F.lit(True)), same, "left")
    return flagged.select(*df.columns, F.coalesce("_hot", F.lit(False)).alias("_hot"))


def apart(
    df: DataFrame, keys: Sequence[str], hot: HotGroups
) -> tuple[DataFrame | None, DataFrame, HotGroups]:
    """The rows of other groups, those of hot groups, and ``hot`` as it applies to the latter."""
    if hot.keys is None:
        return None, df, hot
    small, same = _hot_keys(keys, hot)
    cold, rows = df.join(small, same, "left_anti"), df.join(small, same, "left_semi")
    return cold, rows, replace(hot, keys=None)


def _hot_keys(keys: Sequence[str], hot: HotGroups) -> tuple[DataFrame, list[Column]]:
    names = [f"_hot_{k}" for k in keys]
    small = hot.keys.select(*[F.col(k).alias(name) for k, name in zip(keys, names)])
    same = [F.col(k).eqNullSafe(F.col(name)) for k, name in zip(keys, names)]
    return F.broadcast(small), same


def ordering(order: Sequence[str]) -> list[Column]:
    """Sort columns from names, a leading minus meaning descending."""
    return [F.col(o[1:]).desc() if o.startswith("-") else F.col(o).asc() for o in order]


def segmented(df: DataFrame, order: Sequence[str], hot: HotGroups) -> DataFrame:
    """Rows of hot groups, written with ``_seg``, which rises with the order, and ``_place``, their place in it.

    The cuts are those of Spark's range partitioner, from a sample of all the rows, so no
    segment has much more than ``rows_per_group`` of them, but for rows that are equal in all of ``order``. Columns may
    be of any type that sorts, in either direction.
    """
    by = ordering(order)
    dealt = df.repartitionByRange(hot.segments(), *by).sortWithinPartitions(*by)
    # numbers of partitions and rows hold once they are written
    placed = dealt.withColumns({"_seg": F.spark_partition_id().cast("bigint"), "_place": F.monotonically_increasing_id()})
    return rewritten(placed, name="segments")


def as_number(df: DataFrame, name: str) -> Column:
    """A double that sorts as the column does; nulls lowest, and no negative zero, which sorts as zero does."""
    kind, column = df.schema[name].dataType, F.col(name)
    if isinstance(kind, T.TimestampNTZType):
        number = wall_micros(column)
    elif isinstance(kind, T.TimestampType):
        number = F.unix_micros(column)
    elif isinstance(kind, T.DateType):
        number = F.unix_date(column)
    elif isinstance(kind, T.NumericType):
        number = column
    else:
        raise TypeError(f"cannot cut along {name}: {kind.simpleString()}")
    return F.coalesce(number.cast("double") + F.lit(0.0), F.lit(_LOWEST))

"""Joins that Spark has no operator for, and joins on skewed keys."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkbeam.operators.skew import as_number, flag_hot, hot_groups
from larkbeam.operators.windows import running

_KEEPS_LEFT = {"inner", "left", "left_semi", "left_anti"}

#: The class of infinite points; those of intervals are exponents of a double.
_INFINITE = -5000


def salted_join(
    big: DataFrame,
    small: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    rows_per_group: int | None = None,
) -> DataFrame:
    """Equi-join where a few keys, or null, may hold much of ``big``.

    Rows of ``big`` with a hot key are spread over several salts, and the rows
    of ``small`` with that key are copied to each. With no hot key this is a
    plain join, for which Spark picks broadcast or shuffle by size.
    """
    if how not in _KEEPS_LEFT:
        raise ValueError(f"cannot salt a {how} join")
    hot = hot_groups(big, on, rows_per_group)
    if hot is None:
        return big.join(small, list(on), how)
    salts = hot.salts()
    # the same on a retried task; the partition number spreads equal rows
    spread = F.pmod(F.xxhash64(*big.columns, F.spark_partition_id()), F.lit(salts))
    left = flag_hot(big, on, hot).withColumn(
        "_salt", F.when(F.col("_hot"), spread).otherwise(F.lit(0)).cast("int")
    )
    copies = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(
        F.array(F.lit(0))
    )
    right = flag_hot(small, on, hot).withColumn("_salt", F.explode(copies))
    joined = left.drop("_hot").join(right.drop("_hot"), [*on, "_salt"], how)
    return joined.drop("_salt")


def asof_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    left_at: str,
    right_at: str,
    columns: Mapping[str, str],
    rows_per_group: int | None = None,
) -> DataFrame:
    """Each row of ``left`` with the latest row of ``right`` at or before it.

    ``columns`` maps new names to columns of ``right``; they are null where no
    row matches. Times in ``right`` should be unique per key, else any of the
    latest rows may be taken.
    """
    present = F.col(right_at).isNotNull()
    for key in on:
        present = present & F.col(key).isNotNull()
    found = F.struct(*[F.col(source).alias(name) for name, source in columns.items()])
    rows = left.withColumn("_when", F.col(left_at)).withColumn("_side", F.lit(1))
    marks = right.where(present).select(
        *on, F.col(right_at).alias("_when"), F.lit(0).alias("_side"), found.alias("_found")
    )
    both = rows.unionByName(marks, allowMissingColumns=True)
    hot = hot_groups(both.select(*on), on, rows_per_group)
    matched = running(both, on, ["_when", "_side"], {"_latest": ("last", F.col("_found"))}, hot)
    return matched.where(F.col("_side") == 1).select(
        *left.columns, *[F.col("_latest")[name].alias(name) for name in columns]
    )


def range_join(
    points: DataFrame,
    intervals: DataFrame,
    on: Sequence[str],
    at: str,
    start: str,
    end: str,
    rows_per_group: int | None = None,
) -> DataFrame:
    """Every pair with equal keys where ``start <= at < end``.

    An interval is filed under the power of two at or above its length, where
    it touches at most two cells; a point looks in one cell for each length
    class that occurs. Intervals are first cut to the range of the finite points,
    so they may be open. Infinite points look in a class of their own, which holds
    the intervals that begin or end there. Short and long intervals may be mixed, and the join
    is an equi-join on the cell. Columns of the two sides, other than ``on``,
    must have different names.
    """
    known, number = points.where(F.col(at).isNotNull()), as_number(points, at)
    finite = F.abs(number) < F.lit(math.inf)  # not true for NaN, which sorts last
    low, high = known.where(finite).agg(F.min(number), F.max(number)).first()
    low, high = (0.0, 0.0) if low is None else (low, high)
    first, last = as_number(intervals, start), as_number(intervals, end)
    proper = F.col(start) < F.col(end)
    inside = proper & (last >= F.lit(low)) & (first <= F.lit(high))
    first, last = F.greatest(first, F.lit(low)), F.least(last, F.lit(high))
    # large whole numbers next to one another may be the same double
    size = F.when(last > first, F.ceil(F.log2(last - first))).otherwise(0)
    filed = (
        intervals.where(inside)
        .withColumn("_class", size.cast("int"))
        .withColumn("_cell", F.explode(F.sequence(_cell(first), _cell(last))))
    )
    # a double has some 2,000 exponents, so this list is short whatever the data
    classes = [row[0] for row in filed.select("_class").distinct().collect()]
    if not classes:
        classes = [0]
    looked = (
        known.where(finite)
        .withColumn("_class", F.explode(F.array(*[F.lit(c) for c in classes])))
        .withColumn("_cell", _cell(number))
    )
    if isinstance(points.schema[at].dataType, T.FractionalType):
        ends = [as_number(intervals, start) == F.lit(-math.inf), F.isnan(as_number(intervals, end))]
        for cell, touches in enumerate(ends):  # all of these hold the infinite points of their side
            filed = filed.union(
                intervals.where(proper & touches).withColumn("_class", F.lit(_INFINITE)).withColumn("_cell", F.lit(cell).cast("bigint"))
            )
        side = F.when(number < 0, 0).otherwise(1).cast("bigint")
        looked = looked.union(known.where(~finite).withColumn("_class", F.lit(_INFINITE)).withColumn("_cell", side))
    pairs = salted_join(looked, filed, [*on, "_class", "_cell"], "inner", rows_per_group)
    inside = (F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))
    return pairs.where(inside).drop("_class", "_cell")


def _cell(number: Column) -> Column:
    return F.floor(number / F.pow(F.lit(2.0), F.col("_class")))


def sum_in_range(
    marks: DataFrame,
    points: DataFrame,
    on: Sequence[str],
    mark_id: str,
    start: Column,
    end: Column,
    at: str,
    sums: Mapping[str, Column],
    rows_per_group: int | None = None,
    null_keys: bool = False,
) -> DataFrame:
    """For each row of ``marks``, sums over the points with ``start <= at < end``.

    Takes the running sums at both ends of the range instead of pairing points
    with ranges, so the work is that of one sort however many points fall into
    each range. Give exact types, as sums are subtracted. ``mark_id`` must be
    unique in ``marks``, and its ranges must not be null. A point in no range
    is left out; a mark without points gets zeros. A null key matches nothing, as
    in a join, or with ``null_keys`` other nulls, as in a window.
    """
    keyed = points.dropna(subset=[at] if null_keys else [*on, at])
    point = keyed.select(
        *on,
        F.col(at).alias("_when"),
        F.lit(1).alias("_side"),
        *[value.alias(name) for name, value in sums.items()],
    )
    both_ends = F.array(
        F.struct(start.alias("_when"), F.lit(-1).alias("_sign")),
        F.struct(end.alias("_when"), F.lit(1).alias("_sign")),
    )
    ends = marks.select(*on, mark_id, F.explode(both_ends).alias("_end")).select(
        *on, mark_id, "_end.*", F.lit(0).alias("_side")
    )
    both = point.unionByName(ends, allowMissingColumns=True)
    hot = hot_groups(both.select(*on), on, rows_per_group)
    before = {f"_to_{name}": ("sum", F.col(name)) for name in sums}
    summed = running(both, on, ["_when", "_side"], before, hot).where(F.col("_side") == 0)

    def difference(name: str) -> Column:
        upto = F.col(f"_to_{name}")
        signed = F.when(F.col("_sign") > 0, upto).otherwise(-upto)
        kind = summed.schema[f"_to_{name}"].dataType
        return F.coalesce(F.sum(signed), F.lit(0)).cast(kind).alias(name)

    return summed.groupBy(mark_id).agg(*[difference(name) for name in sums])

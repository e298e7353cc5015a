"""Window functions that also work where one group holds much of the table.

Pass the result of ``hot_groups``. When it is None the functions are plain
windows; otherwise hot groups are computed in pieces and joined up exactly.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkbeam.operators.skew import HotGroups, apart, ordering, segmented

_COMBINE: dict[str, Callable[[Column], Column]] = {
    "sum": F.sum,
    "min": F.min,
    "max": F.max,
    "last": lambda c: F.last(c, ignorenulls=True),
    "total": F.sum,
}


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    columns: Mapping[str, tuple[str, Column]],
    hot: HotGroups | None = None,
) -> DataFrame:
    """Add aggregates over each row and those before it in its group.

    ``columns`` maps a new name to a kind and its input: ``sum``, ``min``,
    ``max`` and ``last`` (last value that is not null) run up to the row, and
    ``total`` is the sum over the whole group. A row number is a running sum
    of ones.

    In hot groups each segment starts with an extra row that carries the
    aggregate of the segments before it, so the data is shuffled once, as for
    a plain window.
    """
    if hot is None:
        upto = Window.partitionBy(*keys).orderBy(*ordering(order))
        return df.select("*", *_aggregates(columns, upto, Window.partitionBy(*keys)))
    cold, rows, hot = apart(df, keys, hot)
    done = _running_in_pieces(rows, keys, order, columns, hot)
    if cold is None:
        return done
    return running(cold, keys, order, columns).unionByName(done)


def _running_in_pieces(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    columns: Mapping[str, tuple[str, Column]],
    hot: HotGroups,
) -> DataFrame:
    inputs = {f"_in_{name}": value for name, (_, value) in columns.items()}
    kinds = {f"_in_{name}": kind for name, (kind, _) in columns.items()}
    cut = segmented(df.withColumns(inputs), order, hot)
    starts = _segment_starts(cut, keys, kinds)
    # the total of a group comes with the start of each segment
    blank = {
        name: F.lit(None).cast(cut.schema[name].dataType)
        for name, kind in kinds.items()
        if kind == "total"
    }
    rows = cut.withColumns(blank).withColumn("_carried", F.lit(1))
    piece = Window.partitionBy(*keys, "_seg")
    upto = piece.orderBy("_carried", "_place")
    by_input = {name: (kind, F.col(f"_in_{name}")) for name, (kind, _) in columns.items()}
    joined = rows.unionByName(starts, allowMissingColumns=True)
    results = _aggregates(by_input, upto, upto)
    # summing sums must not widen a decimal
    plain = [_COMBINE[kind](value).alias(name) for name, (kind, value) in columns.items()]
    types = df.select(*plain).schema
    done = joined.select("*", *results).withColumns(
        {f.name: F.col(f.name).cast(f.dataType) for f in types if isinstance(f.dataType, T.AtomicType)}
    )
    return done.where(F.col("_carried") == 1).drop("_carried", "_seg", "_place", *inputs)


def _aggregates(
    columns: Mapping[str, tuple[str, Column]], upto: WindowSpec, whole: WindowSpec
) -> list[Column]:
    to_here = upto.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return [
        _COMBINE[kind](value).over(whole if kind == "total" else to_here).alias(name)
        for name, (kind, value) in columns.items()
    ]


def _segment_starts(cut: DataFrame, keys: Sequence[str], kinds: Mapping[str, str]) -> DataFrame:
    """For each segment, the aggregates of the segments before it.

    A group has at most as many rows here as there are segments, so the window
    over them is small.
    """

    def summary(name: str, kind: str) -> Column:
        if kind == "last":
            return F.max_by(name, F.when(F.col(name).isNotNull(), F.col("_place"))).alias(name)
        return _COMBINE[kind](F.col(name)).alias(name)

    segments = (
        cut.groupBy(*keys, "_seg")
        .agg(*[summary(name, kind) for name, kind in kinds.items()])
    )
    group = Window.partitionBy(*keys)
    before = group.orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)
    return segments.select(
        *keys,
        "_seg",
        F.lit(0).alias("_carried"),
        *[
            _COMBINE[kind](F.col(name)).over(group if kind == "total" else before).alias(name)
            for name, kind in kinds.items()
        ],
    )


_RANKS = ["rank", "dense_rank", "percent_rank", "cume_dist"]


def row_numbers(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str, hot: HotGroups | None = None
) -> DataFrame:
    """Add the position of each row in its group, from 1. ``order`` must be total."""
    one = F.lit(1).cast("bigint")
    return running(df, keys, order, {name: ("sum", one)}, hot)


def ranks(
    df: DataFrame, keys: Sequence[str], value: str, tie: str, hot: HotGroups | None = None
) -> DataFrame:
    """Add the ranks of ``value`` in its group, ascending, equal values sharing a rank.

    The columns are ``rank``, ``dense_rank``, ``percent_rank`` and
    ``cume_dist``. In hot groups they are worked out on counted values, of
    which there is one row however many rows share a value. ``tie`` is a
    number that differs between rows; it does not change the ranks.
    """
    if hot is None:
        window = Window.partitionBy(*keys).orderBy(value)
        return df.select(
            "*",
            F.rank().over(window).cast("bigint").alias("rank"),
            F.dense_rank().over(window).cast("bigint").alias("dense_rank"),
            F.percent_rank().over(window).alias("percent_rank"),
            F.cume_dist().over(window).alias("cume_dist"),
        )
    by = [*keys, value]
    values = df.groupBy(*by).agg(F.count("*").alias("_n"))
    one = F.lit(1).cast("bigint")
    columns = {
        "_upto": ("sum", F.col("_n")),
        "dense_rank": ("sum", one),
        "_all": ("total", F.col("_n")),
    }
    placed = running(values, keys, [value], columns, hot)
    first = F.col("_upto") - F.col("_n")
    ranked = placed.select(
        *by,
        (first + 1).alias("rank"),
        "dense_rank",
        F.when(F.col("_all") == 1, 0.0)
        .otherwise(first / (F.col("_all") - 1))
        .alias("percent_rank"),
        (F.col("_upto") / F.col("_all")).alias("cume_dist"),
    )
    found = F.struct(*[ranked[c] for c in _RANKS]).alias("_ranks")
    # a value's ranks sort before the rows that have it, which are cut by their tie
    both = df.unionByName(ranked.select(*by, found), allowMissingColumns=True)
    looked = running(both, keys, [value, tie], {"_own": ("last", F.col("_ranks"))}, hot)
    rows = looked.where(F.col("_ranks").isNull())
    return rows.select(*df.columns, *[F.col("_own")[c].alias(c) for c in _RANKS])


def framed(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    before: int,
    after: int,
    build: Callable[[WindowSpec], Mapping[str, Column]],
    hot: HotGroups | None = None,
) -> DataFrame:
    """Add window columns that look at most ``before`` rows back and ``after`` ahead.

    ``build`` gets the ordered window and returns the columns: ``lag``,
    ``lead`` and frames made with ``rowsBetween``. ``order`` must be total.

    Hot groups are numbered and cut into blocks of equal size; each block also
    gets copies of the neighbouring rows that its frames reach.
    """
    if hot is None:
        window = Window.partitionBy(*keys).orderBy(*ordering(order))
        return df.withColumns(dict(build(window)))
    cold, rows, hot = apart(df, keys, hot)
    size = max(hot.rows_per_group, before, after)  # so that frames reach the next block at most
    numbered = row_numbers(rows, keys, order, "_rn", hot)
    offset = (F.col("_rn") - 1) % size
    block = F.floor((F.col("_rn") - 1) / size)
    blocks = F.array(
        block,
        F.when(offset >= size - before, block + 1),
        F.when((offset < after) & (block > 0), block - 1),
    )
    copies = numbered.withColumn("_home", block).withColumn(
        "_block", F.explode(F.array_compact(blocks))
    )
    window = Window.partitionBy(*keys, "_block").orderBy("_rn")
    done = copies.withColumns(dict(build(window)))
    done = done.where(F.col("_home") == F.col("_block")).drop("_home", "_block", "_rn")
    if cold is None:
        return done
    return framed(cold, keys, order, before, after, build).unionByName(done)


def ntile(parts: int, position: Column, size: Column) -> Column:
    """The tile of a row from its position and the size of its group."""
    small, larger = F.floor(size / parts), size % parts
    in_larger = larger * (small + 1)
    return (
        F.when(position <= in_larger, F.floor((position - 1) / (small + 1)) + 1)
        .otherwise(larger + F.floor((position - 1 - in_larger) / F.greatest(small, F.lit(1))) + 1)
        .cast("int")
    )

"""Windows of time over batch tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkbeam.functions.times import MICROS_PER_SECOND, wall, wall_micros

_MERGE = {"sum": F.sum, "min": F.min, "max": F.max}

PANES_PER_TASK = 10_000

Measures = Mapping[str, tuple[str, Column]]


def pane(at: Column, seconds: int) -> Column:
    """Start of the slot of that length that a zoneless time lies in."""
    micros = wall_micros(at)
    return wall(micros - F.pmod(micros, F.lit(seconds * MICROS_PER_SECOND)))


def tumbling(
    df: DataFrame, keys: Sequence[str], at: str, seconds: int, measures: Measures
) -> DataFrame:
    return df.groupBy(*keys, pane(F.col(at), seconds).alias("window_start")).agg(
        *[_MERGE[kind](value).alias(name) for name, (kind, value) in measures.items()]
    )


def sliding(
    df: DataFrame,
    keys: Sequence[str],
    at: str,
    seconds: int,
    slide_seconds: int,
    measures: Measures,
) -> DataFrame:
    """Overlapping windows, from panes one slide long.

    Rows are first merged into panes; only panes are copied to the windows
    that they are part of.
    """
    if seconds % slide_seconds:
        raise ValueError("the slide must divide the window")
    panes = tumbling(df, keys, at, slide_seconds, measures)
    start = wall_micros(F.col("window_start"))
    step = F.lit(slide_seconds * MICROS_PER_SECOND)
    first = start - (seconds - slide_seconds) * MICROS_PER_SECOND
    copies = panes.withColumn("_start", F.explode(F.sequence(first, start, step)))
    return copies.groupBy(*keys, wall(F.col("_start")).alias("window_start")).agg(
        *[
            _MERGE[kind](name).cast(panes.schema[name].dataType).alias(name)
            for name, (kind, _) in measures.items()
        ]
    )


def fill_gaps(
    panes: DataFrame, keys: Sequence[str], at: str, seconds: int, zeros: Sequence[str]
) -> DataFrame:
    """Panes with zeros added for those missing between the first and last of each key.

    The panes of a long span are made in two steps, so that no row holds the
    whole span, and by as many tasks as there are stretches.
    """
    step = seconds * MICROS_PER_SECOND
    stretch = PANES_PER_TASK * step
    spans = panes.groupBy(*keys).agg(
        wall_micros(F.min(at)).alias("_first"), wall_micros(F.max(at)).alias("_last")
    )
    stretches = spans.withColumn("_from", F.explode(F.sequence("_first", "_last", F.lit(stretch))))
    upto = F.least(F.col("_last"), F.col("_from") + stretch - step)
    spread = stretches.repartition(*keys, "_from")
    every = F.explode(F.sequence("_from", upto, F.lit(step))).alias("_at")
    empty = spread.select(*keys, every).select(
        *keys,
        wall(F.col("_at")).alias(at),
        *[F.lit(0).cast(panes.schema[c].dataType).alias(c) for c in zeros],
    )
    both = panes.select(*keys, at, *zeros).unionByName(empty)
    return both.groupBy(*keys, at).agg(
        *[F.sum(c).cast(panes.schema[c].dataType).alias(c) for c in zeros]
    )

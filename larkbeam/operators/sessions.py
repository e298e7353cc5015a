"""Sessions: runs of rows of one key without a long gap."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkbeam.functions.times import MICROS_PER_SECOND, wall_micros
from larkbeam.operators.skew import HotGroups, apart, settled
from larkbeam.operators.windows import framed, running
from larkbeam.sources.files import rewritten

_MERGE = {"sum": F.sum, "min": F.min, "max": F.max}


def sessions(
    df: DataFrame,
    keys: Sequence[str],
    at: str,
    gap_seconds: int,
    measures: Mapping[str, tuple[str, Column]],
    rows_per_group: int | None = None,
) -> DataFrame:
    """One row per session with its number, first and last time, and measures.

    A gap longer than ``gap_seconds`` starts a session. Rows in the same slot
    of that length are always in one session, so rows are merged into slots
    before any of them is shuffled or sorted.
    """
    longest = gap_seconds * MICROS_PER_SECOND
    micros = wall_micros(F.col(at))
    slot = micros - F.pmod(micros, F.lit(longest))
    slots = (
        df.where(F.col(at).isNotNull())
        .groupBy(*keys, slot.alias("_slot"))
        .agg(
            F.min(at).alias("session_start"),
            F.max(at).alias("session_end"),
            *[_MERGE[kind](value).alias(name) for name, (kind, value) in measures.items()],
        )
    )
    slots, hot = settled(df, slots, keys, rows_per_group)
    gap = wall_micros(F.col("session_start")) - wall_micros(F.col("_previous"))
    starts = F.when(gap <= longest, 0).otherwise(1)

    def numbered(part: DataFrame, hot: HotGroups | None) -> DataFrame:
        linked = framed(
            part, keys, ["_slot"], 1, 0, lambda w: {"_previous": F.lag("session_end").over(w)}, hot
        )
        if hot is not None:
            linked = rewritten(linked, name="linked")
        return running(linked, keys, ["_slot"], {"session_no": ("sum", starts)}, hot)

    if hot is None:
        parts = numbered(slots, None)
    else:
        cold, rows, hot = apart(slots, keys, hot)
        parts = numbered(rows, hot)
        parts = parts if cold is None else parts.unionByName(numbered(cold, None))
    merged = parts.groupBy(*keys, "session_no").agg(
        F.min("session_start").alias("session_start"),
        F.max("session_end").alias("session_end"),
        *[
            _MERGE[kind](name).cast(slots.schema[name].dataType).alias(name)
            for name, (kind, _) in measures.items()
        ],
    )
    return merged

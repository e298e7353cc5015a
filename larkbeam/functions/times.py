"""Times without a zone, and instants."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS_PER_SECOND = 1_000_000
_MICROS_PER_DAY = 86_400 * MICROS_PER_SECOND


def wall_micros(ts: Column) -> Column:
    """Microseconds since 1970 of a zoneless timestamp, whatever the session's zone."""
    of_day = F.hour(ts) * 3600 + F.minute(ts) * 60
    second = (F.date_part(F.lit("SECOND"), ts) * MICROS_PER_SECOND).cast("bigint")
    day = F.unix_date(ts.cast("date")).cast("bigint")
    return day * _MICROS_PER_DAY + of_day.cast("bigint") * MICROS_PER_SECOND + second


def wall(micros: Column) -> Column:
    """The zoneless timestamp of that many microseconds since 1970."""
    return F.timestamp_add("MICROSECOND", micros, F.expr("TIMESTAMP_NTZ '1970-01-01'"))


def utc_instant(ts: Column) -> Column:
    """A zoneless timestamp read as UTC; watermarks need an instant."""
    return F.timestamp_micros(wall_micros(ts))


def utc_wall(instant: Column) -> Column:
    """The zoneless UTC time of an instant: the inverse of ``utc_instant``."""
    return wall(F.unix_micros(instant))

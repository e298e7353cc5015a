"""Exact money: sums that do not depend on the order of addition.

A sum of doubles changes with the partitioning and with retried tasks, and
loses cents once it is large. Amounts here are whole cents held in doubles, so
they are turned into whole numbers, which is much cheaper than casting a double
to a decimal, and summed as decimals, which do not overflow.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F


def hundredths(name: str) -> Column:
    """Cents of an amount, or percent of a rate, as a whole number."""
    return F.rint(F.col(name) * 100).cast("bigint")


def scaled(units: Column, digits: int, scale: int) -> Column:
    """Whole units of ``10 ** -scale``, of at most ``digits`` digits, as a decimal."""
    return units.cast(f"decimal({digits},0)") * F.lit(Decimal(1).scaleb(-scale))


def money(name: str) -> Column:
    return scaled(hundredths(name), 15, 2)


def total(units: Column, scale: int) -> Column:
    """Exact sum of whole units of ``10 ** -scale``, as a decimal.

    The upper and lower bits are summed apart as whole numbers, which costs a
    third of a sum of decimals. With units below 2 ** 43 neither sum overflows
    before 2 ** 40 rows.
    """
    upper = F.sum(F.shiftright(units, 20)).cast("decimal(20,0)")
    lower = F.sum(units.bitwiseAND(2**20 - 1)).cast("decimal(20,0)")
    whole = upper * F.lit(Decimal(2**20)) + lower
    return whole * F.lit(Decimal(1).scaleb(-scale))


def revenue_units() -> Column:
    """Discounted price of a line, in hundredths of a cent."""
    return hundredths("l_extendedprice") * (100 - hundredths("l_discount"))


def revenue() -> Column:
    return scaled(revenue_units(), 13, 4)


def taxed_units() -> Column:
    """Discounted price of a line with tax, in ten-thousandths of a cent."""
    return revenue_units() * (100 + hundredths("l_tax"))

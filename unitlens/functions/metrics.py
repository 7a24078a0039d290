"""Column expressions for guarded ratios and rounding.

Money stays DECIMAL through every sum, so totals do not depend on the order in
which partitions are merged. It becomes DOUBLE once, inside a ratio or at the
output, and rounding comes last.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(value: Column, digits: int | None) -> Column:
    """Round half away from zero, as for a decimal number.

    A quotient of DOUBLEs may miss a tie by its last bit: 1145659.95 / 6 comes out just
    below 190943.325. Nine decimals restore such a value before it is rounded.
    """
    if digits is None:
        return value
    return F.round(value.cast("decimal(38,9)"), digits).cast("double")


def ratio(num: Column, den: Column, scale: int = 1, digits: int | None = None) -> Column:
    """``num / den * scale`` as DOUBLE; NULL where the denominator is 0 or NULL."""
    quotient = F.try_divide(num.cast("double"), den.cast("double"))
    if scale != 1:
        quotient = quotient * F.lit(float(scale))
    return rounded(quotient, digits)


def as_money(value: Column, digits: int = 2) -> Column:
    """Round an exact amount, then hand it out as DOUBLE."""
    return F.round(value, digits).cast("double")


def mean(value: Column, digits: int | None = None) -> Column:
    """Mean of the non-NULL values from the exact sum.

    ``avg`` on DECIMAL rounds to a fixed scale first, so a second rounding could
    move a tie; dividing the exact sum rounds once.
    """
    return ratio(F.sum(value), F.count(value), digits=digits)

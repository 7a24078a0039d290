"""Shares, period changes and reconciliation of aggregated tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from unitlens.functions import ratio


def share_of_total(value: Column, digits: int | None = None) -> Column:
    """Each row's part of the column's total.

    For aggregated rows only (here one per channel): the window has no partitions and
    gathers its input in one task. A subquery for the total would instead run the
    aggregation below it twice, because the two runs read different columns.
    """
    return ratio(value, F.sum(value).over(Window.partitionBy()), digits=digits)


def previous_value(partition: str, order: str, value: str) -> Column:
    """Value of the previous row present; a missing period is stepped over."""
    return F.lag(value).over(Window.partitionBy(partition).orderBy(order))


def dense_months(df: DataFrame, by: str, month: str) -> DataFrame:
    """One row per group and calendar month from the group's first to its last one; months that ``df`` lacks
    have NULL in all other columns. ``month`` is the first day of a month, a date."""
    spans = df.groupBy(by).agg(F.min(month).alias("first"), F.max(month).alias("last"))
    spine = spans.select(by, F.explode(F.sequence("first", "last", F.make_ym_interval(F.lit(0), F.lit(1)))).alias(month))
    return spine.join(df, [by, month], "left")


def last_known(partition: str, order: str, value: str) -> Column:
    """The latest value before a row that is not NULL, however long ago."""
    before = Window.partitionBy(partition).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return F.last(value, ignorenulls=True).over(before)


def period_change(previous: Column, current: Column, digits: int | None = None) -> Column:
    """Change against the previous period in percent."""
    return ratio(current - previous, previous, scale=100, digits=digits)


def reconcile(
    a: DataFrame, b: DataFrame, key: str, a_value: str, b_value: str, tolerance: float | None = None
) -> DataFrame:
    """Both sides' values per key and their difference; keys of only one side stay.

    Each side must have one row per key. With a tolerance, ``within_tolerance`` tells
    whether the difference is at most that part of ``b_value``.
    """
    both = (
        a.select(key, F.col(a_value))
        .unionByName(b.select(key, F.col(b_value)), allowMissingColumns=True)
        .groupBy(key)
        .agg(F.max(a_value).alias(a_value), F.max(b_value).alias(b_value))
        .withColumn("difference", F.col(a_value) - F.col(b_value))
    )
    if tolerance is None:
        return both
    gap = ratio(F.abs(F.col("difference")), F.abs(F.col(b_value)))
    return both.withColumn("within_tolerance", F.coalesce(gap <= tolerance, F.lit(False)))

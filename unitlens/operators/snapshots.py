"""Cumulative snapshots: keep the last one per key, bring measures to scale."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_snapshot(
    df: DataFrame, keys: Sequence[str], order: Column, tie_break: Sequence[Column] = ()
) -> DataFrame:
    """Keep the row with the greatest ``order`` per key; rows without one come last.

    A row whose key has a NULL belongs to no other row: it is kept by itself.

    Spark limits each key to one row before the shuffle as well as after it, so a
    hot key sends one row per task. ``tie_break`` makes the choice repeatable.
    """
    incomplete = F.when(reduce(or_, [F.col(k).isNull() for k in keys]), F.monotonically_increasing_id())
    newest_first = Window.partitionBy(*keys, "lone_row").orderBy(order.desc_nulls_last(), *tie_break)
    return (
        df.withColumn("lone_row", incomplete)
        .withColumn("snapshot_rank", F.row_number().over(newest_first))
        .where("snapshot_rank = 1")
        .drop("snapshot_rank", "lone_row")
    )


def rescale(df: DataFrame, columns: Sequence[str], factor: int) -> DataFrame:
    """Divide the columns by ``factor`` in exact decimal arithmetic."""
    divisor = F.lit(Decimal(factor))
    types = dict(df.dtypes)
    return df.withColumns(
        {
            c: (F.col(c) if types[c].startswith("decimal") else F.col(c).cast("decimal(20,0)"))
            / divisor
            for c in columns
        }
    )

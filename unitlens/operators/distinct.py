"""Distinct counts as states that add up: exact bitmaps of whole-number ids.

A state has one row per group and bucket of 32,768 ids, with the bits of the ids that occur. States of days
unite to months, and states of ads to campaigns, without the rows that they come from. Buckets spread a
hot group over the tasks, and a bucket takes 4 KB whatever the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

BUCKET, BITS = "id_bucket", "id_bits"


def distinct_states(df: DataFrame, entity: str, by: Sequence[str | Column], rows: str | None = None) -> DataFrame:
    """The state of ``entity`` per group, with the number of rows in a column ``rows`` if it is named.

    Rows without an entity have a bucket of their own, NULL, so they count as rows and not as entities.
    """
    kind = df.schema[entity].dataType
    if not isinstance(kind, IntegralType):
        raise TypeError(f"bitmaps need whole-number ids; {entity} is {kind.simpleString()}")
    value = F.col(entity).cast("bigint")
    counted = [] if rows is None else [F.count("*").alias(rows)]
    return df.groupBy(*by, F.bitmap_bucket_number(value).alias(BUCKET)).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(value)).alias(BITS), *counted
    )


def united(states: DataFrame, by: Sequence[str | Column], rows: str | None = None) -> DataFrame:
    """States of coarser groups from states of finer ones."""
    counted = [] if rows is None else [F.sum(rows).alias(rows)]
    return states.groupBy(*by, BUCKET).agg(F.bitmap_or_agg(BITS).alias(BITS), *counted)


def state_size() -> Column:
    """Entities in a bucket; none in the bucket of rows without one."""
    return F.when(F.col(BUCKET).isNull(), F.lit(0)).otherwise(F.bitmap_count(BITS))


def distinct_counts(states: DataFrame, by: Sequence[str | Column], name: str, rows: str | None = None) -> DataFrame:
    """Entities per group of ``states``, each group and bucket of which is one row."""
    counted = [] if rows is None else [F.sum(rows).alias(rows)]
    return states.groupBy(*by).agg(*counted, F.sum(state_size()).alias(name))

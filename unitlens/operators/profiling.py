"""Volume, coverage and group profiles of a table."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stack_rows(*parts: DataFrame) -> DataFrame:
    """UNION ALL by column name; a column that a part lacks is NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def side_by_side(*parts: DataFrame) -> DataFrame:
    """Put several one-row results into one row without joining them."""
    stacked = stack_rows(*parts)
    return stacked.agg(*(F.max(name).alias(name) for name in stacked.columns))


def table_schema(df: DataFrame) -> list[tuple[str, str, str]]:
    """(name, type, declared nullability) of every column, from metadata alone."""
    return [(f.name, f.dataType.simpleString(), "YES" if f.nullable else "NO") for f in df.schema.fields]


def schema_overview(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Name, type and declared nullability of every column, with its NULL count.

    Files declare every column optional, so the NULLs actually present are counted
    next to the declaration, in one scan per table.
    """

    def one_table(label: str, df: DataFrame) -> DataFrame:
        counted = df.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in df.columns))
        described = [
            F.struct(
                F.lit(position).alias("ordinal_position"),
                F.lit(name).alias("column_name"),
                F.lit(kind).alias("data_type"),
                F.lit(nullable).alias("is_nullable"),
                F.col(name).alias("null_rows"),
            )
            for position, (name, kind, nullable) in enumerate(table_schema(df), start=1)
        ]
        return counted.select(F.lit(label).alias("table_name"), F.inline(F.array(*described)))

    return (
        stack_rows(*(one_table(label, df) for label, df in tables.items()))
        .orderBy("table_name", "ordinal_position")
        .drop("ordinal_position")
    )


def first_rows(df: DataFrame, n: int) -> DataFrame:
    """A repeatable preview: the first ``n`` rows in the order of all columns."""
    return df.orderBy(*df.columns).limit(n)


def volume(df: DataFrame, entity: str, label: str) -> DataFrame:
    return df.agg(
        F.count("*").alias("rows_total"), F.countDistinct(entity).alias("unique_users")
    ).select(F.lit(label).alias("table_name"), "rows_total", "unique_users")


def days_spanned(first: Column, last: Column) -> Column:
    return (F.datediff(last, first) + 1).cast("bigint")


def coverage(df: DataFrame, ts: str, label: str) -> DataFrame:
    """First and last time of a table and the number of days between, inclusive."""
    return df.agg(
        F.min(ts).alias("earliest_timestamp"), F.max(ts).alias("latest_timestamp")
    ).select(
        F.lit(label).alias("table_name"),
        "earliest_timestamp",
        "latest_timestamp",
        days_spanned(F.col("earliest_timestamp"), F.col("latest_timestamp")).alias("days_covered"),
    )


def group_profile(
    df: DataFrame,
    by: list[str | Column],
    entity: str,
    rows: str,
    entities: str,
    *extra: Column,
) -> DataFrame:
    """Rows, distinct entities and further aggregates per group.

    One distinct expression needs no row expansion: Spark first reduces to
    (group, entity) on the map side and spreads a hot group over its entities.
    """
    return df.groupBy(*by).agg(
        F.count("*").alias(rows), F.countDistinct(entity).alias(entities), *extra
    )

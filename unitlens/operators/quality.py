"""Checks of nulls, duplicates, rules, periods and keys.

All of them reduce on the map side before the shuffle, so a key or a set of equal
rows that holds a large part of the table arrives as one row per task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def null_profile(
    df: DataFrame, columns: Mapping[str, str | None], label: str
) -> DataFrame:
    """NULL count per output name; ``None`` marks a field the table does not have."""
    counts = [
        (F.lit(None).cast("bigint") if source is None else F.count_if(F.col(source).isNull()))
        .alias(name)
        for name, source in columns.items()
    ]
    return df.agg(F.count("*").alias("rows_total"), *counts).select(
        F.lit(label).alias("table_name"), "rows_total", *columns
    )


def duplicate_profile(df: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    """Distinct keys, rows, keys seen more than once and surplus rows. NULLs are equal."""
    n = F.col("rows_per_key")
    return (
        df.groupBy(*keys)
        .agg(F.count("*").alias("rows_per_key"))
        .agg(
            F.count("*").alias("unique_keys"),
            F.coalesce(F.sum(n), F.lit(0)).alias("rows_total"),
            F.count_if(n > 1).alias("duplicated_keys"),
            F.coalesce(F.sum(n - 1), F.lit(0)).alias("duplicate_rows"),
        )
        .select(F.lit(label).alias("table_name"), "*")
    )


def duplicate_rows(df: DataFrame, columns: Sequence[str], strict: bool = False) -> DataFrame:
    """Rows, distinct full-row keys and surplus rows.

    The default key joins the columns as text with ``|`` and skips NULLs, so
    ``('a', NULL, 'b')`` equals ``('a', 'b', NULL)``. The text is not shuffled, but two
    64-bit hashes of it. ``strict`` compares column by column.
    """
    text = F.concat_ws("|", *columns)
    hashes = F.struct(F.xxhash64(text), F.xxhash64(F.lit(1), text))
    key = F.struct(*columns) if strict else hashes
    counted = df.agg(
        F.count("*").alias("rows_total"), F.countDistinct(key).alias("unique_raw_keys")
    )
    return counted.withColumn("duplicate_rows", F.col("rows_total") - F.col("unique_raw_keys"))


def rule_counts(df: DataFrame, rules: Mapping[str, Column], *extra: Column) -> DataFrame:
    """Rows in total and rows that meet each rule; a NULL outcome does not count."""
    counts = [F.count_if(rule).alias(name) for name, rule in rules.items()]
    return df.agg(F.count("*").alias("rows_total"), *counts, *extra)


def row_checks(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Rule counts, surplus rows and whether the table is empty, from one pass over distinct rows.

    Equal rows meet the same rules, so rules are checked once per distinct row and count as often as
    it occurs. Rows are compared column by column.
    """
    n = F.col("rows_per_key")
    met = {name: F.coalesce(rule, F.lit(False)) for name, rule in rules.items()}
    counted = df.groupBy(*df.columns).agg(F.count("*").alias("rows_per_key"))
    counts = [F.coalesce(F.sum(F.when(rule, n)), F.lit(0)).alias(name) for name, rule in met.items()]
    return counted.agg(
        F.coalesce(F.sum(n - 1), F.lit(0)).alias("duplicate_rows"),
        (F.count("*") == 0).cast("bigint").alias("empty_table"),
        *counts,
    )


def value_stability(df: DataFrame, group: str, value: str, *extra: Column) -> DataFrame:
    return df.groupBy(group).agg(
        F.count("*").alias("rows_total"),
        F.countDistinct(value).alias(f"distinct_{value}_values"),
        *extra,
    )


def period_overhang(
    facts: DataFrame, reference: DataFrame, ts: str, amount: str
) -> DataFrame:
    """Facts before and after the reference table's period, and the amount after it.

    The period is a scalar subquery: Spark computes it once and compares each fact
    with a constant, so no join is planned.
    """
    period = reference.agg(F.struct(F.min(ts).alias("first"), F.max(ts).alias("last"))).scalar()
    before = F.col(ts) < period.getField("first")
    after = F.col(ts) > period.getField("last")
    return (
        facts.select(
            before.alias("is_before"), after.alias("is_after"), F.col(amount).alias("amount")
        )
        .agg(
            F.count("*").alias("facts_total"),
            F.count_if("is_before").alias("facts_before"),
            F.count_if("is_after").alias("facts_after"),
            F.sum(F.when(F.col("is_after"), F.col("amount")).otherwise(0)).alias("amount_after"),
        )
    )


def presence_flags(df: DataFrame, entity: str, flags: Mapping[str, Column]) -> DataFrame:
    """One row per entity with a boolean per flag: did any of its rows meet the condition?"""
    return df.groupBy(entity).agg(
        *(F.bool_or(F.coalesce(rule, F.lit(False))).alias(name) for name, rule in flags.items())
    )


def orphan_count(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Distinct keys of ``left`` and those among them that ``right`` lacks.

    Both key sets go through one aggregation instead of two distincts and a join.
    A NULL key never matches, as in an equality join.
    """
    tagged = left.select(key, F.lit(True).alias("in_left")).unionByName(
        right.select(key, F.lit(False).alias("in_left"))
    )
    per_key = tagged.groupBy(key).agg(
        F.bool_or("in_left").alias("in_left"), F.bool_or(~F.col("in_left")).alias("in_right")
    )
    missing = F.col("in_left") & (F.col(key).isNull() | ~F.col("in_right"))
    return per_key.agg(
        F.count_if("in_left").alias("keys_total"), F.count_if(missing).alias("keys_missing")
    )


def group_size_histogram(
    df: DataFrame, keys: Sequence[str], size: str, groups: str
) -> DataFrame:
    """How many groups have each number of rows."""
    return (
        df.groupBy(*keys)
        .agg(F.count("*").alias(size))
        .groupBy(size)
        .agg(F.count("*").alias(groups))
    )


def verdicts(result: DataFrame, subject: Column, expected: Mapping[str, int]) -> DataFrame:
    """One row per check of a result's row: what was observed, expected, and whether it
    passed. A check that does not apply to the subject is NULL there and gives no row."""
    checks = [
        F.struct(
            F.lit(name).alias("check"),
            F.col(name).cast("bigint").alias("observed"),
            F.lit(wanted).cast("bigint").alias("expected"),
            (F.col(name) == wanted).alias("passed"),
        )
        for name, wanted in expected.items()
    ]
    return result.select(subject.alias("subject"), F.inline(F.array(*checks))).where(
        F.col("observed").isNotNull()
    )

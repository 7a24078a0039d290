"""Cohorts, their payments in a calendar-month window, and sums by payment kind."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from unitlens.operators.skew import Skew, hot_keys


def months_later(start: str | Column, months: int) -> Column:
    """Calendar months: keeps the time of day and clamps to the end of a short month."""
    start = F.col(start) if isinstance(start, str) else start
    return start + F.make_ym_interval(F.lit(0), F.lit(months))


def moment(t: datetime) -> Column:
    """A constant without zone, which a filter can hand to the scan."""
    return F.lit(t.isoformat(sep=" ")).cast("timestamp_ntz")


def first_event_cohort(
    df: DataFrame, entity: str, dims: Sequence[str], event: Column, ts: str, start: str
) -> DataFrame:
    """First time of the event per entity and dims."""
    return df.where(event).groupBy(entity, *dims).agg(F.min(ts).alias(start))


def cohort_window_join(
    cohort: DataFrame,
    facts: DataFrame,
    key: str,
    start: str,
    ts: str,
    months: int,
    skew: Skew = Skew(),
    period: tuple[datetime, datetime] | None = None,
) -> DataFrame:
    """Facts of each cohort row in ``[start, start + months)``, with the cohort columns.

    An inner join; ``sum_by_kind`` puts cohort rows without facts back. A missing key or time matches
    nothing. The facts' key is compared as it is, so facts that are bucketed by it are not shuffled.
    The cohort's is compared through a condition that is always true where it can match: that keeps a
    filter out of the cohort's scan, whose shuffle can then serve ``sum_by_kind`` too.

    Facts of hot keys do not meet in one task: they stay where they are read and join the few cohort
    rows of those keys, at most ``skew.most`` keys, which are broadcast.

    ``period`` holds every start. Facts before it, or ``months`` and more after it, can match nothing
    and are left out at the scan.
    """
    if period is not None:
        first, last = (moment(t) for t in period)
        facts = facts.where((F.col(ts) >= first) & (F.col(ts) < months_later(last, months)))
    facts = facts.where(F.col(key).isNotNull() & F.col(ts).isNotNull())
    bounded = cohort.withColumn("window_end", months_later(start, months)).withColumnRenamed(key, "cohort_key")
    cohort_key = F.col("cohort_key")
    in_window = (F.col(ts) >= F.col(start)) & (F.col(ts) < F.col("window_end"))
    same_key = F.col(key) == F.when(cohort_key.isNotNull(), cohort_key)
    hot = hot_keys(facts, key, skew)
    if not hot:
        return facts.join(bounded, same_key & in_window).drop("cohort_key", "window_end")
    usual = facts.where(~F.col(key).isin(hot)).join(bounded, same_key & in_window)
    few = bounded.where(cohort_key.isin(hot))
    apart = facts.where(F.col(key).isin(hot)).join(F.broadcast(few), (F.col(key) == cohort_key) & in_window)
    return usual.unionByName(apart).drop("cohort_key", "window_end")


def binned_window_join(
    cohort: DataFrame, facts: DataFrame, key: str, start: str, ts: str, months: int, days: int = 31
) -> DataFrame:
    """The same rows as ``cohort_window_join``, joined by key and time bin.

    Facts are dealt into bins of ``days`` days, and a cohort row goes to every bin that its window touches, so
    one key's facts are spread over the tasks by time. No key has to be known as hot and nothing is broadcast;
    the price is some ``30 * months / days`` copies of the cohort rows, which are few beside the facts.
    """
    def time_bin(time: Column) -> Column:
        return F.floor(F.datediff(time, F.lit("1970-01-01").cast("date")) / days).cast("int")

    end = months_later(start, months)
    touched = F.sequence(time_bin(F.col(start)), time_bin(end))
    bounded = cohort.withColumnRenamed(key, "cohort_key").withColumn("window_end", end)
    bounded = bounded.withColumn("cohort_bin", F.explode(touched))
    same = (F.col(key) == F.col("cohort_key")) & (F.col("fact_bin") == F.col("cohort_bin"))
    in_window = (F.col(ts) >= F.col(start)) & (F.col(ts) < F.col("window_end"))
    joined = facts.withColumn("fact_bin", time_bin(F.col(ts))).join(bounded, same & in_window)
    return joined.drop("cohort_key", "window_end", "fact_bin", "cohort_bin")


def full_months(start: str, until: Column, most: int) -> Column:
    """How many whole calendar months after ``start`` end at ``until`` or before, at most ``most``."""
    ended = [F.when(months_later(start, k) <= until, 1).otherwise(0) for k in range(1, most + 1)]
    return sum(ended[1:], ended[0])


def sum_by_kind(
    cohort: DataFrame, matched: DataFrame, kind: str, amount: str, kinds: Sequence[str]
) -> DataFrame:
    """One row per cohort row: count and amount of each kind, and the total amount.

    Cohort rows enter as rows without a fact, which keeps those that have none; they
    add to no count and give a sum of 0 only where there is nothing to sum. Grouping by
    the whole cohort row is the same as grouping by its key, and lets Spark reuse the
    cohort's shuffle for both uses.
    """
    blank = cohort.select("*", F.lit(False).alias("has_fact"))
    facts = matched.select(
        *cohort.columns, F.lit(True).alias("has_fact"), F.col(kind), F.col(amount)
    )
    rows = facts.unionByName(blank, allowMissingColumns=True)

    def total(value: Column) -> Column:
        return F.sum(F.when(F.col("has_fact"), value))

    sums = []
    for name in kinds:
        is_kind = F.col(kind) == name
        sums.append(F.count_if(is_kind).alias(f"{name}_count"))
        sums.append(total(F.when(is_kind, F.col(amount)).otherwise(0)).alias(f"{name}_revenue"))
    sums.append(total(F.coalesce(F.col(amount), F.lit(0))).alias("total_revenue"))

    summed = rows.groupBy(*cohort.columns).agg(F.bool_or("has_fact").alias("has_fact"), *sums)
    zero_without_facts = {
        c: F.when(F.col("has_fact"), F.col(c)).otherwise(F.lit(0).cast(t))
        for c, t in summed.dtypes
        if c.endswith("_revenue")
    }
    return summed.withColumns(zero_without_facts).drop("has_fact")

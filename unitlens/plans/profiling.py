"""Profile of the three tables: structure, volume, period, groups and amounts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from unitlens.functions import as_money, load_time, mean, ratio
from unitlens.operators.profiling import (
    coverage,
    days_spanned,
    first_rows,
    group_profile,
    schema_overview as describe_columns,
    side_by_side,
    stack_rows,
    volume,
)
from unitlens.operators.quantiles import discrete_quantiles, frequencies

PREVIEW_ROWS = 10
QUARTILES = {"p25_amount": 0.25, "median_amount": 0.5, "p75_amount": 0.75}


def _revenue():
    return as_money(F.sum("amount")).alias("total_revenue")


def schema_overview(product_events: DataFrame, orders: DataFrame) -> DataFrame:
    return describe_columns({"product_events": product_events, "orders": orders})


def preview_product_events(product_events: DataFrame) -> DataFrame:
    return first_rows(product_events, PREVIEW_ROWS)


def preview_orders(orders: DataFrame) -> DataFrame:
    return first_rows(orders, PREVIEW_ROWS).withColumn("amount", F.col("amount").cast("double"))


def table_volume(product_events: DataFrame, orders: DataFrame) -> DataFrame:
    return stack_rows(
        volume(product_events, "user_id", "product_events"), volume(orders, "user_id", "orders")
    )


def date_coverage(product_events: DataFrame, orders: DataFrame) -> DataFrame:
    return stack_rows(
        coverage(product_events, "timestamp", "product_events"),
        coverage(orders, "timestamp", "orders"),
    )


def product_event_types(product_events: DataFrame) -> DataFrame:
    return group_profile(
        product_events, ["event_type"], "user_id", "events_count", "unique_users"
    ).orderBy(F.desc("events_count"))


def revenue_event_types(orders: DataFrame) -> DataFrame:
    return group_profile(
        orders,
        ["event"],
        "user_id",
        "events_count",
        "unique_users",
        _revenue(),
        mean(F.col("amount"), 2).alias("avg_amount"),
    ).orderBy(F.desc("total_revenue"))


def channel_overview(product_events: DataFrame) -> DataFrame:
    return group_profile(
        product_events, ["channel"], "user_id", "events_count", "unique_users"
    ).orderBy(F.desc("events_count"))


def channel_event_breakdown(product_events: DataFrame) -> DataFrame:
    return group_profile(
        product_events, ["channel", "event_type"], "user_id", "events_count", "unique_users"
    ).orderBy("channel", F.desc("events_count"))


def daily_activity(product_events: DataFrame) -> DataFrame:
    day = F.to_date("timestamp").alias("event_date")
    return group_profile(
        product_events, [day], "user_id", "events_count", "active_users"
    ).orderBy("event_date")


def daily_revenue(orders: DataFrame) -> DataFrame:
    day = F.to_date("timestamp").alias("order_date")
    return group_profile(
        orders,
        [day],
        "user_id",
        "revenue_events",
        "paying_users",
        _revenue(),
        mean(F.col("amount"), 2).alias("avg_order_value"),
    ).orderBy("order_date")


def amount_distribution(orders: DataFrame) -> DataFrame:
    """Everything comes from the rows per distinct amount, so one scan is enough."""
    freq = frequencies(orders, "amount")
    n, amount = F.col("n"), F.col("amount")
    stats = freq.agg(
        F.coalesce(F.sum(n), F.lit(0)).alias("rows_total"),
        F.coalesce(F.sum(n), F.lit(0)).alias("rows_with_amount"),
        as_money(F.min(amount)).alias("min_amount"),
        as_money(F.max(amount)).alias("max_amount"),
        ratio(F.sum(amount * n), F.sum(n), digits=2).alias("avg_amount"),
    )
    quartiles = discrete_quantiles(freq, "amount", QUARTILES)
    return side_by_side(stats, quartiles.select(*(as_money(F.col(q)).alias(q) for q in QUARTILES)))


def aov_by_event(orders: DataFrame) -> DataFrame:
    return group_profile(
        orders.where(F.col("amount").isNotNull()),
        ["event"],
        "user_id",
        "revenue_events",
        "paying_users",
        _revenue(),
        mean(F.col("amount"), 2).alias("avg_order_value"),
        as_money(F.min("amount")).alias("min_amount"),
        as_money(F.max("amount")).alias("max_amount"),
    ).orderBy(F.desc("total_revenue"))


def ads_overview(ads: DataFrame) -> DataFrame:
    """Four distinct counts would expand every row five times, so the rows are first
    reduced to the distinct combinations of the ad hierarchy."""
    hierarchy = ["source", "campaign_id", "adset_id", "ad_id"]
    loaded_at = load_time()
    per_ad = ads.groupBy(*hierarchy).agg(
        F.count("*").alias("n"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
        F.min(loaded_at).alias("first_load"),
        F.max(loaded_at).alias("last_load"),
    )
    return per_ad.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows_total"),
        *(
            F.countDistinct(c).alias(name)
            for c, name in zip(
                hierarchy,
                ["unique_sources", "unique_campaigns", "unique_adsets", "unique_ads"],
                strict=True,
            )
        ),
        F.min("first_date").alias("earliest_date"),
        F.max("last_date").alias("latest_date"),
        F.min("first_load").alias("earliest_timestamp"),
        F.max("last_load").alias("latest_timestamp"),
    ).select(
        F.lit("marketing_ads_raw").alias("table_name"),
        "rows_total",
        "unique_sources",
        "unique_campaigns",
        "unique_adsets",
        "unique_ads",
        "earliest_date",
        "latest_date",
        days_spanned(F.col("earliest_date"), F.col("latest_date")).alias("days_covered"),
        "earliest_timestamp",
        "latest_timestamp",
    )

"""Data-quality checks of the three tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from unitlens.functions import as_money, load_time, mean
from unitlens.operators.profiling import stack_rows
from unitlens.operators.quality import (
    duplicate_profile,
    duplicate_rows,
    group_size_histogram,
    null_profile,
    orphan_count,
    period_overhang,
    presence_flags,
    row_checks,
    rule_counts,
    value_stability,
    verdicts,
)

# Events that lie deeper in the product than registration.
DEEPER_EVENTS = ["like", "match", "message_sent", "paywall_view"]
VERY_HIGH_AMOUNT = 999

# The columns of the ads table.
ADS_COLUMNS = [
    "source",
    "campaign_id",
    "adset_id",
    "ad_id",
    "date",
    "spend",
    "impressions",
    "clicks",
    "installs",
    "registrations",
    "timestamp",
]
MEASURES = ["spend", "impressions", "clicks", "installs", "registrations"]


def dq_nulls(product_events: DataFrame, orders: DataFrame) -> DataFrame:
    return stack_rows(
        null_profile(
            product_events,
            {
                "null_user_id": "user_id",
                "null_event_name": "event_type",
                "null_timestamp": "timestamp",
                "null_channel": "channel",
                "null_amount": None,
            },
            "product_events",
        ),
        null_profile(
            orders,
            {
                "null_user_id": "user_id",
                "null_event_name": "event",
                "null_timestamp": "timestamp",
                "null_channel": None,
                "null_amount": "amount",
            },
            "orders",
        ),
    )


def dq_duplicates(product_events: DataFrame, orders: DataFrame) -> DataFrame:
    return stack_rows(
        duplicate_profile(
            product_events, ["user_id", "event_type", "timestamp", "channel"], "product_events"
        ),
        duplicate_profile(orders, ["user_id", "event", "timestamp", "amount"], "orders"),
    )


def _null_rules(columns: list[str]) -> dict[str, Column]:
    return {f"null_{c}": F.col(c).isNull() for c in columns}


def _amount_rules(very_high: int = VERY_HIGH_AMOUNT) -> dict[str, Column]:
    amount = F.col("amount")
    return {
        "null_amount": amount.isNull(),
        "zero_amount": amount == 0,
        "negative_amount": amount < 0,
        "very_high_amount": amount > very_high,
    }


def _time_rules() -> dict[str, Column]:
    return {"invalid_timestamp_rows": load_time().isNull()}


def _negative_rules() -> dict[str, Column]:
    return {f"negative_{m}": F.col(m) < 0 for m in MEASURES}


def _ads_funnel_rules() -> dict[str, Column]:
    return {
        "clicks_gt_impressions": F.col("clicks") > F.col("impressions"),
        "installs_gt_clicks": F.col("installs") > F.col("clicks"),
        "registrations_gt_installs": F.col("registrations") > F.col("installs"),
    }


def dq_amount_validity(orders: DataFrame, very_high: int = VERY_HIGH_AMOUNT) -> DataFrame:
    amount = F.col("amount")
    return rule_counts(
        orders,
        _amount_rules(very_high),
        as_money(F.min(amount)).alias("min_amount"),
        as_money(F.max(amount)).alias("max_amount"),
        mean(amount, 2).alias("avg_amount"),
    )


def dq_amount_by_event(orders: DataFrame) -> DataFrame:
    return value_stability(
        orders,
        "event",
        "amount",
        as_money(F.min("amount")).alias("min_amount"),
        as_money(F.max("amount")).alias("max_amount"),
        mean(F.col("amount"), 2).alias("avg_amount"),
    ).orderBy("event")


def dq_period_overhang(product_events: DataFrame, orders: DataFrame) -> DataFrame:
    return period_overhang(orders, product_events, "timestamp", "amount").select(
        F.col("facts_total").alias("orders_total"),
        F.col("facts_before").alias("orders_before_product_period"),
        F.col("facts_after").alias("orders_after_product_period"),
        as_money(F.col("amount_after")).alias("revenue_after_product_period"),
    )


def dq_funnel(product_events: DataFrame) -> DataFrame:
    event = F.col("event_type")
    flags = presence_flags(
        product_events,
        "user_id",
        {
            "installed": event == "install",
            "registered": event == "registration",
            "deeper": event.isin(*DEEPER_EVENTS),
        },
    )
    installed, registered, deeper = F.col("installed"), F.col("registered"), F.col("deeper")
    return flags.agg(
        F.count_if(registered).alias("users_with_registration"),
        F.count_if(registered & ~installed).alias("users_registration_without_install"),
        F.count_if(deeper).alias("users_with_deeper_events"),
        F.count_if(deeper & ~registered).alias("users_deeper_events_without_registration"),
    )


def dq_paying_users(product_events: DataFrame, orders: DataFrame) -> DataFrame:
    return orphan_count(orders, product_events, "user_id").select(
        F.col("keys_total").alias("paying_users_total"),
        F.col("keys_missing").alias("paying_users_without_product_events"),
    )


def dq_ads_nulls(ads: DataFrame) -> DataFrame:
    return null_profile(ads, {f"null_{c}": c for c in ADS_COLUMNS}, "marketing_ads_raw")


def dq_ads_duplicates(ads: DataFrame, strict: bool = False) -> DataFrame:
    return duplicate_rows(ads, ADS_COLUMNS, strict)


def dq_ads_duplicates_strict(ads: DataFrame) -> DataFrame:
    return duplicate_rows(ads, ADS_COLUMNS, strict=True)


def dq_multi_channel_users(product_events: DataFrame) -> DataFrame:
    """Users with events, and those among them whose events name several channels; such a user
    counts once in each channel's cohort."""
    per_user = product_events.where(F.col("user_id").isNotNull()).groupBy("user_id").agg(
        F.min("channel").alias("low"), F.max("channel").alias("high")
    )
    return per_user.agg(
        F.count("*").alias("users_total"),
        F.count_if(F.col("low") < F.col("high")).alias("users_with_several_channels"),
    )


def dq_ads_timestamp(ads: DataFrame) -> DataFrame:
    return rule_counts(
        ads,
        _time_rules(),
        F.min(load_time()).alias("earliest_timestamp"),
        F.max(load_time()).alias("latest_timestamp"),
    )


def dq_ads_metric_validity(ads: DataFrame) -> DataFrame:
    return rule_counts(
        ads,
        _negative_rules(),
        F.min("spend").cast("double").alias("min_spend"),
        F.max("spend").cast("double").alias("max_spend"),
        mean(F.col("spend"), 2).alias("avg_spend"),
    )


def dq_ads_funnel(ads: DataFrame) -> DataFrame:
    return rule_counts(ads, _ads_funnel_rules())


def dq_snapshot_structure(ads: DataFrame) -> DataFrame:
    return group_size_histogram(
        ads, ["ad_id", "date"], "snapshots_per_ad_day", "ad_day_groups"
    ).orderBy("snapshots_per_ad_day")


def dq_verdicts(product_events: DataFrame, orders: DataFrame, ads: DataFrame) -> DataFrame:
    """All checks whose count should be 0, an empty table among them. Rules on single rows and
    duplicates come from one pass over each table."""

    def rows(df: DataFrame, name: str, rules: dict[str, Column]) -> DataFrame:
        return zeros(row_checks(df, rules), F.lit(name), "empty_table", "duplicate_rows", *rules)

    def zeros(result: DataFrame, subject: Column, *checks: str) -> DataFrame:
        return verdicts(result, subject, dict.fromkeys(checks, 0))

    return stack_rows(
        rows(
            product_events.select("user_id", "event_type", "timestamp", "channel"),
            "product_events",
            _null_rules(["user_id", "event_type", "timestamp", "channel"]),
        ),
        rows(
            orders.select("user_id", "event", "timestamp", "amount"),
            "orders",
            {**_null_rules(["user_id", "event", "timestamp"]), **_amount_rules()},
        ),
        rows(
            ads.select(*ADS_COLUMNS),
            "marketing_ads_raw",
            {
                **_null_rules(ADS_COLUMNS),
                **_time_rules(),
                **_negative_rules(),
                **_ads_funnel_rules(),
            },
        ),
        zeros(
            dq_funnel(product_events),
            F.lit("product_events"),
            "users_registration_without_install",
            "users_deeper_events_without_registration",
        ),
        zeros(
            dq_paying_users(product_events, orders),
            F.lit("orders"),
            "paying_users_without_product_events",
        ),
    ).orderBy("subject", "check")

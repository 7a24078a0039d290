"""Results that combine product, revenue and advertising data."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime, time, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from unitlens.functions import as_money, ratio, rounded
from unitlens.operators.cohorts import moment
from unitlens.operators.comparison import reconcile, share_of_total
from unitlens.operators.funnels import Step, chain, funnel
from unitlens.operators.profiling import coverage, side_by_side, stack_rows
from unitlens.operators.quality import presence_flags
from unitlens.plans.acquisition import (
    AD_DAY,
    MEASURES,
    channel_totals,
    funnel_rates,
    latest_by_source,
    sum_measures,
)
from unitlens.plans.revenue import LtvTerms, channel_components, registrations

# Order of the product milestones.
MILESTONES = ["install", "registration", "like", "match", "message_sent", "paywall_view"]
# Spend the sources were expected to have.
EXPECTED_SPEND = {"tiktok": 15000, "meta": 50000, "google": 15000}
BREAK_EVEN = 1


def violating_ad_days(ads: DataFrame) -> DataFrame:
    """Ad-days with more than one row, which a deduplicated table must not have."""
    return (
        ads.groupBy(*AD_DAY)
        .agg(F.count("*").alias("n"))
        .agg(F.count_if(F.col("n") > 1).alias("violating_ad_days"))
    )


def dedup_check(ads: DataFrame) -> DataFrame:
    return violating_ad_days(latest_by_source(ads))


def coverage_three_sources(
    product_events: DataFrame, orders: DataFrame, ads: DataFrame
) -> DataFrame:
    spans = stack_rows(
        coverage(product_events, "timestamp", "product_events"),
        coverage(orders, "timestamp", "orders"),
        coverage(ads.select("date"), "date", "marketing_ads_raw"),
    )
    return spans.select(
        F.col("table_name").alias("dataset"),
        F.to_date("earliest_timestamp").alias("earliest_date"),
        F.to_date("latest_timestamp").alias("latest_date"),
        "days_covered",
    )


def spend_scale_check(
    ads: DataFrame, expected: Mapping[str, int] = EXPECTED_SPEND
) -> DataFrame:
    """Stored spend against the expected one; about 100 shows the stored scale."""
    pairs = [F.lit(x) for item in expected.items() for x in item]
    raw = latest_by_source(ads).groupBy("source").agg(F.sum("spend").alias("spend"))
    return raw.withColumn(
        "expected", F.create_map(*pairs)[F.col("source")].cast("double")
    ).select(
        F.col("source").alias("channel"),
        as_money(F.col("spend")).alias("raw_spend"),
        F.col("expected").alias("expected_spend"),
        ratio(F.col("spend"), F.col("expected"), digits=2).alias("scale_ratio"),
    )


def _reconcile_registrations(product_events: DataFrame, ads: DataFrame) -> DataFrame:
    marketing = channel_totals(ads).select(
        F.col("source").alias("channel"),
        as_money(F.col("total_registrations"), 0).alias("marketing_registrations"),
    )
    product = (
        registrations(product_events)
        .groupBy("channel")
        .agg(F.count("user_id").cast("double").alias("product_registered_users"))
    )
    return reconcile(
        marketing, product, "channel", "marketing_registrations", "product_registered_users"
    ).orderBy("channel")


def registration_reconciliation(product_events: DataFrame, ads: DataFrame) -> DataFrame:
    return _reconcile_registrations(product_events, ads)


def registration_reconciliation_shared_period(
    product_events: DataFrame, ads: DataFrame
) -> DataFrame:
    """The same over the days that both sources cover."""

    def days(df: DataFrame, ts: str) -> tuple:
        return tuple(df.agg(F.min(ts).cast("date"), F.max(ts).cast("date")).first())

    product, marketing = days(product_events, "timestamp"), days(ads, "date")
    if None in product + marketing:
        return _reconcile_registrations(product_events.where("false"), ads.where("false"))
    first, last = max(product[0], marketing[0]), min(product[1], marketing[1])
    # Constants on the stored columns, which reach the scans.
    after = moment(datetime.combine(last, time()) + timedelta(days=1))
    ts = F.col("timestamp")
    return _reconcile_registrations(
        product_events.where((ts >= moment(datetime.combine(first, time()))) & (ts < after)),
        ads.where(F.col("date").between(F.lit(first), F.lit(last))),
    )


def product_funnel(product_events: DataFrame) -> DataFrame:
    reached = presence_flags(
        product_events.where(F.col("user_id").isNotNull()),
        "user_id",
        {m: F.col("event_type") == m for m in MILESTONES},
    )
    counts = reached.agg(*(F.count_if(m).alias(m) for m in MILESTONES))
    return funnel(counts, chain(*MILESTONES), "users")


def acquisition_funnel(ads: DataFrame) -> DataFrame:
    steps = [m for m in MEASURES if m != "spend"]
    totals = channel_totals(ads).select(
        F.col("source").alias("channel"), *(F.col(f"total_{s}").cast("double").alias(s) for s in steps)
    )
    return funnel(totals, chain(*steps), "value", by=["channel"]).orderBy("channel", "step_no")


def monetization_funnel(product_events: DataFrame, orders: DataFrame) -> DataFrame:
    """Rebill and upsell users both relate to buyers."""
    steps = [
        Step("registered_users", "registered_users"),
        Step("buyers", "buyers", "registered_users"),
        Step("rebill_users", "rebill_users", "buyers"),
        Step("upsell_users", "upsell_users", "buyers"),
    ]
    components = channel_components(product_events, orders)
    return funnel(components, steps, "users", by=["channel"], overall=False).orderBy(
        "channel", "step_no"
    )


def kpi_cards(product_events: DataFrame, orders: DataFrame, ads: DataFrame) -> DataFrame:
    """Blended figures: ratios of the totals over all channels, not means of ratios."""
    components = channel_components(product_events, orders)
    summed = [c for c in components.columns if c != "channel"]
    revenue = components.agg(*(F.sum(c).alias(c) for c in summed))
    spend = sum_measures(latest_by_source(ads), [])
    cac = funnel_rates()["cac"]
    return side_by_side(revenue, spend).select(
        as_money(F.col("total_revenue")).alias("total_revenue_6m"),
        as_money(F.col("total_spend")).alias("total_spend"),
        rounded(cac, 2).alias("cac"),
        ratio(LtvTerms().per_registered, cac, digits=2).alias("ltv_cac"),
    )


def unit_economics_report(components: DataFrame, totals: DataFrame) -> DataFrame:
    """One row per channel known to either side."""
    cac = funnel_rates()["cac"]
    earned = components.select(
        "channel",
        "registered_users",
        F.col("total_revenue"),
        share_of_total(F.col("total_revenue"), 4).alias("revenue_share"),
        LtvTerms().per_registered.alias("ltv"),
    )
    spent = totals.select(F.col("source").alias("channel"), "total_spend", cac.alias("cac"))
    ltv_cac = ratio(F.col("ltv"), F.col("cac"), digits=2)
    return earned.join(spent, "channel", "full_outer").select(
        "channel",
        "registered_users",
        as_money(F.col("total_revenue")).alias("total_revenue_6m"),
        "revenue_share",
        as_money(F.col("total_spend")).alias("total_spend"),
        rounded(F.col("cac"), 2).alias("cac"),
        rounded(F.col("ltv"), 2).alias("ltv_6m_per_registered_user"),
        ltv_cac.alias("ltv_cac"),
        (ltv_cac >= BREAK_EVEN).alias("above_break_even"),
    )


def unit_economics_by_channel(
    product_events: DataFrame, orders: DataFrame, ads: DataFrame
) -> DataFrame:
    return unit_economics_report(
        channel_components(product_events, orders), channel_totals(ads)
    ).orderBy(F.desc("ltv_cac"))


def rank_channels(report: DataFrame) -> DataFrame:
    """Channels ordered by each question asked of them; equal values go by channel name."""
    answers = {
        "lowest_cac": ("cac", -1),
        "best_ltv_cac": ("ltv_cac", 1),
        "highest_ltv": ("ltv_6m_per_registered_user", 1),
        "largest_revenue": ("total_revenue_6m", 1),
    }
    rows = [
        F.struct(
            F.lit(metric).alias("metric"),
            F.col(column).alias("value"),
            (F.col(column) * sign).alias("score"),
        )
        for metric, (column, sign) in answers.items()
    ]
    best_first = Window.partitionBy("metric").orderBy(F.desc_nulls_last("score"), "channel")
    return (
        report.select("channel", F.inline(F.array(*rows)))
        .withColumn("rank", F.rank().over(best_first).cast("bigint"))
        .select("metric", "rank", "channel", "value")
        .orderBy("metric", "rank")
    )


def channel_ranking(product_events: DataFrame, orders: DataFrame, ads: DataFrame) -> DataFrame:
    return rank_channels(
        unit_economics_report(channel_components(product_events, orders), channel_totals(ads))
    )

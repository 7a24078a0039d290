"""All named queries. A query's parameter names say which tables it reads."""

from __future__ import annotations

import inspect
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from unitlens.plans import acquisition, data_quality, economics, profiling, revenue, states
from unitlens.sources import Tables

PLANS: list[Callable[..., DataFrame]] = [
    profiling.schema_overview,
    profiling.preview_product_events,
    profiling.preview_orders,
    profiling.table_volume,
    profiling.date_coverage,
    profiling.product_event_types,
    profiling.revenue_event_types,
    profiling.channel_overview,
    profiling.channel_event_breakdown,
    profiling.daily_activity,
    profiling.daily_revenue,
    profiling.amount_distribution,
    profiling.aov_by_event,
    profiling.ads_overview,
    data_quality.dq_nulls,
    data_quality.dq_duplicates,
    data_quality.dq_amount_validity,
    data_quality.dq_amount_by_event,
    data_quality.dq_period_overhang,
    data_quality.dq_funnel,
    data_quality.dq_paying_users,
    data_quality.dq_multi_channel_users,
    data_quality.dq_ads_nulls,
    data_quality.dq_ads_duplicates,
    data_quality.dq_ads_duplicates_strict,
    data_quality.dq_ads_timestamp,
    data_quality.dq_ads_metric_validity,
    data_quality.dq_ads_funnel,
    data_quality.dq_snapshot_structure,
    data_quality.dq_verdicts,
    revenue.ltv_by_channel,
    revenue.revenue_scale_by_channel,
    revenue.matured_cohort_ltv,
    revenue.censored_cohort_ltv,
    acquisition.deduplicated_ads,
    acquisition.incremental_ads,
    acquisition.ads_daily_metrics,
    acquisition.ads_channel_totals,
    acquisition.cac_by_channel,
    acquisition.monthly_cac_by_channel,
    acquisition.monthly_cac_calendar,
    acquisition.cac_by_hierarchy,
    economics.dedup_check,
    economics.coverage_three_sources,
    economics.spend_scale_check,
    economics.registration_reconciliation,
    economics.registration_reconciliation_shared_period,
    economics.product_funnel,
    economics.acquisition_funnel,
    economics.monetization_funnel,
    economics.kpi_cards,
    economics.unit_economics_by_channel,
    economics.channel_ranking,
    states.activity_by_period,
    states.amount_quantiles,
    states.hierarchy_activity,
]


def bind(plan: Callable[..., DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """Give a plan the tables it names, read from a folder."""
    inputs = [
        name
        for name in inspect.signature(plan).parameters
        if name in ("product_events", "orders", "ads")
    ]

    def run(spark: SparkSession, folder: str) -> DataFrame:
        tables = Tables(spark, folder)
        return plan(**{name: getattr(tables, name) for name in inputs})

    return run


QUERIES = {plan.__name__: bind(plan) for plan in PLANS}

from __future__ import annotations

import pytest
from conftest import rows
from fixtures import M1_EVENTS, M1_ORDERS, events_df, money, orders_df
from pyspark.sql import functions as F

from unitlens.plans import revenue


def by_channel(df):
    return {r.channel: r for r in df.collect()}


def test_window_bounds_and_month_clamp(spark):
    product_events, orders = events_df(spark, M1_EVENTS), orders_df(spark, M1_ORDERS)
    scale = by_channel(revenue.revenue_scale_by_channel(product_events, orders))
    picked = {
        c: (
            r.registered_users,
            r.paying_users,
            r.total_revenue_6m,
            r.revenue_share,
            r.arppu_6m_per_payer,
            r.arpu_6m_per_registered_user,
        )
        for c, r in scale.items()
    }
    assert picked == {
        "google": (1, 0, 0.0, 0.0, None, 0.0),
        "meta": (2, 1, 74.98, 0.75, 74.98, 37.49),
        "tiktok": (1, 1, 24.99, 0.25, 24.99, 24.99),
    }
    ltv = by_channel(revenue.ltv_by_channel(product_events, orders))
    assert {c: r.buyers for c, r in ltv.items()} == {"google": 0, "meta": 1, "tiktok": 1}
    assert {r.ltv_6m_per_registered_user for r in ltv.values()} == {None}


def test_missing_terms_can_count_as_zero(spark):
    components = revenue.channel_components(
        events_df(spark, M1_EVENTS), orders_df(spark, M1_ORDERS)
    )
    ltv = by_channel(revenue.ltv_report(components, missing_as_zero=True))
    assert ltv["meta"].ltv_6m_per_payer == 74.98
    assert ltv["tiktok"].ltv_6m_per_registered_user == 24.99
    assert ltv["google"].ltv_6m_per_registered_user == 0.0


def test_user_of_two_channels_counts_in_both_and_first_registration_counts(spark):
    product_events = events_df(
        spark,
        [
            (1, "registration", "2024-01-05 00:00:00", "meta"),
            (1, "registration", "2024-01-01 00:00:00", "meta"),
            (1, "registration", "2024-03-01 00:00:00", "google"),
            (1, "install", "2023-01-01 00:00:00", "tiktok"),
        ],
    )
    orders = orders_df(
        spark,
        [
            (1, "purchase", "2024-01-02 00:00:00", 10),
            (1, "rebill", "2024-08-30 00:00:00", 5),
        ],
    )
    scale = by_channel(revenue.revenue_scale_by_channel(product_events, orders))
    assert {c: (r.registered_users, r.total_revenue_6m) for c, r in scale.items()} == {
        "meta": (1, 10.0),
        "google": (1, 5.0),
    }


def test_payer_without_purchase_is_no_buyer(spark):
    product_events = events_df(spark, [(1, "registration", "2024-01-01 00:00:00", "meta")])
    orders = orders_df(spark, [(1, "rebill", "2024-01-02 00:00:00", 5)])
    c = revenue.channel_components(product_events, orders).first()
    assert (c.buyers, c.paying_users, c.rebill_users) == (0, 1, 1)


def test_null_amounts_and_null_keys(spark):
    """A user whose only payment has no amount has no purchase sum, as in a left join."""
    product_events = events_df(
        spark,
        [
            (1, "registration", "2024-01-01 00:00:00", "meta"),
            (2, "registration", "2024-01-01 00:00:00", "google"),
            (3, "registration", "2024-01-01 00:00:00", "google"),
            (None, "registration", "2024-01-01 00:00:00", "google"),
            (4, "registration", None, "tiktok"),
            (5, "registration", "2024-01-01 00:00:00", None),
        ],
    )
    orders = orders_df(
        spark,
        [
            (1, "purchase", "2024-01-02 00:00:00", None),
            (2, "purchase", "2024-01-02 00:00:00", None),
            (None, "purchase", "2024-01-02 00:00:00", 9),
            (4, "purchase", "2024-01-02 00:00:00", 9),
            (5, "purchase", "2024-01-02 00:00:00", 9),
        ],
    )
    c = by_channel(revenue.channel_components(product_events, orders))
    seen = {
        k: (r.registered_users, r.buyers, r.purchase_revenue, r.total_revenue)
        for k, r in c.items()
    }
    assert seen == {
        "meta": (1, 1, None, money("0.00")),
        "google": (2, 1, money("0.00"), money("0.00")),
        "tiktok": (1, 0, money("0.00"), money("0.00")),
        None: (1, 1, money("9.00"), money("9.00")),
    }


# Published results; the counts of rebills and upsells follow from the fixed prices.
PUBLISHED = [
    # channel, registered, buyers, rebills, upsells, revenue, share, CR, per payer, per user
    ("meta", 16114, 531, 513, 106, "41034.56", 0.5220, 0.0330, 77.28, 2.55),
    ("tiktok", 2790, 282, 232, 51, "19664.86", 0.2502, 0.1011, 69.73, 7.05),
    ("google", 1066, 194, 244, 43, "17905.62", 0.2278, 0.1820, 92.30, 16.80),
]


def published_components(spark):
    data = [
        (ch, r, b, b, money("24.99") * b, n, money("49.99") * n, u, u, money("20.00") * u, money(t))
        for ch, r, b, n, u, t, *_ in PUBLISHED
    ]
    return spark.createDataFrame(
        data,
        "channel string, registered_users bigint, buyers bigint, purchase_events bigint,"
        " purchase_revenue decimal(22,2), rebill_events bigint, rebill_revenue decimal(22,2),"
        " upsell_users bigint, upsell_events bigint, upsell_revenue decimal(22,2),"
        " total_revenue decimal(22,2)",
    ).withColumn("rebill_users", F.col("rebill_events"))


def test_published_ltv(spark):
    components = published_components(spark)
    kinds = sum(F.col(f"{k}_revenue") for k in revenue.PAYMENT_KINDS)
    assert components.where(kinds != F.col("total_revenue")).count() == 0
    report = by_channel(revenue.ltv_report(components))
    for channel, *_, share, cr, per_payer, per_user in PUBLISHED:
        r = report[channel]
        assert r.revenue_share == pytest.approx(share, abs=5e-5)
        assert r.cr_registration_to_purchase == pytest.approx(cr, abs=5e-5)
        assert r.ltv_6m_per_payer == per_payer
        assert r.ltv_6m_per_registered_user == per_user


def test_shares_sum_to_one_and_parts_to_ltv(spark):
    report = revenue.ltv_report(published_components(spark)).collect()
    assert sum(r.revenue_share for r in report) == pytest.approx(1, abs=2e-4)
    for r in report:
        parts = (
            r.ltv_component_first_purchase + r.ltv_component_rebill + r.ltv_component_upsell
        )
        assert parts == pytest.approx(r.ltv_6m_per_registered_user, abs=0.016)


def test_matured_registrations(spark):
    product_events = events_df(
        spark,
        [
            (1, "registration", "2024-01-01 00:00:00", "meta"),
            (2, "registration", "2024-01-01 00:00:01", "meta"),
        ],
    )
    orders = orders_df(spark, [(1, "purchase", "2024-07-01 00:00:00", 5)])
    result = rows(revenue.matured_cohort_ltv(product_events, orders))
    assert [r[:4] for r in result] == [("meta", True, 1, 0), ("meta", False, 1, 0)]

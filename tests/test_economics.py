from __future__ import annotations

from conftest import rows
from fixtures import M1_EVENTS, M1_ORDERS, M2_ADS, ads_df, events_df, orders_df
from test_revenue import published_components

from unitlens.operators.comparison import reconcile
from unitlens.operators.funnels import Step, chain, funnel
from unitlens.plans import economics


def test_economics_of_published_figures(spark):
    totals = spark.createDataFrame(
        [("tiktok", 14417.69, 2676.0), ("google", 15199.92, 1076.48), ("meta", 49921.41, 16079.0)],
        "source string, total_spend double, total_registrations double",
    )
    for measure in ("impressions", "clicks", "installs"):
        totals = totals.selectExpr("*", f"1.0d as total_{measure}")
    report = economics.unit_economics_report(published_components(spark), totals)
    flags = {r.channel: (r.ltv_cac, r.above_break_even) for r in report.collect()}
    assert flags == {"tiktok": (1.31, True), "google": (1.19, True), "meta": (0.82, False)}
    first = {r.metric: r.channel for r in economics.rank_channels(report).where("rank = 1").collect()}
    assert first == {
        "lowest_cac": "meta",
        "best_ltv_cac": "tiktok",
        "highest_ltv": "google",
        "largest_revenue": "meta",
    }


def test_channels_of_one_side_only_stay(spark):
    args = (
        events_df(spark, M1_EVENTS),
        orders_df(spark, M1_ORDERS),
        ads_df(spark, M2_ADS).where("source = 'meta'"),
    )
    report = economics.unit_economics_by_channel(*args)
    assert {r.channel: r.total_spend for r in report.collect()} == {
        "meta": 3.5,
        "google": None,
        "tiktok": None,
    }


def test_kpi_uses_ratios_of_totals(spark):
    kpi = economics.kpi_cards(
        events_df(spark, M1_EVENTS), orders_df(spark, M1_ORDERS), ads_df(spark, M2_ADS)
    ).first()
    # 3.90 spend over 0.20 registrations; no upsell anywhere, so LTV stays unknown
    assert (kpi.total_revenue_6m, kpi.total_spend, kpi.cac, kpi.ltv_cac) == (99.97, 3.9, 19.5, None)


def test_funnel_rates(spark):
    counts = spark.createDataFrame([(8, 4, 0, 1)], "a bigint, b bigint, c bigint, d bigint")
    assert rows(funnel(counts, chain("a", "b", "c", "d"), "n")) == [
        (1, "a", 8, None, 1.0),
        (2, "b", 4, 0.5, 0.5),
        (3, "c", 0, 0.0, 0.0),
        (4, "d", 1, None, 0.125),
    ]
    branched = [Step("a", "a"), Step("b", "b", "a"), Step("d", "d", "b"), Step("c", "c", "b")]
    assert rows(funnel(counts, branched, "n", overall=False)) == [
        (1, "a", 8, None),
        (2, "b", 4, 0.5),
        (3, "d", 1, 0.25),
        (4, "c", 0, 0.0),
    ]


def test_product_funnel_counts_users_once(spark):
    events = events_df(
        spark,
        [
            (1, "install", "2024-01-01 00:00:00", "meta"),
            (1, "install", "2024-01-02 00:00:00", "meta"),
            (2, "install", "2024-01-01 00:00:00", "meta"),
            (None, "install", "2024-01-01 00:00:00", "meta"),
            (1, "registration", "2024-01-01 00:00:00", "meta"),
            (1, None, "2024-01-01 00:00:00", "meta"),
        ],
    )
    found = rows(economics.product_funnel(events))
    assert [r[1:4] for r in found[:3]] == [
        ("install", 2, None),
        ("registration", 1, 0.5),
        ("like", 0, 0.0),
    ]


def test_spend_scale(spark):
    report = economics.spend_scale_check(ads_df(spark, M2_ADS), {"meta": 4})
    assert sorted(rows(report)) == [("meta", 350.0, 4.0, 87.5), ("tiktok", 40.0, None, None)]


def test_reconcile_with_itself_and_with_tolerance(spark):
    a = spark.createDataFrame([("x", 10.0), ("y", 11.0)], "k string, a double")
    b = spark.createDataFrame([("x", 10.0), ("y", 10.0), ("z", 1.0)], "k string, b double")
    same = reconcile(a, a.withColumnRenamed("a", "b"), "k", "a", "b")
    assert {r.difference for r in same.collect()} == {0.0}
    judged = reconcile(a, b, "k", "a", "b", tolerance=0.05)
    assert {r.k: r.within_tolerance for r in judged.collect()} == {
        "x": True,
        "y": False,
        "z": False,
    }

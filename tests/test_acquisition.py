from __future__ import annotations

import random
from decimal import Decimal

from conftest import rows
from fixtures import M2_ADS, ads_df, events_df
from pyspark.sql import functions as F

from unitlens.plans import acquisition, economics


def test_latest_valid_snapshot_and_rates(spark):
    totals = acquisition.channel_totals(ads_df(spark, M2_ADS))
    report = acquisition.cac_report(totals, {"meta": 35.0})
    assert sorted(rows(report)) == [
        ("meta", 3.5, 100.0, 10.0, 10.0, 57.14, 17.5, 35.0, 2.0),
        ("tiktok", 0.4, 100.0, 0.0, None, None, None, None, None),
    ]


def test_equal_load_times_keep_one_whole_row(spark):
    same = "2024-01-02 08:00:00"
    data = [
        ("meta", 1, "2024-01-02", same, 5, 10, 9, 8, 7),
        ("meta", 1, "2024-01-02", same, 6, 1, 1, 1, 1),
        ("meta", 1, "2024-01-02", same, 6, 2, 0, 0, 0),
    ]
    for seed in range(3):
        random.Random(seed).shuffle(data)
        kept = acquisition.latest_ads(ads_df(spark, data)).collect()
        assert [(r.spend, r.impressions, r.clicks) for r in kept] == [(Decimal("6.00"), 2, 0)]


def test_ad_day_with_only_bad_times_keeps_a_row(spark):
    kept = acquisition.latest_ads(
        ads_df(spark, [("meta", 1, "2024-01-02", "bad", 1, 1, 1, 1, 1)])
    ).collect()
    assert [r.snapshot_ts for r in kept] == [None]


def test_wider_key_keeps_sources_apart(spark):
    ads = ads_df(
        spark,
        [
            ("meta", 1, "2024-01-02", "2024-01-02 08:00:00", 1, 1, 1, 1, 1),
            ("google", 1, "2024-01-02", "2024-01-02 09:00:00", 2, 1, 1, 1, 1),
        ],
    )
    assert acquisition.latest_ads(ads).count() == 1
    assert acquisition.latest_ads(ads, ("date", "ad_id", "source")).count() == 2


def test_rescaled_measures_are_exact(spark):
    ads = ads_df(spark, [("meta", 1, "2024-01-02", "2024-01-02 08:00:00", "3.63", 7, 5, 3, 1)])
    r = acquisition.deduplicated_ads(ads).first()
    assert (r.spend, r.impressions, r.clicks, r.installs, r.registrations) == (
        0.0363,
        0.07,
        0.05,
        0.03,
        0.01,
    )


def test_month_change_steps_over_a_missing_month(spark):
    ads = ads_df(
        spark,
        [
            ("meta", 1, "2024-01-05", "2024-01-05 08:00:00", 1000, 1, 1, 1, 100),
            ("meta", 1, "2024-03-05", "2024-03-05 08:00:00", 1500, 1, 1, 1, 100),
            ("google", 2, "2024-02-05", "2024-02-05 08:00:00", 1500, 1, 1, 1, 0),
        ],
    )
    report = acquisition.monthly_cac_by_channel(ads)
    picked = report.select("channel", "month", "cac", "previous_month_cac", "cac_mom_change_pct")
    assert rows(picked) == [
        ("google", "2024-02", None, None, None),
        ("meta", "2024-01", 10.0, None, None),
        ("meta", "2024-03", 15.0, 10.0, 50.0),
    ]


def test_published_ltv_cac(spark):
    """Spend and registrations in stored scale; LTV as published."""
    totals = spark.createDataFrame(
        [("tiktok", 14417.69, 2676.0), ("google", 15199.92, 1076.48), ("meta", 49921.41, 16079.0)],
        "source string, total_spend double, total_registrations double",
    ).withColumns({f"total_{m}": F.lit(1.0) for m in ("impressions", "clicks", "installs")})
    report = acquisition.cac_report(totals, {"tiktok": 7.05, "google": 16.80, "meta": 2.55})
    found = {r.channel: (r.cac, r.ltv_per_reg_user, r.ltv_cac) for r in report.collect()}
    assert found == {
        "tiktok": (5.39, 7.05, 1.31),
        "google": (14.12, 16.8, 1.19),
        "meta": (3.10, 2.55, 0.82),
    }


def test_ltv_rounded_first_is_an_option(spark):
    totals = spark.createDataFrame(
        [("meta", 1.0, 1000.0)], "source string, total_spend double, total_registrations double"
    ).withColumns({f"total_{m}": F.lit(1.0) for m in ("impressions", "clicks", "installs")})
    ltv = spark.createDataFrame([("meta", 2.554)], "channel string, ltv double")
    exact = acquisition.cac_report(totals, ltv).first()
    shown = acquisition.cac_report(totals, ltv, round_ltv_first=True).first()
    assert (exact.ltv_cac, shown.ltv_cac) == (2554.0, 2550.0)


def test_hierarchy_levels_add_up(spark):
    report = acquisition.cac_by_hierarchy(ads_df(spark, M2_ADS))
    spend = report.groupBy("level").agg(F.sum("total_spend").alias("s"))
    assert {r.level: round(r.s, 2) for r in spend.collect()} == dict.fromkeys(
        ["source", "campaign", "adset", "ad"], 3.9
    )


def test_no_ad_day_twice_after_deduplication(spark):
    assert rows(economics.dedup_check(ads_df(spark, M2_ADS))) == [(0,)]
    # The check itself sees what is not deduplicated.
    assert rows(economics.violating_ad_days(ads_df(spark, M2_ADS))) == [(1,)]


def test_reconciliation_keeps_one_sided_channels(spark):
    events = events_df(
        spark,
        [
            (1, "registration", "2024-01-02 10:00:00", "meta"),
            (2, "registration", "2024-02-02 10:00:00", "meta"),
            (3, "registration", "2024-01-02 10:00:00", "google"),
        ],
    )
    ads = ads_df(
        spark,
        [
            ("meta", 1, "2024-01-02", "2024-01-02 09:00:00", 1, 1, 1, 1, 149),
            ("TikTok", 2, "2024-01-03", "2024-01-03 09:00:00", 1, 1, 1, 1, 300),
        ],
    )
    assert rows(economics.registration_reconciliation(events, ads)) == [
        ("google", None, 1.0, None),
        ("meta", 1.0, 2.0, -1.0),
        ("tiktok", 3.0, None, None),
    ]
    assert rows(economics.registration_reconciliation_shared_period(events, ads)) == [
        ("google", None, 1.0, None),
        ("meta", 1.0, 1.0, 0.0),
        ("tiktok", 3.0, None, None),
    ]

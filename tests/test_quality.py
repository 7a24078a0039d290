from __future__ import annotations

from conftest import rows
from fixtures import M2_ADS, ads_df, events_df, orders_df

from unitlens.operators.quality import duplicate_profile, duplicate_rows
from unitlens.plans import data_quality as dq


def test_nulls_per_field_with_typed_gaps(spark):
    events = events_df(spark, [(None, "install", "2024-01-01 00:00:00", None)])
    orders = orders_df(spark, [(1, None, "2024-01-01 00:00:00", None)])
    assert rows(dq.dq_nulls(events, orders)) == [
        ("product_events", 1, 1, 0, 0, 1, None),
        ("orders", 1, 0, 1, 0, None, 1),
    ]


def test_null_keys_are_equal(spark):
    df = spark.createDataFrame([(1, None), (1, None), (1, 2)], "a int, b int")
    assert rows(duplicate_profile(df, ["a", "b"], "t")) == [("t", 2, 3, 1, 1)]


def test_text_key_skips_nulls_and_strict_key_does_not(spark):
    df = spark.createDataFrame(
        [("a", None, "b"), ("a", "b", None)], "x string, y string, z string"
    )
    assert rows(duplicate_rows(df, ["x", "y", "z"])) == [(2, 1, 1)]
    assert rows(duplicate_rows(df, ["x", "y", "z"], strict=True)) == [(2, 2, 0)]


def test_strict_key_counts_rows_of_nulls(spark):
    df = spark.createDataFrame([(None, None), (None, None), (None, "b")], "x string, y string")
    assert rows(duplicate_rows(df, ["x", "y"], strict=True)) == [(3, 2, 1)]


def test_amount_rules(spark):
    orders = orders_df(
        spark, [(1, "purchase", "2024-01-01 00:00:00", a) for a in (None, 0, -5, 1000, 24.99)]
    )
    assert rows(dq.dq_amount_validity(orders)) == [(5, 1, 1, 1, 1, -5.0, 1000.0, 255.0)]


def test_funnel_flags(spark):
    t = "2024-01-01 00:00:00"
    events = events_df(
        spark,
        [
            (1, "install", t, "meta"),
            (1, "registration", t, "meta"),
            (1, "like", t, "meta"),
            (2, "registration", t, "meta"),
            (3, "like", t, "meta"),
            (4, None, t, "meta"),
        ],
    )
    assert rows(dq.dq_funnel(events)) == [(2, 1, 2, 1)]


def test_period_overhang_excludes_bounds(spark):
    events = events_df(
        spark,
        [(1, "install", f"2024-01-{d} 00:00:00", "meta") for d in ("02", "10")],
    )
    orders = orders_df(
        spark,
        [
            (1, "purchase", f"2024-01-{d} 00:00:00", a)
            for d, a in (("01", 10), ("02", 5), ("05", 20), ("11", 30))
        ],
    )
    assert rows(dq.dq_period_overhang(events, orders)) == [(4, 1, 1, 30.0)]


def test_payers_without_events_and_null_payers(spark):
    t = "2024-01-01 00:00:00"
    events = events_df(spark, [(1, "install", t, "meta"), (None, "install", t, "meta")])
    orders = orders_df(spark, [(1, "purchase", t, 1), (1, "rebill", t, 1), (2, "purchase", t, 1)])
    assert rows(dq.dq_paying_users(events, orders)) == [(2, 1)]
    with_null = orders.unionByName(orders_df(spark, [(None, "purchase", t, 1)]))
    assert rows(dq.dq_paying_users(events, with_null)) == [(3, 2)]


def test_ads_checks(spark):
    ads = ads_df(spark, M2_ADS)
    t = rows(dq.dq_ads_timestamp(ads))[0]
    assert t[:2] == (5, 1)
    assert rows(dq.dq_snapshot_structure(ads)) == [(1, 2), (3, 1)]
    assert rows(dq.dq_ads_duplicates(ads)) == [(5, 5, 0)]
    bad = ads_df(
        spark,
        [
            ("meta", 1, "2024-01-02", None, -1, 1, 2, 3, 4),
            (None, 1, "2024-01-02", "2024-01-02", 3, -1, -1, -1, -1),
        ],
    )
    assert rows(dq.dq_ads_metric_validity(bad)) == [(2, 1, 1, 1, 1, 1, -1.0, 3.0, 1.0)]
    assert rows(dq.dq_ads_funnel(bad)) == [(2, 1, 1, 1)]
    # A date alone is no load time.
    assert rows(dq.dq_ads_timestamp(bad))[0][:2] == (2, 2)
    assert rows(dq.dq_ads_nulls(bad)) == [
        ("marketing_ads_raw", 2, 1, 0, 0, 0, 0, 0, 0, 0, 0, 0, 1)
    ]


def test_empty_tables(spark):
    ads, orders = ads_df(spark, []), orders_df(spark, [])
    assert rows(dq.dq_ads_funnel(ads)) == [(0, 0, 0, 0)]
    assert rows(dq.dq_amount_validity(orders)) == [(0, 0, 0, 0, 0, None, None, None)]


def test_verdicts_name_what_failed(spark):
    t = "2024-01-01 00:00:00"
    found = dq.dq_verdicts(
        events_df(spark, [(1, "install", t, "meta"), (1, "like", t, "meta")]),
        orders_df(spark, [(2, "purchase", t, 0), (2, "purchase", t, 0)]),
        ads_df(spark, M2_ADS),
    )
    failed = {(r.subject, r.check): r.observed for r in found.collect() if not r.passed}
    assert failed == {
        ("product_events", "users_deeper_events_without_registration"): 1,
        ("orders", "zero_amount"): 2,
        ("orders", "duplicate_rows"): 1,
        ("orders", "paying_users_without_product_events"): 1,
        ("marketing_ads_raw", "invalid_timestamp_rows"): 1,
    }


def test_verdicts_fail_on_empty_tables(spark):
    found = dq.dq_verdicts(events_df(spark, []), orders_df(spark, []), ads_df(spark, []))
    failed = {(r.subject, r.check) for r in found.collect() if not r.passed}
    assert failed == {(t, "empty_table") for t in ("product_events", "orders", "marketing_ads_raw")}
    assert found.where("check = 'duplicate_rows'").count() == 3


def test_ads_duplicates_compare_column_by_column_in_verdicts(spark):
    """Two rows whose texts are equal only because a NULL has no place in them."""
    day, t = "2024-01-02", "2024-01-02 08:00:00"
    ads = ads_df(spark, [("meta", 1, day, t, 7, 1, None, 3, 4), ("meta", 1, day, t, 7, None, 1, 3, 4)])
    assert rows(dq.dq_ads_duplicates(ads)) == [(2, 1, 1)]
    assert rows(dq.dq_ads_duplicates_strict(ads)) == [(2, 2, 0)]
    events = events_df(spark, [(1, "install", t, "meta")])
    found = dq.dq_verdicts(events, orders_df(spark, [(1, "purchase", t, 1)]), ads)
    observed = {(r.subject, r.check): r.observed for r in found.collect()}
    assert observed["marketing_ads_raw", "duplicate_rows"] == 0
    assert observed["marketing_ads_raw", "null_clicks"] == 1


def test_load_times_have_one_form(spark):
    day = "2024-01-02"
    times = ["2024-01-02 08:00:00", "2024", "2024-01", "2024-01-02", "2024-01-02T08:00:00", "", " ", None]
    times += ["2024-01-02 08:00:00+05:00", "2024-01-02 08:00:00 UTC", "2024-02-30 08:00:00", "2024-01-02 25:00:00"]
    ads = ads_df(spark, [("meta", i, day, t, 1, 1, 1, 1, 1) for i, t in enumerate(times)])
    assert rows(dq.dq_ads_timestamp(ads))[0][:2] == (len(times), len(times) - 1)


def test_users_of_several_channels(spark):
    t = "2024-01-01 00:00:00"
    events = [(1, "install", t, "meta"), (1, "like", t, "google"), (2, "install", t, "meta"), (2, "like", t, "meta")]
    events += [(3, "install", t, None), (None, "install", t, "meta"), (4, "install", t, None), (4, "like", t, "meta")]
    assert rows(dq.dq_multi_channel_users(events_df(spark, events))) == [(4, 1)]

from __future__ import annotations

from datetime import date
from decimal import Decimal

import pytest
from conftest import rows
from fixtures import M2_ADS, ads_df

from unitlens.plans import acquisition
from unitlens.sources import (
    MARKETING_ADS_RAW,
    Tables,
    read_ads,
    read_orders,
    read_product_events,
    write_mart,
)

CSV = """source,campaign_id,adset_id,ad_id,date,spend,impressions,clicks,installs,registrations,timestamp
META,1,2,3,2024-01-02,100.50,1000,10,5,2,2024-01-02 08:00:00
TikTok ,1,2,4,2024-01-02,,1000,10,5,2,not a time
"""


def test_ads_csv(spark, tmp_path):
    path = tmp_path / "ads.csv"
    path.write_text(CSV)
    ads = read_ads(spark, str(path))
    assert [f.dataType for f in ads.schema] == [f.dataType for f in MARKETING_ADS_RAW]
    found = ads.orderBy("ad_id").collect()
    assert [r.source for r in found] == ["meta", "tiktok"]
    assert found[0].spend == Decimal("100.50") and found[0].date == date(2024, 1, 2)
    assert found[1].spend is None and found[1].timestamp == "not a time"


def test_ads_csv_goes_by_name_and_refuses_what_it_cannot_read(spark, tmp_path):
    names, first, _ = CSV.strip().split("\n")
    turned = tmp_path / "turned.csv"
    turned.write_text("\n".join(",".join(reversed(x.split(","))) for x in (names, first)))
    found = read_ads(spark, str(turned)).first()
    assert (found.impressions, found.clicks, found.ad_id, found.source) == (1000, 10, 3, "meta")
    bad = tmp_path / "bad.csv"
    bad.write_text(f"{names}\n{first.replace('1000', '1x000')}")
    with pytest.raises(Exception, match="impressions is not bigint: 1x000"):
        read_ads(spark, str(bad)).collect()
    less = tmp_path / "less.csv"
    less.write_text("source,ad_id\nmeta,1")
    with pytest.raises(Exception, match="campaign_id"):
        read_ads(spark, str(less)).collect()


def test_ads_with_text_ids_and_without_ids(spark, tmp_path):
    """Three ads of one day, and two rows whose ad is unknown: every row's spend is counted."""
    path = tmp_path / "text.csv"
    lines = [f"meta,c_1,s_1,ad_{i},2024-01-02,{100 * i}.00,10,5,2,1,2024-01-02 08:00:00" for i in (1, 2, 3)]
    lines += [",,,,2024-01-02,700.00,10,5,2,1,2024-01-02 08:00:00"] * 2
    path.write_text("\n".join([CSV.split("\n")[0], *lines]))
    with pytest.raises(Exception, match="campaign_id is not bigint"):
        read_ads(spark, str(path)).collect()
    totals = acquisition.ads_channel_totals(read_ads(spark, str(path), ids="string"))
    assert {r.source: r.total_spend for r in totals.collect()} == {"meta": 6.0, None: 14.0}


def test_channels_are_spelled_in_one_way(spark, tmp_path):
    path = tmp_path / "events.csv"
    path.write_text("timestamp,user_id,channel,event_type\n2024-01-02 08:00:00,u1, Meta,registration\n")
    found = read_product_events(spark, str(path), "csv", ids="string").first()
    assert (found.user_id, found.channel) == ("u1", "meta")


def test_marts_round_trip(spark, tmp_path):
    report = acquisition.ads_channel_totals(ads_df(spark, M2_ADS))
    for fmt in ("parquet", "csv"):
        path = str(tmp_path / fmt)
        write_mart(report, path, fmt)
        back = spark.read.schema(report.schema).format(fmt).option("header", True).load(path)
        assert sorted(rows(back)) == sorted(rows(report))


def test_parquet_readers(spark, tmp_path):
    tables = Tables(spark, "/root/testdata/sf0.001")
    for name, read in (("product_events", read_product_events), ("orders", read_orders)):
        path = str(tmp_path / name)
        write_mart(getattr(tables, name), path)
        assert read(spark, path).exceptAll(getattr(tables, name)).count() == 0
    write_mart(tables.ads, str(tmp_path / "ads"))
    assert read_ads(spark, str(tmp_path / "ads"), "parquet").exceptAll(tables.ads).count() == 0


def test_derived_tables(spark):
    """Counts at the smallest scale (FIXTURES.md, section 3)."""
    tables = Tables(spark, "/root/testdata/sf0.001")
    events = dict(rows(tables.product_events.groupBy("event_type").count()))
    assert events == {
        "install": 150,
        "registration": 139,
        "like": 75,
        "match": 38,
        "message_sent": 10,
        "paywall_view": 10,
    }
    assert dict(rows(tables.orders.groupBy("event").count())) == {
        "purchase": 589,
        "rebill": 617,
        "upsell": 294,
    }
    assert tables.ads.count() == 6000
    assert acquisition.latest_ads(tables.ads).count() == 5322


def test_ads_grow_within_a_day(spark):
    """Totals of a later minute are never below those of an earlier one."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    ads = Tables(spark, "/root/testdata/sf0.01").ads
    minute = ads.groupBy("ad_id", "date", "timestamp").agg(
        *(F.min(m).alias(f"low_{m}") for m in acquisition.MEASURES),
        *(F.max(m).alias(f"high_{m}") for m in acquisition.MEASURES),
    )
    day = Window.partitionBy("ad_id", "date").orderBy("timestamp")
    falls = [F.col(f"low_{m}") < F.lag(f"high_{m}").over(day) for m in acquisition.MEASURES]
    flagged = minute.select(*(f.alias(f"f{i}") for i, f in enumerate(falls)))
    assert flagged.where("f0 or f1 or f2 or f3 or f4").count() == 0


@pytest.mark.parametrize("fmt", ["parquet", "orc"])
def test_files_without_a_column_are_refused(spark, tmp_path, fmt):
    """A missing id would be NULL in every row, and each snapshot would count by itself."""
    path = str(tmp_path / "ads")
    ads_df(spark, M2_ADS).drop("ad_id", "clicks").write.format(fmt).save(path)
    with pytest.raises(ValueError, match="no column ad_id, clicks"):
        read_ads(spark, path, fmt)

"""Ad spend, the advertising funnel and CAC, from the last snapshot of each ad-day."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from unitlens.functions import as_money, load_time, ratio, rounded
from unitlens.operators.comparison import dense_months, last_known, period_change, previous_value
from unitlens.operators.snapshots import latest_snapshot, rescale
from unitlens.plans.data_quality import MEASURES
from unitlens.plans.revenue import LtvTerms, channel_components
from unitlens.sources.marts import NONE, Manifest, manifest_of, publish, read_mart
from unitlens.sources.workspace import work_folder

# Fixed value: measures are stored this many times too large.
STORED_SCALE = 100

# The date comes first: it has more values, so sorting rarely looks past it.
AD_DAY = ("date", "ad_id")
HIERARCHY = ["source", "campaign_id", "adset_id", "ad_id"]


def timed_ads(ads: DataFrame, keys: Sequence[str], describe: Sequence[str]) -> DataFrame:
    columns = dict.fromkeys([*describe, *keys, *MEASURES])
    return ads.select(*columns, load_time().alias("snapshot_ts"))


def last_of(timed: DataFrame, keys: Sequence[str], describe: Sequence[str]) -> DataFrame:
    ties = [F.desc(m) for m in MEASURES] + [F.asc(c) for c in describe]
    return latest_snapshot(timed, keys, F.col("snapshot_ts"), ties)


def latest_ads(
    ads: DataFrame, keys: Sequence[str] = AD_DAY, describe: Sequence[str] = tuple(HIERARCHY)
) -> DataFrame:
    """Last snapshot per ad-day with measures as stored and the columns that describe it.

    Of snapshots loaded at the same time the one with the largest running totals is kept,
    then the one whose description comes first. Rows are sorted to find it, so queries ask
    only for the description they need.
    """
    return last_of(timed_ads(ads, keys, describe), keys, describe)


def merge_ad_loads(loads: DataFrame, path: str, batch: str, period: str = "yyyy-MM-dd") -> Manifest:
    """Merge new load files into the stored last snapshots in ``path``; only the dates that they touch are read
    and written, or only the longer periods if ``period`` names those (``yyyy-MM``).

    Which snapshot is last doesn't depend on when it was merged, so loads may come late, in any order and
    again. Rows with an incomplete key belong to no other row; those that the same batch brought before are
    replaced, so a repeated batch doesn't double them. The periods of one batch, a few per load, are what
    reaches the driver.
    """
    spark = loads.sparkSession
    new = timed_ads(loads, AD_DAY, HIERARCHY).withColumns({"batch": F.lit(batch), "period": F.date_format("date", period)})
    touched = [r[0] for r in new.select(F.coalesce("period", F.lit(NONE))).distinct().collect()]
    rows = new
    if manifest_of(spark, path):
        whole = F.col("date").isNotNull() & F.col("ad_id").isNotNull()
        rows = read_mart(spark, path, parts=touched).where(whole | (F.col("batch") != batch)).unionByName(new)
    state = last_of(rows, AD_DAY, [*HIERARCHY, "batch"]).select(*new.columns)
    return publish(state, path, batch, by="period", replaces=touched)


def stored_ads(state: DataFrame) -> DataFrame:
    """The stored snapshots as ``deduplicated_ads`` gives them."""
    return measures_as_double(rescale(state.drop("batch", "period"), MEASURES, STORED_SCALE))


def incremental_ads(ads: DataFrame) -> DataFrame:
    """``deduplicated_ads`` from two batches of loads, of which the later one holds the earlier snapshots."""
    spark = ads.sparkSession
    path = work_folder(spark, "ad-snapshots")
    second_half = F.coalesce(F.substring("timestamp", 12, 2).between("12", "24"), F.lit(False))
    merge_ad_loads(ads.where(second_half), path, "second", "yyyy-MM")
    merge_ad_loads(ads.where(~second_half), path, "first", "yyyy-MM")
    return stored_ads(read_mart(spark, path))


def latest_by_source(ads: DataFrame) -> DataFrame:
    return latest_ads(ads, describe=["source"])


def sum_measures(ads: DataFrame, by: list[str | Column], prefix: str = "total_") -> DataFrame:
    """Sum stored whole numbers and cents exactly, then bring the sums to scale once."""
    names = [f"{prefix}{m}" for m in MEASURES]
    sums = ads.groupBy(*by).agg(
        *(F.sum(m).alias(name) for m, name in zip(MEASURES, names, strict=True))
    )
    return rescale(sums, names, STORED_SCALE)


def measures_as_double(df: DataFrame, prefix: str = "") -> DataFrame:
    return df.withColumns({f"{prefix}{m}": F.col(f"{prefix}{m}").cast("double") for m in MEASURES})


def deduplicated_ads(ads: DataFrame) -> DataFrame:
    return measures_as_double(rescale(latest_ads(ads), MEASURES, STORED_SCALE))


def ads_daily_metrics(ads: DataFrame) -> DataFrame:
    daily = sum_measures(latest_by_source(ads), ["source", "date"], "daily_")
    return measures_as_double(daily, "daily_")


def channel_totals(ads: DataFrame) -> DataFrame:
    """Exact totals per source, for further calculation."""
    return sum_measures(latest_by_source(ads), ["source"])


def ads_channel_totals(ads: DataFrame) -> DataFrame:
    return measures_as_double(channel_totals(ads), "total_")


def funnel_rates() -> dict[str, Column]:
    """Unrounded rates over columns of ``sum_measures``."""
    spend, impressions, clicks, installs, registrations = (F.col(f"total_{m}") for m in MEASURES)
    return {
        "cpm": ratio(spend, impressions, scale=1000),
        "ctr_pct": ratio(clicks, impressions, scale=100),
        "cr_click_install_pct": ratio(installs, clicks, scale=100),
        "cr_install_reg_pct": ratio(registrations, installs, scale=100),
        "cac": ratio(spend, registrations),
    }


def cac_report(
    totals: DataFrame, ltv: DataFrame | Mapping[str, float], round_ltv_first: bool = False
) -> DataFrame:
    """CAC and LTV/CAC per source.

    ``ltv`` is a table (channel, ltv) or a mapping of known values; a source without
    one keeps its row. ``round_ltv_first`` divides the LTV as shown, with two digits.
    """
    if isinstance(ltv, DataFrame):
        priced = totals.join(
            ltv.withColumnRenamed("channel", "source"), "source", "left"
        )
    else:
        known = F.create_map(*(F.lit(x) for x in chain.from_iterable(ltv.items())))
        priced = totals.withColumn("ltv", known[F.col("source")].cast("double"))
    rates = funnel_rates()
    shown = rounded(F.col("ltv"), 2)
    used = shown if round_ltv_first else F.col("ltv")
    return priced.select(
        F.col("source").alias("channel"),
        as_money(F.col("total_spend")).alias("total_spend"),
        *(rounded(rate, 2).alias(name) for name, rate in rates.items()),
        shown.alias("ltv_per_reg_user"),
        ratio(used, rates["cac"], digits=2).alias("ltv_cac"),
    )


def channel_ltv(components: DataFrame) -> DataFrame:
    return components.select("channel", LtvTerms().per_registered.alias("ltv"))


def cac_by_channel(product_events: DataFrame, orders: DataFrame, ads: DataFrame) -> DataFrame:
    ltv = channel_ltv(channel_components(product_events, orders))
    return cac_report(channel_totals(ads), ltv).orderBy(F.desc("ltv_cac"))


def monthly_report(monthly: DataFrame) -> DataFrame:
    """Monthly rates; the change compares unrounded CAC with the previous month present."""
    rates = funnel_rates()
    with_rates = monthly.withColumns(rates).withColumn(
        "previous_cac", previous_value("source", "month", "cac")
    )
    cac, previous = F.col("cac"), F.col("previous_cac")
    return with_rates.select(
        F.col("source").alias("channel"),
        "month",
        as_money(F.col("total_spend")).alias("total_spend"),
        as_money(F.col("total_registrations"), 0).alias("registrations"),
        rounded(cac, 2).alias("cac"),
        rounded(previous, 2).alias("previous_month_cac"),
        period_change(previous, cac, 2).alias("cac_mom_change_pct"),
        *(rounded(F.col(name), 2).alias(name) for name in rates if name != "cac"),
    )


def monthly_cac_by_channel(ads: DataFrame) -> DataFrame:
    month = F.date_format("date", "yyyy-MM").alias("month")
    return monthly_report(sum_measures(latest_by_source(ads), ["source", month])).orderBy(
        "channel", "month"
    )


def monthly_cac_calendar(ads: DataFrame) -> DataFrame:
    """Monthly CAC without holes: every calendar month of a source from its first to its last.

    ``change_pct`` compares with the month before only, and is NULL after a month without a CAC;
    ``change_since_last_pct`` compares with the last month that has one, ``months_since`` months ago, and
    ``gap`` marks a row whose month before has none although an earlier one does.
    """
    month = F.trunc("date", "month").alias("month")
    monthly = sum_measures(latest_by_source(ads).where("source IS NOT NULL AND date IS NOT NULL"), ["source", month])
    valued = monthly.withColumn("cac", funnel_rates()["cac"])
    valued = valued.withColumn("month_with_cac", F.when(F.col("cac").isNotNull(), F.col("month")))
    dense = dense_months(valued, "source", "month").withColumns(
        {
            "before": previous_value("source", "month", "cac"),
            "known": last_known("source", "month", "cac"),
            "known_month": last_known("source", "month", "month_with_cac"),
        }
    )
    since = F.months_between("month", "known_month").cast("bigint")
    return dense.select(
        F.col("source").alias("channel"),
        F.date_format("month", "yyyy-MM").alias("month"),
        as_money(F.col("total_spend")).alias("total_spend"),
        rounded(F.col("cac"), 2).alias("cac"),
        rounded(F.col("before"), 2).alias("previous_month_cac"),
        period_change(F.col("before"), F.col("cac"), 2).alias("change_pct"),
        rounded(F.col("known"), 2).alias("last_known_cac"),
        since.alias("months_since"),
        period_change(F.col("known"), F.col("cac"), 2).alias("change_since_last_pct"),
        F.coalesce(since > 1, F.lit(False)).alias("gap"),
    ).orderBy("channel", "month")


def cac_by_hierarchy(ads: DataFrame) -> DataFrame:
    """CAC per source, campaign, ad set and ad. The rollup runs over totals per ad, so it
    multiplies ads, not snapshots."""
    per_ad = latest_ads(ads).groupBy(*HIERARCHY).agg(*(F.sum(m).alias(m) for m in MEASURES))
    level = F.when(F.grouping("campaign_id") == 1, "source")
    level = level.when(F.grouping("adset_id") == 1, "campaign")
    level = level.when(F.grouping("ad_id") == 1, "adset").otherwise("ad")
    totals = (
        per_ad.rollup(*HIERARCHY)
        .agg(
            level.alias("level"),
            F.grouping("source").alias("all_sources"),
            *(F.sum(m).alias(f"total_{m}") for m in MEASURES),
        )
        .where("all_sources = 0")
    )
    rates = funnel_rates()
    return (
        rescale(totals, [f"total_{m}" for m in MEASURES], STORED_SCALE)
        .select(
            "level",
            F.col("source").alias("channel"),
            "campaign_id",
            "adset_id",
            "ad_id",
            as_money(F.col("total_spend")).alias("total_spend"),
            *(rounded(rate, 2).alias(name) for name, rate in rates.items()),
        )
        .orderBy("channel", "campaign_id", "adset_id", "ad_id")
    )

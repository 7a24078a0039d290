"""Reports from stored states: distinct users, amount quantiles, and the reach of the ad hierarchy.

A state is built once from the rows and stored by month, so a refresh builds those of new days only; every
report of any grouping then reads states.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from unitlens.functions import as_money, ratio
from unitlens.operators.distinct import distinct_counts, distinct_states, state_size, united
from unitlens.operators.quantiles import grouped_quantiles
from unitlens.operators.sketches import RANK_ERROR, as_whole, merged, sketched_quantiles, sketches
from unitlens.operators.snapshots import rescale
from unitlens.plans.acquisition import HIERARCHY, STORED_SCALE, latest_ads
from unitlens.plans.data_quality import MEASURES
from unitlens.sources.marts import publish, read_mart
from unitlens.sources.workspace import work_folder

PERIODS = ["day", "month", "year"]
QUANTILES = {"p25": 0.25, "p50": 0.5, "p75": 0.75}


def month_of(day: str) -> Column:
    return F.date_format(day, "yyyy-MM").alias("month")


def user_states(product_events: DataFrame) -> DataFrame:
    """Users and events per day and channel."""
    day = F.to_date("timestamp").alias("day")
    return distinct_states(product_events, "user_id", [day, "channel"], "events_count").select("*", month_of("day"))


def period_activity(states: DataFrame) -> DataFrame:
    """Active users and events by day, month and year, from states of days."""
    starts = F.explode(F.array(*[F.struct(F.lit(p).alias("period"), F.trunc("day", p).alias("start")) if p != "day" else F.struct(F.lit(p).alias("period"), F.col("day").alias("start")) for p in PERIODS]))
    by_period = united(states.withColumn("at", starts).select("*", "at.*"), ["period", "start"], "events_count")
    return distinct_counts(by_period, ["period", "start"], "active_users", "events_count")


def activity_by_period(product_events: DataFrame) -> DataFrame:
    """A user active on several days of a month counts once in it: the bits of the days are united."""
    spark = product_events.sparkSession
    path = work_folder(spark, "user-states")
    publish(user_states(product_events), path, "all", by="month")
    return period_activity(read_mart(spark, path)).orderBy("period", "start")


def paid_by_channel(product_events: DataFrame, orders: DataFrame) -> DataFrame:
    """Payments of registered users with their channel; a user of two channels counts in both."""
    users = product_events.where(F.col("event_type") == "registration").select("user_id", "channel").distinct()
    return orders.join(users, "user_id")


def amount_states(paid: DataFrame) -> DataFrame:
    """One sketch of the amounts per day, event and channel."""
    day = F.to_date("timestamp").alias("day")
    return sketches(paid, "amount", [day, "event", "channel"]).select("*", month_of("day"))


def amounts_from_states(states: DataFrame, scale: int) -> DataFrame:
    """Quantiles of the amounts by event and channel, from sketches of days: event, channel, n and the quantiles."""
    return sketched_quantiles(merged(states, ["event", "channel"], ["day"]), QUANTILES, scale)


def amount_quantiles(product_events: DataFrame, orders: DataFrame) -> DataFrame:
    """Quantiles of amounts by event and channel from stored sketches of days, held against the exact ones.

    ``lowest`` and ``highest`` are the exact amounts at RANK_ERROR of the payments below and above the rank; a
    sketch draws lots, so its amount is not the same in every run, but ``within_bound`` says that it lies there.
    """
    spark = orders.sparkSession
    paid = paid_by_channel(product_events, orders)
    path = work_folder(spark, "amount-states")
    publish(amount_states(paid), path, "all", by="month")
    found = amounts_from_states(read_mart(spark, path), as_whole(paid, "amount")[1])
    named = F.array(*[F.struct(F.lit(name).alias("quantile"), F.col(name).alias("sketched")) for name in QUANTILES])
    found = found.select("event", "channel", F.col("n").alias("payments"), F.inline(named))
    shifted = {"lowest": -RANK_ERROR, "exact": 0.0, "highest": RANK_ERROR}
    probs = {f"{name}_{at}": round(p + by, 6) for name, p in QUANTILES.items() for at, by in shifted.items()}
    freq = paid.where(F.col("amount").isNotNull()).groupBy("event", "channel", "amount").agg(F.count("*").alias("n"))
    exact = grouped_quantiles(freq, ["event", "channel"], "amount", probs)
    rows = F.array(*[F.struct(F.lit(name).alias("quantile"), *[F.col(f"{name}_{at}").alias(at) for at in shifted]) for name in QUANTILES])
    both = exact.select("event", "channel", F.inline(rows)).join(found, ["event", "channel", "quantile"])
    return both.select(
        "event",
        "channel",
        "quantile",
        "payments",
        *[as_money(F.col(at)).alias(f"{at}_amount") for at in shifted],
        F.col("sketched").between(F.col("lowest"), F.col("highest")).alias("within_bound"),
    ).orderBy("event", "channel", "quantile")


def ad_states(ads: DataFrame) -> DataFrame:
    """Per ad: bits of the days on which it ran, bits of its own id, and the measures, as rows of three kinds."""
    last = latest_ads(ads).withColumn("day_number", F.datediff("date", F.lit("1970-01-01").cast("date")))
    per_day = last.groupBy(*HIERARCHY, "day_number").agg(*(F.sum(m).alias(m) for m in MEASURES))
    days = distinct_states(per_day, "day_number", [*HIERARCHY, F.lit("days").alias("kind")])
    ids = distinct_states(per_day, "ad_id", [*HIERARCHY, F.lit("ads").alias("kind")])
    sums = per_day.groupBy(*HIERARCHY, F.lit("sums").alias("kind")).agg(*(F.sum(m).alias(m) for m in MEASURES))
    return days.unionByName(ids).unionByName(sums, allowMissingColumns=True)


def hierarchy_activity(ads: DataFrame) -> DataFrame:
    """Active ads, days with ads and CAC per source, campaign, ad set and ad.

    States of ads and their measures go up the hierarchy in one rollup; neither the ads nor the days are
    expanded once more per level and count. An ad or a day that several branches share counts once above them.
    """
    spark = ads.sparkSession
    path = work_folder(spark, "ad-states")
    publish(ad_states(ads), path, "all", by="kind")
    states = read_mart(spark, path)
    columns = [F.col(c) for c in (*HIERARCHY, "kind", "id_bucket")]
    sets = [[*columns[len(HIERARCHY) :], *columns[:depth]] for depth in range(1, len(HIERARCHY) + 1)]
    level = F.when(F.grouping("campaign_id") == 1, "source").when(F.grouping("adset_id") == 1, "campaign")
    level = level.when(F.grouping("ad_id") == 1, "adset").otherwise("ad")
    rolled = states.groupingSets(sets, *columns).agg(
        level.alias("level"), F.bitmap_or_agg("id_bits").alias("id_bits"), *(F.sum(m).alias(f"total_{m}") for m in MEASURES)
    )
    totals = rolled.groupBy("level", *HIERARCHY).agg(
        *(F.sum(F.when(F.col("kind") == k, state_size()).otherwise(0)).alias(f"active_{k}") for k in ("ads", "days")),
        *(F.sum(f"total_{m}").alias(f"total_{m}") for m in ("spend", "registrations")),
    )
    return rescale(totals, ["total_spend", "total_registrations"], STORED_SCALE).select(
        "level",
        F.col("source").alias("channel"),
        "campaign_id",
        "adset_id",
        "ad_id",
        "active_ads",
        "active_days",
        as_money(F.col("total_spend")).alias("total_spend"),
        ratio(F.col("total_spend"), F.col("total_registrations"), digits=2).alias("cac"),
    ).orderBy("channel", "campaign_id", "adset_id", "ad_id")

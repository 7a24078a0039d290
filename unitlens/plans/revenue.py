"""Six-month revenue and decomposed LTV by channel, per registered user."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from unitlens.functions import as_money, ratio, rounded
from unitlens.operators.cohorts import (
    binned_window_join,
    cohort_window_join,
    first_event_cohort,
    full_months,
    months_later,
    sum_by_kind,
)
from unitlens.operators.comparison import share_of_total
from unitlens.operators.skew import Skew
from unitlens.operators.survival import converted, mean_cumulative

PAYMENT_KINDS = ["purchase", "rebill", "upsell"]
WINDOW_MONTHS = 6


def registrations(product_events: DataFrame) -> DataFrame:
    """First registration per user and channel; a user of two channels counts in both."""
    return first_event_cohort(
        product_events,
        "user_id",
        ["channel"],
        F.col("event_type") == "registration",
        "timestamp",
        "registration_ts",
    )


def registration_period(product_events: DataFrame) -> tuple[datetime, datetime] | None:
    """First and last registration on record, read here; no user's first registration lies outside."""
    registered = product_events.where(F.col("event_type") == "registration")
    first, last = registered.agg(F.min("timestamp"), F.max("timestamp")).first()
    return None if first is None else (first, last)


def user_monetization(
    cohort: DataFrame,
    orders: DataFrame,
    months: int = WINDOW_MONTHS,
    skew: Skew = Skew(),
    period: tuple[datetime, datetime] | None = None,
) -> DataFrame:
    """Payments of every registered user in the window; users without any have zeros."""
    paid = cohort_window_join(
        cohort, orders, "user_id", "registration_ts", "timestamp", months, skew, period
    )
    return sum_by_kind(cohort, paid, "event", "amount", PAYMENT_KINDS)


def sum_users(per_user: DataFrame, *by: str) -> DataFrame:
    """Totals over users. The input has one row per user and channel, so users of a
    channel are counted as rows, without a distinct."""
    aggs = [
        F.count("user_id").alias("registered_users"),
        F.count(F.when(F.col("purchase_count") > 0, F.col("user_id"))).alias("buyers"),
        F.count(F.when(F.col("total_revenue") > 0, F.col("user_id"))).alias("paying_users"),
    ]
    for kind in PAYMENT_KINDS:
        aggs += [
            F.count(F.when(F.col(f"{kind}_count") > 0, F.col("user_id"))).alias(f"{kind}_users"),
            F.sum(f"{kind}_count").alias(f"{kind}_events"),
            F.sum(f"{kind}_revenue").alias(f"{kind}_revenue"),
        ]
    return per_user.groupBy(*by).agg(*aggs, F.sum("total_revenue").alias("total_revenue"))


def channel_components(
    product_events: DataFrame,
    orders: DataFrame,
    months: int = WINDOW_MONTHS,
    skew: Skew = Skew(),
) -> DataFrame:
    cohort = registrations(product_events)
    per_user = user_monetization(cohort, orders, months, skew, registration_period(product_events))
    return sum_users(per_user, "channel")


class LtvTerms:
    """Unrounded parts of the LTV formula over columns of ``sum_users``.

    A channel without an event of some kind has no average value for it, and the sum
    is NULL then. ``missing_as_zero`` lets such a term count as 0 instead.
    """

    def __init__(self, missing_as_zero: bool = False):
        registered, buyers = F.col("registered_users"), F.col("buyers")

        def aov(kind: str) -> Column:
            return ratio(F.col(f"{kind}_revenue"), F.col(f"{kind}_events"))

        self.conversion = ratio(buyers, registered)
        self.aov = {kind: aov(kind) for kind in PAYMENT_KINDS}
        self.rebills_per_buyer = ratio(F.col("rebill_events"), buyers)
        self.upsell_conversion = ratio(F.col("upsell_users"), buyers)
        terms = [
            self.aov["purchase"],
            self.aov["rebill"] * self.rebills_per_buyer,
            self.aov["upsell"] * self.upsell_conversion,
        ]
        if missing_as_zero:
            terms = [F.coalesce(term, F.lit(0.0)) for term in terms]
        self.per_payer = terms[0] + terms[1] + terms[2]
        self.per_registered = self.conversion * self.per_payer


def ltv_report(components: DataFrame, missing_as_zero: bool = False) -> DataFrame:
    t = LtvTerms(missing_as_zero)
    return components.select(
        "channel",
        "registered_users",
        "buyers",
        as_money(F.col("total_revenue")).alias("total_revenue_6m"),
        share_of_total(F.col("total_revenue"), 4).alias("revenue_share"),
        rounded(t.conversion, 4).alias("cr_registration_to_purchase"),
        rounded(t.aov["purchase"], 2).alias("aov_first_purchase"),
        rounded(t.per_payer, 2).alias("ltv_6m_per_payer"),
        rounded(t.conversion * t.aov["purchase"], 2).alias("ltv_component_first_purchase"),
        "rebill_users",
        rounded(t.rebills_per_buyer, 4).alias("freq_rebills_per_payer_6m"),
        rounded(t.aov["rebill"], 2).alias("aov_rebill"),
        rounded(t.conversion * t.aov["rebill"] * t.rebills_per_buyer, 2).alias(
            "ltv_component_rebill"
        ),
        "upsell_users",
        rounded(t.upsell_conversion, 4).alias("cr_sub_to_upsell"),
        rounded(t.aov["upsell"], 2).alias("aov_upsell"),
        rounded(t.conversion * t.aov["upsell"] * t.upsell_conversion, 2).alias(
            "ltv_component_upsell"
        ),
        rounded(t.per_registered, 2).alias("ltv_6m_per_registered_user"),
    )


def ltv_by_channel(product_events: DataFrame, orders: DataFrame) -> DataFrame:
    return ltv_report(channel_components(product_events, orders)).orderBy(
        F.desc("ltv_6m_per_registered_user")
    )


def revenue_report(components: DataFrame) -> DataFrame:
    """ARPU and ARPPU. Payers have revenue above 0; buyers have a purchase."""
    revenue = F.col("total_revenue")
    return components.select(
        "channel",
        "registered_users",
        "paying_users",
        as_money(revenue).alias("total_revenue_6m"),
        *(as_money(F.col(f"{k}_revenue")).alias(f"{k}_revenue_6m") for k in PAYMENT_KINDS),
        ratio(revenue, F.col("paying_users"), digits=2).alias("arppu_6m_per_payer"),
        ratio(revenue, F.col("registered_users"), digits=2).alias("arpu_6m_per_registered_user"),
        share_of_total(F.col("total_revenue"), 4).alias("revenue_share"),
    )


def revenue_scale_by_channel(product_events: DataFrame, orders: DataFrame) -> DataFrame:
    return revenue_report(channel_components(product_events, orders)).orderBy(
        F.desc("total_revenue_6m")
    )


def matured_cohort_ltv(product_events: DataFrame, orders: DataFrame) -> DataFrame:
    """LTV of matured and not yet matured registrations: a registration is matured when
    its whole window lies before the last payment on record."""
    cohort = registrations(product_events)
    last_payment = orders.agg(F.max("timestamp")).scalar()
    full_window = months_later("registration_ts", WINDOW_MONTHS) <= last_payment
    period = registration_period(product_events)
    per_user = user_monetization(cohort, orders, period=period).withColumn(
        "matured", F.coalesce(full_window, F.lit(False))
    )
    t = LtvTerms()
    return (
        sum_users(per_user, "channel", "matured")
        .select(
            "channel",
            "matured",
            "registered_users",
            "buyers",
            as_money(F.col("total_revenue")).alias("total_revenue_6m"),
            rounded(t.per_registered, 2).alias("ltv_6m_per_registered_user"),
        )
        .orderBy("channel", F.desc("matured"))
    )


def observed_users(cohort: DataFrame, orders: DataFrame, until: Column, months: int = WINDOW_MONTHS) -> DataFrame:
    """Per channel, observed months and months of the first purchase and upsell: users and what they paid.

    Only whole months of age that end at ``until`` or before are observed; payments of later ones are left out.
    """
    seen = cohort.withColumn("observed", full_months("registration_ts", until, months))
    # An order is in month k of age if k whole months lie between; clamped month ends are months_later's.
    age = full_months("registration_ts", F.col("timestamp"), months)
    paid = binned_window_join(seen, orders, "user_id", "registration_ts", "timestamp", months)
    paid = paid.withColumn("age", age).where("age < observed")
    blank = seen.select("*", F.lit(None).cast("int").alias("age"), F.lit(None).cast("string").alias("event"), F.lit(None).cast("decimal(12,2)").alias("amount"))
    rows = paid.select(*blank.columns).unionByName(blank)
    amount = F.coalesce("amount", F.lit(0).cast("decimal(12,2)"))
    is_kind = {kind: F.coalesce(F.col("event") == kind, F.lit(False)) for kind in PAYMENT_KINDS}
    per_user = rows.groupBy("user_id", "channel", "observed").agg(
        *(F.min(F.when(is_kind[kind], F.col("age"))).alias(f"first_{kind}") for kind in ("purchase", "upsell")),
        *(F.sum(F.when(is_kind[kind], amount).otherwise(0)).alias(f"{kind}_revenue") for kind in PAYMENT_KINDS),
        *(F.count_if(is_kind[kind]).alias(f"{kind}_events") for kind in PAYMENT_KINDS),
        *(F.sum(F.when((F.col("age") == k) & is_kind["rebill"], amount).otherwise(0)).alias(f"rebill_{k}") for k in range(months)),
        *(F.sum(F.when(F.col("age") == k, amount).otherwise(0)).alias(f"revenue_{k}") for k in range(months)),
    )
    groups = ["channel", "observed", "first_purchase", "first_upsell"]
    sums = [c for c in per_user.columns if c not in (*groups, "user_id")]
    return per_user.groupBy(*groups).agg(F.count("user_id").alias("users"), *(F.sum(c).alias(c) for c in sums))


def censored_cohort_ltv(product_events: DataFrame, orders: DataFrame) -> DataFrame:
    """Conversion, revenue per user and LTV over six months that use every user for as long as they were observed.

    Users whose window isn't over yet would lower the plain figures, and leaving them out loses what is known
    of them. Conversion is the product-limit estimate over months of age, revenue per user adds up each month's
    revenue per user observed in it. Once all users are observed to the end both are the plain figures. If
    nobody was observed in some month, the sums that need it are NULL.
    """
    until = orders.agg(F.max("timestamp")).scalar()
    users = observed_users(registrations(product_events), orders, until)
    months = range(WINDOW_MONTHS)
    n, observed = F.col("users"), F.col("observed")
    at_risk = [F.sum(F.when(observed > k, n).otherwise(0)) for k in months]

    def aov(kind: str) -> Column:
        return ratio(F.sum(f"{kind}_revenue"), F.sum(f"{kind}_events"))

    buyers, upsold = (converted(f"first_{kind}", "observed", "users", WINDOW_MONTHS) for kind in ("purchase", "upsell"))
    rebills = mean_cumulative([F.sum(f"rebill_{k}") for k in months], at_risk)
    return (
        users.groupBy("channel")
        .agg(
            F.sum(n).alias("registered_users"),
            F.sum(F.when(observed >= WINDOW_MONTHS, n).otherwise(0)).alias("matured_users"),
            F.sum(n * observed).alias("observed_months"),
            rounded(buyers, 4).alias("conversion"),
            rounded(mean_cumulative([F.sum(f"revenue_{k}") for k in months], at_risk), 2).alias("revenue_per_user"),
            rounded(buyers * aov("purchase") + rebills + upsold * aov("upsell"), 2).alias("ltv_6m_per_registered_user"),
        )
        .orderBy("channel")
    )

"""Cohorts that are observed for less than their window, joins by time bins, and months without holes."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from conftest import rows
from dateutil.relativedelta import relativedelta
from fixtures import M1_EVENTS, M1_ORDERS, ads_df, events_df, orders_df
from pyspark.sql import functions as F

from unitlens.operators.cohorts import binned_window_join, cohort_window_join
from unitlens.plans import acquisition, revenue
from unitlens.sources import Tables

FOLDER = "/root/testdata/sf0.001"


def estimates(events, orders):
    """conversion, revenue per user, LTV per channel; plain Python, user by user."""
    until = max(datetime.fromisoformat(t) for _, _, t, _ in orders)
    start = {}
    for u, e, t, c in events:
        if e == "registration":
            start[u, c] = min(datetime.fromisoformat(t), start.get((u, c), datetime.max))
    out = {}
    for channel in {c for _, c in start}:
        users = []
        for (u, c), t0 in start.items():
            if c != channel:
                continue
            ends = [t0 + relativedelta(months=k) for k in range(1, 7)]
            observed = sum(e <= until for e in ends)
            paid = []
            for o, kind, t, amount in orders:
                t = datetime.fromisoformat(t)
                if o == u and t0 <= t < ends[-1]:
                    age = sum(e <= t for e in ends)
                    if age < observed:
                        paid.append((kind, age, amount))
            users.append((observed, paid))
        risk = [sum(o > k for o, _ in users) for k in range(6)]
        if not all(risk):
            out[channel] = (None, None, None)
            continue

        def part(kind):
            stay = 1.0
            for k in range(6):
                firsts = [min((a for x, a, _ in paid if x == kind), default=99) for o, paid in users if o > k]
                left = sum(f >= k for f in firsts)
                stay *= 1 - firsts.count(k) / left if left else 1
            return 1 - stay

        def per_user(kinds):
            return sum(sum(m for _, paid in users for x, a, m in paid if a == k and x in kinds) / risk[k] for k in range(6))

        def aov(kind):
            amounts = [m for _, paid in users for x, _, m in paid if x == kind]
            return sum(amounts) / len(amounts) if amounts else None

        terms = [part("purchase"), aov("purchase"), part("upsell"), aov("upsell")]
        ltv = None if None in terms else terms[0] * terms[1] + per_user({"rebill"}) + terms[2] * terms[3]
        out[channel] = (part("purchase"), per_user({"purchase", "rebill", "upsell"}), ltv)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_censored_figures_against_plain_python(spark, seed):
    rng = random.Random(seed)
    first = datetime(2024, 1, 29)
    events, orders = [], []
    for u in range(60):
        t = first + timedelta(hours=rng.randrange(24 * 300))
        events.append((u, "registration", str(t), rng.choice(["meta", "google"])))
        for _ in range(rng.randrange(5)):
            paid = t + timedelta(hours=rng.randrange(24 * 200))
            if paid < first + timedelta(days=330):
                orders.append((u, rng.choice(["purchase", "rebill", "upsell"]), str(paid), rng.randrange(1, 50)))
    found = revenue.censored_cohort_ltv(events_df(spark, events), orders_df(spark, orders))
    got = {r.channel: (r.conversion, r.revenue_per_user, r.ltv_6m_per_registered_user) for r in found.collect()}
    want = estimates(events, orders)
    assert got.keys() == want.keys()
    for channel, values in want.items():
        assert got[channel] == pytest.approx(values, abs=0.0051) if values[0] is not None else got[channel] == values


def test_equals_the_plain_figures_when_all_are_matured(spark):
    tables = Tables(spark, FOLDER)
    last = tables.orders.agg(F.max("timestamp")).first()[0]
    early = tables.product_events.where(F.col("timestamp") < F.lit(last - timedelta(days=200)))
    censored = {r.channel: r for r in revenue.censored_cohort_ltv(early, tables.orders).collect()}
    plain = {r.channel: r for r in revenue.ltv_by_channel(early, tables.orders).collect()}
    scale = {r.channel: r for r in revenue.revenue_scale_by_channel(early, tables.orders).collect()}
    assert censored.keys() == plain.keys()
    for channel, r in censored.items():
        assert r.matured_users == r.registered_users == plain[channel].registered_users
        assert r.conversion == plain[channel].cr_registration_to_purchase
        assert r.revenue_per_user == scale[channel].arpu_6m_per_registered_user
        assert r.ltv_6m_per_registered_user == plain[channel].ltv_6m_per_registered_user


def test_unobserved_months_are_unknown(spark):
    found = revenue.censored_cohort_ltv(events_df(spark, M1_EVENTS), orders_df(spark, M1_ORDERS))
    by_channel = {r.channel: tuple(r)[1:] for r in found.collect()}
    # The last payment is on 2025-02-28 10:00: user 3's window ends at that very moment.
    assert by_channel["tiktok"][:3] == (1, 1, 6)
    late = [*M1_EVENTS, (9, "registration", "2025-02-20 00:00:00", "late")]
    found = revenue.censored_cohort_ltv(events_df(spark, late), orders_df(spark, M1_ORDERS))
    assert {r.channel: tuple(r)[1:] for r in found.collect()}["late"] == (1, 0, 0, None, None, None)


@pytest.mark.parametrize("days", [1, 31, 400])
def test_binned_join_finds_the_same_rows(spark, days):
    rng = random.Random(days)
    start = datetime(2023, 12, 31, 23, 59, 59)
    stamp = lambda: str(start + timedelta(seconds=rng.randrange(400 * 86400)))
    events = [(rng.choice([0, rng.randrange(40)]), "registration", stamp(), rng.choice("ab")) for _ in range(60)]
    orders = [(0 if k % 3 == 0 else rng.randrange(50), "purchase", stamp(), 1 + k) for k in range(600)]
    cohort = revenue.registrations(events_df(spark, events))
    paid = orders_df(spark, orders + [(7, "purchase", "1969-12-31 10:00:00", 3)])
    args = ("user_id", "registration_ts", "timestamp", 6)
    plain = cohort_window_join(cohort, paid, *args)
    binned = binned_window_join(cohort, paid, *args, days=days)
    assert sorted(rows(binned.select(plain.columns))) == sorted(rows(plain)) != []


def test_a_hot_user_is_dealt_to_many_tasks(spark, conf):
    """A third of the payments are one user's; with bins no task of the join gets more than a small part of them."""
    n = 60_000
    orders = spark.range(n, numPartitions=8).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 997).cast("long").alias("user_id"),
        F.lit("purchase").alias("event"),
        (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(mins=(F.col("id") * 4).cast("int"))).alias("timestamp"),
        F.lit(1).cast("decimal(12,2)").alias("amount"),
    )
    users = spark.range(997).select(
        F.col("id").alias("user_id"), F.lit("2024-01-01").cast("timestamp_ntz").alias("registration_ts"), F.lit("meta").alias("channel")
    )
    with conf(
        spark__sql__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__enabled="false",
        spark__sql__shuffle__partitions="16",
    ):
        def largest(joined):
            return joined.groupBy(F.spark_partition_id()).count().agg(F.max("count"), F.sum("count")).first()

        args = ("user_id", "registration_ts", "timestamp", 6)
        most, total = largest(binned_window_join(users, orders, *args, days=2))
        assert most < 0.15 * total
        whole = users.withColumnRenamed("user_id", "k")
        plain = orders.join(whole, (F.col("user_id") == F.col("k")) & (F.col("timestamp") < F.lit("2024-07-01").cast("timestamp_ntz")))
        assert largest(plain)[0] > 0.33 * total == 0.33 * largest(plain)[1]


def test_months_without_holes(spark):
    """M3 in both forms: against the month before, and against the last month with a value."""
    ads = ads_df(
        spark,
        [
            ("meta", 1, "2024-01-05", "2024-01-05 08:00:00", 1000, 1, 1, 1, 100),
            ("meta", 1, "2024-03-05", "2024-03-05 08:00:00", 1500, 1, 1, 1, 100),
            ("meta", 1, "2024-04-05", "2024-04-05 08:00:00", 1500, 1, 1, 1, 0),
            ("meta", 1, "2024-05-05", "2024-05-05 08:00:00", 3000, 1, 1, 1, 100),
            ("google", 2, "2024-02-05", "2024-02-05 08:00:00", 1500, 1, 1, 1, 0),
        ],
    )
    report = acquisition.monthly_cac_calendar(ads)
    picked = report.select("channel", "month", "cac", "previous_month_cac", "change_pct", "last_known_cac", "months_since", "change_since_last_pct", "gap")
    assert rows(picked) == [
        ("google", "2024-02", None, None, None, None, None, None, False),
        ("meta", "2024-01", 10.0, None, None, None, None, None, False),
        ("meta", "2024-02", None, 10.0, None, 10.0, 1, None, False),
        ("meta", "2024-03", 15.0, None, None, 10.0, 2, 50.0, True),
        ("meta", "2024-04", None, 15.0, None, 15.0, 1, None, False),
        ("meta", "2024-05", 30.0, None, None, 15.0, 2, 100.0, True),
    ]

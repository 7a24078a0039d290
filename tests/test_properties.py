"""Random tables with NULLs, repeats and ties against plain Python."""

from __future__ import annotations

import calendar
from collections import defaultdict
from datetime import datetime, timedelta
from decimal import Decimal

from conftest import rows
from fixtures import ads_df, events_df, orders_df
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from unitlens.operators.skew import Skew
from unitlens.plans import acquisition, data_quality, revenue

FEW = settings(
    max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)

START = datetime(2023, 8, 29)
user = st.one_of(st.none(), st.integers(0, 4))
moment = st.integers(0, 400 * 24).map(lambda h: str(START + timedelta(hours=h)))
events = st.lists(
    st.tuples(
        user,
        st.sampled_from(["install", "registration", "registration", "like"]),
        moment,
        st.sampled_from(["meta", "google", None]),
    ),
    max_size=25,
)
payments = st.lists(
    st.tuples(
        user,
        st.sampled_from([*revenue.PAYMENT_KINDS, "refund", None]),
        moment,
        st.sampled_from([None, "24.99", "49.99", "0.00", "-5.00"]),
    ),
    max_size=40,
)


def six_months_after(t: datetime) -> datetime:
    month = t.month + 6
    year, month = t.year + (month - 1) // 12, (month - 1) % 12 + 1
    return t.replace(year, month, min(t.day, calendar.monthrange(year, month)[1]))


def expected_components(events, payments):
    first = {}
    for u, event, t, channel in events:
        t = datetime.fromisoformat(t)
        if event == "registration":
            first[u, channel] = min(t, first.get((u, channel), t))
    out = {}
    for (u, channel), joined in first.items():
        found = [
            (event, None if a is None else Decimal(a))
            for who, event, t, a in payments
            if u is not None
            and who == u
            and joined <= datetime.fromisoformat(t) < six_months_after(joined)
        ]
        c = out.setdefault(channel, defaultdict(list))
        c["registered"].append(u is not None)
        bought = any(event == "purchase" for event, _ in found)
        total = sum((a for _, a in found if a is not None), Decimal("0.00"))
        c["buyers"].append(bought)
        c["payers"].append(total > 0)
        c["total"].append(total)
    return {
        channel: (sum(c["registered"]), sum(c["buyers"]), sum(c["payers"]), sum(c["total"]))
        for channel, c in out.items()
    }


@FEW
@given(events, payments)
def test_components_equal_plain_python(spark, events, payments):
    product_events, orders = events_df(spark, events), orders_df(spark, payments).repartition(3)
    expected = expected_components(events, payments)
    for skew in (Skew(), Skew(rows_per_task=2, fraction=1.0)):
        found = {
            r.channel: (r.registered_users, r.buyers, r.paying_users, r.total_revenue)
            for r in revenue.channel_components(product_events, orders, skew=skew).collect()
        }
        assert found == expected


snapshots = st.lists(
    st.tuples(
        st.sampled_from(["meta", "google"]),
        st.integers(1, 2),
        st.sampled_from(["2024-01-02", "2024-01-03"]),
        st.sampled_from([None, "bad", "2024-01-02 08:00:00", "2024-01-02 20:00:00"]),
        st.integers(0, 2),
        *[st.integers(0, 1)] * 4,
    ),
    max_size=30,
)


@FEW
@given(snapshots)
def test_last_snapshot_equals_plain_python(spark, snapshots):
    best = {}
    for row in snapshots:
        source, ad, day, loaded, *measures = row
        time = "" if loaded in (None, "bad") else loaded
        rank = (time, *measures, source == "google")  # google comes before meta
        if (ad, day) not in best or rank > best[ad, day][0]:
            best[ad, day] = (rank, (ad, source, *measures))
    kept = acquisition.latest_ads(ads_df(spark, snapshots).repartition(3))
    found = rows(kept.selectExpr("ad_id", "source", "int(spend)", *acquisition.MEASURES[1:]))
    assert sorted(found) == sorted(row for _, row in best.values())


@FEW
@given(events, payments)
def test_quality_counts_equal_plain_python(spark, events, payments):
    product_events, orders = events_df(spark, events), orders_df(spark, payments)
    payers, known = {p[0] for p in payments}, {e[0] for e in events if e[0] is not None}
    assert rows(data_quality.dq_paying_users(product_events, orders)) == [
        (len(payers), len(payers - known))
    ]
    found = rows(data_quality.dq_duplicates(product_events, orders))
    for table, (_, unique, total, _, surplus) in zip((events, payments), found, strict=True):
        assert (unique, total or 0, surplus or 0) == (
            len(set(table)),
            len(table),
            len(table) - len(set(table)),
        )

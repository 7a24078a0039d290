"""Small inline tables with hand-computed answers (FIXTURES.md, section 4)."""

from __future__ import annotations

from datetime import date, datetime
from decimal import Decimal

from unitlens.sources import MARKETING_ADS_RAW, ORDERS, PRODUCT_EVENTS, normalise_ads


def ts(text: str) -> datetime:
    return datetime.fromisoformat(text)


def money(x) -> Decimal | None:
    return None if x is None else Decimal(str(x))


def events_df(spark, rows):
    """Rows of (user, event, time, channel)."""
    return spark.createDataFrame(
        [(u, e, None if t is None else ts(t), c) for u, e, t, c in rows], PRODUCT_EVENTS
    )


def orders_df(spark, rows):
    """Rows of (user, event, time, amount)."""
    return spark.createDataFrame([(u, e, ts(t), money(a)) for u, e, t, a in rows], ORDERS)


def ads_df(spark, rows):
    """Rows of (source, ad, date, load time, spend, impressions, clicks, installs, regs)."""
    return normalise_ads(
        spark.createDataFrame(
            [
                (s, 1, 1, ad, date.fromisoformat(d), money(spend), i, c, n, r, loaded)
                for s, ad, d, loaded, spend, i, c, n, r in rows
            ],
            MARKETING_ADS_RAW,
        )
    )


M1_EVENTS = [
    (1, "registration", "2024-01-31 10:00:00", "meta"),
    (2, "registration", "2024-02-01 00:00:00", "meta"),
    (3, "registration", "2024-08-31 10:00:00", "tiktok"),
    (4, "registration", "2024-03-01 00:00:00", "google"),
]
M1_ORDERS = [
    (1, "purchase", "2024-01-31 10:00:00", 24.99),
    (1, "rebill", "2024-07-31 09:59:59", 49.99),
    (1, "rebill", "2024-07-31 10:00:00", 49.99),
    (2, "purchase", "2024-01-31 23:59:59", 24.99),
    (3, "purchase", "2025-02-28 09:59:59", 24.99),
    (3, "upsell", "2025-02-28 10:00:00", 20.00),
    (5, "purchase", "2024-02-02 00:00:00", 24.99),
]
M2_ADS = [
    ("meta", 1, "2024-01-02", "2024-01-02 08:00:00", 100, 1000, 100, 10, 5),
    ("meta", 1, "2024-01-02", "2024-01-02 20:00:00", 300, 3000, 300, 30, 15),
    ("meta", 1, "2024-01-02", "bad", 900, 9000, 900, 90, 45),
    ("META", 1, "2024-01-03", "2024-01-03 09:00:00", 50, 500, 50, 5, 5),
    ("TikTok ", 2, "2024-01-02", "2024-01-02 09:00:00", 40, 400, 0, 0, 0),
]

"""The three logical tables, derived row by row from the TPC-H-like test tables.

Every derivation is a narrow projection of one scan: no shuffle and no window, so
a hot customer, part or day costs the derivation nothing. The mapping is written
down in FIXTURES.md.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from unitlens.sources.schemas import MARKETING_ADS_RAW, ORDERS, PRODUCT_EVENTS

# Milestone, hours after install, divisor of c_custkey, whether a
# user has the milestone when the remainder is zero.
MILESTONE_RULES = [
    ("install", 0, 1, True),
    ("registration", 1, 14, False),
    ("like", 2, 2, True),
    ("match", 3, 4, True),
    ("message_sent", 4, 16, True),
    ("paywall_view", 5, 16, True),
]

MINUTES_PER_DAY = 1440

# The columns used, declared so that no file is opened to find the schema.
SCHEMAS = {
    "customer": "c_custkey bigint, c_mktsegment string",
    "orders": (
        "o_custkey bigint, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"
    ),
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int,"
        " l_quantity double, l_extendedprice double, l_shipdate timestamp_ntz"
    ),
}


@dataclass(frozen=True)
class Tables:
    """Lazy access to ``product_events``, ``orders`` and ``ads`` under one folder."""

    spark: SparkSession
    folder: str

    def _scan(self, name: str) -> DataFrame:
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def product_events(self) -> DataFrame:
        key = F.col("c_custkey")
        installed = F.lit("1995-01-01 09:30:00").cast("timestamp_ntz") + F.make_dt_interval(
            (key % 2190).cast("int")
        )
        milestones = [
            F.struct(
                F.lit(event).alias("event_type"),
                (installed + F.make_dt_interval(hours=F.lit(hours))).alias("timestamp"),
                ((key % divisor == 0) == F.lit(on_zero)).alias("reached"),
            )
            for event, hours, divisor, on_zero in MILESTONE_RULES
        ]
        channel = (
            F.when(F.col("c_mktsegment") == "AUTOMOBILE", "tiktok")
            .when(F.col("c_mktsegment") == "FURNITURE", "google")
            .otherwise("meta")
        )
        return (
            self._scan("customer")
            .select(key.alias("user_id"), channel.alias("channel"), F.inline(F.array(*milestones)))
            .where("reached")
            .select("user_id", "event_type", "timestamp", "channel")
            .to(PRODUCT_EVENTS)
        )

    @cached_property
    def orders(self) -> DataFrame:
        priority = F.col("o_orderpriority")
        event = (
            F.when(priority.isin("1-URGENT", "2-HIGH"), "purchase")
            .when(priority == "5-LOW", "upsell")
            .otherwise("rebill")
        )
        return (
            self._scan("orders")
            .select(
                F.col("o_custkey").alias("user_id"),
                event.alias("event"),
                F.col("o_orderdate").alias("timestamp"),
                F.col("o_totalprice").cast("decimal(12,2)").alias("amount"),
            )
            .to(ORDERS)
        )

    @cached_property
    def ads(self) -> DataFrame:
        # Each measure is a fixed amount per elapsed minute plus a remainder smaller
        # than one minute's amount, so it grows with the load time within a day.
        line = F.col("l_linenumber").cast("bigint")
        minute = (F.col("l_orderkey") * 7 + line * 131 + F.col("l_suppkey")) % MINUTES_PER_DAY
        elapsed = F.col("minute") + 1
        campaign = F.col("campaign_id")
        cents = elapsed * (campaign * 500 + 4000) + F.round(
            F.col("l_extendedprice") * 100
        ).cast("bigint") % 4000

        def two_digits(value):
            return F.lpad(value.cast("string"), 2, "0")

        loaded_at = F.concat(
            F.col("date").cast("string"),
            F.lit(" "),
            two_digits(F.expr("minute div 60")),
            F.lit(":"),
            two_digits(F.col("minute") % 60),
            F.lit(":00"),
        )
        return (
            self._scan("lineitem")
            .withColumns(
                {
                    "ad_id": F.col("l_partkey") % 10,
                    "date": F.col("l_shipdate").cast("date"),
                    "minute": minute,
                }
            )
            .withColumn("campaign_id", F.expr("ad_id * 6 div 10"))
            .select(
                F.when(campaign <= 1, "meta")
                .when(campaign <= 3, "tiktok")
                .otherwise("google")
                .alias("source"),
                "campaign_id",
                F.col("ad_id").alias("adset_id"),
                "ad_id",
                "date",
                (cents.cast("decimal(16,0)") * F.lit(Decimal("0.01")))
                .cast("decimal(18,2)")
                .alias("spend"),
                (elapsed * 1000 + F.col("l_quantity").cast("bigint") * 10).alias("impressions"),
                (elapsed * (campaign + 20) + F.col("l_suppkey") % 10).alias("clicks"),
                (elapsed * 8 + line % 4).alias("installs"),
                (elapsed * 6 + line % 3).alias("registrations"),
                loaded_at.alias("timestamp"),
            )
            .to(MARKETING_ADS_RAW)
        )

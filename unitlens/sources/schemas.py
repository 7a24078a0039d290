"""Explicit schemas of the three logical tables; nothing is inferred."""

from pyspark.sql.types import (
    DateType,
    DecimalType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
)

# One row = one user reaching one milestone.
PRODUCT_EVENTS = StructType(
    [
        StructField("user_id", LongType()),
        StructField("event_type", StringType()),
        StructField("timestamp", TimestampNTZType()),
        StructField("channel", StringType()),
    ]
)

# One row = one payment.
ORDERS = StructType(
    [
        StructField("user_id", LongType()),
        StructField("event", StringType()),
        StructField("timestamp", TimestampNTZType()),
        StructField("amount", DecimalType(12, 2)),
    ]
)

# One row = running totals of one ad on one date at one load time. The load time
# arrives as text and may be invalid, so it is parsed where it is used.
MARKETING_ADS_RAW = StructType(
    [
        StructField("source", StringType()),
        StructField("campaign_id", LongType()),
        StructField("adset_id", LongType()),
        StructField("ad_id", LongType()),
        StructField("date", DateType()),
        StructField("spend", DecimalType(18, 2)),
        StructField("impressions", LongType()),
        StructField("clicks", LongType()),
        StructField("installs", LongType()),
        StructField("registrations", LongType()),
        StructField("timestamp", StringType()),
    ]
)


def with_ids(schema: StructType, kind: str) -> StructType:
    """``schema`` with ids of type ``bigint`` or ``string``; ids are only ever compared."""
    kinds = {"bigint": LongType(), "string": StringType()}
    return StructType(
        [StructField(f.name, kinds[kind] if f.name.endswith("_id") else f.dataType) for f in schema]
    )

"""Readers for the logical tables (Parquet, ORC, CSV or JSON files)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StringType, StructType

from unitlens.sources.schemas import MARKETING_ADS_RAW, ORDERS, PRODUCT_EVENTS, with_ids


def strict_cast(name: str, kind: DataType) -> Column:
    """A text column as ``kind``; a value that is not of that kind is an error, not a NULL."""
    text = F.col(name)
    value = text.try_cast(kind)
    problem = F.concat(F.lit(f"{name} is not {kind.simpleString()}: "), text)
    return F.when(text.isNotNull() & value.isNull(), F.raise_error(problem)).otherwise(value).cast(kind).alias(name)


def _read(spark: SparkSession, path: str, fmt: str, schema: StructType) -> DataFrame:
    """The schema's columns, found by name. JSON fails on malformed values, CSV on those and on files
    whose headers differ from the first one's; a column that a CSV header or a Parquet or ORC schema lacks is an
    error. JSON writers leave out what is NULL, so there a missing name is a NULL."""
    if fmt in ("parquet", "orc"):
        present = spark.read.format(fmt).load(path).columns
        lacking = [f.name for f in schema if f.name not in present]
        if lacking:
            raise ValueError(f"{path} has no column {', '.join(lacking)}")
    if fmt != "csv":
        return spark.read.format(fmt).schema(schema).option("mode", "FAILFAST").load(path)
    text = spark.read.option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").csv(path)
    columns = [
        F.col(f.name) if f.dataType == StringType() else strict_cast(f.name, f.dataType) for f in schema
    ]
    return text.select(*columns)


def read_product_events(
    spark: SparkSession, path: str, fmt: str = "parquet", ids: str = "bigint"
) -> DataFrame:
    """``ids`` is the type of the user ids: ``bigint`` or ``string``."""
    return normalise_channel(_read(spark, path, fmt, with_ids(PRODUCT_EVENTS, ids)), "channel")


def read_orders(spark: SparkSession, path: str, fmt: str = "parquet", ids: str = "bigint") -> DataFrame:
    return _read(spark, path, fmt, with_ids(ORDERS, ids))


def read_ads(spark: SparkSession, path: str, fmt: str = "csv", ids: str = "bigint") -> DataFrame:
    """``ids`` is the type of campaign, ad set and ad ids."""
    return normalise_ads(_read(spark, path, fmt, with_ids(MARKETING_ADS_RAW, ids)))


def normalise_channel(df: DataFrame, column: str) -> DataFrame:
    """Spell channels in one way (``META`` and ``TikTok `` occur)."""
    return df.withColumn(column, F.lower(F.trim(column)))


def normalise_ads(ads: DataFrame) -> DataFrame:
    """Spell platforms the way channels are spelled."""
    return normalise_channel(ads, "source")

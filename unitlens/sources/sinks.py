"""Write a result so that a dashboard can load it."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_mart(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    writer = df.write.format(fmt).mode(mode)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.save(path)

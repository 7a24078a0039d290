"""Intermediate tables in the folder that driver and executors share, and what Python workers need."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. Only a local session, whose executors are the driver, may do
    without and gets a folder of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='unitlens-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def written(df: DataFrame, merged: int = 1) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: its lineage ends there, so a lost
    executor costs no recomputation and every later use sees the same rows. ``merged`` shuffle
    partitions go to one file, for tables that are much smaller than what they come from."""
    spark = df.sparkSession
    if merged > 1:
        df = df.coalesce(max(6, int(spark.conf.get("spark.sql.shuffle.partitions")) // merged))
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of rows that a Python worker gets at once, unless the session says otherwise.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", "8m"


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this library where it is not installed, through Spark's own files, and get
    rows in batches of bounded bytes."""
    if spark.conf.get(BATCH[0], None) is None:
        spark.conf.set(*BATCH)
    context = spark.sparkContext
    if "unitlens.zip" not in context._python_includes:
        top = Path(__file__).resolve().parents[2]
        context.addPyFile(shutil.make_archive(f"{tempfile.mkdtemp(prefix='unitlens-')}/unitlens", "zip", top, "unitlens"))

"""Marts that are replaced as a whole or by partition, and never seen half-written.

A mart is a folder with ``data``, one folder of files per write, and ``versions``, one small manifest per
write that names the folder of every partition. Files are never changed once a manifest names them: a
write puts its partitions into a new folder, and the new version exists as soon as its manifest does.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from dataclasses import asdict, dataclass, field, replace
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: The column that files are dealt by; part of folder names only.
PART = "part"
#: The partition of rows without a value, and of marts that have no partition column.
NONE = "none"
LAST_LINE = "complete"


@dataclass(frozen=True)
class Manifest:
    """One version: the schema as JSON, the format, and per partition folder name the write that holds it."""

    version: int
    batch: str
    schema: str
    fmt: str
    partitions: dict[str, str] = field(default_factory=dict)

    def folders(self, path: str, parts: Iterable[str] | None = None) -> list[str]:
        wanted = None if parts is None else set(parts)
        return [
            f"{path}/data/{written}/{name}"
            for name, written in sorted(self.partitions.items())
            if wanted is None or unquote(name.split("=", 1)[1]) in wanted
        ]


class Folder:
    """The few file operations that a mart needs, in whatever store its path names."""

    def __init__(self, spark: SparkSession, path: str):
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._spark = spark
        self._files = self._path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def names(self, path: str) -> list[str]:
        at = self._path(path)
        return [s.getPath().getName() for s in self._files.listStatus(at)] if self._files.exists(at) else []

    def read(self, path: str) -> str:
        stream = self._files.open(self._path(path))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def create(self, path: str, text: str) -> None:
        """Fails if the file is there, so of two writers of one version the second one fails."""
        stream = self._files.create(self._path(path), False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def delete(self, path: str) -> None:
        self._files.delete(self._path(path), True)


def versions(folder: Folder, path: str) -> list[int]:
    return sorted(int(n.removesuffix(".json")) for n in folder.names(f"{path}/versions") if n.endswith(".json"))


def manifest_of(spark: SparkSession, path: str, version: int | None = None) -> Manifest | None:
    """The latest complete version, or the one asked for; None if there is none."""
    folder = Folder(spark, path)
    for n in reversed(versions(folder, path) if version is None else [version]):
        text, _, last = folder.read(f"{path}/versions/{n:08d}.json").rpartition("\n")
        if last == LAST_LINE:
            return Manifest(**json.loads(text))
    return None


def publish(
    df: DataFrame,
    path: str,
    batch: str,
    by: str | None = None,
    replaces: Iterable[str] | None = None,
    fmt: str = "parquet",
    files: int = 1,
) -> Manifest:
    """Write ``df`` as the next version of the mart.

    Without ``replaces`` the mart becomes ``df``. With it, only the partitions of ``by`` that it lists are
    replaced, those that ``df`` has no rows for become empty, and all others stay as they are, unread; rows of
    other partitions are an error. A write that fails leaves the version before it in place; every attempt has
    a folder of its own, and ``forget_versions`` removes those that came to nothing. A partition is dealt to
    ``files`` files by the rows' hash and sorted, so the same rows give the same files in whatever order they come.
    """
    spark = df.sparkSession
    folder, now = Folder(spark, path), manifest_of(spark, path)
    taken = versions(folder, path)
    schema = StructType([StructField(f.name, f.dataType) for f in df.schema])
    new = Manifest(taken[-1] + 1 if taken else 1, batch, schema.json(), fmt)
    if now and replaces is not None and (now.schema, now.fmt) != (new.schema, fmt):
        raise ValueError("partitions of another schema or format can't be replaced one by one")
    value = F.lit(NONE) if by is None else F.coalesce(F.col(by).cast("string"), F.lit(NONE))
    deal = F.pmod(F.xxhash64(*df.columns), F.lit(files))
    rows = df.withColumn(PART, value).repartition(PART, deal).sortWithinPartitions(PART, *df.columns)
    attempt = f"{new.version:08d}-{uuid.uuid4().hex}"
    rows.write.partitionBy(PART).format(fmt).save(f"{path}/data/{attempt}")
    written = {n: attempt for n in folder.names(f"{path}/data/{attempt}") if n.startswith(f"{PART}=")}
    kept = {}
    if replaces is not None:
        listed = set(replaces)
        stray = {unquote(n.split("=", 1)[1]) for n in written} - listed
        if stray:
            raise ValueError(f"rows of partitions that are not replaced: {sorted(stray)[:5]}")
        kept = {n: v for n, v in (now.partitions if now else {}).items() if unquote(n.split("=", 1)[1]) not in listed}
    new = replace(new, partitions=kept | written)
    folder.create(f"{path}/versions/{new.version:08d}.json", json.dumps(asdict(new)) + "\n" + LAST_LINE)
    return new


def read_mart(spark: SparkSession, path: str, version: int | None = None, parts: Iterable[str] | None = None) -> DataFrame:
    """The latest version, or the one asked for; ``parts`` are the partition values that are read at all."""
    found = manifest_of(spark, path, version)
    if found is None:
        raise FileNotFoundError(f"no version of a mart in {path}")
    schema, folders = StructType.fromJson(json.loads(found.schema)), found.folders(path, parts)
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.format(found.fmt).schema(schema).load(folders)


def forget_versions(spark: SparkSession, path: str, keep: int = 2) -> list[int]:
    """Delete all but the latest ``keep`` versions, and the data that none of those names; readers of a
    deleted version fail."""
    if keep < 1:
        raise ValueError("one version has to stay")
    folder = Folder(spark, path)
    all_versions = versions(folder, path)
    old, stay = all_versions[:-keep], all_versions[-keep:]
    used = {v for n in stay if (m := manifest_of(spark, path, n)) for v in m.partitions.values()}
    for n in old:
        folder.delete(f"{path}/versions/{n:08d}.json")
    for name in folder.names(f"{path}/data"):
        if name not in used and int(name.split("-")[0]) <= all_versions[-1]:
            folder.delete(f"{path}/data/{name}")
    return old

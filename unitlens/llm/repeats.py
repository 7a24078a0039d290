"""Long repeats of a corpus without shuffling it: keyed segments, fixed-size filters, first occurrences.

An operator gives every window of a text a key that depends on the window's content only, such that
neighbouring windows mostly share it. A segment is a run of windows with one key. Equal windows have
equal keys, so only segments of a repeated key can hold repeats, and the rest is never shipped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from unitlens.llm.scratch import written
from unitlens.llm.text import MULTIPLIER, mix

#: Words of 64 bits in a filter, whatever the corpus: 16 MB. A full filter lets more through, and drops nothing.
FILTER_WORDS = 1 << 21


@dataclass
class Segments:
    """Segments of a chunk: row in the batch, first window, number of windows, key, digest of the
    whole segment, whether it may hold a window twice; ``hashes`` gives the fingerprints of its windows
    and ``raw`` its bytes."""

    row: np.ndarray
    start: np.ndarray
    n: np.ndarray
    key: np.ndarray
    digest: np.ndarray
    twice: np.ndarray
    hashes: Callable[[int], np.ndarray]
    raw: Callable[[int], bytes]


Cut = Callable[[pa.Array], Iterator[Segments]]


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def passes(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    word = bits[(values >> np.uint64(43)).astype(np.int64)]
    return (word >> (values & np.uint64(63))) & np.uint64(1) == 1


def identity(key: np.ndarray, digest: np.ndarray, rid: np.ndarray, start: np.ndarray) -> np.ndarray:
    place = mix(rid.astype(np.uint64) * MULTIPLIER + start.astype(np.uint64))
    return mix(key ^ mix(digest) ^ place)


def bit_filter(values: DataFrame) -> np.ndarray:
    """A bitmap of the only column, ``value``: at most FILTER_WORDS rows reach the driver."""
    word = F.shiftrightunsigned("value", 43).alias("word")
    bit = F.expr("shiftleft(1L, cast(value & 63 as int))").alias("bit")
    table = values.select(word, bit).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    bits = np.zeros(FILTER_WORDS, np.uint64)
    bits[table["word"].to_numpy()] = table["bits"].to_numpy().view(np.uint64)
    return bits


def among(bits):
    """A vectorised function from values to whether the bitmap has them; a few others pass by chance."""

    @F.pandas_udf("boolean")
    def known(values: pd.Series) -> pd.Series:
        return pd.Series(passes(bits.value, values.to_numpy().view(np.uint64)))

    return known


def keyed(cut: Cut):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in cut(batch.column(2)):
                yield pa.RecordBatch.from_arrays([signed(s.key), pa.array(1 + s.twice.astype(np.int64))], ["key", "n"])

    return run


def passing(cut: Cut, shared):
    """Segments whose key passes the filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in cut(batch.column(2)):
                at = np.flatnonzero(passes(shared.value, s.key))
                row = pa.array(s.row[at])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(row), batch.column(1).take(row), signed(s.key[at]), signed(s.digest[at])]
                    + [pa.array(s.start[at]), pa.array(s.n[at]), pa.array(s.twice[at])],
                    ["rid", "doc_id", "key", "digest", "start", "n", "twice"],
                )

    return run


def chosen(cut: Cut, shared, with_windows: bool):
    """The windows, or the bytes, of the segments whose identity passes the filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rids = batch.column(0).to_numpy()
            for s in cut(batch.column(2)):
                at = np.flatnonzero(passes(shared.value, identity(s.key, s.digest, rids[s.row], s.start)))
                if not len(at):
                    continue
                row = pa.array(s.row[at])
                ids = [batch.column(0).take(row), batch.column(1).take(row), signed(s.key[at]), signed(s.digest[at])]
                if with_windows:
                    each = pa.array(np.repeat(np.arange(len(at)), s.n[at]))
                    first = np.concatenate([s.start[k] + np.arange(s.n[k]) for k in at])
                    yield pa.RecordBatch.from_arrays(
                        [x.take(each) for x in ids] + [pa.array(first), signed(np.concatenate([s.hashes(k) for k in at]))],
                        ["rid", "doc_id", "key", "digest", "start", "window"],
                    )
                else:
                    raw = pa.array([s.raw(k) for k in at], pa.binary())
                    yield pa.RecordBatch.from_arrays(
                        [*ids, pa.array(s.start[at]), pa.array(s.n[at]), raw],
                        ["rid", "doc_id", "key", "digest", "start", "n", "raw"],
                    )

    return run


def order(*more: str) -> Column:
    """Documents in order, those without id last; then rows, then places."""
    return F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid", "start", *more)


@dataclass
class Repeats:
    """Segments that may hold repeats; each distinct one with its copies and its first occurrence."""

    base: DataFrame
    id_type: str
    cut: Cut
    segments: DataFrame
    distinct: DataFrame

    @classmethod
    def find(cls, base: DataFrame, cut: Cut) -> Repeats:
        """``base`` has rid, doc_id, text. Keys are counted over all documents with sums before the shuffle."""
        context, id_type = base.sparkSession.sparkContext, dict(base.dtypes)["doc_id"]
        keys = base.mapInArrow(keyed(cut), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
        repeated = context.broadcast(bit_filter(keys.where("n > 1").select(F.col("key").alias("value"))))
        columns = f"rid long, doc_id {id_type}, key long, digest long, start long, n long, twice boolean"
        segments = written(base.mapInArrow(passing(cut, repeated), columns))
        distinct = written(
            segments.groupBy("key", "digest").agg(
                F.count("*").alias("copies"), F.max("twice").alias("twice"), F.max("n").alias("n"), F.min(order()).alias("first")
            )
        )
        return cls(base, id_type, cut, segments, distinct)

    def mixed(self) -> DataFrame:
        """Distinct segments whose key has others too, or that may repeat themselves, with the key's windows."""
        keys = self.distinct.groupBy("key").agg(
            F.count("*").alias("kinds"), F.max("twice").alias("twice"), F.sum("n").alias("windows")
        )
        return self.distinct.drop("twice").join(keys.where("kinds > 1 OR twice").select("key", "windows"), "key")

    def reread(self, firsts: DataFrame, with_windows: bool) -> DataFrame:
        """Windows or bytes of the first occurrences of ``firsts``, read from the documents again.

        The filter may let other segments pass as well. They are true segments of the documents, so
        what they repeat, or what repeats them, is a true repeat.
        """
        spark = self.base.sparkSession
        asked = firsts.select("key", "digest", F.col("first.rid").alias("rid"), F.col("first.start").alias("start"))
        values = asked.mapInArrow(identified, "value long")
        shared = spark.sparkContext.broadcast(bit_filter(values))
        last = "window long" if with_windows else "n long, raw binary"
        columns = f"rid long, doc_id {self.id_type}, key long, digest long, start long, {last}"
        return self.base.mapInArrow(chosen(self.cut, shared, with_windows), columns)


def identified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        key, digest, rid, start = (batch.column(k).to_numpy() for k in range(4))
        yield pa.RecordBatch.from_arrays(
            [signed(identity(key.view(np.uint64), digest.view(np.uint64), rid, start))], ["value"]
        )


def by_document(base: DataFrame, ranges: DataFrame) -> DataFrame:
    """``base`` with ``gone``, the list of each document's removed ranges (a, b); null if there are none."""
    lists = ranges.groupBy("rid").agg(F.collect_list(F.struct("a", "b")).alias("gone"))
    return base.join(lists, "rid", "left").select("rid", "doc_id", "text", "gone")


def covered(size: int, gone: list | None) -> np.ndarray:
    """Which of ``size`` units lie in one of the ranges."""
    steps = np.zeros(size + 1, np.int64)
    if gone:
        np.add.at(steps, [g["a"] for g in gone], 1)
        np.add.at(steps, [g["b"] for g in gone], -1)
    return np.cumsum(steps[:-1]) > 0

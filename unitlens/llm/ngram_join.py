"""N-gram Jaccard self-join: rare-first prefix filtering, verified once per pair, reported by component."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from unitlens.llm.components import components
from unitlens.llm.repeats import among, bit_filter, passes
from unitlens.llm.scratch import written
from unitlens.llm.text import MULTIPLIER, chunks, mix, span_hashes, utf8, word_spans

#: Counters of the document frequencies; an order by hashed counts is as right as one by exact counts.
COUNTERS = 1 << 16
#: Counters of a set's sketch, and rows of a bucket that are compared in one block.
SKETCH, BLOCK = 64, 1024
#: Counters of the sketch that two candidates' sets are compared by before the sets are.
WIDE = 512
#: Bytes of texts whose n-grams are made at once; a worker's memory and its core's cache hold them easily.
CHUNK = 1 << 17


@dataclass(frozen=True)
class Jaccard:
    """Word n-grams and the least similarity in percent."""

    width: int = 3
    percent: int = 90

    def overlap(self, n, m):
        """Least intersection of linked sets of these sizes: 100 * i >= percent * (n + m - i)."""
        return -(-self.percent * (n + m) // (100 + self.percent))

    def prefix(self, n: int) -> int:
        """A linked pair shares an n-gram among the first so many of each set."""
        return n - -(-self.percent * n // 100) + 1


def lower_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


def shingle_sets(column: pa.Array, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """Row and sorted distinct 64-bit n-gram fingerprints of every text; A-Z are lowered."""
    lower = lower_table()
    for a, b in chunks(column, CHUNK):
        data, bounds = utf8(column[a:b])
        data = lower[data]
        starts, ends, first = word_spans(data, bounds)
        each = span_hashes(data, starts, ends)
        gram = np.zeros(len(each), np.uint64)
        for k in range(width):
            gram[: max(0, len(each) - k)] += mix(each[k:] + np.full(1, k + 1, np.uint64) * MULTIPLIER)
        gram = mix(gram)
        for row in range(b - a):
            lo, hi = first[row], first[row + 1]
            if hi - lo >= width:
                yield a + row, np.unique(gram[lo : hi - width + 1])
            elif hi > lo:
                whole = np.full(1, hi - lo, np.uint64)
                for k in range(lo, hi):
                    whole = mix(whole * MULTIPLIER + each[k : k + 1])
                yield a + row, whole
            else:
                yield a + row, np.zeros(0, np.uint64)


SIGNED = "rid long, doc_id long, n long, k1 long, k2 long, sketch binary, counts binary"


def signed(width: int):
    """Size, two fingerprints and a sketch of each row's set, and the task's n-gram counts in a row of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, names, kind = np.zeros(COUNTERS, np.int64), ["rid", "doc_id", "n", "k1", "k2", "sketch", "counts"], None
        for batch in batches:
            n, k1, k2, sketch = [], [], [], []
            for _, grams in shingle_sets(batch.column(2), width):
                n.append(len(grams))
                k1.append(mix(grams).sum(dtype=np.uint64))
                k2.append(mix(grams ^ MULTIPLIER).sum(dtype=np.uint64))
                bucket = (grams >> np.uint64(32)).astype(np.int64)
                sketch.append(np.bincount(bucket % SKETCH, minlength=SKETCH).astype(np.uint8).tobytes())
                counts += np.bincount((grams & np.uint64(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS)
            kind = batch.column(1).type
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64())]
                + [pa.array(np.array(k, np.uint64).view(np.int64)) for k in (k1, k2)]
                + [pa.array(sketch, pa.binary()), pa.nulls(len(n), pa.binary())],
                names,
            )
        if kind is not None:
            nulls = [pa.nulls(1, t) for t in (pa.int64(), kind, pa.int64(), pa.int64(), pa.int64(), pa.binary())]
            yield pa.RecordBatch.from_arrays([*nulls, pa.array([counts.tobytes()], pa.binary())], names)

    return run


def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(COUNTERS, np.int64)
    for batch in batches:
        for raw in batch.column(0).to_pylist():
            total += np.frombuffer(raw, np.int64)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["at", "n"])


def rare_first(grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return grams[np.lexsort((grams, counts[(grams & np.uint64(COUNTERS - 1)).astype(np.int64)]))]


def prefixes(rule: Jaccard, counts: np.ndarray):
    """Postings (gram, k1, n, place) of every set's prefix in the rare-first order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gram, key, size, place = [], [], [], []
            for _, grams in shingle_sets(batch.column(0), rule.width):
                if not len(grams):
                    continue
                head = rare_first(grams, counts)[: rule.prefix(len(grams))]
                gram.append(head)
                key.append(np.full(len(head), mix(grams).sum(dtype=np.uint64)))
                size.append(np.full(len(head), len(grams), np.int32))
                place.append(np.arange(len(head), dtype=np.int32))
            if gram:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(x).view(np.int64)) for x in (gram, key)]
                    + [pa.array(np.concatenate(x)) for x in (size, place)],
                    ["gram", "k1", "n", "place"],
                )

    return run


def same_group(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[list[np.ndarray]]:
    """Sorted batches as numpy columns that end where a group of the first ``columns`` columns ends."""
    held: pa.Table | None = None

    def arrays(table: pa.Table) -> list[np.ndarray]:
        return [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in table.columns]

    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        keys = np.stack([held.column(k).to_numpy() for k in range(columns)])
        last = np.flatnonzero((keys != keys[:, -1:]).any(0))
        if len(last):
            yield arrays(held.slice(0, last[-1] + 1))
            held = held.slice(last[-1] + 1)
    if held is not None and held.num_rows:
        yield arrays(held)


def candidates(rule: Jaccard, nearest: bool):
    """Pairs of a bucket block that pass the length, positional and suffix filters.

    The suffix filter bounds the sets' difference from below by their sketches. ``nearest`` gives
    each row only its closest candidate on either side; else pairs within a component are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for gram, i, j, n, block, cls, place, comp, sketch in same_group(batches, 3):
            gram, i, j, n, block, cls, place, comp = (
                x.to_numpy() for x in (gram, i, j, n, block, cls, place, comp)
            )
            raw = np.frombuffer(b"".join(sketch.to_pylist()), np.uint8).reshape(-1, SKETCH)
            group = np.concatenate([[0], np.cumsum((np.diff(gram) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0))])
            after, before = np.zeros(len(n), bool), np.zeros(len(n), bool)
            out, alive, d = [], np.arange(len(n)), 0
            while len(alive):
                d += 1
                alive = alive[alive + d < len(n)]
                a, b = alive, alive + d
                # Rows are sorted by size: past the length filter there is no partner further on.
                near = (group[a] == group[b]) & (100 * n[a] >= rule.percent * n[b])
                alive = a = a[near]
                b = a + d
                apart = cls[a] != cls[b]
                apart &= (i[a] == j[a]) | (block[a] != block[b])
                apart &= ~(after[a] & before[b]) if nearest else comp[a] != comp[b]
                a, b = a[apart], b[apart]
                need = rule.overlap(n[a], n[b])
                fits = np.minimum(n[a] - place[a], n[b] - place[b]) >= need
                a, b, need = a[fits], b[fits], need[fits]
                for lo in range(0, len(a), 1 << 16):
                    x, y, least = a[lo : lo + (1 << 16)], b[lo : lo + (1 << 16)], need[lo : lo + (1 << 16)]
                    gap = np.abs((raw[x] - raw[y]).view(np.int8).astype(np.int16)).sum(1)
                    good = gap <= n[x] + n[y] - 2 * least
                    x, y = x[good], y[good]
                    after[x] = before[y] = True
                    out.append(np.stack([np.minimum(cls[x], cls[y]), np.maximum(cls[x], cls[y])]))
                    if sum(x.shape[1] for x in out) > 1 << 18:
                        yield distinct_pairs(out)
                        out = []
            if out:
                yield distinct_pairs(out)

    return run


def distinct_pairs(parts: list[np.ndarray]) -> pa.RecordBatch:
    a, b = np.concatenate(parts, 1)
    by = np.lexsort((b, a))
    a, b = a[by], b[by]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return pa.RecordBatch.from_arrays([pa.array(a[new]), pa.array(b[new])], ["a", "b"])


def packed_sets(width: int, bits):
    """Size, wide sketch and set of the rows (cls, text, value) whose value passes the bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(passes(bits.value, batch.column(2).to_numpy().view(np.uint64))))
            n, wide, sets = [], [], []
            for _, grams in shingle_sets(batch.column(1), width):
                n.append(len(grams))
                bucket = (grams >> np.uint64(32)).astype(np.int64)
                wide.append(np.bincount(bucket % WIDE, minlength=WIDE).astype(np.uint8).tobytes())
                sets.append(grams.tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(wide, pa.binary()), pa.array(sets, pa.binary())],
                ["cls", "n", "wide", "grams"],
            )

    return run


def closer(rule: Jaccard):
    """Pairs (a, b, sizes, wide sketches) whose sketches don't yet prove them too far apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = (batch.column(k).to_numpy() for k in (2, 3))
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, WIDE) for k in (4, 5))
            # Counters are kept modulo 256, so their differences are at most the true ones.
            gap = np.abs((x - y).view(np.int8).astype(np.int16)).sum(1)
            yield batch.filter(pa.array(gap <= n + m - 2 * rule.overlap(n, m))).select([0, 1])

    return run


def verified(rule: Jaccard):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= rule.percent * (len(x) + len(y) - both))
            kept = batch.filter(pa.array(keep, pa.bool_()))
            yield kept.select([0, 1])

    return run


def blocks(buckets: DataFrame) -> DataFrame:
    """Rows of a large bucket copied to the pairs of blocks that they belong to; a small bucket is one block."""
    n = F.ceil(F.col("many") / BLOCK).cast("int")
    dealt = buckets.withColumn("nb", n).withColumn("block", F.pmod(F.xxhash64("cls"), F.col("nb")).cast("int"))
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("nb") - 1),
        lambda k: F.struct(F.least(k, F.col("block")).alias("i"), F.greatest(k, F.col("block")).alias("j")),
    )
    return dealt.withColumn("pair", F.explode(pairs)).select(
        "gram", F.col("pair.i").alias("i"), F.col("pair.j").alias("j"), "n", "block", "cls", "place", "comp", "sketch"
    )


def compare(buckets: DataFrame, rule: Jaccard, nearest: bool) -> DataFrame:
    dealt = blocks(buckets).repartition("gram", "i", "j").sortWithinPartitions("gram", "i", "j", "n", "cls")
    return dealt.mapInArrow(candidates(rule, nearest), "a long, b long").distinct()


def ngram_join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rule: Jaccard = Jaccard()) -> DataFrame:
    """Per row of ``docs``: rid, doc_id, n_shingles, component, component_id, first.

    Rows link when their n-gram sets reach the similarity; equal sets always link. ``component_id`` is
    the smallest doc_id reachable, ``first`` marks one row of each component (smallest doc_id, then
    row id; rows without doc_id come last), ``rid`` is the row's number in this scan. A null or empty
    text has an empty set, is linked with nothing and first of its own; a component without any doc_id
    has a null component_id. Repeated rows are one set. Other columns are ignored.

    Equal sets are one class. Postings of shared prefix n-grams are compared in blocks of a bucket, so
    a hot n-gram is many tasks. The first turn gives each row its nearest candidates; the second only
    compares rows whose components still differ, so a large cluster is not expanded into all pairs.
    """
    base = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    id_type = dict(base.dtypes)["doc_id"]
    table = written(base.mapInArrow(signed(rule.width), SIGNED.replace("doc_id long", f"doc_id {id_type}")))
    counted = table.where("counts IS NOT NULL").select("counts").mapInArrow(unpacked, "at long, n long")
    counts = np.zeros(COUNTERS, np.int64)
    for at, n in counted.groupBy("at").agg(F.sum("n")).collect():  # at most COUNTERS rows
        counts[at] = n
    sets = table.where("counts IS NULL").drop("counts")
    rows = sets.drop("sketch")
    classes = written(
        sets.where("n > 0").groupBy("k1", "k2", "n").agg(F.min("rid").alias("cls"), F.min("sketch").alias("sketch"))
    )
    context = docs.sparkSession.sparkContext

    def bitmap(values: DataFrame):
        return context.broadcast(bit_filter(values.toDF("value")))

    postings = written(
        base.select("text").mapInArrow(prefixes(rule, counts), "gram long, k1 long, n int, place int")
    )
    shared = written(postings.groupBy("gram").agg(F.count("*").alias("many")).where("many > 1"))
    repeated = bitmap(shared.select("gram"))
    found = postings.where(among(repeated)(F.col("gram"))).join(shared, "gram").distinct()
    named = classes.select("k1", "cls", "sketch")
    buckets = written(
        found.join(named, "k1").select("gram", F.col("n").cast("long").alias("n"), "cls", "place", F.lit(0).cast("long").alias("comp"), "sketch", "many")
    )
    repeated.unpersist()
    first = written(compare(buckets, rule, nearest=True), 8)
    own = F.xxhash64("cls")
    ends = bitmap(first.select(F.explode(F.array("a", "b")).alias("cls")).select(own))
    texts = base.select(F.col("rid").alias("cls"), "text", F.xxhash64("rid").alias("value"))
    grams = written(texts.mapInArrow(packed_sets(rule.width, ends), "cls long, n long, wide binary, grams binary"))

    def beside(pairs: DataFrame, sets: DataFrame, *columns: str) -> DataFrame:
        """The pairs with both sides' columns."""
        for side in ("a", "b"):
            pairs = pairs.join(sets.select(F.col("cls").alias(side), *(F.col(c).alias(f"{c}_{side}") for c in columns)), side)
        return pairs.select("a", "b", *(f"{c}_{side}" for c in columns for side in ("a", "b")))

    def verify(pairs: DataFrame) -> DataFrame:
        """The linked ones of the pairs: most others go by their wide sketches, so only few sets are sent."""
        near = written(beside(pairs, grams, "n", "wide").mapInArrow(closer(rule), "a long, b long"), 8)
        left = bitmap(near.select(F.explode(F.array("a", "b")).alias("cls")).select(own))
        # Written, so that no task runs the filter's Python worker beside those that compare the sets.
        few = written(grams.where(among(left)(own)).select("cls", "grams"))
        left.unpersist()
        return written(beside(near, few, "grams").mapInArrow(verified(rule), "a long, b long"))

    links = verify(first)
    comps = components(links)
    # A class without a candidate in the first turn has none; n-grams within one component give no pair.
    again = buckets.drop("comp").where(among(ends)(own))
    again = again.join(comps.select(F.col("node").alias("cls"), F.col("component").alias("of")), "cls", "left")
    again = written(again.withColumn("comp", F.coalesce("of", "cls")).drop("of"))
    ends.unpersist()
    mixed = bitmap(again.groupBy("gram").agg(F.min("comp").alias("c"), F.max("comp").alias("d")).where("c < d").select("gram"))
    second = written(compare(again.where(among(mixed)(F.col("gram"))), rule, nearest=False), 8)
    mixed.unpersist()
    comps = components(written(links.unionByName(verify(second)), 8))

    placed = classes.select("k1", "k2", "n", "cls").join(
        comps.select(F.col("node").alias("cls"), "component"), "cls", "left"
    )
    placed = placed.select("k1", "k2", "n", F.coalesce("component", "cls").alias("component"))
    rows = rows.join(placed, ["k1", "k2", "n"], "left").select(
        "rid", "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rid").alias("component")
    )
    rows = written(rows, 8)
    heads = rows.groupBy("component").agg(
        F.min("doc_id").alias("component_id"),
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid"))["rid"].alias("head"),
    )
    return rows.join(heads, "component").select(
        "rid", "doc_id", "n_shingles", "component", "component_id", (F.col("rid") == F.col("head")).alias("first")
    )

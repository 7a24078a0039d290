"""Near copies by SimHash: fingerprints join within a Hamming distance by walking a binary trie against itself."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from unitlens.llm.components import components
from unitlens.llm.scratch import written
from unitlens.llm.text import chunks, lower_table, spaced, utf8, word_spans

WIDTH = 4
SEED = 42
#: Fingerprints that link differ in at most so many bits.
RADIUS = 4
#: Fingerprints that one unit of comparison takes from either side.
BLOCK = 4_096
#: Rows of a task's group of units, about.
DEALT = 1 << 15
#: Node pairs that are walked at once, and pairs of fingerprints below which a node pair is compared directly.
WALKED, DIRECT = 1 << 16, 64
#: Shingles whose bits are counted at once.
COUNTED = 1 << 16


def simhashes(column: pa.Array, width: int) -> np.ndarray:
    """One fingerprint per text: a bit is set if it is set in over half of the shingles' hashes; 0 without words."""
    data, bounds = utf8(column)
    data = lower_table()[data]
    starts, ends, first = word_spans(data, bounds)
    data, starts, ends = spaced(data, starts, ends)
    many = np.diff(first)
    row = np.repeat(np.arange(len(many)), many)
    # A text of fewer words is one shingle.
    last = np.minimum(np.arange(len(row)) + width - 1, first[row + 1] - 1)
    whole = (np.arange(len(row)) + width <= first[row + 1]) | (np.arange(len(row)) == first[row])
    row, a, b = row[whole], starts[whole], ends[last[whole]]
    raw = data.tobytes()
    ones = np.zeros((len(many), 64), np.int64)
    for k in range(0, len(row), COUNTED):
        part = slice(k, k + COUNTED)
        hashes = np.array([xxhash.xxh64_intdigest(raw[x:y], SEED) for x, y in zip(a[part].tolist(), b[part].tolist())], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        heads = np.flatnonzero(np.diff(row[part], prepend=-1))
        ones[row[part][heads]] += np.add.reduceat(bits, heads, axis=0, dtype=np.int64)
    shingles = np.bincount(row, minlength=len(many))
    return np.packbits(2 * ones > shingles[:, None], axis=1, bitorder="little").view("<u8").ravel()


def signed(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in chunks(batch.column(1)):
                prints = simhashes(batch.column(1).slice(a, b - a), width)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(prints.view(np.int64))], ["doc_id", "print"])

    return run


class Groups:
    """Classes of numbers that are merged by pairs; the least number names a class."""

    def __init__(self, n: int):
        self.of = np.arange(n)

    def merge(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            low, high = np.minimum(self.of[a], self.of[b]), np.maximum(self.of[a], self.of[b])
            apart = low < high
            if not apart.any():
                return
            np.minimum.at(self.of, high[apart], low[apart])
            while (self.of != self.of[self.of]).any():
                self.of = self.of[self.of]


def trie_pairs(prints: np.ndarray, cuts: np.ndarray, radius: int, inside=None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places of ``prints`` within the radius, in batches, each pair once. ``cuts`` are the places where units
    begin, and the end; a unit's fingerprints ascend, and pairs lie in one unit.

    Fingerprints of a unit are the leaves of a binary trie, and a node is a range of them. A pair of nodes of
    one depth carries the bits in which their prefixes differ; its children are the pairs of their children,
    and a pair beyond the radius goes, as does one that ``inside`` (lo, hi, lo2, hi2) says is of no interest.
    """
    stack = [(63, np.stack([cuts[:-1], cuts[1:], cuts[:-1], cuts[1:], np.zeros(len(cuts) - 1, np.int64)]))]
    ones: dict[int, np.ndarray] = {}
    while stack:
        bit, pairs = stack.pop()
        if pairs.shape[1] > WALKED:
            half = pairs.shape[1] // 2
            stack += [(bit, pairs[:, half:]), (bit, pairs[:, :half])]
            continue
        if inside is not None:
            pairs = pairs[:, ~inside(*pairs[:4])]
        lo, hi, lo2, hi2, _ = pairs
        direct = ((hi - lo) * (hi2 - lo2) <= DIRECT) | (bit < 0)
        if direct.any():
            lo, hi, lo2, hi2, _ = pairs[:, direct]
            wide = hi2 - lo2
            size = (hi - lo) * wide
            at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            wide = np.repeat(wide, size)
            i, j = np.repeat(lo, size) + at // wide, np.repeat(lo2, size) + at % wide
            near = (i < j) & (np.bitwise_count(prints[i] ^ prints[j]) <= radius)
            yield i[near], j[near]
            pairs = pairs[:, ~direct]
        if not pairs.shape[1]:
            continue
        if bit not in ones:
            ones[bit] = np.concatenate([[0], np.cumsum((prints >> np.uint64(bit)) & np.uint64(1), dtype=np.int64)])
        lo, hi, lo2, hi2, apart = pairs
        mid, mid2 = (y - (ones[bit][y] - ones[bit][x]) for x, y in ((lo, hi), (lo2, hi2)))
        other = lo != lo2
        children = np.concatenate(
            [
                np.stack([mid, hi, lo2, mid2, apart + 1])[:, other],
                np.stack([lo, mid, mid2, hi2, apart + 1]),
                np.stack([lo, mid, lo2, mid2, apart]),
                np.stack([mid, hi, mid2, hi2, apart]),
            ],
            axis=1,
        )
        children = children[:, (children[0] < children[1]) & (children[2] < children[3]) & (children[4] <= radius)]
        if children.shape[1]:
            stack.append((bit - 1, children))


def by_unit(unit: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order by unit, then fingerprint, and where units begin in it, and the end."""
    order = np.lexsort((prints, unit))
    unit = unit[order]
    return order, np.concatenate([[0], np.flatnonzero(unit[1:] != unit[:-1]) + 1, [len(unit)]])


def trie_links(unit: np.ndarray, prints: np.ndarray, named: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a forest over the classes ``named``: two classes are connected if and only if fingerprints
    of theirs within the radius, in the same unit, connect them. Node pairs inside one class are not walked, so
    dense groups are not expanded."""
    order, cuts = by_unit(unit, prints)
    names, own = np.unique(named[order], return_inverse=True)
    groups = Groups(len(names))
    label = groups.of[own]
    run = np.concatenate([[0], np.cumsum(label[1:] != label[:-1])])

    def one_class(lo: np.ndarray, hi: np.ndarray, lo2: np.ndarray, hi2: np.ndarray) -> np.ndarray:
        return (run[lo] == run[hi - 1]) & (run[lo2] == run[hi2 - 1]) & (label[lo] == label[lo2])

    for i, j in trie_pairs(prints[order], cuts, radius, one_class):
        near = label[i] != label[j]
        if near.any():
            groups.merge(own[i[near]], own[j[near]])
            label = groups.of[own]
            run = np.concatenate([[0], np.cumsum(label[1:] != label[:-1])])
    moved = np.flatnonzero(groups.of != np.arange(len(names)))
    return names[moved], names[groups.of[moved]]


def linked(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit, prints, named = (batch.column(k).to_numpy() for k in range(3))
            a, b = trie_links(unit, prints.view(np.uint64), named, radius)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return run


def linked_group(radius: int):
    def run(table: pa.Table) -> pa.Table:
        unit, prints, named = (table.column(k).to_numpy() for k in ("unit", "print", "class"))
        a, b = trie_links(unit, prints.view(np.uint64), named, radius)
        return pa.table({"a": a, "b": b})

    return run


def masks(n: int, radius: int) -> list[int]:
    """Bits in which close fingerprints agree for one mask at least: of ``radius`` + j parts, some j are free of
    differences. j grows with the number of fingerprints, so that a group of equal bits stays small."""
    for more in range(1, 5):
        parts = radius + more
        edges = [64 * k // parts for k in range(parts + 1)]
        if more == 4 or n <= (BLOCK // 4) << (64 * more // parts):
            bits = [((1 << b) - (1 << a)) for a, b in zip(edges, edges[1:])]
            return [sum(some) for some in combinations(bits, more)]


def as_long(value: int) -> Column:
    return F.lit(value - (1 << 64) if value >> 63 else value)


def compare(rows: DataFrame, radius: int) -> DataFrame:
    """Links within the units of ``rows`` (unit, print, class); whole units are dealt to tasks together."""
    several = max(1, rows.count() // DEALT)
    dealt = rows.withColumn("deal", F.pmod("unit", F.lit(several)))
    return dealt.groupBy("deal").applyInArrow(linked_group(radius), "a long, b long")


def split_units(large: DataFrame, dealt: str) -> DataFrame:
    """Rows of units of any size copied to the pairs of blocks in which they meet rows of another ``class``: those
    outside of the unit's largest class, in blocks of BLOCK rows by the hash of ``dealt``, with each other and
    with the blocks of that class. Units of one class need no comparison and go."""
    per_class = large.groupBy("unit", "class").agg(F.count("*").alias("n"))
    split = per_class.groupBy("unit").agg(F.max(F.struct("n", "class")).alias("top"), F.sum("n").alias("many")).where("many > top.n")
    split = split.select(
        "unit", F.col("top.class").alias("main"), F.ceil(F.col("top.n") / BLOCK).alias("ins"), F.ceil((F.col("many") - F.col("top.n")) / BLOCK).alias("outs")
    )
    sides = large.join(split, "unit").withColumn("inside", F.col("class") == F.col("main"))
    block = F.pmod(F.xxhash64(dealt), F.when(F.col("inside"), F.col("ins")).otherwise(F.col("outs")))
    sides = sides.withColumn("block", block)
    ins, outs = F.sequence(F.lit(0), F.col("ins") - 1), F.sequence(F.lit(0), F.col("outs") - 1)
    met = F.when(F.col("inside"), F.transform(outs, lambda o: F.struct(F.lit(0).alias("kind"), F.col("block").alias("x"), o.alias("y")))).otherwise(
        F.concat(
            F.transform(ins, lambda i: F.struct(F.lit(0).alias("kind"), i.alias("x"), F.col("block").alias("y"))),
            F.transform(outs, lambda o: F.struct(F.lit(1).alias("kind"), F.least(o, "block").alias("x"), F.greatest(o, "block").alias("y"))),
        )
    )
    return sides.withColumn("met", F.explode(met)).withColumn("unit", F.xxhash64("unit", "met"))


def hamming_classes(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(print, class) for the distinct fingerprints of the only column, ``print``; class is the smallest one that
    links reach.

    Close fingerprints agree in the bits of some mask. Those that do are a group, a subtrie whose top
    is shared, and each group is joined with itself. A group of more than BLOCK fingerprints is first walked in
    runs of its sorted order; then only fingerprints outside of its largest class are compared, in blocks,
    with each other and with that class.
    """
    prints = written(prints)
    keyed = prints.select(
        "print",
        F.explode(F.array(*[F.struct(F.lit(k).alias("mask"), F.col("print").bitwiseAND(as_long(m)).alias("key")) for k, m in enumerate(masks(prints.count(), radius))])).alias("g"),
    ).select("g.mask", "g.key", "print", F.col("print").alias("class"))
    keyed = keyed.withColumn("unit", F.xxhash64("mask", "key"))
    sizes = keyed.groupBy("unit").agg(F.count("*").alias("many")).where("many > 1")
    shared = written(keyed.join(sizes, "unit").select("unit", "print", "class", "many"))
    links = compare(shared.where(f"many <= {BLOCK}"), radius)
    large = shared.where(f"many > {BLOCK}").drop("many")
    if large.isEmpty():
        return components(written(links, 8)).select(F.col("node").alias("print"), F.col("component").alias("class"))
    by_trie = large.repartitionByRange("unit", "print").sortWithinPartitions("unit", "print")
    links = written(links.union(by_trie.select("unit", "print", "class").mapInArrow(linked(radius), "a long, b long")), 8)
    reached = components(links).select(F.col("node").alias("print"), F.col("component").alias("now"))
    large = written(large.drop("class").join(reached, "print", "left").withColumn("class", F.coalesce("now", "print")).drop("now"))
    units = split_units(large, "print").select("unit", "print", "class")
    links = written(links.union(compare(written(units), radius)), 8)
    return components(links).select(F.col("node").alias("print"), F.col("component").alias("class"))


def simhash_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, radius: int = RADIUS) -> DataFrame:
    """Per row of ``docs``: doc_id, print (the fingerprint as a long), component_id.

    A fingerprint has a bit where over half of the XXH64 hashes of a text's shingles have it; shingles
    are runs of ``width`` words, repeats included. Rows link at ``radius`` differing bits or fewer, and
    ``component_id`` is the smallest doc_id reachable.

    Null texts and texts without words have fingerprint zero and link like any other; fewer words are one
    shingle. Rows of equal fingerprints, repeated rows among them, are one class and are not compared. A null doc_id
    is never the smallest; a component of nulls has a null component_id. Other columns are ignored; an empty table
    gives no rows.
    """
    base = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    rows = written(base.mapInArrow(signed(width), f"doc_id {base.schema['doc_id'].dataType.simpleString()}, print long"))
    classes = written(rows.groupBy("print").agg(F.min("doc_id").alias("low")), 8)
    joined = classes.join(hamming_classes(classes.select("print"), radius), "print", "left")
    joined = joined.select("print", "low", F.coalesce("class", "print").alias("class"))
    heads = joined.groupBy("class").agg(F.min("low").alias("component_id"))
    return rows.join(joined.join(heads, "class").select("print", "component_id"), "print").select("doc_id", "print", "component_id")

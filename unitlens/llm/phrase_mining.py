"""Collocations of a corpus by language: frequent phrases by SON partitioning, scored by their weakest cut."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from unitlens.llm.repeats import bit_filter, passes
from unitlens.llm.repeats import signed as as_longs
from unitlens.llm.scratch import written
from unitlens.llm.text import MULTIPLIER, chunks, lower_table, mix, span_hashes, spaced, utf8, word_spans

#: Phrases that a task gathers before it counts them and hands them on, and tables of spelled ones likewise.
GATHERED, TABLES = 1 << 21, 32
#: Bytes of text behind one group that merges counts.
MERGED = 1 << 24
#: Bytes that are hashed at once; longer words take another way.
STEP, LONG = 8, 256
#: What ends a piece, and what else separates words.
PIECE_ENDS = ".,;:!?\n\x0b\x0c\r"
BLANKS = " \t"


@dataclass(frozen=True)
class Mining:
    """Phrases of up to ``longest`` words that occur ``support`` times in their language; one inside a longer one with
    ``absorbed`` percent of its occurrences goes. ``shards`` parts of the corpus are mined each by itself."""

    longest: int = 4
    support: int = 30
    absorbed: int = 80
    best: int = 2_000
    shards: int = 8


def table_of(characters: str) -> np.ndarray:
    table = np.zeros(256, bool)
    table[[ord(c) for c in characters]] = True
    return table


ENDS_PIECE, SEPARATES = table_of(PIECE_ENDS), table_of(PIECE_ENDS + BLANKS)
LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(STEP)] + [2**64 - 1], np.uint64)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """64-bit hashes of words, read STEP bytes at a time; a word's length decides how it is hashed."""
    view = np.ndarray(len(data) + 1, "<u8", np.append(data, np.zeros(STEP, np.uint8)), strides=(1,))
    left = ends - starts
    out = mix(left.astype(np.uint64) * MULTIPLIER + np.uint64(seed))
    some, at = np.flatnonzero(left <= LONG), starts.copy()
    while len(some):
        block = view[at[some]] & LOW_BYTES[np.minimum(left[some], STEP)]
        out[some] = mix(out[some] * MULTIPLIER ^ block)
        at[some] += STEP
        left[some] -= STEP
        some = some[left[some] > 0]
    long = np.flatnonzero(ends - starts > LONG)
    if len(long):
        out[long] = span_hashes(data, starts[long], ends[long], seed)
    return out


@dataclass
class Words:
    """The words of a chunk: text row, whether the next word is in the same piece, place, and hashes of
    language and word."""

    row: np.ndarray
    next_too: np.ndarray
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    langs: np.ndarray

    @classmethod
    def of(cls, langs: pa.Array, texts: pa.Array) -> Words:
        data, bounds = utf8(texts)
        data = lower_table()[data]
        starts, ends, first = word_spans(data, bounds, SEPARATES)
        row = np.repeat(np.arange(len(texts)), np.diff(first))
        piece = np.searchsorted(np.flatnonzero(ENDS_PIECE[data]), starts)
        next_too = np.append((row[1:] == row[:-1]) & (piece[1:] == piece[:-1]), False)[: len(row)]
        named, edges = utf8(langs)
        return cls(row, next_too, data, starts, ends, mix(span_hashes(named, edges[:-1], edges[1:], seed=1)))

    def levels(self, longest: int, seed: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For 1, 2, ... words: hashes of the phrases that begin at each word, and whether there is one."""
        one = mix(word_hashes(self.data, self.starts, self.ends, seed) ^ self.langs[self.row])
        grams, there = one, np.ones(len(one), bool)
        for k in range(1, longest + 1):
            yield grams, there
            after = np.concatenate([one[k:], np.zeros(min(k, len(one)), np.uint64)])
            joined = np.concatenate([self.next_too[k - 1 :], np.zeros(min(k - 1, len(one)), bool)])
            grams, there = mix(grams * MULTIPLIER + after), there & joined


def in_shard(grams: np.ndarray, shard: np.ndarray) -> np.ndarray:
    return mix(grams + (shard.astype(np.uint64) + np.uint64(1)) * MULTIPLIER)


def later(values: np.ndarray, k: int) -> np.ndarray:
    """``values`` of the place ``k`` further on; False beyond the end."""
    return np.concatenate([values[k:], np.zeros(min(k, len(values)), bool)])


def runs(grams: np.ndarray, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order in which equal pairs of gram and cell lie together, cells of a gram as well, and grams ascend by
    their upper halves; and where each run of equal pairs begins."""
    low = np.uint64((1 << 12) - 1)
    if len(cells) and cells.max() <= low:
        # One sort where no two grams differ in their last bits only, which are lent to the cells.
        keys = (grams & ~low) | cells.astype(np.uint64)
        order = np.argsort(keys)
        keys, sorted_grams = keys[order], grams[order]
        if not ((keys[1:] ^ keys[:-1] <= low) & (sorted_grams[1:] != sorted_grams[:-1])).any():
            return order, np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    order = np.lexsort((cells, grams))
    grams, cells = grams[order], cells[order]
    return order, np.flatnonzero(np.concatenate([[True], (grams[1:] != grams[:-1]) | (cells[1:] != cells[:-1])])[: len(order)])


def group_of(grams: np.ndarray, groups: int) -> np.ndarray:
    """The merging group of each gram: equal ranges of the upper halves."""
    return ((grams >> np.uint64(32)) * np.uint64(groups)) >> np.uint64(32)


def parted(grams: np.ndarray, cells: np.ndarray, names: list[str], groups: int) -> Iterator[pa.RecordBatch]:
    """Counts of equal phrases as one row per merging group, packed."""
    cells = cells.astype(np.min_scalar_type(len(names)))
    order, first = runs(grams, cells)
    n = np.diff(np.append(first, len(order))).astype(np.uint32)
    grams, cells = grams[order[first]], cells[order[first]]
    # The order is that of the grams, so the groups, ranges of them, lie one after another.
    group = group_of(grams, groups)
    cuts = np.searchsorted(group, np.arange(groups + 1, dtype=np.uint64))
    full = np.flatnonzero(np.diff(cuts))
    ranges = [slice(cuts[g], cuts[g + 1]) for g in full]
    used = [np.unique(cells[r], return_inverse=True) for r in ranges]
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(full.astype(np.int32)),
            pa.array([[names[c] for c in u[0]] for u in used], pa.list_(pa.string())),
            pa.array([u[1].astype(np.uint32).tobytes() for u in used], pa.binary()),
            pa.array([grams[r].tobytes() for r in ranges], pa.binary()),
            pa.array([n[r].tobytes() for r in ranges], pa.binary()),
        ],
        ["part", "cells", "cell", "gram", "n"],
    )


PARTED = "part int, cells array<string>, cell binary, gram binary, n binary"


def counted(lengths: range, below, groups: int):
    """Counts of the phrases of these lengths all of whose parts of ``lengths[0] - 1`` words pass ``below``."""
    shorter = lengths[0] - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[str, int] = {}
        grams_of, cells_of, many = [], [], 0
        for batch in batches:
            lang, cell, text = (batch.column(k) for k in range(3))
            kinds = cell.dictionary_encode()
            code = np.array([names.setdefault(c, len(names)) for c in kinds.dictionary.to_pylist()], np.int64)
            code = code[kinds.indices.to_numpy()]
            shard_of = np.array([int(c.split("|", 1)[0]) for c in names], np.int64)
            for a, b in chunks(text):
                words = Words.of(lang.slice(a, b - a), text.slice(a, b - a))
                cells = code[a:b][words.row]
                passed = None
                for k, (grams, there) in enumerate(words.levels(lengths[-1]), 1):
                    if k == shorter:
                        passed = there & passes(below.value, in_shard(grams, shard_of[cells]))
                    if k not in lengths:
                        continue
                    for i in range(k - shorter + 1) if passed is not None else ():
                        there = there & later(passed, i)
                    at = np.flatnonzero(there)
                    grams_of.append(grams[at])
                    cells_of.append(cells[at])
                    many += len(at)
                if many >= GATHERED:
                    yield from parted(np.concatenate(grams_of), np.concatenate(cells_of), list(names), groups)
                    grams_of, cells_of, many = [], [], 0
        if many:
            yield from parted(np.concatenate(grams_of), np.concatenate(cells_of), list(names), groups)

    return run


def frequent_in_shard(support: int, all_counted: bool):
    """Sums of one group's counts: the grams that reach their shard's support and can reach the whole one, and
    their values in the shard. A shard that didn't count a phrase has fewer than its support of it, or none if
    ``all_counted``; that bounds the phrase's occurrences in all shards, and those of all longer ones."""

    def run(table: pa.Table) -> pa.Table:
        names: dict[str, int] = {}
        cells = []
        for kinds, raw in zip(table.column("cells").to_pylist(), table.column("cell").to_pylist()):
            cells.append(np.array([names.setdefault(c, len(names)) for c in kinds], np.uint32)[np.frombuffer(raw, np.uint32)])
        cells = np.concatenate(cells).astype(np.min_scalar_type(len(names)))
        grams = np.concatenate([np.frombuffer(raw, np.uint64) for raw in table.column("gram").to_pylist()])
        n = np.concatenate([np.frombuffer(raw, np.uint32) for raw in table.column("n").to_pylist()]).astype(np.int64)
        order, first = runs(grams, cells)
        n, grams, cells = np.add.reduceat(n[order], first), grams[order[first]], cells[order[first]]
        shard, least, slack = np.array([[int(x) for x in c.split("|", 3)[:3]] for c in names], np.int64).T
        head = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
        if all_counted:
            most = np.add.reduceat(n, head)
        else:
            most = np.add.reduceat(n - (least[cells] - 1), head) + slack[cells[head]]
        most = np.repeat(most, np.diff(np.append(head, len(grams))))
        kept = (n >= least[cells]) & (most >= support)
        return pa.table({"gram": as_longs(grams[kept]), "value": as_longs(in_shard(grams[kept], shard[cells[kept]]))})

    return run


SPELLED = "part int, lang array<string>, words array<int>, phrase array<string>, n array<long>"


def summed(table: pa.Table, *by: str) -> pa.Table:
    out = table.group_by(list(by)).aggregate([("n", "sum")])
    return out.rename_columns([*by, "n"]).combine_chunks()


def spelled(longest: int, candidates, groups: int):
    """Occurrences of the phrases that pass ``candidates``, counted by their spelling, as one row per merging group;
    with 0 words, all words of the language."""

    def packed(table: pa.Table) -> Iterator[pa.RecordBatch]:
        table = table.sort_by("part").combine_chunks()
        part = table["part"].to_numpy()
        first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])[: len(part)])
        bounds = pa.array(np.append(first, len(part)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(bounds, table[c].combine_chunks()) for c in ("lang", "words", "phrase", "n")]
        yield pa.RecordBatch.from_arrays([pa.array(part[first]), *lists], ["part", "lang", "words", "phrase", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: list[pa.Table] = []
        for batch in batches:
            for a, b in chunks(batch.column(1)):
                lang, text = (batch.column(k).slice(a, b - a) for k in range(2))
                words = Words.of(lang, text)

                def table(part: np.ndarray, of: pa.Array, k: int, phrase: pa.Array, n) -> pa.Table:
                    columns = [pa.array(part.astype(np.int32)), of, pa.array(np.full(len(part), k, np.int32)), phrase, pa.array(n, pa.int64())]
                    return pa.table(columns, ["part", "lang", "words", "phrase", "n"])

                per_lang = lang.take(pa.array(words.row)).value_counts()
                langs = per_lang.field(0)
                tables.append(table(np.zeros(len(langs)), langs, 0, pa.array([""] * len(langs), pa.string()), per_lang.field(1)))
                spaced_data, starts, ends = spaced(words.data, words.starts, words.ends)
                levels = zip(words.levels(longest), words.levels(longest, seed=2))
                for k, ((grams, there), (others, _)) in enumerate(levels, 1):
                    at = np.flatnonzero(there & passes(candidates.value, grams))
                    order = np.argsort(grams[at])
                    own, other = grams[at[order]], others[at[order]]
                    same = own[1:] == own[:-1]
                    if (same & (other[1:] != other[:-1])).any():
                        # Two phrases of one hash, told apart by the other one.
                        order = np.lexsort((others[at], grams[at]))
                        own, other = grams[at[order]], others[at[order]]
                        same = (own[1:] == own[:-1]) & (other[1:] == other[:-1])
                    first = np.flatnonzero(np.concatenate([[True], ~same])[: len(at)])
                    n, at = np.diff(np.append(first, len(order))), at[order[first]]
                    data, begins, _ = spaced(spaced_data, starts[at], ends[at + k - 1])
                    # The blank behind each phrase belongs to it here, and goes with the next step.
                    offsets = np.append(begins, len(data)).astype(np.int64)
                    phrases = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(data))
                    phrases = pc.utf8_slice_codeunits(phrases, 0, -1).cast(pa.string())
                    tables.append(table(group_of(grams[at], groups), lang.take(pa.array(words.row[at])), k, phrases, n))
                if len(tables) >= TABLES * (longest + 1):
                    tables = [summed(pa.concat_tables(tables), "part", "lang", "words", "phrase")]
                    if tables[0].num_rows > GATHERED:
                        yield from packed(tables[0])
                        tables = []
        if tables:
            yield from packed(summed(pa.concat_tables(tables), "part", "lang", "words", "phrase"))

    return run


def frequent_spellings(support: int):
    """Sums of one group's spelled counts that reach the support; words of a language always do."""

    def run(table: pa.Table) -> pa.Table:
        flat = pa.table({c: pa.concat_arrays([x.flatten() for x in table[c].chunks]) for c in ("lang", "words", "phrase", "n")})
        found = summed(flat, "lang", "words", "phrase")
        return found.filter(pc.or_(pc.equal(found["words"], 0), pc.greater_equal(found["n"], support)))

    return run


def frequent_phrases(docs: DataFrame, rule: Mining = Mining(), lang: str = "lang", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(lang, words, phrase, n) of all phrases with the rule's support, single words included, and (lang, n) with
    all word occurrences.

    A text's shard is the hash of the text, a shard's part of a language the part of its bytes. What has the
    support in a language has, in one shard at least, that shard's part of it. Each shard is mined completely at
    that lower support: first words, then pairs of words frequent there, then longer phrases all of whose pairs are
    frequent there. A shard is as large as the corpus needs; its counts merge in many groups, by hash, where the
    shards' counts of a phrase meet and also bound it from above. Hashes only select: phrases that are frequent in
    some shard are counted over all documents by their spelling.
    """
    context = docs.sparkSession.sparkContext
    base = docs.select(
        F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.pmod(F.xxhash64(text), F.lit(rule.shards)).alias("shard"), F.col(text).alias("text")
    )
    sizes = written(base.groupBy("lang", "shard").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")).alias("size")), 8)
    whole = sizes.groupBy("lang").agg(F.sum("size").alias("whole"))
    size, total = (F.col(c).cast("decimal(38,0)") for c in ("size", "whole"))
    least = F.greatest(F.call_function("div", rule.support * size + total - 1, total), F.lit(1))
    shares = written(sizes.join(whole.where("whole > 0"), "lang").select("lang", "shard", least.alias("least")), 8)
    slack = shares.groupBy("lang").agg(F.sum(F.col("least") - 1).alias("slack"))
    cells = written(shares.join(slack, "lang").select("lang", "shard", F.concat_ws("|", "shard", "least", "slack", "lang").alias("cell")), 8)
    # As small as the languages are few; Spark sees the size and shuffles the texts only beyond its limit for broadcasts.
    celled = base.join(cells, ["lang", "shard"]).select("lang", "cell", "text")
    groups = max(1, (sizes.agg(F.sum("size")).first()[0] or 0) // MERGED)
    below, kept = None, []
    for lengths in (range(1, 2), range(2, 3), range(3, rule.longest + 1)):
        if not lengths:
            continue
        parts = celled.mapInArrow(counted(lengths, below, groups), PARTED)
        frequent = written(parts.groupBy("part").applyInArrow(frequent_in_shard(rule.support, below is None), "gram long, value long"), 2)
        below = context.broadcast(bit_filter(frequent.select("value")))
        kept.append(frequent.select(F.col("gram").alias("value")))
    union = kept[0]
    for more in kept[1:]:
        union = union.union(more)
    candidates = context.broadcast(bit_filter(union))
    occurrences = base.select("lang", "text").mapInArrow(spelled(rule.longest, candidates, groups), SPELLED)
    merged = occurrences.groupBy("part").applyInArrow(frequent_spellings(rule.support), "lang string, words int, phrase string, n long")
    counts = written(merged, 4)
    return counts.where("words > 0"), counts.where("words = 0").select("lang", "n")


def part(words: Column, start: Column, size: Column) -> Column:
    return F.array_join(F.slice(words, start, size), " ")


def collocations(docs: DataFrame, rule: Mining = Mining(), lang: str = "lang", text: str = "text") -> DataFrame:
    """The best phrases by language: lang, rank, phrase, a, l, r, n, score.

    A-Z are lower-cased; ``.,;:!?`` and line ends cut a text into pieces, blanks and tabs a piece into words. ``a``
    counts a phrase's occurrences, overlaps included, ``n`` all words of the language. Cut into two parts that occur
    ``l`` and ``r`` times, it scores floor(2000000 a / (l + r)); its lowest cut counts, the first of equal ones.
    Phrases inside a longer one with the rule's part of their occurrences go, whether or not that one stays.

    A null language is ``und``, together with documents that say so; null and empty texts have no words.
    Repeated rows count as often as they come. Ties in the score go by ``a``, then by the phrase's bytes. Other
    columns are ignored; an empty table gives no rows. Products are decimals of 38 digits.
    """
    counts, totals = frequent_phrases(docs, rule, lang, text)
    phrases = counts.where("words > 1").select("lang", "words", "phrase", F.col("n").alias("a"), F.split("phrase", " ").alias("w"))
    spans = F.flatten(
        F.transform(
            F.sequence(F.lit(2), F.col("words") - 1),
            lambda m: F.transform(F.sequence(F.lit(1), F.col("words") - m + 1), lambda i: part(F.col("w"), i, m)),
        )
    )
    inside = phrases.where("words > 2").select("lang", F.explode(spans).alias("phrase"), F.col("a").alias("longer"))
    inside = inside.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    a, longer = (F.col(c).cast("decimal(20,0)") for c in ("a", "longer"))
    free = phrases.join(inside, ["lang", "phrase"], "left").where(F.coalesce(100 * longer < rule.absorbed * a, F.lit(True)))
    cut = free.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cut = cut.select(
        "lang", "phrase", "a", "cut", part(F.col("w"), F.lit(1), F.col("cut")).alias("left"), part(F.col("w"), F.col("cut") + 1, F.col("words")).alias("right")
    )
    sides = counts.where(F.col("words") < rule.longest).select("lang", "phrase", "n")
    cut = cut.join(sides.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l")), ["lang", "left"])
    cut = cut.join(sides.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r")), ["lang", "right"])
    score = F.call_function("div", F.lit(2_000_000).cast("decimal(7,0)") * a, F.col("l").cast("decimal(20,0)") + F.col("r"))
    weakest = F.min(F.struct(score.alias("score"), "cut", "l", "r"))
    scored = cut.groupBy("lang", "phrase", "a").agg(weakest.alias("at")).select("lang", "phrase", "a", "at.l", "at.r", "at.score")
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = scored.withColumn("rank", F.row_number().over(best).cast("long")).where(F.col("rank") <= rule.best)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")

"""Substring deduplication by recompression: rounds name runs and pairs alike wherever they occur.

Names are 64-bit fingerprints of what they stand for, so a name is global without a table of names
that all tasks would have to share.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from unitlens.llm.repeats import Repeats, Segments, by_document, covered, order
from unitlens.llm.scratch import written
from unitlens.llm.text import MULTIPLIER, chunks, mix, powers, span_hashes, utf8, word_spans

ROUNDS = 2
FAR = 1 << 40


def window_hashes(units: np.ndarray, width: int) -> np.ndarray:
    """Fingerprints of all windows of ``width`` units, by doubling."""
    out, size, block, span = None, 0, units, 1
    while True:
        if width & span:
            if out is None:
                out, size = block, span
            else:
                n = max(0, min(len(out), len(block) - size))
                out, size = mix(out[:n] * MULTIPLIER + block[size : size + n]), size + span
        if size == width:
            return out
        n = max(0, len(block) - span)
        block, span = mix(block[:n] * MULTIPLIER + block[span:]), 2 * span


def neighbours(values: np.ndarray, row: np.ndarray, side: int, outside: int) -> np.ndarray:
    """The neighbour's value on one side; ``outside`` where the row ends."""
    out = np.full(len(values), outside, values.dtype)
    if len(values) > 1:
        same = row[1:] == row[:-1]
        if side < 0:
            out[1:] = np.where(same, values[:-1], outside)
        else:
            out[:-1] = np.where(same, values[1:], outside)
    return out


def one_round(name, row, lo, hi, level):
    """Runs of equal symbols become one symbol, then pairs of a left and a right symbol do.

    ``lo`` and ``hi`` bound the words that a symbol's name depends on: a symbol whose bounds lie in a
    window is the same wherever the window occurs.
    """
    head = np.ones(len(name), bool)
    head[1:] = (name[1:] != name[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(head)
    last = np.append(first[1:], len(name)) - 1
    length = (last - first + 1).astype(np.uint64)
    # That a run ends is known from the symbols beside it.
    before, after = neighbours(lo, row, -1, -FAR)[first], neighbours(hi, row, 1, FAR)[last]
    name, row, lo, hi = name[first], row[first], before, after
    name = np.where(length > 1, mix((name + length) * MULTIPLIER + np.full(1, level, np.uint64)), name)
    right = mix(name + np.full(1, 7919 * level, np.uint64)) >> np.uint64(63) == 1
    joins = np.zeros(len(name), bool)
    joins[:-1] = ~right[:-1] & right[1:] & (row[1:] == row[:-1])
    joined = np.concatenate([[False], joins[:-1]])
    # A left symbol stays alone because of what follows, a right one because of what precedes.
    alone_lo = np.where(right, neighbours(lo, row, -1, -FAR), lo)
    next_hi = neighbours(hi, row, 1, FAR)
    new_hi = np.where(right & ~joins, hi, next_hi)
    after = np.append(name[1:], name[:1]) if len(name) else name
    new_name = np.where(joins, mix(mix(name * MULTIPLIER) + after), name)
    keep = ~joined
    return new_name[keep], row[keep], np.where(joins, lo, alone_lo)[keep], new_hi[keep]


def window_keys(words: np.ndarray, first: np.ndarray, width: int) -> np.ndarray:
    """A key for every window that starts at a word and fits in its row; 0 for the others.

    The key is the least fingerprint of a symbol of the last round that the window determines, taken
    together with the words that determine it; windows without one use the round before, and so on.
    """
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    place = np.arange(len(words), dtype=np.int64)
    levels = [(words, row, place, place + 1)]
    for level in range(1, ROUNDS + 1):
        levels.append(one_round(*levels[-1], level))
    up, down = powers(len(words))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * up[: len(words)])])
    fits = place + width <= first[1:][row]
    best = np.zeros(len(words), np.uint64)
    for name, row_of, lo, hi in reversed(levels):
        open_ = fits & (best == 0)
        if not open_.any():
            break
        until = np.concatenate([[0], np.cumsum(open_)])
        usable = np.flatnonzero((hi - lo <= width) & (lo >= 0))
        usable = usable[until[lo[usable] + 1] > until[np.maximum(hi[usable] - width, 0)]]
        lo, hi, name = lo[usable], hi[usable], name[usable]
        key = mix(name ^ ((sums[hi] - sums[lo]) * down[lo])) | np.uint64(1)
        for shift in range(width):
            at = hi - width + shift
            here = (at <= lo) & (at >= 0)
            spot, value = at[here], key[here]
            mine = open_[spot]
            spot, value = spot[mine], value[mine]
            best[spot] = np.maximum(best[spot], value)
    return best


def word_segments(column: pa.Array, width: int) -> Iterator[Segments]:
    for a, b in chunks(column):
        data, bounds = utf8(column[a:b])
        starts, ends, first = word_spans(data, bounds)
        words = span_hashes(data, starts, ends)
        if len(words) < width:
            continue
        keys = window_keys(words, first, width)
        row = np.repeat(np.arange(b - a), np.diff(first))
        windows = np.zeros(len(words), np.uint64)
        windows[: len(words) - width + 1] = window_hashes(words, width)
        change = np.ones(len(words), bool)
        change[1:] = (keys[1:] != keys[:-1]) | (row[1:] != row[:-1])
        cuts = np.flatnonzero(change)
        n = np.diff(np.append(cuts, len(words)))
        real = keys[cuts] != 0
        run = np.cumsum(change) - 1
        by = np.argsort(windows, kind="stable")
        same = (windows[by][1:] == windows[by][:-1]) & (run[by][1:] == run[by][:-1])
        twice = np.zeros(len(cuts), bool)
        twice[run[by][1:][same]] = True
        cuts, n, twice = cuts[real], n[real], twice[real]
        other = mix(words + MULTIPLIER)
        up, down = powers(len(words))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(other * up[: len(words)])])
        digest = mix((sums[cuts + n + width - 1] - sums[cuts]) * down[cuts] ^ n.astype(np.uint64))
        yield Segments(
            a + row[cuts],
            cuts - first[row[cuts]],
            n,
            keys[cuts],
            digest,
            twice,
            lambda k, c=cuts, m=n, w=windows: w[c[k] : c[k] + m[k]],
            lambda k: b"",
        )


def without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each document without its removed words."""
    for batch in batches:
        counts, removed, kept = [], [], []
        for text, gone in zip(batch.column(2), batch.column(3)):
            words = (text.as_py() or "").encode().split()
            out = covered(len(words), gone.as_py())
            counts.append(len(words))
            removed.append(int(out.sum()))
            kept.append(b" ".join(words if not removed[-1] else [w for w, x in zip(words, out) if not x]).decode())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
            ["rid", "doc_id", "n_words", "n_removed", "kept"],
        )


def substring_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 20) -> DataFrame:
    """Per row of ``docs``: rid, doc_id, n_words, n_removed, kept (the remaining words, joined by blanks).

    A word goes if a window of ``width`` words that covers it also starts earlier: in a document with a
    smaller id, or before in the same one. Rows without id count as last, rows with one id by their
    place in the scan. Windows are judged on the input. A null or empty text has no word; a text with
    fewer than ``width`` words loses nothing; an empty table gives no rows; other columns are ignored.

    Recompression gives every window a key. Segments of a repeated key are compared by fingerprints of
    64 bits beside the key's 64: first whole segments, so copies collapse to one, then, where a key has
    different segments, the windows of each distinct one. All comparisons are sums and minima that are
    combined before the shuffle, so no group of copies meets in one task.
    """
    base = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    repeats = Repeats.find(base, partial(word_segments, width=width))
    ends = F.col("start") + F.col("n") + (width - 1)
    first = repeats.distinct.where("copies > 1").select("key", "digest", "first")
    later = repeats.segments.join(first, ["key", "digest"]).where(
        (F.col("rid") != F.col("first.rid")) | (F.col("start") != F.col("first.start"))
    )
    windows = written(repeats.reread(repeats.mixed(), with_windows=True).drop("digest"))
    firsts = windows.groupBy("key", "window").agg(F.count("*").alias("n"), F.min(order()).alias("first")).where("n > 1")
    again = windows.join(firsts.select("key", "window", "first"), ["key", "window"]).where(
        (F.col("rid") != F.col("first.rid")) | (F.col("start") != F.col("first.start"))
    )
    ranges = later.select("rid", F.col("start").alias("a"), ends.alias("b")).unionByName(
        again.select("rid", F.col("start").alias("a"), (F.col("start") + width).alias("b"))
    )
    kind = dict(base.dtypes)["doc_id"]
    columns = f"rid long, doc_id {kind}, n_words long, n_removed long, kept string"
    return by_document(base, ranges).mapInArrow(without, columns)

"""Benchmark decontamination: CGK walks and bit sampling find passages, edit distance verifies them."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from unitlens.llm.text import MULTIPLIER, chunks, mix

SYMBOLS = 64
#: Items whose index is sent to the tasks at once; more items take further passes over the documents.
ITEMS = 2048
#: Normalised characters of the shortest passage that is searched.
SHORTEST = 12


#: Windows by the length of the item: least characters, walk steps, sampled steps, stride in a text.
LENGTHS = ((96, 32, 14, 8), (48, 28, 13, 6), (24, 20, 10, 3), (SHORTEST, 12, 7, 2))
#: Characters of an item that are compared at once around a window, before all of it is.
SLICE = 64


@dataclass(frozen=True)
class Search:
    """Distance relative to the item's length, and the share of passages at that distance to be found.

    Walks of ``tables`` keys each are added, for items of each length by themselves, until the windows
    find ``recall`` of ``copies`` edited copies of these items. ``slack`` is how many times ``most`` the
    SLICE characters around a window of a longer item may differ.
    """

    most: float = 0.2
    recall: float = 0.95
    tables: int = 4
    walks: int = 12
    copies: int = 600
    slack: float = 1.75
    seed: int = 7


@lru_cache(maxsize=1)
def lowered() -> tuple[np.ndarray, np.ndarray]:
    """Lower-case code point (0: neither letter nor digit) and symbol of each code point."""
    lower = np.zeros(0x110000, np.uint32)
    for point in range(0x110000):
        char = chr(point)
        if char.isalnum():
            small = char.lower()
            lower[point] = ord(small) if len(small) == 1 else point
    symbol = (lower * np.uint32(2654435761) >> np.uint32(26)).astype(np.uint8)
    symbol[lower == 0] = 0
    return lower, symbol


def normalised(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-case letters and digits with single blanks between: code points, symbols, each text's
    bounds, and the original place of every kept character. Each text starts with a blank."""
    points = np.frombuffer("".join("\n" + t for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    lower, symbol = lowered()
    low = lower[points]
    starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
    blank = low == 0
    keep = ~blank
    keep[1:] |= ~blank[:-1]
    keep[starts[:-1]] = True
    place = np.flatnonzero(keep)
    bounds = np.searchsorted(place, starts)
    return np.where(blank, 32, low)[place], symbol[points[place]], bounds, place - np.repeat(starts[:-1], np.diff(bounds))


def edited(text: str, most: float, rng: np.random.Generator) -> str:
    """The text with so many edits a character at random places: a third each removed, added and changed."""
    out, letters = list(text), sorted(set(text))
    for k in rng.choice(len(text), int(most * len(text)), replace=False).tolist():
        kind, letter = rng.integers(3), letters[rng.integers(len(letters))]
        out[k] = "" if kind == 0 else out[k] + letter if kind == 1 else letter
    return "".join(out)


@dataclass
class Index:
    """Sampled walk keys of all windows of a block's items of one length class, and what share of copies they find."""

    search: Search
    items: list[tuple[object, str]]
    steps: int
    stride: int
    symbols: np.ndarray
    first: np.ndarray
    found: float = 0.0
    samples: list[list[np.ndarray]] = field(default_factory=list)
    moves: list[np.ndarray] = field(default_factory=list)
    keys: list[np.ndarray] = field(default_factory=list)
    owner: list[np.ndarray] = field(default_factory=list)
    offset: list[np.ndarray] = field(default_factory=list)
    present: list[np.ndarray] = field(default_factory=list)

    @classmethod
    def build(cls, rows: list[tuple[object, str]], search: Search) -> list[Index]:
        """One index for each length class with items of SHORTEST normalised characters."""
        points, _, bounds, _ = normalised([t or "" for _, t in rows])
        texts = ["".join(map(chr, points[a:b])).strip() for a, b in zip(bounds, bounds[1:])]
        out, above = [], math.inf
        for least, steps, sampled, stride in LENGTHS:
            items = [(i, t) for (i, _), t in zip(rows, texts) if least <= len(t) < above]
            above = least
            if items:
                out.append(cls.of(items, search, steps, sampled, stride))
        return out

    @classmethod
    def of(cls, items: list[tuple[object, str]], search: Search, steps: int, sampled: int, stride: int) -> Index:
        rng = np.random.default_rng(search.seed)
        symbols = normalised([" ".join(t for _, t in items)])[1][1:]
        sizes = np.array([len(t) for _, t in items])
        first = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
        index = cls(search, items, steps, stride, symbols, first)
        owner = np.repeat(np.arange(len(items)), sizes)
        offset = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        inside = offset + steps // 2 <= sizes[owner]
        owner, offset = owner[inside], offset[inside]

        own = rng.permutation(np.arange(search.copies) % len(items))
        copies = normalised([" " * int(rng.integers(stride)) + "o" * int(rng.integers(stride)) + " " + edited(items[i][1], search.most, rng) for i in own])
        shift = np.diff(copies[2])
        n = -(-shift // stride)
        copy = np.repeat(np.arange(len(own)), n)
        starts = copies[2][copy] + stride * (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
        seen = np.zeros(len(own), bool)
        while index.found < search.recall and len(index.moves) < search.walks:
            index.moves.append(rng.integers(0, 2, (steps, SYMBOLS)).astype(np.int64))
            index.samples.append([np.sort(rng.choice(steps, sampled, replace=False)) for _ in range(search.tables)])
            for keys in index.walk(symbols, first[owner] + offset, len(index.moves) - 1):
                order = np.argsort(keys, kind="stable")
                index.keys.append(keys[order])
                index.owner.append(owner[order])
                index.offset.append(offset[order])
                bits = np.zeros(1 << 20, bool)
                bits[(keys >> np.uint64(44)).astype(np.int64)] = True
                index.present.append(bits)
            item, _, window = index.hits(copies[1], starts, len(index.moves) - 1)
            seen[copy[window[item == own[copy[window]]]]] = True
            index.found = float(seen.mean())
        return index

    def walk(self, symbols: np.ndarray, starts: np.ndarray, since: int = 0) -> Iterator[np.ndarray]:
        """Keys of the windows at ``starts``, table after table of the walks from ``since`` on. All windows walk together: at each
        step a window shows its present symbol, and moves on or stays as step and symbol say."""
        padded = np.concatenate([symbols, np.zeros(self.steps + 1, np.uint8)])
        for moves, tables in zip(self.moves[since:], self.samples[since:]):
            keys = [np.full(len(starts), k + 1, np.uint64) for k in range(len(tables))]
            at = starts.astype(np.int64)
            wanted: dict[int, list[int]] = {}
            for k, steps in enumerate(tables):
                for step in steps.tolist():
                    wanted.setdefault(step, []).append(k)
            for step in range(max(wanted) + 1):
                shown = padded[at]
                for k in wanted.get(step, ()):
                    keys[k] = (keys[k] + shown) * MULTIPLIER
                    keys[k] ^= keys[k] >> np.uint64(29)
                at += moves[step][shown]
            yield from map(mix, keys)

    def hits(self, symbols: np.ndarray, starts: np.ndarray, since: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Items, the places where they would begin, and the windows that say so, as places in ``starts``."""
        items, begins, windows = [], [], []
        parts = (x[since * self.search.tables :] for x in (self.keys, self.owner, self.offset, self.present))
        for keys, own, item, offset, bits in zip(self.walk(symbols, starts, since), *parts):
            maybe = np.flatnonzero(bits[(keys >> np.uint64(44)).astype(np.int64)])
            lo, hi = (np.searchsorted(own, keys[maybe], side) for side in ("left", "right"))
            n = hi - lo
            entry = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            items.append(item[entry])
            windows.append(np.repeat(maybe, n))
            begins.append(starts[windows[-1]] - offset[entry])
        return np.concatenate(items), np.concatenate(begins), np.concatenate(windows)

    def likely(self, symbols: np.ndarray, lo: np.ndarray, hi: np.ndarray, item: np.ndarray, begin: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Whether SLICE characters of the item around the window at ``at`` are near the text there, between
        ``lo`` and ``hi``: bit-parallel, all hits at once. For items of up to SLICE characters this is the distance itself."""
        out = np.zeros(len(item), bool)
        sizes = np.array([len(t) for _, t in self.items])
        for a in range(0, len(item), 4096):
            part = slice(a, a + 4096)
            i, whole = item[part], sizes[item[part]]
            size = np.minimum(whole, SLICE)
            skip = np.clip(at[part] - begin[part] + self.steps // 4 - SLICE // 2, 0, whole - size)
            most = np.where(whole <= SLICE, self.search.most * whole, np.minimum(1, self.search.slack * self.search.most) * size).astype(np.int64)
            rows, each = np.arange(len(i)), np.zeros((len(i), SYMBOLS), np.uint64)
            for k in range(SLICE):
                bit = np.where(k < size, np.uint64(1 << k), np.uint64(0))
                each[rows, self.symbols[np.minimum(self.first[i] + skip + k, len(self.symbols) - 1)]] |= bit
            top, one = (size - 1).astype(np.uint64), np.uint64(1)
            up, down = np.full(len(i), ~np.uint64(0)), np.zeros(len(i), np.uint64)
            score, least = size.copy(), size.copy()
            start = begin[part] + skip - SLICE // 4
            for k in range(SLICE + SLICE // 2):
                place = start + k
                inside = (place >= lo[part]) & (place < hi[part])
                same = np.where(inside, each[rows, symbols[np.clip(place, 0, len(symbols) - 1)]], np.uint64(0))
                vertical = same | down
                horizontal = (((same & up) + up) ^ up) | same
                rise, fall = down | ~(horizontal | up), up & horizontal
                score += (rise >> top & one).astype(np.int64) - (fall >> top & one).astype(np.int64)
                rise, fall = rise << one, fall << one
                up, down = fall | ~(vertical | rise), rise & vertical
                np.minimum(least, score, out=least)
            out[part] = least <= most
        return out


def nearest(pattern: str, text: str, most: int) -> tuple[int, int] | None:
    """Least edit distance of the pattern to any part of the text, and where that part ends (bit-parallel)."""
    mask, top = (1 << len(pattern)) - 1, 1 << len(pattern) - 1
    where: dict[str, int] = {}
    for k, c in enumerate(pattern):
        where[c] = where.get(c, 0) | 1 << k
    up, down, score, best = mask, 0, len(pattern), None
    for end, c in enumerate(text, 1):
        same = where.get(c, 0)
        vertical = same | down
        horizontal = (((same & up) + up) ^ up) | same
        rise, fall = down | ~(horizontal | up) & mask, up & horizontal
        score += bool(rise & top) - bool(fall & top)
        rise, fall = rise << 1 & mask, fall << 1 & mask
        up, down = fall | ~(vertical | rise) & mask, rise & vertical
        if score <= most and (best is None or score < best[0]):
            best = score, end
    return best


def passages(index: Index, points: np.ndarray, symbols: np.ndarray, bounds: np.ndarray) -> dict[tuple[int, int], tuple[int, int, int]]:
    """By text and item: distance, start and stop of the closest part."""
    sizes = np.diff(bounds)
    n = -(-sizes // index.stride)
    row = np.repeat(np.arange(len(sizes)), n)
    starts = bounds[row] + index.stride * (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
    tried = set()
    for lo in range(0, len(starts), 1 << 17):
        item, begin, window = index.hits(symbols, starts[lo : lo + (1 << 17)])
        window += lo
        # The window's own text is searched: the item itself may seem to begin before it.
        once = np.unique(np.stack([row[window], item, begin // 8]), axis=1, return_index=True)[1] if len(item) else []
        item, begin, window = item[once], begin[once], window[once]
        own = row[window]
        good = index.likely(symbols, bounds[own], bounds[own + 1], item, begin, starts[window])
        tried.update(zip(own[good].tolist(), item[good].tolist(), (begin[good] // 32).tolist()))
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    for r, i, near in sorted(tried):
        pattern = index.items[i][1]
        if (r, i) in best and best[r, i][0] == 0:
            continue
        most = int(index.search.most * len(pattern))
        lo = max(bounds[r], near * 32 - most - 32)
        hi = min(bounds[r + 1], near * 32 + 32 + len(pattern) + most + 32)
        if hi - lo < len(pattern) - most:
            continue
        part = "".join(map(chr, points[lo:hi]))
        match = nearest(pattern, part, most)
        if match is None or (r, i) in best and best[r, i][0] <= match[0]:
            continue
        back = nearest(pattern[::-1], part[: match[1]][::-1], match[0])
        best[r, i] = match[0], lo + match[1] - (back[1] if back else len(pattern)), lo + match[1] - 1
    return best


def found(indexes: list[Index], id_type: pa.DataType):
    """Verified passages (doc_id, rid, item_id, distance, item_chars, start, stop) of a task's documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for a, b in chunks(batch.column(2)):
                texts = ["" if t is None else t for t in batch.column(2)[a:b].to_pylist()]
                points, symbols, bounds, place = normalised(texts)
                for index in indexes:
                    for (r, i), (distance, first, last) in passages(index, points, symbols, bounds).items():
                        out.append((a + r, *index.items[i], distance, int(place[first]), int(place[last]) + 1))
            if out:
                rows, items, texts, distance, start, stop = zip(*out)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(1).take(pa.array(rows)),
                        batch.column(0).take(pa.array(rows)),
                        pa.array(items, id_type),
                        pa.array(distance, pa.int32()),
                        pa.array(map(len, texts), pa.int32()),
                        pa.array([max(0, s - 1) for s in start], pa.int32()),
                        pa.array([max(0, s - 1) for s in stop], pa.int32()),
                    ],
                    ["doc_id", "rid", "item_id", "distance", "item_chars", "start", "stop"],
                )

    return run


def contaminated(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    search: Search = Search(),
) -> DataFrame:
    """Per document and item found in it: doc_id, rid, item_id, distance, item_chars, start, stop.

    An item is found where a part of the text is within ``search.most`` edits per character of it, both
    in lower case with everything but letters and digits as single blanks; the closest part is given,
    start and stop are characters of the original text. ``rid`` is the row's number in this scan.

    Windows are shorter than items (LENGTHS; about half as many characters as steps): a passage with
    edits is found by a part with few. They start every ``stride`` characters of a text and at every
    character of an item, so a passage holds several whatever its place. Items are indexed in blocks of ITEMS by length, each a
    pass over the documents, so what is sent to tasks stays bounded. Null texts and items with fewer
    than SHORTEST normalised characters match nothing; rows without id are searched and give null;
    repeated rows and items give a row each; an empty table on either side gives no rows; other
    columns are ignored.
    """
    base = docs.select(
        F.monotonically_increasing_id().alias("rid"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text")
    )
    known = items.select(F.col(item_id).alias("item_id"), F.col(text).alias("text"))
    types = dict(base.dtypes)["doc_id"], dict(known.dtypes)["item_id"]
    columns = f"doc_id {types[0]}, rid long, item_id {types[1]}, distance int, item_chars int, start int, stop int"
    kind = pa.int64() if types[1] in ("bigint", "int") else pa.string()
    wanted = known.where(F.length("text") >= SHORTEST)
    blocks = max(1, math.ceil(wanted.count() / ITEMS))
    out = None
    for k in range(blocks):
        own = wanted.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        rows = [(r[0], r[1]) for r in own.collect()]  # a block of about ITEMS passages
        indexes = Index.build(rows, search)
        if indexes:
            part = base.mapInArrow(found(indexes, kind), columns)
            out = part if out is None else out.unionByName(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], columns)

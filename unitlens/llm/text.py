"""Words and bytes of whole Arrow columns as numpy arrays."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Words are maximal runs of characters other than these six.
WHITE_SPACE = " \t\n\x0b\x0c\r"
WHITE_SPACE_RUN = r"[\x20\x09-\x0D]+"

# Frequent function words by language.
STOP_WORDS = {
    "en": "the of and to in a is that was it for on as with by at be this from or an are not his he had",
    "de": "der die das und den von zu mit sich des auf für ist im dem nicht ein eine als auch es an ich er",
    "fr": "le la les de des du et en un une que qui dans pour sur au par est pas ne se ce il plus",
    "es": "el la los las de del y en que un una se no por con para su al lo como más es son",
}

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=8)
def byte_codes(seed: int) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * MULTIPLIER + np.uint64(seed))


BASE = 0x2545F4914F6CDD1D
POWERS: list[tuple[np.ndarray, np.ndarray]] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least ``n`` powers of BASE modulo 2**64, and of its inverse; kept for the next call."""
    if not POWERS or len(POWERS[0][0]) < n:
        size = 1 << max(16, n.bit_length())
        up, down = np.full(size, BASE, np.uint64), np.full(size, pow(BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        POWERS[:] = [(np.multiply.accumulate(up), np.multiply.accumulate(down))]
    return POWERS[0]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit fingerprints of byte spans; equal bytes give equal values."""
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(byte_codes(seed)[data] * up[: len(data)], out=sums[1:])
    raw = (sums[ends] - sums[starts]) * down[starts]
    return mix(raw ^ ((ends - starts).astype(np.uint64) * MULTIPLIER))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, one after another, and each row's offsets; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


def give_back() -> None:
    """Return freed memory to the system: a worker that waits for its next task would keep it."""
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def chunks(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of a string column with about ``most`` bytes each; one row is never cut. Memory is given back
    behind the last one."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = np.cumsum(sizes) // most
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(sizes)]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield a, b
    give_back()


@lru_cache(maxsize=1)
def white_table() -> np.ndarray:
    table = np.zeros(256, bool)
    table[[ord(c) for c in WHITE_SPACE]] = True
    return table


def word_spans(data: np.ndarray, bounds: np.ndarray, table: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word in the bytes, and the first word of each row (one entry more than rows).

    ``table`` marks the bytes that separate words; white space by default. Words never cross rows.
    """
    inside = ~(white_table() if table is None else table)[data]
    before = np.concatenate([[False], inside[:-1]]) if len(data) else inside
    first = bounds[:-1][bounds[:-1] < len(data)]
    starting = inside & ~before
    starting[first] = inside[first]
    starts = np.flatnonzero(starting)
    after = np.concatenate([inside[1:], [False]]) if len(data) else inside
    ending = inside & ~after
    last = bounds[1:][bounds[1:] > 0] - 1
    ending[last] = inside[last]
    ends = np.flatnonzero(ending) + 1
    return starts, ends, np.searchsorted(starts, bounds)


@lru_cache(maxsize=1)
def lower_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[ord("A") : ord("Z") + 1] += 32
    return table


def spaced(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words one after another with a blank behind each, and where they start and end there."""
    sizes = ends - starts + 1
    stops = np.cumsum(sizes)
    begins = stops - sizes
    at = np.repeat(starts - begins, sizes) + np.arange(stops[-1] if len(stops) else 0)
    out = data[np.minimum(at, max(len(data) - 1, 0))]
    out[stops - 1] = 32
    return out, begins, stops - 1

"""Token-ID output: best-fit-decreasing packing of tokenised documents into rows of one length."""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: the pattern that the vocabulary's pieces were made with.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
MAX_VOCABULARY_BYTES = 16 << 20
#: Bytes of text that are packed together, and characters that are tokenised at once.
SHARD_BYTES, PART = 16 << 20, 100_000


@dataclass(frozen=True)
class Tokenizer:
    """A public byte-pair vocabulary, read on the driver and sent to the tasks."""

    ranks: bytes
    pattern: str = PIECES
    end: int = 50256

    @classmethod
    def read(cls, path: str = VOCABULARY, pattern: str = PIECES, end: int = 50256) -> Tokenizer:
        with open(path, "rb") as file:
            ranks = file.read(MAX_VOCABULARY_BYTES + 1)
        if len(ranks) > MAX_VOCABULARY_BYTES:
            raise ValueError(f"{path} has more than {MAX_VOCABULARY_BYTES} bytes")
        return cls(ranks, pattern, end)

    def table(self) -> dict[bytes, int]:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, self.ranks.splitlines())}

    def encoding(self):
        import tiktoken

        return tiktoken.Encoding("public", pat_str=self.pattern, mergeable_ranks=self.table(), special_tokens={})

    def dtype(self) -> np.dtype:
        return np.dtype("<u2" if self.end < 1 << 16 else "<u4")


def encoded(encoding, text: str) -> list[int]:
    """Tokens of a whole text; a very long one is cut before a space, which decoding joins again."""
    if len(text) <= PART:
        return encoding.encode_ordinary(text)
    out: list[int] = []
    at = 0
    while at < len(text):
        cut = at + PART
        if cut < len(text):
            space = text.rfind(" ", at + PART // 2, cut)
            cut = space if space > 0 else cut
        out += encoding.encode_ordinary(text[at:cut])
        at = cut
    return out


class Capacities:
    """A segment tree over free places: open rows by what is left in them."""

    def __init__(self, most: int):
        self.width = 1 << most.bit_length()
        self.full = bytearray(2 * self.width)  # whether a node has an open row below it
        self.rows: list[list[int]] = [[] for _ in range(self.width)]

    def add(self, free: int, row: int) -> None:
        self.rows[free].append(row)
        node = free + self.width
        while node and not self.full[node]:
            self.full[node] = 1
            node >>= 1

    def best(self, need: int) -> tuple[int, int] | None:
        """Take out the row with the least free places that suffice."""
        node = need + self.width
        if not self.full[node]:
            while node > 1 and (node & 1 or not self.full[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.width:
                node = 2 * node if self.full[2 * node] else 2 * node + 1
        free = node - self.width
        row = self.rows[free].pop()
        if not self.rows[free]:
            while node and not (node < self.width and (self.full[2 * node] or self.full[2 * node + 1])):
                self.full[node] = 0
                node >>= 1
        return free, row


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Rows of places of ``lengths``, which decrease and are at most ``capacity``."""
    rows: list[list[int]] = []
    open_rows = Capacities(capacity)
    for place, n in enumerate(lengths):
        found = open_rows.best(n) if n < capacity else None
        if found is None:
            found = capacity, len(rows)
            rows.append([])
        free, row = found
        rows[row].append(place)
        if free > n:
            open_rows.add(free - n, row)
    return rows


COLUMNS = (
    "shard int, row int, n_tokens int, input_ids binary, position_ids binary, cu_seqlens array<int>, "
    "position_resets array<int>, {}, pieces array<int>"
)


def packed(tokenizer: Tokenizer, length: int):
    """Tokenise, split and pack the rows (shard, doc_id, text, rid) of one partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, kind = tokenizer.encoding(), tokenizer.dtype()
        pieces, tokens, ids, id_type, shard = [], [], [], None, 0
        for batch in batches:
            id_type = batch.column(1).type
            for part, doc, text, rid in zip(*(batch.column(k) for k in range(4))):
                if not (text := text.as_py()):
                    continue
                shard = part.as_py()
                whole = np.array([*encoded(encoding, text), tokenizer.end], kind)
                order = (doc.as_py() is None, doc.as_py() if doc.is_valid else 0, rid.as_py())
                for n, at in enumerate(range(0, len(whole), length)):
                    cut = whole[at : at + length]
                    pieces.append((-len(cut), order, n, len(tokens)))
                    tokens.append(cut)
                    ids.append(doc.as_py())
        if not pieces:
            return
        pieces.sort()
        rows = best_fit([-p[0] for p in pieces], length)
        for lo in range(0, len(rows), 256):
            out: dict[str, list] = {k: [] for k in ("n", "ids", "positions", "ends", "resets", "docs", "numbers")}
            for row in rows[lo : lo + 256]:
                own = [pieces[k] for k in row]
                sizes = [-p[0] for p in own]
                ends = np.cumsum([0, *sizes])
                line, place = np.full(length, tokenizer.end, kind), np.zeros(length, kind if length < 1 << 16 else "<u4")
                for p, a, b in zip(own, ends, ends[1:]):
                    line[a:b] = tokens[p[3]]
                    place[a:b] = np.arange(b - a)
                out["n"].append(int(ends[-1]))
                out["ids"].append(line.tobytes())
                out["positions"].append(place.tobytes())
                out["ends"].append(ends.tolist())
                out["resets"].append(ends[:-1].tolist())
                out["docs"].append([ids[p[3]] for p in own])
                out["numbers"].append([p[2] for p in own])
            n = len(out["n"])
            ints = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([shard] * n, pa.int32()),
                    pa.array(range(lo, lo + n), pa.int32()),
                    pa.array(out["n"], pa.int32()),
                    pa.array(out["ids"], pa.binary()),
                    pa.array(out["positions"], pa.binary()),
                    pa.array(out["ends"], ints),
                    pa.array(out["resets"], ints),
                    pa.array(out["docs"], pa.list_(id_type)),
                    pa.array(out["numbers"], ints),
                ],
                ["shard", "row", "n_tokens", "input_ids", "position_ids", "cu_seqlens", "position_resets", "doc_ids", "pieces"],
            )

    return run


def pack(
    docs: DataFrame, tokenizer: Tokenizer, length: int = 2048, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Rows of ``length`` token ids: the whole texts of ``docs``, each closed by the end token.

    A document longer than a row is split into pieces of ``length`` and a rest; nothing is lost or
    moved. Pieces of a shard are packed best fit, longest first. Columns: shard, row, n_tokens (without
    padding), input_ids (little-endian ids, padded with the end token; 2 bytes each if they fit),
    position_ids (from 0 in every segment; 0 in the padding), cu_seqlens, position_resets (where
    segments start), doc_ids and pieces (document and piece number of each segment).

    A null or empty text makes no segment; a row without doc_id has a null there; repeated rows are
    packed each; an empty table gives no rows; other columns are ignored. Shards are hashed from the
    row's place in the scan: about SHARD_BYTES of text each, whatever the sources, so a task holds one
    shard's tokens; a document is never spread over tasks.
    """
    base = docs.select(
        F.monotonically_increasing_id().alias("rid"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text")
    )
    total = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, math.ceil(total / SHARD_BYTES))
    dealt = base.where("text <> ''").select("doc_id", "text", "rid").repartition(shards, F.xxhash64("rid"))
    rows = dealt.select(F.spark_partition_id().alias("shard"), "doc_id", "text", "rid")
    kind = dict(base.dtypes)["doc_id"]
    return rows.mapInArrow(packed(tokenizer, length), COLUMNS.format(f"doc_ids array<{kind}>"))

"""The manifest, collocations and SimHash classes against plain Python, on test tables and on odd rows."""

from __future__ import annotations

import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from unitlens.llm import simhash_dedup as sim
from unitlens.llm.merkle_manifest import folded, leaf, manifest, proof
from unitlens.llm.phrase_mining import Mining, collocations, frequent_phrases
from unitlens.llm.queries import QUERIES
from unitlens.llm.scratch import ship_package

FOLDER = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"
#: Names that the operators use themselves.
CLASHING = ["key", "node", "pos", "total", "path", "root", "tie", "level0", "shard", "gram", "value", "n", "phrase", "print", "class", "unit", "many"]
ODD = [None, "", " \t\n\x0b\x0c\r ", "one", "One  two", "a\nb\nc\n", "-", "ä ö ü ß 日本 語 " * 30, "x " * 400, "\U0001f600 \u0000 end. " * 9]
LONG = " ".join(f"w{i % 977}x{i % 13}" + ".,\n"[i % 3] * (i % 17 == 0) for i in range(60_000))


@pytest.fixture(scope="module")
def rows(spark):
    ship_package(spark)
    given = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select(*COLUMNS).collect()]
    odd = [(10_000 + i, None if i % 3 == 0 else f"ü{i % 2}", None if i % 2 else "en", None if i % 4 else i, t) for i, t in enumerate(ODD)]
    repeated = [(7, "src0", "en", 3, "same row")] * 5 + [(None, "src0", "en", 3, "no id")] * 4 + [(None, None, None, None, None)] * 3
    return given + odd + repeated + [(20_000, "alone", "de", len(LONG), LONG), (20_001, "src1", "de", len(LONG), LONG + " end")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    return df.select("*", *[F.lit(k).alias(c) for k, c in enumerate(CLASHING)])


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_manifest(docs, rows):
    shown = leaf(*[F.col(c) for c in COLUMNS[:4]], F.replace("text", F.lit("\n"), F.lit("")))
    even = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.lit(False))
    out = manifest(docs, COLUMNS, claimed=F.when(even, shown).otherwise(leaf(*[F.col(c) for c in COLUMNS])))
    got = out.select("doc_id", "leaf", "subroot", "root", proof(F.col("path")), folded(F.col("claimed"), F.col("path"))).collect()
    key = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    assert sorted(map(tuple, got), key=key) == sorted(brute.manifest(rows), key=key)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 728, 729, 730, 2187, 2188])
def test_manifest_of_trees_around_a_block(spark, n):
    rows = [(i, "s", None, None, str(i)) for i in range(n)]
    out = manifest(spark.createDataFrame(rows, SCHEMA).repartition(5))
    got = out.select("doc_id", "leaf", "subroot", "root", proof(F.col("path")), folded(F.col("leaf"), F.col("path"))).collect()
    top, paths = brute.tree([brute.leaf(r) for r in rows])
    want = [(r[0], brute.leaf(r), top, top, brute.sha("".join(a + b for a, b in p)), top) for r, p in zip(rows, paths)]
    assert sorted(map(tuple, got)) == want


def test_manifest_with_more_steps(spark, monkeypatch):
    """Blocks of nine leaves: four steps in one group, one in others, and several steps over the groups."""
    import unitlens.llm.merkle_manifest as m

    monkeypatch.setattr(m, "LEVELS", 2)
    monkeypatch.setattr(m, "BLOCK", 9)
    rows = [(i, f"s{i % 100}" if i % 2 else "hot", None, i, str(i)) for i in range(1500)]
    out = m.manifest(spark.createDataFrame(rows, SCHEMA).repartition(5))
    got = out.select("doc_id", "leaf", "subroot", "root", proof(F.col("path"))).collect()
    assert sorted(map(tuple, got)) == sorted(r[:5] for r in brute.manifest(rows))


def test_changed_rows_fail(spark):
    rows = [(i, f"s{i % 3}", "en", i, f"text {i}") for i in range(200)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = manifest(df, claimed=leaf(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), F.when(F.col("doc_id") == 77, "text").otherwise(F.col("text"))))
    failed = out.where(folded(F.col("claimed"), F.col("path")) != F.col("root")).select("doc_id").collect()
    assert [r[0] for r in failed] == [77]


def test_collocations(docs, rows):
    got = [tuple(r) for r in collocations(docs).collect()]
    assert sorted(got) == sorted(brute.collocations([(r[2], r[4]) for r in rows]))


@pytest.mark.parametrize("shards", [1, 3, 40])
def test_collocations_of_any_shards(spark, shards):
    """Scarce phrases, a hot language and copies: no shard may hide what reaches the support in all."""
    ship_package(spark)
    rng = random.Random(shards)
    vocabulary = [f"w{k}" for k in range(30)]
    rows = [("de" if i % 5 else None, " ".join(rng.choices(vocabulary, k=rng.randrange(40))) + rng.choice(" .,\t")) for i in range(400)]
    rows += [("de", "copied words come here again")] * 200
    got = collocations(spark.createDataFrame(rows, "lang string, text string"), Mining(support=9, best=50, shards=shards)).collect()
    assert sorted(map(tuple, got)) == sorted(brute.collocations(rows, support=9, best=50))


def test_large_counts_stay_exact(spark):
    """The score's product passes 64 bits."""
    a, l, r = 9 * 10**15, 9 * 10**15 + 12345, 9 * 10**15 + 7
    row = spark.range(1).select(
        F.call_function("div", F.lit(2_000_000).cast("decimal(7,0)") * F.lit(a).cast("decimal(20,0)"), F.lit(l).cast("decimal(20,0)") + F.lit(r))
    )
    assert row.first()[0] == 2_000_000 * a // (l + r)


def test_words_are_counted_too(docs, rows):
    counts, totals = frequent_phrases(docs)
    want = sum(len(brute.words(brute.lowered(r[4]).translate(str.maketrans(".,;:!?\n\x0b\x0c\r", " " * 10)))) for r in rows)
    assert totals.agg(F.sum("n")).first()[0] == want
    assert counts.where("words = 1").count() > 0


def test_fingerprints(docs, rows):
    got = [(r.doc_id, r.print % 2**64, r.component_id) for r in sim.simhash_dedup(docs).collect()]
    prints = [(r[0], brute.simhash(r[4])) for r in rows]
    found = brute.close_classes([p for _, p in prints])
    least = {}
    for i, p in prints:
        if i is not None:
            least[found[p]] = min(i, least.get(found[p], i))
    key = lambda r: tuple((x is not None, x or 0) for x in r)
    assert sorted(got, key=key) == sorted(((i, p, least.get(found[p])) for i, p in prints), key=key)


def ball(rng, n, flips):
    center = rng.getrandbits(64)
    out = set()
    while len(out) < n:
        p = center
        for b in rng.sample(range(64), rng.randrange(flips + 1)):
            p ^= 1 << b
        out.add(p)
    return out


@pytest.mark.parametrize("block", [4096, 64])
def test_classes_of_dense_and_scattered_prints(spark, monkeypatch, block):
    """Groups beyond a block take the second turn; chains and balls come out whole in either way."""
    ship_package(spark)
    rng = random.Random(5)
    prints = ball(rng, 900, 7) | ball(rng, 200, 3) | {rng.getrandbits(64) for _ in range(500)} | {0, 2**64 - 1, 2**63}
    chain = rng.getrandbits(64)
    for k in range(0, 40, 4):
        prints.add(chain)
        chain ^= 0b1111 << k
    monkeypatch.setattr(sim, "BLOCK", block)
    monkeypatch.setattr(sim, "masks", lambda n, radius, of=sim.masks: of(1, radius))
    signed = [(p - 2**64 if p >> 63 else p,) for p in prints]
    found = sim.hamming_classes(spark.createDataFrame(signed, "print long")).collect()
    got = {r[0] % 2**64: r[1] % 2**64 for r in found}
    want = brute.close_classes(prints)
    groups = lambda of: {frozenset(p for p in prints if of(p) == c) for c in map(of, prints)}
    assert groups(lambda p: got.get(p, p)) == groups(want.get)


@pytest.mark.parametrize("n", [1, 10**8, 10**10, 10**13])
def test_every_close_pair_shares_a_mask(n):
    rng = random.Random(n)
    masks = sim.masks(n, 4)
    for _ in range(2000):
        differing = sum(1 << b for b in rng.sample(range(64), 4))
        assert any(differing & m == 0 for m in masks)


def test_trie_links_compare_all_pairs():
    rng = np.random.default_rng(3)
    prints = np.unique(rng.integers(0, 1 << 14, 3000, dtype=np.uint64))
    unit = np.zeros(len(prints), np.int64)
    names = np.arange(len(prints))
    for radius in (0, 1, 2):
        a, b = sim.trie_links(unit, prints, names, radius)
        found = brute.classes(list(zip(a.tolist(), b.tolist())), names.tolist())
        want = brute.close_classes([int(p) for p in prints], radius)
        at = {int(p): k for k, p in enumerate(prints)}
        assert found == {at[p]: at[c] for p, c in want.items()}


def test_empty_tables(empty):
    assert manifest(empty).collect() == []
    assert collocations(empty).collect() == []
    assert sim.simhash_dedup(empty).collect() == []


@pytest.mark.parametrize("name", ["op11_merkle_manifest", "op12_phrase_mining", "op13_simhash_dedup"])
def test_unwritten_shuffled_input(spark, name, tmp_path, rows):
    """The result is the same when rows come from a shuffle in another order."""
    rows = [r for r in rows if r[0] is not None and r[0] != 7]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/a/documents.parquet")
    spark.createDataFrame(rows[::-1], SCHEMA).repartition(11).write.parquet(f"{tmp_path}/b/documents.parquet")
    a, b = (sorted(map(tuple, QUERIES[name](spark, f"{tmp_path}/{x}").collect()), key=str) for x in "ab")
    assert a == b


"""Cases that the operators once did by halves."""

from __future__ import annotations

import random
from itertools import combinations

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from unitlens.llm import language_id
from unitlens.llm.decontamination import contaminated
from unitlens.llm.line_dedup import RADIUS, Lines
from unitlens.llm.ngram_join import ngram_join
from unitlens.llm.scratch import ship_package, written

MIDDLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship_package(spark)


def runs(text, width):
    w = brute.words(brute.lowered(text))
    return {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} or {tuple(w)}


def test_near_copies_at_five_words_and_four_fifths(spark):
    """Copies with 2 % of their words replaced: 0.8 or more at five words, below 0.9 at three."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("aeioklmnrst") for _ in range(7))
    table = []
    for k in range(30):
        text = [word() for _ in range(300)]
        table.append((10 * k, " ".join(text)))
        for copy, n in enumerate((3, 6, 9), 1):
            own = list(text)
            for at in rng.sample(range(300), n):
                own[at] = word()
            table.append((10 * k + copy, " ".join(own)))
    sets = {i: runs(t, 5) for i, t in table}
    links = [(a, b) for a, b in combinations(sets, 2) if 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])]
    firsts = set(brute.classes(links, sets).values())
    docs = written(spark.createDataFrame(table, "doc_id long, text string").repartition(3))
    kept = {r.doc_id for r in corpus_pipeline.near_copies(spark, docs, MIDDLE).collect()}
    assert kept == firsts
    assert len(kept) < ngram_join(docs).where("first").count()


def test_cut_passages_behind_empty_texts(spark):
    """Documents that open with an item without its first k characters, after texts of no character."""
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{MIDDLE}/benchmark.parquet").orderBy("item_id").limit(12).collect()]
    table, want = [], set()
    for n, (i, x) in enumerate(items):
        cut = (0, 1, 4, 9, 15)[n % 5]
        table += [(-1, t) for t in (None, "", "a", None, "", "")[: n % 6 + 1]]
        table.append((n, x[cut:]))
        want.add((n, i))
    docs = spark.createDataFrame(table, "doc_id long, text string").coalesce(1)
    found = contaminated(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in found.collect()} == want


def test_passages_up_to_a_fifth_of_edits(spark):
    """Items of all lengths in one block, each copied with edits at random places."""
    rng = random.Random(11)
    letters = "eeeetttaaaooinnssrhhldcumfpg"
    prose = lambda n: " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 9))) for _ in range(n))[:n].strip()

    def edited(text, n):
        out = list(text)
        for k in rng.sample(range(len(text)), n):
            out[k] = rng.choice(["", out[k] + rng.choice(letters), rng.choice(letters)])
        return "".join(out)

    sizes, rates, each = (16, 32, 60, 120, 300), (0.1, 0.15, 0.2), 40
    items = [(k, prose(sizes[k // each])) for k in range(each * len(sizes))]
    table = []
    for n, rate in enumerate(rates):
        for k, x in items:
            table.append((1000 * n + k, f"{prose(90 + k % 17)} {edited(x, int(rate * len(x)))} {prose(60)}"))
    docs = spark.createDataFrame(table, "doc_id long, text string").repartition(3)
    got = {(r.doc_id, r.item_id) for r in contaminated(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    for n in range(len(rates)):
        for size in range(len(sizes)):
            own = range(each * size, each * (size + 1))
            assert sum((1000 * n + k, k) in got for k in own) >= 0.9 * each, (rates[n], sizes[size])


@pytest.mark.parametrize("left_out", ["es", "de"])
def test_texts_in_an_unlearned_language_are_rejected(spark, left_out):
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet").select("doc_id", "text", "lang")
    truth = docs.toPandas().set_index("doc_id")["lang"]
    learned = docs.withColumn("lang", F.when(F.col("lang") != left_out, F.col("lang")))
    rejected = language_id.identify(learned).toPandas().set_index("doc_id")["rejected"][truth.index]
    assert rejected[truth == left_out].mean() >= 0.98
    assert not rejected[truth != left_out].any()


def test_long_lines_that_differ_in_a_word():
    rng = random.Random(4)
    long = [rng.choice("abcdefghijklmnop") for _ in range(33_000)]
    other = [*long[:500], "z", *long[501:]]
    prints, keys, of = Lines(pa.array([" ".join(long), " ".join(other)])).prints_and_parts()
    assert np.bitwise_count(prints[0] ^ prints[1]) <= RADIUS
    assert set(keys[of == 0]) & set(keys[of == 1])

"""Arrays, thresholds and numbers that the operators' methods rest on, against plain Python."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from unitlens.llm import suffix_dedup, toxicity
from unitlens.llm.mixing import mix_sources, numbered_repeats
from unitlens.llm.scratch import shared_folder, ship_package, written


def test_later_copies_go_and_the_first_stays(spark):
    """One document's repeats, copies with another end, and a long run of one byte."""
    ship_package(spark)
    base = "".join(chr(97 + (i * i) % 23) for i in range(700))
    rows = [(1, base), (2, base[:500] + "#" * 50), (3, "x" * 5000), (3, "x" * 5000), (4, base[100:] + base[:400]), (5, None)]
    docs = written(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1))
    found = suffix_dedup.suffix_dedup(docs)
    got = sorted((r.doc_id, bytes(r.kept)) for r in found.collect())
    seen, want = set(), []
    for i, text in rows:
        raw, gone = (text or "").encode(), set()
        for p in range(len(raw) - 199):
            if raw[p : p + 200] in seen:
                gone.update(range(p, p + 200))
            seen.add(raw[p : p + 200])
        want.append((i, bytes(c for k, c in enumerate(raw) if k not in gone)))
    assert got == sorted(want)


def test_texts_without_function_words_have_the_common_threshold():
    languages, table = toxicity.stop_words()
    texts = pa.array(["the of and it", "der die und", "слова без языка", "", "zzz qqq"], pa.large_string())
    found = toxicity.guessed(*toxicity.word_ids(texts), table, len(languages))
    assert [languages[k] if k >= 0 else None for k in found] == ["en", "de", None, None, None]
    net = toxicity.Network.fresh(np.random.default_rng(1))
    net.cuts = np.array([0.1] * len(languages) + [0.7])
    ids, first = toxicity.word_ids(texts)
    p = 1 / (1 + np.exp(-net.logits(ids, first).astype(float)))
    scores = net.scores(ids, first, found)
    assert ((scores >= toxicity.CUT) == (p >= np.array([0.1, 0.1, 0.7, 0.7, 0.7]))).all()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 20), st.booleans()), min_size=1, max_size=60))
def test_thresholds_from_counts(texts):
    """The cut from counts per probability separates as well as the best cut of all."""
    p = np.array([0.02 + 0.045 * k for k in range(21)])
    clean = np.array([sum(k == x and not bad for x, bad in texts) for k in range(21)], float)
    toxic = np.array([sum(k == x and bad for x, bad in texts) for k in range(21)], float)
    cut = toxicity.threshold(p, clean, toxic)
    assert 0 < cut < 1
    assert cut == 0.5 or (clean.sum() and toxic.sum())


def test_a_document_with_two_labels_is_toxic_and_repeats_count_once(spark):
    ship_package(spark)
    docs = [(i, f"clean and fine words {i}" if i % 2 else f"vile awful words {i}") for i in range(200)] * 2
    labels = [(i, 0) for i in range(200)] + [(i, 1) for i in range(0, 200, 2)] + [(None, 1), (999, 1), (3, None)]
    wide = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("score", "toxic", "language", "step")})
    found = toxicity.toxicity(wide, spark.createDataFrame(labels, "doc_id long, toxic int")).toPandas()
    assert len(found) == 400 and found.groupby("doc_id")["score"].nunique().max() == 1
    assert (found["predicted"] == (found["doc_id"] % 2 == 0)).mean() > 0.95


def test_equal_rows_are_numbered_and_spread_over_leaves(spark):
    rows = [(None, "a b"), (7, "a b")] * 3000 + [(i, "a b c") for i in range(100)]
    for parts in (2, 5):
        sized = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts).select("doc_id", F.size(F.split("text", " ")).cast("long").alias("size"))
        found = numbered_repeats(sized).groupBy("doc_id", "size").agg(F.sort_array(F.collect_list("repeat")).alias("n")).collect()
        assert all(r.n == list(range(len(r.n))) for r in found)


def test_reruns_of_equal_rows_agree(spark):
    ship_package(spark)
    rows = [(None, "a b", "s")] * 9000 + [(5, "x y z", "t")] * 50 + [(i, "w " * (i % 9), "t") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    one, two = (
        sorted((str(r.doc_id), r.size, r.copies) for r in mix_sources(written(docs.repartition(n))).collect()) for n in (2, 9)
    )
    assert one == two
    assert {c for i, _, c in one if i == "None"} <= {1, 2} and len({c for i, _, c in one}) > 1


def test_only_a_local_session_makes_its_own_folder(spark, monkeypatch):
    class Context:
        master = "spark://somewhere"

    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(Session())

"""Operators tested by planted cases, round trips, held-out accuracy and plain versions of their parts."""

from __future__ import annotations

import random
import re
from collections import defaultdict

import brute
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from unitlens.llm import language_id, toxicity
from unitlens.llm.decontamination import contaminated, nearest
from unitlens.llm import line_dedup as line_module
from unitlens.llm import simhash_dedup as simhash_module
from unitlens.llm.line_dedup import RADIUS, line_dedup, without_lines
from unitlens.llm.line_dedup import edits as line_edits
from unitlens.llm.ngram_join import ngram_join
from unitlens.llm.phrase_mining import word_hashes
from unitlens.llm.queries import ORACLE, QUERIES
from unitlens.llm.scratch import ship_package, written
from unitlens.llm.text import mix
from unitlens.llm.token_output import Tokenizer, best_fit, pack

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, rid long, item_id long, line string, shard int"


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship_package(spark)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@settings(max_examples=150, deadline=None)
@given(st.text("abc", min_size=1, max_size=8), st.text("abc", max_size=12))
def test_nearest_part_of_a_text(pattern, text):
    parts = [text[a:b] for a in range(len(text) + 1) for b in range(a, len(text) + 1)]
    least = min(edits(pattern, p) for p in parts)
    found = nearest(pattern, text, len(pattern))
    assert (found[0] if found else len(pattern)) == min(least, len(pattern))


def changed(text, rate, rng):
    out = []
    for c in text:
        x = rng.random()
        out.append("" if x < rate / 3 else c + rng.choice("etaoin") if x < 2 * rate / 3 else rng.choice("etaoin") if x < rate else c)
    return "".join(out)


def test_passages_are_found(spark):
    rng = random.Random(3)
    items = [tuple(r) for r in spark.read.parquet(f"{MIDDLE}/benchmark.parquet").select("item_id", "text").collect()]
    clean = [r.text for r in spark.read.parquet(f"{MIDDLE}/documents.parquet").orderBy("doc_id").limit(300).collect()]
    low = lambda t: " ".join(re.findall(r"[^\W_]+", t.lower()))
    clean = [t for t in clean if not any(low(x) in low(t) for _, x in items)]
    table, planted = [(k, t) for k, t in enumerate(clean)], {}
    for n, rate in enumerate((0.0, 0.03, 0.08)):
        for i, x in items:
            key = 10_000 * (n + 1) + i
            before, after = rng.choice(clean)[:800], rng.choice(clean)[:500]
            passage = changed(x, rate, rng).upper() if n == 1 else changed(x, rate, rng)
            table.append((key, f"{before} {passage} {after}"))
            planted[key] = i, n
    table += [(None, items[0][1]), (-1, None), (-2, ""), (-3, items[1][1] * 2)]
    docs = spark.createDataFrame(table, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame([*items, (900, None), (901, ""), (902, "short")], "item_id long, text string")
    found = contaminated(docs, bench).collect()
    pairs = {(r.doc_id, r.item_id) for r in found}
    for n, least in enumerate((1.0, 0.95, 0.9)):
        own = [(key, i) for key, (i, k) in planted.items() if k == n]
        assert sum(p in pairs for p in own) >= least * len(own)
    assert (None, items[0][0]) in pairs and (-3, items[1][0]) in pairs
    assert not {d for d, _ in pairs if d is not None and 0 <= d < 10_000 or d in (-1, -2)}
    texts = dict(table)
    for r in found:
        part = low(texts[r.doc_id][r.start : r.stop])
        assert edits(low(dict(items)[r.item_id]), part) <= r.distance + 2
        assert r.distance <= 0.2 * r.item_chars


def test_blocks_of_items_and_empty_tables(spark, empty, monkeypatch):
    monkeypatch.setattr("unitlens.llm.decontamination.ITEMS", 7)
    docs, items = (spark.read.parquet(f"{SMALL}/{n}.parquet") for n in ("documents", "benchmark"))
    found = {(r.doc_id, r.item_id) for r in contaminated(docs, items).collect()}
    low = lambda t: " ".join(re.findall(r"[^\W_]+", t.lower()))
    known = [(r.item_id, low(r.text)) for r in items.collect()]
    want = {(r.doc_id, i) for r in docs.collect() for t in [low(r.text)] for i, x in known if x in t}
    assert found == want and want
    assert contaminated(empty, items).count() == 0
    assert contaminated(docs, empty.select("item_id", "text")).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=60))
def test_best_fit(lengths):
    lengths = sorted(lengths, reverse=True)
    rows = best_fit(lengths, 40)
    free, want = [], []
    for place, n in enumerate(lengths):
        fits = [k for k, f in enumerate(free) if f >= n]
        if fits:
            least = min(free[k] for k in fits)
            assert any(free[k] == least and place in rows[k] for k in fits)
            k = next(k for k in fits if free[k] == least and place in rows[k])
        else:
            free.append(40)
            k = len(free) - 1
            assert place in rows[k]
        free[k] -= n
        want.append(k)
    assert sorted(x for row in rows for x in row) == list(range(len(lengths)))


def test_token_rows_round_trip(spark, empty):
    tokenizer = Tokenizer.read()
    encoding = tokenizer.encoding()
    texts = [r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    texts += ["", None, " ", "日本語 ä\U0001f600\n\n\t x" * 50, "a" * 150_000, " " * 120_000, "word " * 60_000]
    table = [(k if k != 3 else None, t, "x", "y", 1, 2, "z", 3) for k, t in enumerate(texts)] + [(1, texts[1], "x", "y", 1, 2, "z", 3)]
    length = 512
    rows = pack(spark.createDataFrame(table, SCHEMA).repartition(4), tokenizer, length).collect()
    pieces = defaultdict(list)
    for r in rows:
        ids, place = np.frombuffer(bytes(r.input_ids), "<u2"), np.frombuffer(bytes(r.position_ids), "<u2")
        assert len(ids) == len(place) == length and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens <= length
        assert r.position_resets == r.cu_seqlens[:-1]
        for a, b, d, n in zip(r.cu_seqlens, r.cu_seqlens[1:], r.doc_ids, r.pieces):
            assert place[a:b].tolist() == list(range(b - a))
            pieces[d].append((n, ids[a:b].tolist()))
        assert (ids[r.n_tokens :] == tokenizer.end).all() and not place[r.n_tokens :].any()
    for d, t, *_ in table[:-1]:
        own = sorted(pieces.pop(d, []))
        if d == 1:
            assert [n for n, _ in own] == sorted(2 * list(range(len(own) // 2)))
            own = own[::2]
        tokens = [x for _, p in own for x in p]
        assert all(len(p) == length for _, p in own[:-1])
        assert (tokens == []) if not t else tokens[-1] == tokenizer.end and encoding.decode(tokens[:-1]) == t
    assert not pieces
    assert pack(empty, tokenizer).count() == 0


def word_hash(word):
    raw = np.frombuffer(word.encode(), np.uint8)
    return int(word_hashes(raw, np.array([0]), np.array([len(raw)]), 0)[0])


def plain_simhash(line):
    hashes = [word_hash(w) for w in line.split(" ")]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_parts(line):
    words = line.split(" ")
    n, own = len(words), []
    parts = min(max(n // 2, 1), line_module.EVEN)
    found = {(parts, k, " ".join(words[n * k // parts : n * (k + 1) // parts])) for k in range(parts)}
    for k, word in enumerate(words):
        own.append(word)
        if k == n - 1 or int(mix(np.array([word_hash(word)], np.uint64))[0]) % line_module.EVERY == 0:
            found |= {" ".join(own)} if len(own) > 1 else set()
            own = []
    return found


def plain_lines(rows, least=0.8):
    norm = lambda x: re.sub(r"[\W_]+", " ", x.lower()).strip()
    first = {}
    for i, t in rows:
        for at, line in enumerate((t or "").split("\n") if t is not None else []):
            if norm(line):
                first.setdefault(norm(line), (i, at))
    sims = {x: (plain_simhash(x), plain_parts(x)) for x in first}
    names = list(first)
    number = {x: k for k, x in enumerate(sorted(names, key=first.get))}
    links = []
    for a in range(len(names)):
        for b in range(a):
            x, y = names[a], names[b]
            close = (sims[x][0] ^ sims[y][0]).bit_count() <= RADIUS and sims[x][1] & sims[y][1]
            if close and min(len(x), len(y)) >= 5 and edits(x, y) <= (1 - least) * max(len(x), len(y)) + 1e-9:
                links.append((number[x], number[y]))
    group = brute.classes(links, number.values())
    keep = {k: x for x, k in number.items()}
    out = {}
    for i, t in rows:
        own = [(at, norm(x)) for at, x in enumerate((t or "").split("\n")) if norm(x)]
        out[i] = len(own), [at for at, x in own if first[keep[group[number[x]]]] != (i, at)]
    return out


def test_lines(spark, empty):
    rng = random.Random(1)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "ne", "ru") for b in ("tan", "sel", "dor", "vik", "pum", "ras")]
    lines = [" ".join(rng.choice(words) for _ in range(rng.randint(30, 60))) for _ in range(12)]
    table = []
    for k in range(40):
        own = []
        for _ in range(4):
            line = rng.choice(lines).split()
            if rng.random() < 0.5:
                line[rng.randrange(len(line))] = rng.choice(words) + "x"
            own.append(" ".join(line).capitalize() + rng.choice([".", "!", ""]))
        table.append((k, "\n".join(own)))
    table += [(50, None), (51, ""), (52, "\n\n--\n"), (53, "Ä ö\nä Ö!\n" + "lone " * 3000)]
    wide = [(i, t, "l", "s", 7, 8, "line", 9) for i, t in table]
    docs = written(spark.createDataFrame(wide, SCHEMA).repartition(4, "doc_id"))
    found = line_dedup(docs)
    got = {r.doc_id: (r.n_lines, r.removed) for r in found.collect()}
    want = plain_lines(table)
    assert got == want
    assert sum(len(x) for _, x in want.values()) > len(plain_lines(table, 1.0)) > 0
    kept = {r.doc_id: r.text for r in without_lines(docs, found).collect()}
    assert kept[53] == "Ä ö\n" + "lone " * 3000
    assert len(kept) == len(table) and without_lines(docs, found).columns == docs.columns
    assert line_dedup(empty).count() == 0


def test_lines_without_ids_and_repeated_rows(spark):
    """Rows without id come last; a repeated row loses all lines; a block of two lines takes the second turn."""
    line = " ".join(f"word{k}" for k in range(30))
    near = line.replace("word7", "wort7")
    table = [(None, f"{near}\nonly here"), (3, f"{line}\n{line}\nlast"), (3, f"{line}\n{line}\nlast"), (2, near.upper()), (9, "ab\nab cd")]
    docs = written(spark.createDataFrame(table, "doc_id long, text string").coalesce(1))
    got = sorted(((r.doc_id, r.n_lines, r.removed) for r in line_dedup(docs).collect()), key=str)
    assert got == sorted([(None, 2, [0]), (3, 3, [0, 1]), (3, 3, [0, 1, 2]), (2, 1, []), (9, 2, [])], key=str)


def test_dense_units_are_compared_in_blocks(spark, monkeypatch):
    """Chains of near lines, more than a block of them in one unit, come out as the plain version has them."""
    rng = random.Random(6)
    start = [rng.choice("abcdefgh") * rng.randint(1, 4) for _ in range(24)]
    table = []
    for k in range(90):
        if k % 30 == 0:
            words = list(start)
        words[rng.randrange(len(words))] = rng.choice("abcdefgh") * rng.randint(1, 4)
        table.append((k, " ".join(words)))
    monkeypatch.setattr(line_module, "BLOCK", 8)
    monkeypatch.setattr(simhash_module, "BLOCK", 8)
    docs = written(spark.createDataFrame(table, "doc_id long, text string").repartition(3))
    assert {r.doc_id: (r.n_lines, r.removed) for r in line_dedup(docs).collect()} == plain_lines(table)


def test_recall_of_near_lines(spark):
    """Lines of five words and more of scale 0.01 that share three words in a row, by edit similarity alone."""
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet").where("length(text) < 20000")
    lines = sorted({n for r in docs.collect() for x in r.text.split("\n") if len((n := re.sub(r"[\W_]+", " ", x.lower()).strip()).split()) >= 5 and len(n) < 1000})
    at = defaultdict(set)
    for k, x in enumerate(lines):
        w = x.split()
        for i in range(len(w) - 2):
            at[tuple(w[i : i + 3])].add(k)
    pairs = {(a, b) for v in at.values() if len(v) < 100 for a in v for b in v if a < b}
    short = lambda a, b: min(len(a), len(b)) >= 0.8 * max(len(a), len(b))
    near = [(a, b) for a, b in pairs if short(lines[a], lines[b]) and line_edits(lines[a], lines[b], m := max(len(lines[a]), len(lines[b])) // 5) <= m]
    ship_package(spark)
    everything = spark.sparkContext.broadcast(np.full(1 << 21, 2**64 - 1, np.uint64))
    rows = spark.createDataFrame([(k, k, x) for k, x in enumerate(lines)], "rid long, doc_id long, text string").repartition(8)
    columns = "name long, other long, chars long, print long, text string, parts array<long>"
    texts = rows.mapInArrow(line_module.sharing(everything, everything), columns)
    texts = written(texts.join(rows.select("text", F.col("rid").alias("line")), "text").drop("name", "other"))
    of = {r.node: r.component for r in line_module.line_groups(texts, 0.8).collect()}
    found = [of.get(a, a) == of.get(b, b) for a, b in near]
    assert len(near) > 200 and sum(found) / len(found) >= 0.97


@settings(max_examples=200, deadline=None)
@given(st.text("ab c", max_size=40), st.text("ab c", max_size=40), st.integers(0, 12))
def test_bounded_edits(x, y, most):
    exact = edits(x, y)
    assert line_edits(x, y, 99) == exact
    assert (line_edits(x, y, most) <= most) == (exact <= most)


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(0)
    codes, counts = np.unique(rng.integers(0, 1 << 24, 3000).astype(np.int32) & 0x0C30C3, return_counts=True)
    four, three, back = language_id.kneser_ney(codes, counts.astype(float), codes)
    model = language_id.Model(["x"], codes, four[:, None], three[:, None], back[:, None])
    for context in (codes[0] >> 6, codes[-1] >> 6, 77):
        whole = (context << 6) + np.arange(64, dtype=np.int32)
        assert np.exp(model.log_probabilities(whole)).sum() == pytest.approx(1, abs=1e-4)


def test_language(spark, empty):
    given_ = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    odd = [(-1, None), (-2, ""), (-3, "12 34 !?"), (-4, "É"), (None, "and of the"), (-5, "x" * 200_000), (-6, "\0\0 \0")]
    docs = given_.select("doc_id", "text", "lang", "source").unionByName(
        spark.createDataFrame([(i, t, None, "s") for i, t in odd], "doc_id long, text string, lang string, source string")
    )
    found = language_id.identify(docs).toPandas().set_index("doc_id", drop=False)
    truth = given_.select("doc_id", "lang").toPandas().set_index("doc_id")["lang"]
    own = found.loc[truth.index]
    assert (own.lang_pred == truth)[own.held_out].mean() >= 0.98
    assert not own.rejected.any()
    assert found.score.between(0, 1).all() and set(found.lang_pred) <= {*truth, "und"}
    assert {i for i in (-1, -2, -3, -6) if found.loc[i, "lang_pred"] == "und" and found.loc[i, "rejected"]} == {-1, -2, -3, -6}
    assert found.loc[-4, "lang_pred"] != "und"
    assert found.loc[-5, "rejected"]
    assert language_id.identify(empty).count() == 0
    without = language_id.identify(empty.unionByName(docs.where("doc_id = 1").withColumn("lang", F.lit(None).cast("string")), True))
    assert [r.lang_pred for r in without.collect()] == ["und"]


def test_gradients():
    rng = np.random.default_rng(2)
    net = toxicity.Network.fresh(rng)
    net.embedding = net.embedding.astype(float) * 20
    net.filters, net.weights = [f.astype(float) for f in net.filters], net.weights.astype(float)
    ids, first = toxicity.word_ids(pa.array(["a b c d e", "f", "", "g a b"], pa.large_string()))
    label = np.array([1, 0, 1, 0])

    def loss():
        z = net.logits(ids, first).astype(np.float64)
        return float(np.mean(np.log1p(np.exp(z)) - label * z))

    grads, _, loss_ = net.gradients(ids, first, label)
    assert loss_ == pytest.approx(loss(), rel=1e-6)
    for value, grad in zip(net.parameters(), grads):
        for at in [np.unravel_index(k, grad.shape) for k in np.argsort(-np.abs(grad), axis=None)[:4]]:
            kept = value[at]
            value[at] = kept + 1e-6
            up = loss()
            value[at] = kept - 1e-6
            down = loss()
            value[at] = kept
            assert (up - down) / 2e-6 == pytest.approx(float(grad[at]), rel=1e-3, abs=1e-6)


def test_toxicity(spark, empty, monkeypatch):
    monkeypatch.setattr(toxicity, "STEPS", 300)
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{MIDDLE}/labels.parquet").select("doc_id", "toxic")
    odd = spark.createDataFrame([(-1, None), (-2, ""), (None, "some words"), (-3, "w " * 100_000)], "doc_id long, text string")
    more = spark.createDataFrame([(5, None), (None, 1), (10**9, 1)], "doc_id long, toxic int")
    found = toxicity.toxicity(docs.unionByName(odd), labels.unionByName(more)).toPandas()
    assert found.score.between(0, 1).all() and (found.predicted == (found.score >= 0.3)).all()
    both = found.merge(labels.toPandas(), on="doc_id")
    seen, unseen = both[~both.held_out], both[both.held_out]
    assert (seen.predicted == seen.toxic).mean() >= 0.97
    # Some fifty toxic texts in four languages are too few to know each language's words.
    assert unseen.score[unseen.toxic == 1].mean() > 2 * unseen.score[unseen.toxic == 0].mean()
    assert (unseen.predicted == unseen.toxic).mean() >= 0.8
    assert len(found) == docs.count() + 4
    assert toxicity.toxicity(empty, labels).count() == 0
    none = toxicity.toxicity(docs.limit(20), labels.where("false")).toPandas()
    assert none.score.nunique() == 1 and not none.predicted.any()


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, texts = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language", "near_copies", "decontamination", "mixture", "tokens"]
    given_ = docs
    for name, stage in corpus_pipeline.STAGES:
        out = written(stage(spark, docs, SMALL))
        if name == "language":
            identified = language_id.identify(given_).where("rejected").select("doc_id").collect()
            assert {r.doc_id for r in out.collect()} == set(texts) - {r.doc_id for r in identified}
        elif name == "near_copies":
            rows = [(r.doc_id, r.text) for r in docs.collect()]
            near = brute.jaccard_components(rows, corpus_pipeline.NEAR.percent, corpus_pipeline.NEAR.width)
            assert {r.doc_id for r in out.collect()} == {c for _, c in near.values()}
        elif name == "decontamination":
            hit = {r.doc_id for r in contaminated(docs, spark.read.parquet(f"{SMALL}/benchmark.parquet")).collect()}
            assert hit and {r.doc_id for r in out.collect()} == {r.doc_id for r in docs.collect()} - hit
        elif name == "mixture":
            size = sum(len(brute.words(r.text)) for r in docs.collect())
            assert sum(len(brute.words(r.text)) for r in out.collect()) == pytest.approx(1.5 * size, rel=0.1)
        else:
            assert out.select(F.sum(F.size("doc_ids"))).first()[0] >= docs.count()
        if name != "tokens":
            assert out.columns == columns and all(texts[r.doc_id] == r.text for r in out.collect())
        docs = out


def test_pipeline_of_an_empty_table(spark, tmp_path):
    for name in ("documents", "benchmark"):
        spark.read.parquet(f"{SMALL}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline_keeps_odd_rows_whole(spark):
    """Rows without id, repeated rows and columns that the operators use themselves."""
    text = "and of the was in " + " ".join(f"word{i} the" for i in range(60))
    table = [(None, text, "en", "s", 1, 2, "z", 3), (4, text, "en", None, 1, 2, "z", 3), (4, text, "en", None, 1, 2, "z", 3)]
    table += [(i, f"{text} of it {i} " * 3, "en", "s", 1, 2, "z", 3) for i in range(20, 30)]
    docs = written(spark.createDataFrame(table, SCHEMA).coalesce(2))
    firsts = written(corpus_pipeline.near_copies(spark, docs, SMALL))
    assert firsts.columns == docs.columns
    assert firsts.count() == ngram_join(docs).where("first").count()
    mixed = written(corpus_pipeline.mixture(spark, firsts, SMALL))
    assert mixed.columns == docs.columns


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert ORACLE.keys() <= QUERIES.keys()

"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from unitlens.llm.language_id import held_out
from unitlens.llm.text import STOP_WORDS, chunks, span_hashes, utf8, word_spans

#: Labelled documents of each class that the network learns from, at most. Thresholds come from all documents of
#: the quarter of the labelled ones that it doesn't learn from.
SAMPLE = 4000
#: Steps of the logit in the counts that thresholds are found in, and its bounds.
STEP, OUTERMOST = 0.02, 12.0
BUCKETS, SIZE, FILTERS, WIDTHS = 1 << 16, 8, 8, (1, 2, 3)
#: A word's embedding is the sum of its own and those of its first bytes, so inflected words are near.
HEADS = (4, 6)
STEPS, BATCH, RATE, SEED = 1200, 16, 0.01, 5
#: Training ends early once an epoch's mean loss is this small.
ENOUGH = 0.003
PRIOR = 20
#: Scores are laid out so that a language's threshold comes to lie here.
CUT = 0.3


def separators() -> np.ndarray:
    """Bytes outside words: all of ASCII but letters, digits and apostrophe."""
    table = np.ones(256, bool)
    table[128:] = False
    table[[*range(48, 58), *range(65, 91), *range(97, 123), 39]] = False
    return table


def word_ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashed ids of all lowered words and of their heads, a row per word, and the first word of each text
    (one entry more than texts). Bytes are looked at in small parts."""
    ids, firsts = [np.zeros((0, 1 + len(HEADS)), np.int32)], [np.zeros(1, np.int64)]
    for a, b in chunks(column, 1 << 18):
        own, first = some_word_ids(column[a:b])
        ids.append(own.astype(np.int32))
        firsts.append(firsts[-1][-1] + first[1:])
    return np.concatenate(ids), np.concatenate(firsts)


def some_word_ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, bounds = utf8(column)
    low = np.arange(256, dtype=np.uint8)
    low[65:91] += 32
    data = low[data]
    starts, ends, first = word_spans(data, bounds, separators())
    spans = [ends, *(np.minimum(starts + n, ends) for n in HEADS)]
    each = [span_hashes(data, starts, until, k) >> np.uint64(48) for k, until in enumerate(spans)]
    return np.stack(each, 1).astype(np.int64), first


def stop_words() -> tuple[list[str], np.ndarray]:
    """Languages, and the language of each word id or -1."""
    languages = sorted(STOP_WORDS)
    table = np.full(BUCKETS, -1, np.int8)
    for k, language in enumerate(languages):
        ids, _ = word_ids(pa.array([STOP_WORDS[language]], pa.large_string()))
        table[ids[:, 0]] = k
    return languages, table


def guessed(ids: np.ndarray, first: np.ndarray, table: np.ndarray, languages: int) -> np.ndarray:
    """The language with most function words in each row; -1 for none."""
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    kind = table[ids[:, 0]]
    known = kind >= 0
    hits = np.bincount(row[known] * languages + kind[known], minlength=(len(first) - 1) * languages)
    hits = hits.reshape(-1, languages)
    return np.where(hits.max(1) > 0, hits.argmax(1), -1)


@dataclass
class Network:
    """Embeddings, one filter bank per width, a linear layer over the largest response of each filter; a threshold
    per language, and as the last one that of texts without a known function word."""

    embedding: np.ndarray
    filters: list[np.ndarray]
    weights: np.ndarray
    bias: float
    cuts: np.ndarray | None = None

    @classmethod
    def fresh(cls, rng: np.random.Generator) -> Network:
        banks = [rng.normal(0, 1 / np.sqrt(w * SIZE), (w * SIZE, FILTERS)).astype(np.float32) for w in WIDTHS]
        weights = rng.normal(0, 0.3, FILTERS * len(WIDTHS)).astype(np.float32)
        return cls(rng.normal(0, 0.02, (BUCKETS, SIZE)).astype(np.float32), banks, weights, 0.0)

    def responses(self, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
        """Largest response of every filter in every row (at least 0), the inputs and the responses by width."""
        rows = len(first) - 1
        row = np.repeat(np.arange(rows), np.diff(first))
        words = self.embedding[ids].sum(1)
        pooled, inputs, each = [], [], []
        full = np.flatnonzero(np.diff(first))
        for width, bank in zip(WIDTHS, self.filters):
            x = np.zeros((len(ids), width * SIZE), words.dtype)
            for k in range(width):
                n = max(0, len(ids) - k)
                # Words after the row's end are blanks.
                own = row[:n] == row[k : k + n]
                x[:n, k * SIZE : (k + 1) * SIZE] = words[k : k + n] * own[:, None]
            z = x @ bank
            best = np.zeros((rows, FILTERS), words.dtype)
            if len(full):
                best[full] = np.maximum(np.maximum.reduceat(z, first[full]), 0)
            pooled.append(best)
            inputs.append(x)
            each.append(z)
        return np.concatenate(pooled, 1), inputs, each

    def logits(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        return self.responses(ids, first)[0] @ self.weights + self.bias

    def gradients(self, ids: np.ndarray, first: np.ndarray, label: np.ndarray):
        pooled, inputs, each = self.responses(ids, first)
        p = 1 / (1 + np.exp(-(pooled @ self.weights + self.bias)))
        d = ((p - label) / len(label)).astype(self.embedding.dtype)
        row = np.repeat(np.arange(len(first) - 1), np.diff(first))
        embedding = np.zeros_like(self.embedding)
        banks = []
        for n, (width, bank, x, z) in enumerate(zip(WIDTHS, self.filters, inputs, each)):
            part = slice(n * FILTERS, (n + 1) * FILTERS)
            top = pooled[:, part]
            at, f = np.nonzero((z == top[row]) & (z > 0))
            # The first place of a row's largest response carries the gradient.
            _, once = np.unique(row[at] * FILTERS + f, return_index=True)
            at, f = at[once], f[once]
            g = d[row[at]] * self.weights[part][f]
            change = np.zeros_like(bank)
            np.add.at(change.T, f, x[at] * g[:, None])
            banks.append(change)
            back = bank.T[f] * g[:, None]
            for j in range(width):
                word = np.minimum(at + j, len(ids) - 1)
                own = (row[word] == row[at]) & (at + j < len(ids))
                for k in range(ids.shape[1]):
                    np.add.at(embedding, ids[word[own], k], back[own, j * SIZE : (j + 1) * SIZE])
        loss = -np.log(np.clip(np.where(label == 1, p, 1 - p), 1e-7, 1)).mean()
        return [embedding, *banks, pooled.T @ d], float(d.sum()), float(loss)

    def parameters(self) -> list[np.ndarray]:
        return [self.embedding, *self.filters, self.weights]

    def scores(self, ids: np.ndarray, first: np.ndarray, language: np.ndarray) -> np.ndarray:
        """Probabilities, stretched so that the threshold of a row's language lies at CUT."""
        p = 1 / (1 + np.exp(-self.logits(ids, first).astype(np.float64)))
        cut = self.cuts[language]
        return np.where(p < cut, p / cut * CUT, CUT + (p - cut) / (1 - cut) * (1 - CUT))


def train(texts: pa.Array, label: np.ndarray, rng: np.random.Generator) -> Network:
    """Adam over shuffled batches; whole texts."""
    ids, first = word_ids(texts)
    net = Network.fresh(rng)
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in net.parameters()]
    net.bias, step = 0.0, 0
    while step < STEPS:
        order, losses = rng.permutation(len(label)), []
        for lo in range(0, len(order), BATCH):
            rows = order[lo : lo + BATCH]
            own = np.concatenate([ids[first[r] : first[r + 1]] for r in rows])
            bounds = np.cumsum([0, *(first[r + 1] - first[r] for r in rows)])
            grads, bias, loss = net.gradients(own, bounds, label[rows])
            losses.append(loss)
            step += 1
            net.bias -= RATE * bias
            for p, g, (m, v) in zip(net.parameters(), grads, moments):
                if p is net.embedding:  # only the batch's words
                    at = np.unique(own)
                    m[at] = 0.9 * m[at] + 0.1 * g[at]
                    v[at] = 0.999 * v[at] + 0.001 * g[at] ** 2
                    p[at] -= RATE * (m[at] / (1 - 0.9**step)) / (np.sqrt(v[at] / (1 - 0.999**step)) + 1e-8)
                else:
                    m[:] = 0.9 * m + 0.1 * g
                    v[:] = 0.999 * v + 0.001 * g**2
                    p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        if np.mean(losses) < ENOUGH:
            break
    return net


def threshold(p: np.ndarray, clean: np.ndarray, toxic: np.ndarray) -> float:
    """Middle of the gap at which precision and recall balance best, drawn to 0.5 as if by PRIOR more texts.
    ``p`` are different probabilities, with the clean and toxic texts that have each."""
    if not clean.sum() or not toxic.sum():
        return 0.5
    by = np.argsort(-p, kind="stable")
    p, clean, toxic = p[by], clean[by], toxic[by]
    right = np.cumsum(toxic)
    f1 = 2 * right / (np.cumsum(clean + toxic) + right[-1])
    k = int(f1.argmax())
    below = p[k + 1] if k + 1 < len(p) else 0.0
    edge = np.clip([p[k], below], 1e-3, 1 - 1e-3)
    middle = np.log(edge / (1 - edge)).mean() * right[-1] / (right[-1] + PRIOR)
    return float(1 / (1 + np.exp(-middle)))


def binned_logit(net: Network):
    """A vectorised function from texts to the guessed language and the logit in steps."""

    @F.pandas_udf("struct<language: int, step: int>")
    def binned(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        languages, table = stop_words()
        for series in texts:
            column = pa.Array.from_pandas(series, type=pa.large_string())
            out = [np.zeros((0, 2), np.int64)]
            for a, b in chunks(column, 1 << 18):
                ids, first = word_ids(column[a:b])
                logit = np.clip(net.logits(ids, first).astype(np.float64), -OUTERMOST, OUTERMOST)
                out.append(np.stack([guessed(ids, first, table, len(languages)), np.floor(logit / STEP).astype(np.int64)], 1))
            yield pd.DataFrame(np.concatenate(out).astype(np.int32), columns=["language", "step"])

    return binned


def calibrate(net: Network, rows: DataFrame) -> None:
    """Thresholds from all ``rows`` (text, toxic): one for each guessed language; one with fewer than 20 texts of a
    class shares the common one. What reaches the driver are counts by language and step of the logit."""
    steps = rows.select(binned_logit(net)(F.col("text")).alias("b"), "toxic")
    counts = steps.groupBy("b.language", "b.step").agg(F.count_if(F.col("toxic") == 0).alias("clean"), F.count_if(F.col("toxic") == 1).alias("bad"))
    found = counts.toPandas()  # at most 5 * 2 * OUTERMOST / STEP rows
    languages = len(stop_words()[0])

    def cut(own: pd.DataFrame) -> float:
        own = own.groupby("step", as_index=False)[["clean", "bad"]].sum()
        p = 1 / (1 + np.exp(-(own["step"].to_numpy() + 0.5) * STEP))
        return threshold(p, own["clean"].to_numpy(np.float64), own["bad"].to_numpy(np.float64))

    net.cuts = np.full(languages + 1, cut(found))
    for k in range(languages):
        own = found[found["language"] == k]
        if min(own["clean"].sum(), own["bad"].sum()) >= 20:
            net.cuts[k] = cut(own)


def sampled(docs: DataFrame, labels: DataFrame, sample: int) -> tuple[pa.Array, np.ndarray]:
    """At most ``sample`` labelled texts of each class, the same at every run; one text of an id that repeats."""
    order = F.xxhash64(F.lit(SEED), "doc_id")
    chosen = None
    for value in (0, 1):
        own = labels.where(F.col("toxic") == value).orderBy(order, "doc_id").limit(sample)
        chosen = own if chosen is None else chosen.unionByName(own)
    # The ids are bounded by the sample, so they may be broadcast.
    rows = docs.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).toArrow()
    rows = rows.sort_by([("doc_id", "ascending")])
    return rows["text"].combine_chunks(), rows["toxic"].to_numpy().astype(np.int64)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Network:
    """Learn from a bounded sample of three quarters of the labelled documents (doc_id, text), (doc_id, toxic), one
    label each; calibrate on all of the fourth quarter, so thresholds see the classes as they come at any size."""
    rest = F.pmod(F.xxhash64(F.lit(SEED + 1), "doc_id"), F.lit(4)) == 0
    texts, label = sampled(docs, labels.where(~rest), sample)
    rng = np.random.default_rng(SEED)
    net = train(texts, label, rng) if len(label) else Network.fresh(rng)
    if len(label) == 0:
        net.weights[:] = 0.0
        net.cuts = np.full(len(STOP_WORDS) + 1, 0.9)
        return net
    calibrate(net, docs.join(labels.where(rest), "doc_id").select("text", "toxic"))
    return net


def score_column(net: Network):
    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        languages, table = stop_words()
        for series in texts:
            column = pa.Array.from_pandas(series, type=pa.large_string())
            out = []
            for a, b in chunks(column, 1 << 18):
                ids, first = word_ids(column[a:b])
                out.append(net.scores(ids, first, guessed(ids, first, table, len(languages))))
            yield pd.Series(np.concatenate(out) if out else np.zeros(0))

    return score


def toxicity(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic", sample: int = SAMPLE
) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, score, predicted (1 from a score of CUT on).

    Learns from at most ``sample`` labelled documents of each class that are not held out (null labels
    and labels without document are ignored; one label of 1 makes a document toxic, whatever its others);
    language, source and id are never seen by the network. Thresholds are set by language, guessed from function
    words; a text without any has the common one. Without any labelled row every text scores the same, below CUT. A null or empty text is scored as one without
    words. Repeated rows score alike; rows without doc_id are scored; an empty table gives no rows.
    The network (some 2 MB) travels with the tasks; scoring is one scan.
    """
    base = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).withColumn("held_out", held_out(F.col("doc_id")))
    known = labels.select(F.col(doc_id).alias("doc_id"), F.col(toxic).alias("toxic")).dropna()
    known = known.where(F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    learned = base.where(~F.col("held_out")).select("doc_id", "text")
    net = fit(learned, known.where(~held_out(F.col("doc_id"))), sample)
    scored = base.select("doc_id", "held_out", score_column(net)(F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= CUT).cast("int"))

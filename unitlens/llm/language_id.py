"""Language identification with interpolated Kneser-Ney character models in sorted arrays.

Characters fall into 64 classes, so a four-gram is a number below 2**24: a model has a proven size
whatever the corpus. Counts cover every labelled training document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from unitlens.llm.text import chunks

BITS = 6
OTHER, EDGE = 0, 63
MASKS = {n: (1 << BITS * n) - 1 for n in (1, 2, 3)}
MAX_LANGUAGES = 64
#: A text is strange beyond the quantile of the training documents, each scored by a model of the half that it
#: is not in, times the slack.
REJECT_QUANTILE, REJECT_SLACK = 0.999, 1.1
UNDETERMINED = "und"
#: Bytes of texts that are scored at once.
CHUNK = 1 << 17


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """Class of each code point: 0 no letter, 1 to 26 a to z, 27 to 62 other letters, 63 edge of a text."""
    table = np.zeros(0x110000, np.uint8)
    for point in range(0x110000):
        if chr(point).isalpha():
            table[point] = 27 + point * 2654435761 % (1 << 32) * 36 // (1 << 32)
    table[ord("a") : ord("z") + 1] = np.arange(1, 27)
    table[0] = EDGE
    return table


def four_grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all four-grams of the texts and the text each belongs to; runs of non-letters count once."""
    joined = [("\0\0\0" + t.replace("\0", " ")).lower() for t in texts]
    points = np.frombuffer("".join(joined).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) for t in joined])
    kind = classes()[points]
    keep = kind != OTHER
    keep[1:] |= kind[:-1] != OTHER
    kind, owner = kind[keep].astype(np.int32), owner[keep]
    if len(kind) < 4:
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    codes = (kind[:-3] << 18) | (kind[1:-2] << 12) | (kind[2:-1] << 6) | kind[3:]
    own = kind[3:] != EDGE
    return codes[own], owner[3:][own]


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    codes, place = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return codes, np.bincount(place, np.concatenate([p[1] for p in parts]), len(codes)).astype(np.int64)


def count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Four-gram counts by language and half of a task's documents; each list has a bounded length."""
    found: dict[tuple[str, int], list[tuple[np.ndarray, np.ndarray]]] = {}
    for batch in batches:
        for a, b in chunks(batch.column(0)):
            texts = np.array(batch.column(0)[a:b].to_pylist(), object)
            langs = np.array(batch.column(1)[a:b].to_pylist(), object)
            halves = batch.column(2)[a:b].to_numpy()
            for lang, half in set(zip(langs, halves.tolist())):
                codes, _ = four_grams(texts[(langs == lang) & (halves == half)].tolist())
                parts = found.setdefault((lang, half), [])
                parts.append(np.unique(codes, return_counts=True))
                if len(parts) > 8:
                    found[lang, half] = [merged(parts)]
    for (lang, half), parts in found.items():
        codes, counts = merged(parts)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(codes), pa.string()), pa.array([half] * len(codes), pa.int32())]
            + [pa.array(codes, pa.int32()), pa.array(counts, pa.int64())],
            ["lang", "half", "code", "n"],
        )


def discount(counts: np.ndarray) -> float:
    once, twice = int((counts == 1).sum()), int((counts == 2).sum())
    return once / (once + 2 * twice) if once and twice else 0.5


def interpolated(counts: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Dense conditional probabilities of an order from its counts, and each context's back-off weight."""
    table = counts.reshape(-1, 1 << BITS).astype(np.float64)
    d, total, kinds = discount(counts), table.sum(1), (table > 0).sum(1)
    safe = np.maximum(total, 1)
    weight = np.where(total > 0, d * kinds / safe, 1.0)
    spread = np.tile(lower.reshape(-1, 1 << BITS), (len(table) // (len(lower) >> BITS), 1))
    return (np.maximum(table - d, 0) / safe[:, None] + weight[:, None] * spread).ravel(), weight


def kneser_ney(codes: np.ndarray, counts: np.ndarray, union: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log probabilities of the union's four-grams, of all trigrams, and log back-off weights of contexts."""
    three = np.bincount(codes & MASKS[3], minlength=MASKS[3] + 1)
    two = np.bincount(np.flatnonzero(three) & MASKS[2], minlength=MASKS[2] + 1)
    one = np.bincount(np.flatnonzero(two) & MASKS[1], minlength=MASKS[1] + 1)
    p1, _ = interpolated(one, np.full(1 << BITS, 1.0 / (1 << BITS)))
    p2, _ = interpolated(two, p1)
    p3, _ = interpolated(three, p2)
    d = discount(counts)
    total = np.bincount(codes >> BITS, counts, MASKS[3] + 1)
    kinds = np.bincount(codes >> BITS, minlength=MASKS[3] + 1)
    weight = np.where(total > 0, d * kinds / np.maximum(total, 1), 1.0)
    own = np.zeros(len(union))
    own[np.searchsorted(union, codes)] = np.maximum(counts - d, 0) / total[codes >> BITS]
    p4 = own + weight[union >> BITS] * p3[union & MASKS[3]]
    return tuple(np.log(np.maximum(p, 1e-30)).astype(np.float32) for p in (p4, p3, weight))


@dataclass
class Model:
    """Sorted four-gram codes of all languages with log probabilities, trigrams and back-off weights."""

    languages: list[str]
    codes: np.ndarray
    four: np.ndarray
    three: np.ndarray
    back: np.ndarray

    def log_probabilities(self, codes: np.ndarray) -> np.ndarray:
        if not len(self.codes):
            return self.back[codes >> BITS] + self.three[codes & MASKS[3]]
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        known = self.codes[at] == codes
        out = self.four[at]
        rest = codes[~known]
        out[~known] = self.back[rest >> BITS] + self.three[rest & MASKS[3]]
        return out

    def cross_entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Mean negative log probability of each text in each language, and its number of four-grams."""
        codes, owner = four_grams(texts)
        seen, place = np.unique(codes, return_inverse=True)
        each = self.log_probabilities(seen)
        n = np.bincount(owner, minlength=len(texts))
        sums = np.stack([np.bincount(owner, each[:, k][place], len(texts)) for k in range(len(self.languages))], 1)
        return -sums / np.maximum(n, 1)[:, None], n


def half_of(text: Column) -> Column:
    """0 or 1; equal texts are in the same half."""
    return F.pmod(F.xxhash64(F.lit(9), text), F.lit(2)).cast("int")


def model_of(table: pd.DataFrame) -> Model | None:
    """Models of the languages in a table of counts (lang, code, n); None without any."""
    table = table.groupby(["lang", "code"], as_index=False)["n"].sum().sort_values(["lang", "code"])
    languages = sorted(table["lang"].unique())
    if not languages:
        return None
    union = np.unique(table["code"].to_numpy(np.int32))
    each = []
    for language in languages:
        own = table[table["lang"] == language]
        each.append(kneser_ney(own["code"].to_numpy(np.int32), own["n"].to_numpy(np.float64), union))
    return Model(languages, union, *(np.stack(x, 1) for x in zip(*each)))


def fit(docs: DataFrame, text: str = "text", lang: str = "lang") -> tuple[Model | None, list[Model | None]]:
    """Models of the languages in the labelled rows of ``docs``, and those without each half of them; None
    without any labelled text."""
    rows = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang"), half_of(F.col(text)).alias("half"))
    counted = (
        rows.where("text IS NOT NULL AND lang IS NOT NULL")
        .mapInArrow(count_batches, "lang string, half int, code int, n long")
        .groupBy("lang", "half", "code")
        .agg(F.sum("n").alias("n"))
    )
    # At most 2 * MAX_LANGUAGES * 2**24 rows whatever the corpus; texts of one script have far fewer.
    table: pd.DataFrame = counted.toPandas()
    many = table["lang"].nunique()
    if many > MAX_LANGUAGES:
        raise ValueError(f"{many} languages; at most {MAX_LANGUAGES} are supported")
    return model_of(table), [model_of(table[table["half"] != half]) for half in (0, 1)]


def lettered(text: str | None) -> bool:
    points = np.frombuffer((text or "").replace("\0", " ").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    return bool(classes()[points].any())


@dataclass
class Identifier:
    """Models and, by language, the strangeness beyond which a text is rejected.

    Strangeness is the cross-entropy over 1 + 1 / sqrt(four-grams): the mean of few varies more, so a
    limit for it is a higher limit of cross-entropy for a short text.
    """

    model: Model | None
    limits: dict[str, float]

    def predict(self, column: pa.Array) -> pd.DataFrame:
        """lang_pred, score, cross_entropy and rejected of every text."""
        out = [self.chunk(column[a:b].to_pylist()) for a, b in chunks(column, CHUNK)]
        return pd.concat(out) if out else self.chunk([])

    def chunk(self, texts: list[str | None]) -> pd.DataFrame:
        some = np.array([self.model is not None and lettered(t) for t in texts], bool)
        lang, score, lowest = np.full(len(texts), UNDETERMINED, object), np.zeros(len(texts)), np.full(len(texts), np.nan)
        strange = np.full(len(texts), np.nan)
        if some.any():
            entropy, n = self.model.cross_entropies([t for t, own in zip(texts, some) if own])
            gap = (entropy - entropy.min(1)[:, None]) * np.minimum(n, 100)[:, None]
            lang[some] = np.array(self.model.languages, object)[entropy.argmin(1)]
            score[some], lowest[some] = 1 / np.exp(-gap).sum(1), entropy.min(1)
            strange[some] = entropy.min(1) / (1 + 1 / np.sqrt(np.maximum(n, 1)))
        limit = np.array([self.limits.get(name, np.inf) for name in lang], float)
        rejected = ~some | (np.nan_to_num(strange) > limit)
        columns = {"lang_pred": lang, "score": score, "cross_entropy": lowest, "strangeness": strange, "rejected": rejected}
        return pd.DataFrame(columns)

    def column(self):
        """A vectorised function from texts to the prediction."""

        @F.pandas_udf("struct<lang_pred: string, score: double, cross_entropy: double, strangeness: double, rejected: boolean>")
        def predict(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            for series in texts:
                yield self.predict(pa.Array.from_pandas(series, type=pa.large_string()))

        return predict

    def accepts(self):
        """A vectorised function from texts to whether they are not rejected."""

        @F.pandas_udf("boolean")
        def accepted(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for series in texts:
                yield ~self.predict(pa.Array.from_pandas(series, type=pa.large_string()))["rejected"]

        return accepted


def held_out(doc_id: Column) -> Column:
    """The quarter of the documents that no model learns from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def labelled(docs: DataFrame, doc_id: str, text: str, lang: str) -> DataFrame:
    base = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    return base.withColumn("held_out", held_out(F.col("doc_id")))


def other_half(models: list[Model | None]):
    """A vectorised function from texts and their halves to language and strangeness by the models without them."""

    @F.pandas_udf("struct<lang: string, strangeness: double>")
    def judge(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        own = [Identifier(model, {}) for model in models]
        for texts, halves in parts:
            lang, strange = np.full(len(texts), None, object), np.full(len(texts), np.nan)
            for half in (0, 1):
                at = np.flatnonzero(halves.to_numpy() == half)
                if len(at):
                    found = own[half].predict(pa.Array.from_pandas(texts.iloc[at], type=pa.large_string()))
                    lang[at], strange[at] = found["lang_pred"], found["strangeness"]
            yield pd.DataFrame({"lang": lang, "strangeness": strange})

    return judge


def strangeness_quantiles(train: DataFrame, without: list[Model | None]) -> DataFrame:
    """(lang, q): REJECT_QUANTILE of the strangeness of a language's texts that are taken for it by the models without
    their half; languages without such a text are left out.

    The condition is inside the aggregate: as a filter it would be pushed below the models, which then
    judge every text twice, in two Python workers a task.
    """
    crossed = train.select("lang", other_half(without)(F.col("text"), half_of(F.col("text"))).alias("p"))
    right = F.when(F.col("lang") == F.col("p.lang"), F.col("p.strangeness"))
    return crossed.groupBy("lang").agg(F.percentile_approx(right, REJECT_QUANTILE, 1000).alias("q")).where("q IS NOT NULL")


def learn(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Identifier:
    """The identifier that ``identify`` uses on the same documents."""
    base = labelled(docs, doc_id, text, lang)
    train = base.where("NOT held_out AND text IS NOT NULL AND lang IS NOT NULL")
    model, without = fit(train)
    limits = strangeness_quantiles(train, without).collect()  # at most MAX_LANGUAGES rows
    return Identifier(model, {row["lang"]: row["q"] * REJECT_SLACK for row in limits})


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, lang_pred, score, cross_entropy, rejected.

    The models learn from the rows with text and language that are not held out. A text that is null
    or has no letter is ``und`` with score 0 and rejected, and so is everything if no row is labelled.
    ``rejected`` is also true for a text whose strangeness (see Identifier) lies beyond REJECT_QUANTILE
    of its language's training documents, each scored without the half of the documents it is in, times
    REJECT_SLACK; ``lang_pred`` still names the closest language. A language whose training texts are
    all in one half has no limit.
    Rows without doc_id are training rows. Repeated rows get the same answer, an empty table gives no
    rows, and other columns are not touched.
    """
    answer = learn(docs, doc_id, text, lang).column()
    scored = labelled(docs, doc_id, text, lang).select("doc_id", "held_out", answer(F.col("text")).alias("p"))
    return scored.select("doc_id", "held_out", "p.lang_pred", "p.score", "p.cross_entropy", "p.rejected")

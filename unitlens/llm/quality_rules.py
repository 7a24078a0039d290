"""Quality rules: a threshold table compiled into one projection without user functions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from unitlens.llm.text import STOP_WORDS, WHITE_SPACE_RUN

SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """A ratio of two measures and the range that a good text keeps."""

    name: str
    above: str
    below: str
    least: float | None = None
    most: float | None = None


#: Ratios are per word or per line; a text without words or lines has no ratio and passes the rule.
RULES = (
    Rule("mean_word_chars", "word_chars", "n_words", least=2.0, most=16.0),
    Rule("symbols_per_word", "n_symbols", "n_words", most=0.25),
    Rule("exclamations_per_word", "n_exclamations", "n_words", most=0.25),
    Rule("stop_word_ratio", "n_stop_words", "n_words", least=0.03),
    Rule("dup_line_ratio", "n_dup_lines", "n_lines", most=0.5),
    Rule("bullet_line_ratio", "n_bullet_lines", "n_lines", most=0.9),
    Rule("ellipsis_line_ratio", "n_ellipsis_lines", "n_lines", most=0.3),
)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` mentions it."""
    return F.transform(F.array(value), use)[0]


def count(condition: Column) -> Column:
    return F.size(condition).cast("long")


def repeated_window_words(words: Column, width: int) -> Column:
    """Words inside a window of ``width`` words that the text has twice or more, first one included.

    Windows are compared by 64-bit hashes. Only a text with a repeated window sorts them.
    """

    def of(hashes: Column) -> Column:
        def covered(pairs: Column) -> Column:
            def twin(x: Column, i: Column) -> Column:
                left = (i > 0) & (F.get(pairs, i - 1)["h"] == x["h"])
                right = (i + 1 < F.size(pairs)) & (F.get(pairs, i + 1)["h"] == x["h"])
                return left | right

            at = F.sort_array(F.transform(F.filter(pairs, twin), lambda x: x["i"]))
            start = F.struct(F.lit(-width).alias("last"), F.lit(0).alias("total"))
            return F.aggregate(
                at,
                start,
                lambda a, x: F.struct(
                    x.alias("last"), (a["total"] + F.least(F.lit(width), x - a["last"])).alias("total")
                ),
                lambda a: a["total"],
            )

        indexed = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(
            bound(F.sort_array(indexed), covered)
        )

    places = F.sequence(F.lit(0), F.size(words) - width)
    windows = F.transform(places, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(width)]))
    return F.when(F.size(words) < width, F.lit(0)).otherwise(bound(windows, of)).cast("long")


def measures(text: Column) -> Column:
    """All measures of a text as one struct."""
    text = F.coalesce(text, F.lit(""))
    stop = sorted({w for words in STOP_WORDS.values() for w in words.split()})

    def of(both: Column) -> Column:
        words, lines = both["words"], both["lines"]
        return F.struct(
            count(words).alias("n_words"),
            F.aggregate(words, F.lit(0), lambda a, w: a + F.char_length(w)).cast("long").alias("word_chars"),
            F.char_length(F.regexp_replace(text, f"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
            (count(lines) - F.size(F.array_distinct(lines))).alias("n_dup_lines"),
            repeated_window_words(words, 3).alias("n_repeat_words"),
            (F.char_length(text) - F.char_length(F.replace(text, F.lit("!"), F.lit("")))).cast("long").alias("n_exclamations"),
            count(F.filter(words, lambda w: F.lower(w).isin(stop))).alias("n_stop_words"),
            count(lines).alias("n_lines"),
            count(F.filter(lines, lambda x: F.ltrim(x).substr(1, 1).isin("-", "*", "•"))).alias("n_bullet_lines"),
            count(F.filter(lines, lambda x: F.rtrim(x).endswith("..."))).alias("n_ellipsis_lines"),
        )

    words = F.filter(F.split(text, WHITE_SPACE_RUN), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return bound(F.struct(words.alias("words"), lines.alias("lines")), of)


def base_failed(m: Column, min_words: int = 50, most_repeated: int = 50) -> Column:
    return (m["n_words"] < min_words) | (100 * m["n_repeat_words"] > most_repeated * m["n_words"])


def broken_rules(m: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """Names of the rules that a text breaks."""

    def broken(rule: Rule) -> Column:
        ratio = F.try_divide(m[rule.above].cast("double"), m[rule.below].cast("double"))
        low = F.lit(False) if rule.least is None else ratio < rule.least
        high = F.lit(False) if rule.most is None else ratio > rule.most
        return F.when(low | high, F.lit(rule.name))

    return F.filter(F.array(*[broken(rule) for rule in rules]), lambda x: x.isNotNull())


def quality(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Every row of ``docs`` with a struct ``quality``: the measures, base_failed, broken rules, kept.

    A null text counts as empty: no word, base_failed. Repeated rows are judged alike; an empty
    table gives an empty result. One projection of one scan: no shuffle. Other columns are kept;
    a column that is called quality already is replaced.
    """
    judged = docs.withColumn("quality", measures(F.col(text)))
    m = F.col("quality")
    return judged.withColumn(
        "quality",
        F.struct(m.alias("measures"), base_failed(m).alias("base_failed"), broken_rules(m, rules).alias("broken")),
    ).withColumn("quality", m.withField("kept", ~m["base_failed"] & (F.size(m["broken"]) == 0)))

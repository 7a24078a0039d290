"""How many Python workers a task needs at once: each holds some 100 MB of an executor."""

from __future__ import annotations

from pyspark.sql import functions as F

from unitlens.llm import language_id, ngram_join

COLUMNS = "doc_id long, text string, lang string"


def test_texts_are_judged_once_for_the_limits(spark):
    rows = [(k, f"the cat of {k} and the dog" if k % 2 else f"der hund von {k} und die katze", "en" if k % 2 else "de") for k in range(60)]
    rows += [(60, "xyz", "fr"), (61, "... !!", "en")]
    train = spark.createDataFrame(rows, COLUMNS)
    _, without = language_id.fit(train)
    limits = language_id.strangeness_quantiles(train, without)
    plan = limits._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    judged = train.select("lang", language_id.other_half(without)(F.col("text"), language_id.half_of(F.col("text"))).alias("p")).collect()
    own = {lang: [r.p.strangeness for r in judged if r.lang == lang == r.p.lang] for lang in ("en", "de", "fr")}
    got = {r.lang: r.q for r in limits.collect()}
    assert got == {lang: sorted(x)[-1] for lang, x in own.items() if x} and set(got) >= {"en", "de"}


def test_sets_are_filtered_before_they_are_compared(spark, monkeypatch):
    """No written table's tasks run one Python step behind another."""
    text = " ".join(f"w{k}" for k in range(200))
    rows = [(k, text.replace(f"w{k * 7} ", "other "), "en") for k in range(20)] + [(30, "alone here", "en")]
    most = []

    def written(df, merged=1):
        lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
        chain = 0
        for line in lines:
            chain = 0 if "Exchange" in line else chain + ("ArrowEvalPython" in line or "MapInArrow" in line)
            most.append(chain)
        return plain(df, merged)

    plain = ngram_join.written
    monkeypatch.setattr(ngram_join, "written", written)
    found = {r.doc_id: r.component_id for r in ngram_join.ngram_join(spark.createDataFrame(rows, COLUMNS)).collect()}
    assert found == {**dict.fromkeys(range(20), 0), 30: 30} and max(most) == 1

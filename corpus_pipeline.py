"""A corpus pipeline: language, near copies, contamination, mixture, token rows.

Each stage gets all documents that the stage before kept, written as Parquet and read again; all but
the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from unitlens.llm.decontamination import contaminated
from unitlens.llm.language_id import learn
from unitlens.llm.mixing import mix_sources
from unitlens.llm.ngram_join import Jaccard, ngram_join
from unitlens.llm.repeats import among, bit_filter
from unitlens.llm.scratch import ship_package, written
from unitlens.llm.token_output import Tokenizer, pack


#: Near copies share four fifths of their runs of five words; op4's rule is stricter and its own.
NEAR = Jaccard(width=5, percent=80)


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with the rows' numbers in the scan, as the operators count them, in a column of a new name."""
    name = "rid"
    while name in docs.columns:
        name += "_"
    return docs.withColumn(name, F.monotonically_increasing_id()), name


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is determined and whose text is like that language's others."""
    ship_package(spark)
    return docs.where(learn(docs).accepts()(F.col("text")))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (NEAR): the one with the smallest id.

    Only rows that pass a bitmap of those to go are shuffled, to be told apart; the others stay where they are.
    """
    ship_package(spark)
    rows, rid = numbered(docs)
    gone = written(ngram_join(docs, rule=NEAR).where("NOT first").select(F.col("rid").alias(rid)), 8)
    bits = spark.sparkContext.broadcast(bit_filter(gone.select(F.xxhash64(rid).alias("value"))))
    maybe = among(bits)(F.xxhash64(rid))
    kept = rows.where(~maybe).unionByName(rows.where(maybe).join(gone, rid, "left_anti"))
    return kept.select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any passage of the benchmark."""
    ship_package(spark)
    rows, rid = numbered(docs)
    found = contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return rows.join(found.select(F.col("rid").alias(rid)), rid, "left_anti").select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them; those that it leaves out go."""
    ship_package(spark)
    rows, rid = numbered(docs)
    copies = mix_sources(rows, carry=(rid,)).where("copies > 0").select(rid, F.col("copies").alias(rid + "#"))
    taken = rows.join(copies, rid).withColumn(rid, F.explode(F.sequence(F.lit(1), F.col(rid + "#"))))
    return taken.select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of token ids of one length."""
    ship_package(spark)
    return pack(docs, Tokenizer.read())


STAGES = [
    ("language", language),
    ("near_copies", near_copies),
    ("decontamination", decontamination),
    ("mixture", mixture),
    ("tokens", tokens),
]

#: Not for SQL: models, walks and draws; the tests compare each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

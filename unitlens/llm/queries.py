"""One query per operator, over whole tables, and the same results in DuckDB SQL where it can say them."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from unitlens.llm.decontamination import contaminated
from unitlens.llm.language_id import identify
from unitlens.llm.line_dedup import line_dedup
from unitlens.llm.merkle_manifest import folded, leaf, manifest, proof
from unitlens.llm.mixing import mix_sources
from unitlens.llm.ngram_join import ngram_join
from unitlens.llm.oracle import ORACLE as ORACLE
from unitlens.llm.phrase_mining import collocations
from unitlens.llm.quality_rules import quality
from unitlens.llm.scratch import ship_package
from unitlens.llm.simhash_dedup import simhash_dedup
from unitlens.llm.substring_dedup import substring_dedup
from unitlens.llm.suffix_dedup import suffix_dedup
from unitlens.llm.token_output import Tokenizer, pack
from unitlens.llm.toxicity import toxicity


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    judged = quality(table(spark, folder, "documents").select("doc_id", "text"))
    q = F.col("quality")
    shown = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return judged.select(
        "doc_id", *[q["measures"][x].alias(x) for x in shown], q["base_failed"].alias("base_failed"), q["kept"].alias("kept")
    )


def op2_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mix_sources(table(spark, folder, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies")


def op3_token_output(spark: SparkSession, folder: str) -> DataFrame:
    return pack(table(spark, folder, "documents").select("doc_id", "text"), Tokenizer.read())


def op5_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    docs, items = table(spark, folder, "documents"), table(spark, folder, "benchmark")
    return contaminated(docs.select("doc_id", "text"), items.select("item_id", "text")).drop("rid")


def op4_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    joined = ngram_join(table(spark, folder, "documents").select("doc_id", "text"))
    return joined.select("doc_id", "n_shingles", "component_id")


def op6_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup(table(spark, folder, "documents").select("doc_id", "text")).drop("rid")


def op7_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    kept = suffix_dedup(table(spark, folder, "documents").select("doc_id", "text"), keep_first=False)
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op8_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    kept = substring_dedup(table(spark, folder, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op9_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return identify(table(spark, folder, "documents")).select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op10_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity(table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "labels"))


def op11_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    columns = ("doc_id", "source", "lang", "n_chars", "text")
    odd = F.crc32(F.col("doc_id").cast("string")) % 2 == 1
    tampered = F.replace(F.col("text"), F.lit("\n"), F.lit(""))
    values = [F.col(c) for c in columns[:-1]]
    shown = F.when(F.coalesce(odd, F.lit(True)), leaf(*values, F.col("text"))).otherwise(leaf(*values, tampered))
    rows = manifest(table(spark, folder, "documents").select(*columns), columns, claimed=shown)
    folds = rows.withColumn("folded_root", folded(F.col("claimed"), F.col("path")))
    return folds.select(
        "doc_id", "leaf", "subroot", "root", proof(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified")
    )


def op12_phrase_mining(spark: SparkSession, folder: str) -> DataFrame:
    return collocations(table(spark, folder, "documents").select("lang", "text"))


def op13_simhash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    rows = simhash_dedup(table(spark, folder, "documents").select("doc_id", "text"))
    return rows.select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")


def shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @wraps(query)
    def run(spark: SparkSession, folder: str) -> DataFrame:
        ship_package(spark)
        return query(spark, folder)

    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: shipped(f) for f in (op1_quality_rules, op2_source_mixing, op3_token_output, op4_ngram_jaccard_join, op5_decontamination, op6_line_dedup, op7_suffix_dedup, op8_substring_dedup, op9_language_id, op10_toxicity, op11_merkle_manifest, op12_phrase_mining, op13_simhash_dedup)
}

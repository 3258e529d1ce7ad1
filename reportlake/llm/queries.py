"""Registered queries of this subpackage: thin digests of the operators' results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from reportlake.llm.common import table, tuned
from reportlake.llm.sql import oracles

LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
LLM_ORACLES: dict[str, str] = oracles()


def query(name: str):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(tuned(spark), sf_dir)
        run.__name__, run.__doc__ = name, fn.__doc__
        LLM_QUERIES[name] = run
        return fn
    return deco


def tokenizer_path(name: str) -> str:
    """Where the box keeps a public tokenizer file."""
    import public_tokenizers
    return public_tokenizers.path(name)


@query("op1_quality_rules")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from reportlake.llm.quality_rules import quality_rules
    return quality_rules(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op2_license_scan")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from reportlake.llm.licenses import license_scan
    return license_scan(table(spark, sf_dir, "documents")).drop("detections")


@query("op3_bpe")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from reportlake.llm.bpe import bpe_round_trip
    return bpe_round_trip(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


@query("op4_secret_scan")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from reportlake.llm.secret_scan import secret_spans
    return secret_spans(table(spark, sf_dir, "documents")).drop("secrets")


@query("op5_near_dedup")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from reportlake.llm.near_dedup import near_duplicates
    return near_duplicates(table(spark, sf_dir, "documents"), words=2)


@query("op8_token_counts")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from reportlake.llm.token_counts import token_counts
    return token_counts(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


@query("op6_decontamination")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from reportlake.llm.decontaminate import contamination
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op7_language_id")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from reportlake.llm.language_id import languages
    return languages(table(spark, sf_dir, "documents")).drop("spans")


@query("op9_quality_classifier")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from reportlake.llm.quality_model import quality_scores
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op10_substring_dedup")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from reportlake.llm.substring_dedup import repeated_passages
    return repeated_passages(table(spark, sf_dir, "documents")).drop("removed")


@query("op11_hard_negatives")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    from reportlake.llm.hard_negatives import hard_negatives
    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", moved), anchor=F.col("vec_id") % 100 == 0)


@query("op12_periodic_runs")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from reportlake.llm.periodic_runs import periodic_runs, runs_text, with_repeats
    docs = table(spark, sf_dir, "documents")
    seed = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    found = periodic_runs(docs.select("doc_id", with_repeats(F.col("text"), seed).alias("text")))
    return found.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(runs_text(F.col("runs")), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


@query("op13_toxicity")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    from reportlake.llm.toxicity import toxicity
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("evidence")

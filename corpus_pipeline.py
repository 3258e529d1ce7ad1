"""The corpus pipeline: documents in, token ids out, by the operators of ``reportlake.llm``.

``STAGES`` lists (name, function); each function takes ``(spark, docs, sf_dir)``
and returns a DataFrame. ``run`` applies them in order and writes each result
as Parquet into the session's shared folder, from where the next stage reads
it, so a lost executor costs at most one stage's tasks.

Every stage decides about each row from its own input, accepts null or empty
texts, null ids, repeated rows, very long texts, extra columns of any name and an
empty table (which gives an empty one), and all but the last return their input's
columns.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession, functions as F

from reportlake.llm.common import table, tuned
from reportlake.llm.queries import tokenizer_path
from reportlake.session import scratch_path, scratch_scope


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; ``labels`` teach it, as far
    as they cover the documents given. Null and empty texts are scored as empty,
    null ids like any other; repeated rows stay or go together."""
    from reportlake.llm.quality_model import keep_good
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, similarity 0.8). Null and
    empty texts and null ids are no duplicates and stay; a row repeated in id and text
    stays once; texts of one id are documents of their own."""
    from reportlake.llm.near_dedup import keep_one
    return keep_one(docs, words=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of ``benchmark``. Null and empty texts hold none and
    stay, whatever their ids; repeated rows stay or go together; without items all stay."""
    from reportlake.llm.decontaminate import drop_contaminated
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret, plain or nested in encodings, is replaced by a mark; all
    documents stay, empty and repeated ones and null ids too, with ``n_chars`` of the new
    text (unchanged for a null text)."""
    from reportlake.llm.secret_scan import redact_secrets
    clean = redact_secrets(docs)
    n_chars = F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars"))
    return clean.withColumn("n_chars", n_chars).select(*docs.columns)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with the digest of what they decode to; null and empty
    texts have none, null ids and repeated rows are kept."""
    from reportlake.llm.bpe import bpe_round_trip
    return bpe_round_trip(docs, tokenizer_path("byte_bpe_50k.json"), keep_ids=True)


def _tuned(stage):
    """The stage with the session set up for it, also when it is called alone."""
    @functools.wraps(stage)
    def call(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        return stage(tuned(spark), docs, sf_dir)
    return call


STAGES = [(name, _tuned(stage)) for name, stage in (
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("bpe", bpe),
)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the rows of the last one. What a stage staged, and
    the result it read, are removed when its own result is written."""
    docs, before = table(spark, sf_dir, "documents"), ()
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        with scratch_scope(spark, *before):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs, before = spark.read.parquet(path), (path,)
    return docs

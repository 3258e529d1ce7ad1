"""Catalogue tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reportlake.functions import scalars as S

TEMPLATE_TIME_COLUMNS = ["schedule_last_run", "schedule_next_run", "created_at", "updated_at"]
RUN_TIME_COLUMNS = ["generated_at"]


def parse_time_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Add ``<col>_ts`` (UTC TIMESTAMP_NTZ) for ISO text columns; unparseable
    text -> null (S8)."""
    for c in columns:
        if c in df.columns and dict(df.dtypes)[c] == "string":
            df = df.withColumn(f"{c}_ts", S.parse_iso_utc(c))
    return df


def load_catalog(spark: SparkSession, base: str) -> tuple[DataFrame, DataFrame]:
    """Read ``report_templates`` and ``generated_reports`` Parquet tables from
    ``base`` with their ISO text timestamps parsed (S8)."""
    t = spark.read.parquet(f"{base.rstrip('/')}/report_templates")
    r = spark.read.parquet(f"{base.rstrip('/')}/generated_reports")
    return parse_time_columns(t, TEMPLATE_TIME_COLUMNS), parse_time_columns(r, RUN_TIME_COLUMNS)


def write_bucketed(df: DataFrame, table: str, key: str, buckets: int, path: str | None = None) -> DataFrame:
    """Store a catalogue table bucketed and sorted by ``key`` (e.g. the run
    log by ``template_id``, templates by ``id`` with the same bucket count).
    Later per-template aggregates, windows and joins on that key read the
    buckets as co-partitioned input and skip the shuffle. With ``path`` the
    table is external (its files live there, e.g. in the shared folder)."""
    w = df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).format("parquet")
    if path:
        w = w.option("path", path)
    w.saveAsTable(table)
    return df.sparkSession.table(table)

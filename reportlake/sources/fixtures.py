"""Fixture views: the report-studio inputs derived from the landed tables.

Each view is a lazy DataFrame over the TPC-H-style tables, so its size grows
with the data. The DuckDB oracle builds the same views in SQL
(``reportlake.plans.oracle.FX_SQL``).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reportlake import constants as K
from reportlake.functions import scalars as S
from reportlake.sources.tables import read_table

ISO_FMT = "yyyy-MM-dd'T'HH:mm:ss"


def severity_of(priority: Column) -> Column:
    """Order priority -> severity name (the fixture's severity mapping)."""
    return (F.when(priority == "1-URGENT", "Critical")
            .when(priority == "2-HIGH", "High")
            .when(priority == "3-MEDIUM", "Medium")
            .when(priority == "5-LOW", "Low")
            .otherwise("Unrated"))


def _ts(y, m, d, h=0, mi=0) -> Column:
    return S.ntz(dt.datetime(y, m, d, h, mi))


def _plus_minutes(ts: Column, minutes: Column) -> Column:
    return ts + F.make_dt_interval(F.lit(0), F.lit(0), minutes.cast("long"), F.lit(0))


def _iso(ts: Column) -> Column:
    return F.date_format(ts, ISO_FMT)


def fx_history(spark: SparkSession, d: str) -> DataFrame:
    """Monthly vulnerability counts per severity and zone."""
    o = read_table(spark, d, "orders").select("o_custkey", "o_orderdate", "o_orderpriority")
    c = read_table(spark, d, "customer").select("c_custkey", "c_nationkey")
    n = read_table(spark, d, "nation").select("n_nationkey", "n_regionkey")
    j = (o.join(c, o.o_custkey == c.c_custkey)
         .join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")))  # 25-row dim
    return (j.groupBy(
                F.trunc("o_orderdate", "month").cast("timestamp_ntz").alias("timestamp"),
                severity_of(F.col("o_orderpriority")).alias("vuln_severity"),
                (F.col("n_regionkey") + 1).alias("zone_id"))
            .agg(F.count(F.lit(1)).alias("value"))
            .select("timestamp", "value", "vuln_severity", "zone_id"))


def fx_customer_history(spark: SparkSession, d: str) -> DataFrame:
    """One history point per order, keyed by customer."""
    o = read_table(spark, d, "orders")
    return o.select(F.col("o_custkey").alias("customer_id"),
                    F.col("o_orderdate").alias("timestamp"),
                    F.floor("o_totalprice").cast("bigint").alias("value"),
                    severity_of(F.col("o_orderpriority")).alias("vuln_severity"))


def fx_zones(spark: SparkSession, d: str) -> DataFrame:
    r = read_table(spark, d, "region")
    return r.select((F.col("r_regionkey") + 1).alias("id"), F.col("r_name").alias("name"))


def fx_templates(spark: SparkSession, d: str) -> DataFrame:
    """Report templates with schedules, one per customer."""
    c = read_table(spark, d, "customer").select("c_custkey", "c_name")
    k = F.col("c_custkey")
    last_base = _plus_minutes(_ts(2024, 4, 1, 8), (k * 7) % 150)
    last_text = F.concat(_iso(last_base),
                         F.when((k % 8).isin(3, 4), "+00:00").when(k % 8 == 5, "Z")
                         .when(k % 8 == 6, "").otherwise("+10:00"))
    return c.select(
        k.alias("id"),
        F.col("c_name").alias("name"),
        F.when(k % 19 == 18, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit('{"global": {"customer": "'), F.col("c_name"), F.lit('"}}')))
         .alias("config_yaml"),
        F.when(k % 10 == 0, 0).otherwise(1).alias("schedule_enabled"),
        F.when(k % 5 == 0, "daily").when(k % 5 == 1, "weekly").when(k % 5 == 2, "monthly")
         .when(k % 5 == 3, "daily").otherwise(F.lit(None).cast("string")).alias("schedule_frequency"),
        F.when(k % 11 == 10, None).otherwise(k % 24).cast("int").alias("schedule_hour"),
        F.when(k % 13 == 12, None).otherwise(k % 7).cast("int").alias("schedule_day_of_week"),
        F.when(k % 17 == 16, None).otherwise(k % 28 + 1).cast("int").alias("schedule_day_of_month"),
        F.when(k % 4 == 0, "UTC").when(k % 4 == 1, "Australia/Sydney").when(k % 4 == 2, "Not/AZone")
         .otherwise(F.lit(None).cast("string")).alias("schedule_timezone"),
        F.when(k % 6 == 0, None).when(k % 6 == 1, 0).otherwise(k % 6).cast("int")
         .alias("schedule_retain_count"),
        F.when(k % 8 == 0, F.lit(None).cast("string")).when(k % 8 == 1, "garbage")
         .when(k % 8 == 2, "").otherwise(last_text).alias("schedule_last_run"),
        F.concat(_iso(_plus_minutes(_ts(2023, 1, 1), k)), F.lit("+00:00")).alias("created_at"),
        F.concat(_iso(_plus_minutes(_ts(2023, 6, 1), (k * 37) % 100000)), F.lit("+00:00"))
         .alias("updated_at"),
    )


def fx_reports(spark: SparkSession, d: str) -> DataFrame:
    """Run log, one run per order; every 50th points at a missing template."""
    o = read_table(spark, d, "orders")
    k = F.col("o_orderkey")
    failed = F.col("o_orderstatus") == "F"
    return o.select(
        k.alias("id"),
        F.when(k % 50 == 0, F.col("o_custkey") + 1000000).otherwise(F.col("o_custkey")).alias("template_id"),
        F.concat(F.lit("run_"), k.cast("string"), F.lit(".pdf")).alias("filename"),
        F.concat(F.lit("/reports/run_"), k.cast("string"), F.lit(".pdf")).alias("file_path"),
        F.when(failed, None).otherwise(F.floor("o_totalprice")).cast("bigint").alias("file_size"),
        F.when(failed, "failed").otherwise("success").alias("status"),
        F.when(failed, F.concat(F.lit("error: "), F.col("o_orderpriority"))).alias("error_message"),
        F.col("o_orderdate").alias("generated_at"),
    )


def fx_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Six blocks per template with varied widths and all eight types."""
    c = read_table(spark, d, "customer").select("c_custkey")
    blocks = c.select(F.col("c_custkey").alias("template_id"),
                      F.explode(F.sequence(F.lit(0), F.lit(5))).alias("block_idx"))
    t, b = F.col("template_id"), F.col("block_idx")
    w = (t + b * 3) % 5
    ty = (t + b) % 8
    width = (F.when(w == 0, "full").when(w == 1, "half").when(w == 2, "half")
             .when(w == 3, F.lit(None).cast("string")).otherwise("half"))
    tcol = F.element_at(F.array(*[F.lit(x) for x in K.BLOCK_TYPES]), (ty + 1).cast("int"))
    return blocks.select("template_id", "block_idx", width.alias("width"), tcol.alias("type"))


def fx_blocks_full(spark: SparkSession, d: str) -> DataFrame:
    """fx_blocks plus the optional block settings, some left unset."""
    b = fx_blocks(spark, d)
    t, i, ty = F.col("template_id"), F.col("block_idx"), F.col("type")
    query_types = ["traffic_lights", "vertical_bar", "horizontal_bar", "pie_chart", "table"]
    return b.select(
        "template_id", "block_idx", "width", "type",
        F.when((t + i) % 4 == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("Block "), i.cast("string"))).alias("title"),
        F.when(t % 3 == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("About "), ty)).alias("description"),
        F.when(ty == "history", F.when(t % 3 == 0, None).otherwise(t % 40 + 1))
         .when(ty == "trend_summary", 7).cast("int").alias("days"),
        F.when(ty.isin("history", "trend_summary"), t % 6).cast("int").alias("zone_id"),
        F.when(ty.isin(*query_types),
               F.when(t % 7 == 0, F.lit(None).cast("string"))
               .otherwise(F.concat(F.lit("q"), (t % 3).cast("string")))).alias("query"),
        F.when(t % 2 == 0, F.lit(None).cast("boolean")).otherwise(t % 4 == 1).alias("show_legend"),
        F.when(ty.isin("vertical_bar", "horizontal_bar"), (t % 14) * 50 + 150).cast("int")
         .alias("chart_height"),
    )


def fx_workloads(spark: SparkSession, d: str) -> DataFrame:
    p = read_table(spark, d, "part")
    return p.select(F.col("p_partkey").alias("workload_id"), F.col("p_name").alias("name"))


def fx_edges(spark: SparkSession, d: str) -> DataFrame:
    li = read_table(spark, d, "lineitem")
    return li.select(F.col("l_partkey").alias("workload_id"), F.col("l_orderkey").alias("vuln_id"))


def fx_vulns(spark: SparkSession, d: str) -> DataFrame:
    o = read_table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("vuln_id"),
                    severity_of(F.col("o_orderpriority")).alias("severity"))


def fx_old_schedules(spark: SparkSession, d: str) -> DataFrame:
    s = read_table(spark, d, "supplier")
    k = F.col("s_suppkey")
    return s.select(
        k.alias("id"), F.col("s_name").alias("name"), F.lit("{}").alias("config_yaml"),
        F.lit(1).alias("enabled"), F.lit("daily").alias("frequency"),
        (k % 24).cast("int").alias("hour"),
        F.lit(None).cast("int").alias("day_of_week"), F.lit(None).cast("int").alias("day_of_month"),
        F.lit("UTC").alias("timezone"), (k % 12).cast("int").alias("retain_count"),
        F.lit(None).cast("string").alias("last_run"),
        F.lit("2022-01-01T00:00:00+00:00").alias("created_at"),
        F.lit("2022-01-01T00:00:00+00:00").alias("updated_at"))


def fx_old_reports(spark: SparkSession, d: str) -> DataFrame:
    o = read_table(spark, d, "orders")
    k = F.col("o_orderkey")
    return o.select(
        k.alias("id"), (k % 120).alias("schedule_id"),
        F.concat(F.lit("old_"), k.cast("string"), F.lit(".pdf")).alias("filename"),
        F.concat(F.lit("/old/old_"), k.cast("string"), F.lit(".pdf")).alias("file_path"),
        F.floor("o_totalprice").cast("bigint").alias("file_size"),
        F.lit("success").alias("status"), F.lit(None).cast("string").alias("error_message"),
        F.col("o_orderdate").alias("generated_at"))


def fx_iso(spark: SparkSession, d: str) -> DataFrame:
    e = read_table(spark, d, "events")
    k, ts = F.col("event_id"), F.col("ts")
    return e.select(k, F.when(k % 5 == 0, F.concat(_iso(ts), F.lit("Z")))
                    .when(k % 5 == 1, _iso(ts))
                    .when(k % 5 == 2, "not-a-date-but-long")
                    .when(k % 5 == 3, "")
                    .otherwise(F.lit(None).cast("string")).alias("iso"))


def fx_ticks(spark: SparkSession, d: str) -> DataFrame:
    """Poll instants (UTC): the 30-minute slots that saw events, moved 84 days
    forward so they span the Sydney fall-back of 2024-04-07."""
    e = read_table(spark, d, "events").select("ts")
    ts = F.col("ts")
    slot = F.make_timestamp_ntz(F.year(ts), F.month(ts), F.dayofmonth(ts), F.hour(ts),
                                F.floor(F.minute(ts) / 30) * 30, F.lit(0))
    return (e.select((slot + F.expr("INTERVAL 84 DAYS")).alias("tick")).distinct())

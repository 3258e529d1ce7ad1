"""Registered frame and scalar queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from reportlake.functions import scalars as S
from reportlake.operators import catalog as C
from reportlake.operators import frames as FR
from reportlake.plans.registry import query
from reportlake.sources import fixtures as FX
from reportlake.sources.tables import TABLES, read_table


def severity_frames(spark, d):
    """Per-customer frame: orders counted per severity."""
    return (FX.fx_customer_history(spark, d).groupBy("customer_id", "vuln_severity")
            .agg(F.count(F.lit(1)).alias("value")))


def zone_frames(spark, d):
    """Per-zone frame: summed history value per severity."""
    return (FX.fx_history(spark, d).groupBy("zone_id", "vuln_severity")
            .agg(F.sum("value").cast("bigint").alias("value")))


def user_frames(spark, d):
    """Per-user table frames with ISO-looking text columns."""
    e = read_table(spark, d, "events")
    k, ts = F.col("event_id"), F.col("ts")
    iso = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    return e.select("user_id", "event_id",
                    F.concat(iso, F.lit("Z")).alias("iso_z"),
                    F.when(k % 5 == 0, F.concat(iso, F.lit("Z"))).when(k % 5 == 1, iso)
                    .when(k % 5 == 2, "not-a-date-but-long").when(k % 5 == 3, "")
                    .otherwise(F.lit(None).cast("string")).alias("iso_mix"),
                    F.when(F.col("user_id") % 3 == 0, F.lit(None).cast("string"))
                    .otherwise(F.concat(iso, F.lit("+02:00"))).alias("iso_off"),
                    "event_type")


@query("detect_columns")
def q_detect_columns(spark, d):
    rows = []
    for t in TABLES:
        cat, val = FR.detect_columns(read_table(spark, d, t).schema)
        rows.append((t, cat, val))
    schema = T.StructType([T.StructField("table_name", T.StringType()),
                           T.StructField("cat_col", T.StringType()),
                           T.StructField("val_col", T.StringType())])
    return spark.createDataFrame(rows, schema)


@query("pie_shares")
def q_pie_shares(spark, d):
    return FR.pie_shares(severity_frames(spark, d), "vuln_severity", "value", keys=["customer_id"])


@query("pie_shares_single_frame")
def q_pie_single(spark, d):
    frame = C.severity_counts(FX.fx_workloads(spark, d), FX.fx_edges(spark, d), FX.fx_vulns(spark, d),
                              limit=None)
    return FR.pie_shares(frame, "Severity", "Vulnerabilities")


@query("has_severity")
def q_has_severity(spark, d):
    from reportlake.sources.fixtures import severity_of
    o = read_table(spark, d, "orders")
    frame = o.select(F.col("o_custkey").alias("customer_id"),
                     F.when(F.col("o_custkey") % 3 == 0, F.col("o_orderpriority"))
                     .otherwise(severity_of(F.col("o_orderpriority"))).alias("category"))
    return FR.has_severity(frame, "category", keys=["customer_id"])


@query("record_counts")
def q_record_counts(spark, d):
    return FR.record_counts(FX.fx_reports(spark, d), keys=["template_id"])


@query("traffic_light_tiles")
def q_tiles(spark, d):
    return FR.traffic_light_tiles(zone_frames(spark, d), "vuln_severity", "value",
                                  order_by=["vuln_severity"], keys=["zone_id"])


@query("bar_series")
def q_bar_series(spark, d):
    from reportlake.sources.fixtures import severity_of
    o = read_table(spark, d, "orders")
    frame = o.select(F.col("o_custkey").alias("customer_id"), "o_orderkey",
                     severity_of(F.col("o_orderpriority")).alias("severity"),
                     F.floor("o_totalprice").cast("bigint").alias("amount"))
    return FR.bar_series(frame, "severity", "amount", order_by=["o_orderkey"], keys=["customer_id"])


@query("datetime_columns")
def q_datetime_columns(spark, d):
    return FR.datetime_columns(user_frames(spark, d), order_by="event_id", keys=["user_id"],
                               columns=["iso_z", "iso_mix", "iso_off", "event_type"])


@query("datetime_columns_print")
def q_datetime_columns_print(spark, d):
    return FR.datetime_columns(user_frames(spark, d), order_by="event_id", keys=["user_id"],
                               rule="print", columns=["iso_z", "iso_mix", "iso_off", "event_type"])


@query("fmt_datetime_columns")
def q_fmt_datetime_columns(spark, d):
    return FR.fmt_datetime_columns(user_frames(spark, d), order_by="event_id", keys=["user_id"],
                                   columns=["iso_z", "iso_mix", "iso_off", "event_type"])


@query("fmt_datetime_columns_print")
def q_fmt_datetime_columns_print(spark, d):
    return FR.fmt_datetime_columns(user_frames(spark, d), order_by="event_id", keys=["user_id"], rule="print",
                                   columns=["iso_z", "iso_mix", "iso_off", "event_type"])


@query("column_widths")
def q_column_widths(spark, d):
    return FR.column_widths(read_table(spark, d, "customer"), width=100.0)


@query("fmt_thousands")
def q_fmt_thousands(spark, d):
    o = read_table(spark, d, "orders")
    v = (F.floor("o_totalprice") * F.when(F.col("o_orderkey") % 2 == 0, -1).otherwise(1)).cast("bigint")
    return o.select("o_orderkey", S.fmt_thousands(v).alias("text"))


@query("iso_to_display")
def q_iso_to_display(spark, d):
    return FX.fx_iso(spark, d).select("event_id", S.iso_to_display("iso", "Australia/Sydney").alias("display"))


@query("truncate_cells")
def q_truncate(spark, d):
    p = read_table(spark, d, "pages")
    return p.select("page_id", S.truncate_cell("url").alias("url"))


@query("report_filename")
def q_report_filename(spark, d):
    r = FX.fx_reports(spark, d)
    t = FX.fx_templates(spark, d).select(F.col("id").alias("tid"), F.col("name"))
    j = r.join(t, r.template_id == t.tid)
    return j.select("id", S.report_filename(F.concat(F.col("name"), F.lit(" a/b")), "generated_at",
                                            "template_id", F.col("status") == "failed").alias("filename"))


@query("clip_error")
def q_clip_error(spark, d):
    doc = read_table(spark, d, "documents")
    return doc.select("doc_id", S.clip_error("text").alias("error_message"))


@query("severity_color")
def q_severity_color(spark, d):
    from reportlake.sources.fixtures import severity_of
    o = read_table(spark, d, "orders")
    return o.select("o_orderkey", severity_of(F.col("o_orderpriority")).alias("severity"),
                    S.severity_color(severity_of(F.col("o_orderpriority")), F.col("o_orderkey")).alias("color"))


@query("cell_text")
def q_cell_text(spark, d):
    c = read_table(spark, d, "customer")
    k = F.col("c_custkey")
    f = c.select(k, F.col("c_acctbal"), (F.col("c_acctbal") * 10000).alias("big"),
                 (F.col("c_acctbal") / 10000000).alias("small"),
                 F.when(k % 9 == 0, None).otherwise(F.col("c_acctbal")).alias("gappy"),
                 (F.col("c_acctbal") > 0).alias("positive"),
                 F.when(k % 7 == 0, F.lit(None).cast("string")).otherwise(F.col("c_mktsegment")).alias("seg"))
    return f.select("c_custkey",
                    *[FR.text_of(f, x).alias(f"{x}_text")
                      for x in ["c_custkey", "c_acctbal", "big", "small", "gappy", "positive", "seg"]])


@query("column_widths_per_frame")
def q_column_widths_per_frame(spark, d):
    """Per-user table frames: ISO columns are formatted by the print rule first."""
    f = user_frames(spark, d).select("user_id", "event_id", "iso_z", "iso_mix", "iso_off", "event_type")
    return FR.column_widths(f, width=100.0, keys=["user_id"], datetime_order_by="event_id")

"""Registered maintenance queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from reportlake.operators import maintenance as M
from reportlake.plans.registry import query
from reportlake.sources import fixtures as FX
from reportlake.sources.tables import read_table

NOW_TEXT = "2024-05-01T00:00:00+00:00"


def fx_template_changes(spark, d):
    """Edits from the supplier table: renames, set-to-null hours, unknown
    ids, empty changes, and new templates."""
    s = read_table(spark, d, "supplier")
    k = F.col("s_suppkey")
    upd = M.change_rows(s, "update", k * 2, F.when(k % 10 == 0, k * 3 + 2000000).otherwise(k * 3),
                        {"name": (F.col("s_name"), k % 2 == 0),
                         "schedule_hour": (F.lit(None), k % 3 == 0)})
    ins = M.change_rows(s, "insert", k * 2 + 1, None,
                        {"name": F.concat(F.lit("New "), F.col("s_name")), "config_yaml": F.lit("{}")})
    return upd.unionByName(ins)


def fx_schedule_edits(spark, d):
    s = read_table(spark, d, "supplier")
    k = F.col("s_suppkey")
    return s.select((k * 7).alias("id"), k.alias("seq"), (k % 4 == 0).alias("disable_only"),
                    (k % 2 == 1).alias("enabled"), F.lit("weekly").alias("frequency"),
                    (k % 24).cast("int").alias("hour"), (k % 7).cast("int").alias("day_of_week"),
                    F.lit(None).cast("int").alias("day_of_month"),
                    F.when(k % 3 == 0, F.lit(None).cast("string")).otherwise("Australia/Sydney").alias("timezone"),
                    F.when(k % 5 == 0, None).otherwise(k % 100 + 1).cast("int").alias("retain_count"))


def fx_new_runs(spark, d):
    o = read_table(spark, d, "orders")
    k = F.col("o_orderkey")
    started = (F.col("o_orderdate") + F.expr("INTERVAL 3650 DAYS")
               + F.make_dt_interval(F.lit(0), F.lit(0), (k % 1440).cast("long"), F.lit(0)))
    return o.select(k.alias("seq"), F.col("o_custkey").alias("template_id"), started.alias("started_at"),
                    F.when(k % 10 == 0, "failed").when(k % 10 == 1, "no_token").when(k % 10 == 2, "exception")
                    .otherwise("success").alias("outcome"),
                    F.repeat(F.concat(F.col("o_orderpriority"), F.lit(" ")), 40).alias("error"),
                    F.floor("o_totalprice").cast("bigint").alias("file_size"),
                    (k % 3 != 0).alias("scheduled"))


def _migrated(spark, d):
    return M.migrate_legacy(FX.fx_templates(spark, d), FX.fx_reports(spark, d),
                            FX.fx_old_schedules(spark, d), FX.fx_old_reports(spark, d))


@query("migrate_legacy_templates")
def q_migrate_t(spark, d):
    return _migrated(spark, d)[0]


@query("migrate_legacy_reports")
def q_migrate_r(spark, d):
    return _migrated(spark, d)[1]


@query("upsert_templates")
def q_upsert(spark, d):
    return M.upsert_templates(FX.fx_templates(spark, d), fx_template_changes(spark, d), NOW_TEXT)


@query("apply_schedules")
def q_apply_schedules(spark, d):
    return M.apply_schedules(FX.fx_templates(spark, d), fx_schedule_edits(spark, d), NOW_TEXT)


def _appended(spark, d):
    return M.append_runs(FX.fx_reports(spark, d), FX.fx_templates(spark, d), fx_new_runs(spark, d))


@query("append_runs_log")
def q_append_log(spark, d):
    return _appended(spark, d)["runs"]


@query("append_runs_expired")
def q_append_expired(spark, d):
    return _appended(spark, d)["expired"].select("id", "template_id")


@query("append_runs_templates")
def q_append_templates(spark, d):
    return _appended(spark, d)["templates"].select("id", "schedule_last_run", "updated_at")


def _deleted(spark, d):
    t = FX.fx_templates(spark, d)
    return M.delete_templates(t, FX.fx_reports(spark, d), t.where("schedule_enabled = 0").select("id"))


@query("delete_templates")
def q_delete_t(spark, d):
    return _deleted(spark, d)["templates"]


@query("delete_templates_runs")
def q_delete_t_runs(spark, d):
    return _deleted(spark, d)["runs"]


@query("delete_templates_files")
def q_delete_t_files(spark, d):
    return _deleted(spark, d)["files"]


@query("delete_runs")
def q_delete_runs(spark, d):
    r = FX.fx_reports(spark, d)
    return M.delete_runs(r, r.where("status = 'failed'").select("id"))["runs"]

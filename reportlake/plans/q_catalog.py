"""Registered catalogue queries."""

from __future__ import annotations

from reportlake.operators import catalog as C
from reportlake.plans.registry import query
from reportlake.sources import fixtures as FX


@query("active_schedules")
def q_active(spark, d):
    return C.active_schedules(FX.fx_templates(spark, d))


@query("template_by_id")
def q_by_id(spark, d):
    return C.template_by_id(FX.fx_templates(spark, d), 42)


@query("templates_by_recency")
def q_recency(spark, d):
    return C.templates_by_recency(FX.fx_templates(spark, d))


@query("report_catalog")
def q_report_catalog(spark, d):
    return C.report_catalog(FX.fx_reports(spark, d), FX.fx_templates(spark, d))


@query("orphan_reports")
def q_orphans(spark, d):
    return C.orphan_reports(FX.fx_reports(spark, d), FX.fx_templates(spark, d))


@query("latest_report")
def q_latest(spark, d):
    return C.latest_report(FX.fx_reports(spark, d))


@query("recent_reports")
def q_recent(spark, d):
    return C.recent_reports(FX.fx_reports(spark, d), n=5)


@query("retention_expired")
def q_retention(spark, d):
    return C.retention_expired(FX.fx_reports(spark, d), FX.fx_templates(spark, d))


@query("retention_expired_exact_path")
def q_retention_exact(spark, d):
    return C.retention_expired(FX.fx_reports(spark, d), FX.fx_templates(spark, d))


@query("template_overview")
def q_overview(spark, d):
    return C.template_overview(FX.fx_templates(spark, d), FX.fx_reports(spark, d))


@query("severity_counts")
def q_severity_counts(spark, d):
    return C.severity_counts(FX.fx_workloads(spark, d), FX.fx_edges(spark, d), FX.fx_vulns(spark, d))


@query("severity_counts_by_rank")
def q_severity_counts_rank(spark, d):
    return C.severity_counts(FX.fx_workloads(spark, d), FX.fx_edges(spark, d), FX.fx_vulns(spark, d),
                             limit=None, order="rank")


@query("downloadable_reports")
def q_downloadable(spark, d):
    r, t = FX.fx_reports(spark, d), FX.fx_templates(spark, d)
    # The sink listing: files of runs whose template still exists.
    files = C.report_catalog(r, t).select("file_path")
    return C.downloadable_reports(r, files).select("id", "template_id", "file_path", "status")


@query("schedule_label")
def q_schedule_label(spark, d):
    from reportlake.functions import scalars as S
    t = FX.fx_templates(spark, d)
    return t.select("id", S.schedule_label("schedule_enabled", "schedule_frequency", "schedule_hour",
                                           "schedule_timezone", "schedule_day_of_week",
                                           "schedule_day_of_month").alias("label"))


@query("status_icon")
def q_status_icon(spark, d):
    from reportlake.functions import scalars as S
    r = FX.fx_reports(spark, d)
    return r.select("id", S.status_icon("status").alias("icon"))

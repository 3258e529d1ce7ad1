"""Oracle SQL: catalogue operators."""

from reportlake.plans.oracle import oracle

RUN_ORDER = "generated_at DESC NULLS LAST, id DESC"
RETAIN = ("CASE WHEN t.schedule_retain_count IS NULL OR t.schedule_retain_count = 0 THEN 10 "
          "ELSE t.schedule_retain_count END")

LABEL = """CASE WHEN schedule_enabled IS NULL OR schedule_enabled = 0 THEN 'No schedule configured'
  WHEN schedule_frequency IS NULL OR schedule_hour IS NULL THEN NULL
  ELSE (CASE WHEN upper(substr(schedule_frequency, 1, 1)) || lower(substr(schedule_frequency, 2)) = 'Weekly'
                  AND schedule_day_of_week IS NOT NULL
             THEN 'Weekly (' || ['Mon', 'Tue', 'Wed', 'Thu', 'Fri', 'Sat', 'Sun'][schedule_day_of_week + 1] || ')'
             WHEN upper(substr(schedule_frequency, 1, 1)) || lower(substr(schedule_frequency, 2)) = 'Monthly'
                  AND schedule_day_of_month IS NOT NULL AND schedule_day_of_month <> 0
             THEN 'Monthly (Day ' || CAST(schedule_day_of_month AS VARCHAR) || ')'
             ELSE upper(substr(schedule_frequency, 1, 1)) || lower(substr(schedule_frequency, 2)) END)
       || ' at ' || lpad(CAST(schedule_hour AS VARCHAR), 2, '0') || ':00 ' || coalesce(schedule_timezone, 'None')
  END"""

oracle("active_schedules", "SELECT * FROM fx_templates WHERE schedule_enabled = 1")
oracle("template_by_id", "SELECT * FROM fx_templates WHERE id = 42")
oracle("templates_by_recency", "SELECT * FROM fx_templates")
oracle("report_catalog", """
SELECT r.*, t.name AS template_name FROM fx_reports r JOIN fx_templates t ON r.template_id = t.id""")
oracle("orphan_reports", """
SELECT r.* FROM fx_reports r WHERE NOT EXISTS (SELECT 1 FROM fx_templates t WHERE t.id = r.template_id)""")
oracle("latest_report", f"""
SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY template_id ORDER BY {RUN_ORDER}) AS rn FROM fx_reports
) WHERE rn = 1""")
oracle("recent_reports", f"""
SELECT * EXCLUDE (rn), CAST(rn AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY template_id ORDER BY {RUN_ORDER}) AS rn FROM fx_reports
) WHERE rn <= 5""")
_RET = f"""
SELECT r.* EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY template_id ORDER BY {RUN_ORDER}) AS rn FROM fx_reports
) r JOIN fx_templates t ON r.template_id = t.id
WHERE r.rn > {RETAIN}"""
oracle("retention_expired", _RET)
oracle("retention_expired_exact_path", _RET)
oracle("template_overview", f"""
SELECT t.id, t.name, l.id AS last_run_id, l.status AS last_status, l.generated_at AS last_generated_at,
  CASE WHEN l.status IS NULL THEN NULL WHEN l.status = 'success' THEN '✅' ELSE '❌' END AS last_icon,
  {LABEL.replace('schedule_', 't.schedule_')} AS schedule_label
FROM fx_templates t LEFT JOIN (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY template_id ORDER BY {RUN_ORDER}) AS rn
                 FROM fx_reports) WHERE rn = 1
) l ON l.template_id = t.id""")
oracle("severity_counts", """
SELECT v.severity AS "Severity", CAST(count(*) AS BIGINT) AS "Vulnerabilities"
FROM fx_workloads w JOIN fx_edges e ON w.workload_id = e.workload_id JOIN fx_vulns v ON e.vuln_id = v.vuln_id
GROUP BY v.severity ORDER BY v.severity DESC LIMIT 4""")
oracle("severity_counts_by_rank", """
SELECT v.severity AS "Severity", CAST(count(*) AS BIGINT) AS "Vulnerabilities"
FROM fx_workloads w JOIN fx_edges e ON w.workload_id = e.workload_id JOIN fx_vulns v ON e.vuln_id = v.vuln_id
GROUP BY v.severity""")
oracle("downloadable_reports", """
SELECT r.id, r.template_id, r.file_path, r.status FROM fx_reports r
WHERE r.status = 'success' AND r.file_path IN (
  SELECT r2.file_path FROM fx_reports r2 JOIN fx_templates t ON r2.template_id = t.id)""")
oracle("schedule_label", f"SELECT id, {LABEL} AS label FROM fx_templates")
oracle("status_icon", "SELECT id, CASE WHEN status = 'success' THEN '✅' ELSE '❌' END AS icon FROM fx_reports")

"""Oracle SQL: catalogue maintenance (sequential-id semantics written with
row_number over the whole input, as an autoincrement key would assign)."""

from reportlake.plans.oracle import oracle

T_COLS = ("id, name, config_yaml, schedule_enabled, schedule_frequency, schedule_hour, schedule_day_of_week, "
          "schedule_day_of_month, schedule_timezone, schedule_retain_count, schedule_last_run, created_at, updated_at")
R_COLS = "id, template_id, filename, file_path, file_size, status, error_message, generated_at"
NOW = "'2024-05-01T00:00:00+00:00'"
RUN_ORDER = "generated_at DESC NULLS LAST, id DESC"
RETAIN = ("CASE WHEN t.schedule_retain_count IS NULL OR t.schedule_retain_count = 0 THEN 10 "
          "ELSE t.schedule_retain_count END")

_MIG_T = """
SELECT (SELECT max(id) FROM fx_templates) + row_number() OVER (ORDER BY id) AS new_id, * FROM fx_old_schedules"""

oracle("migrate_legacy_templates", f"""
SELECT {T_COLS} FROM fx_templates
UNION ALL
SELECT new_id AS id, name, config_yaml, enabled AS schedule_enabled, frequency AS schedule_frequency,
  hour AS schedule_hour, day_of_week AS schedule_day_of_week, day_of_month AS schedule_day_of_month,
  timezone AS schedule_timezone, retain_count AS schedule_retain_count, last_run AS schedule_last_run,
  created_at, updated_at
FROM mt""", mt=_MIG_T)

oracle("migrate_legacy_reports", f"""
SELECT {R_COLS} FROM fx_reports
UNION ALL
SELECT (SELECT max(id) FROM fx_reports) + row_number() OVER (ORDER BY mt.new_id, o.id) AS id,
  mt.new_id AS template_id, o.filename, o.file_path, o.file_size, o.status, o.error_message, o.generated_at
FROM fx_old_reports o JOIN mt ON o.schedule_id = mt.id""", mt=_MIG_T)

_CH = """
SELECT s_suppkey * 2 AS seq, 'update' AS op,
  CASE WHEN s_suppkey % 10 = 0 THEN s_suppkey * 3 + 2000000 ELSE s_suppkey * 3 END AS id,
  s_name AS name, s_suppkey % 2 = 0 AS set_name, CAST(NULL AS VARCHAR) AS config_yaml, false AS set_config_yaml,
  CAST(NULL AS INT) AS schedule_hour, s_suppkey % 3 = 0 AS set_schedule_hour
FROM supplier
UNION ALL
SELECT s_suppkey * 2 + 1, 'insert', NULL, 'New ' || s_name, true, '{}', true, NULL, false
FROM supplier"""

oracle("upsert_templates", f"""
SELECT t.id, CASE WHEN coalesce(a.set_name, false) THEN a.name ELSE t.name END AS name, t.config_yaml,
  t.schedule_enabled, t.schedule_frequency,
  CASE WHEN coalesce(a.set_schedule_hour, false) THEN a.schedule_hour ELSE t.schedule_hour END AS schedule_hour,
  t.schedule_day_of_week, t.schedule_day_of_month, t.schedule_timezone, t.schedule_retain_count,
  t.schedule_last_run, t.created_at,
  CASE WHEN coalesce(a.set_name, false) OR coalesce(a.set_schedule_hour, false) THEN {NOW} ELSE t.updated_at END
    AS updated_at
FROM fx_templates t LEFT JOIN (
  SELECT id, bool_or(set_name) AS set_name, arg_max_null(name, CASE WHEN set_name THEN seq END) AS name,
    bool_or(set_schedule_hour) AS set_schedule_hour,
    arg_max_null(schedule_hour, CASE WHEN set_schedule_hour THEN seq END) AS schedule_hour
  FROM ch WHERE op = 'update' GROUP BY id) a ON a.id = t.id
UNION ALL
SELECT (SELECT max(id) FROM fx_templates) + row_number() OVER (ORDER BY seq), name, config_yaml, 0, NULL, NULL,
  NULL, NULL, 'UTC', 10, NULL, {NOW}, {NOW}
FROM ch WHERE op = 'insert'""", ch=_CH)

oracle("apply_schedules", f"""
SELECT t.id, t.name, t.config_yaml,
  CASE WHEN e.id IS NULL THEN t.schedule_enabled WHEN e.disable_only THEN 0 WHEN e.enabled THEN 1 ELSE 0 END
    AS schedule_enabled,
  CASE WHEN e.id IS NULL OR e.disable_only THEN t.schedule_frequency ELSE 'weekly' END AS schedule_frequency,
  CASE WHEN e.id IS NULL OR e.disable_only THEN t.schedule_hour ELSE e.hour END AS schedule_hour,
  CASE WHEN e.id IS NULL OR e.disable_only THEN t.schedule_day_of_week ELSE e.day_of_week END AS schedule_day_of_week,
  CASE WHEN e.id IS NULL OR e.disable_only THEN t.schedule_day_of_month ELSE NULL END AS schedule_day_of_month,
  CASE WHEN e.id IS NULL OR e.disable_only THEN t.schedule_timezone ELSE coalesce(e.timezone, 'UTC') END
    AS schedule_timezone,
  CASE WHEN e.id IS NULL OR e.disable_only THEN t.schedule_retain_count ELSE coalesce(e.retain_count, 10) END
    AS schedule_retain_count,
  t.schedule_last_run, t.created_at, CASE WHEN e.id IS NULL THEN t.updated_at ELSE {NOW} END AS updated_at
FROM fx_templates t LEFT JOIN (
  SELECT s_suppkey * 7 AS id, s_suppkey % 4 = 0 AS disable_only, s_suppkey % 2 = 1 AS enabled,
    CAST(s_suppkey % 24 AS INT) AS hour, CAST(s_suppkey % 7 AS INT) AS day_of_week,
    CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE 'Australia/Sydney' END AS timezone,
    CAST(CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE s_suppkey % 100 + 1 END AS INT) AS retain_count
  FROM supplier) e ON e.id = t.id""")

_NEW = """
SELECT (SELECT max(id) FROM fx_reports) + row_number() OVER (ORDER BY o_orderkey) AS id,
  o_custkey AS template_id, fname AS filename, '/reports/' || fname AS file_path,
  CASE WHEN outcome = 'success' THEN CAST(floor(o_totalprice) AS BIGINT) END AS file_size,
  CASE WHEN outcome = 'success' THEN 'success' ELSE 'failed' END AS status,
  CASE WHEN outcome = 'no_token' THEN 'No API token configured'
       WHEN outcome IN ('failed', 'exception') THEN CASE WHEN scheduled THEN substr(err, 1, 500) ELSE err END
  END AS error_message,
  started_at AS generated_at
FROM (
  SELECT *, CASE WHEN outcome IN ('no_token', 'exception')
      THEN 'failed_' || CAST(o_custkey AS VARCHAR) || '_' || strftime(started_at, '%Y%m%d_%H%M%S') || '.pdf'
      ELSE translate(tname, ' /', '__') || '_' || strftime(started_at, '%Y%m%d_%H%M%S') || '.pdf' END AS fname
  FROM (
    SELECT o.*, t.name AS tname,
      o.o_orderdate + INTERVAL 3650 DAY + to_minutes(CAST(o.o_orderkey % 1440 AS BIGINT)) AS started_at,
      CASE o.o_orderkey % 10 WHEN 0 THEN 'failed' WHEN 1 THEN 'no_token' WHEN 2 THEN 'exception' ELSE 'success' END
        AS outcome,
      repeat(o.o_orderpriority || ' ', 40) AS err, o.o_orderkey % 3 <> 0 AS scheduled
    FROM orders o JOIN fx_templates t ON t.id = o.o_custkey)
  WHERE scheduled OR outcome <> 'exception')"""

_LOG = f"SELECT {R_COLS} FROM fx_reports UNION ALL SELECT {R_COLS} FROM nr"
_EXP = f"""
SELECT l.* EXCLUDE (rn) FROM (  -- only templates that got a row are pruned

  SELECT *, row_number() OVER (PARTITION BY template_id ORDER BY {RUN_ORDER}) AS rn FROM lg
) l JOIN fx_templates t ON l.template_id = t.id WHERE l.rn > {RETAIN}
  AND l.template_id IN (SELECT template_id FROM nr)"""

oracle("append_runs_log", "SELECT * FROM lg WHERE id NOT IN (SELECT id FROM ex)", nr=_NEW, lg=_LOG, ex=_EXP)
oracle("append_runs_expired", "SELECT id, template_id FROM ex", nr=_NEW, lg=_LOG, ex=_EXP)
oracle("append_runs_templates", """
SELECT t.id,
  CASE WHEN s.last IS NOT NULL THEN strftime(s.last, '%Y-%m-%dT%H:%M:%S') || '+00:00' ELSE t.schedule_last_run END
    AS schedule_last_run,
  CASE WHEN s.last IS NOT NULL THEN strftime(s.last, '%Y-%m-%dT%H:%M:%S') || '+00:00' ELSE t.updated_at END
    AS updated_at
FROM fx_templates t LEFT JOIN (
  SELECT o_custkey AS tid,
    max(o_orderdate + INTERVAL 3650 DAY + to_minutes(CAST(o_orderkey % 1440 AS BIGINT))) AS last
  FROM orders WHERE o_orderkey % 3 <> 0 AND (o_orderkey % 10 = 0 OR o_orderkey % 10 >= 3)
  GROUP BY o_custkey) s ON s.tid = t.id""")

oracle("delete_templates", "SELECT * FROM fx_templates WHERE schedule_enabled <> 0")
oracle("delete_templates_runs", """
SELECT r.* FROM fx_reports r WHERE r.template_id NOT IN (SELECT id FROM fx_templates WHERE schedule_enabled = 0)""")
oracle("delete_templates_files", """
SELECT r.id, r.file_path FROM fx_reports r
WHERE r.template_id IN (SELECT id FROM fx_templates WHERE schedule_enabled = 0)""")
oracle("delete_runs", "SELECT * FROM fx_reports WHERE status <> 'failed'")

"""Oracle SQL: report runs (B1, B2)."""

from reportlake.plans.fixture_sql import SEV_CASE
from reportlake.plans.oracle import oracle, trend_sql

DH = f"""
SELECT o.o_orderdate AS timestamp, {SEV_CASE} AS vuln_severity, n.n_regionkey + 1 AS zone_id, count(*) AS value
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey
GROUP BY 1, 2, 3"""
BL = """
SELECT template_id, block_idx, coalesce(type, 'table') AS type,
  CASE WHEN coalesce(type, 'table') = 'history' THEN coalesce(days, 7)
       WHEN coalesce(type, 'table') = 'trend_summary' THEN 31 END AS days,
  coalesce(zone_id, 0) AS zone, coalesce(query, '') AS query
FROM fx_blocks_full"""
ZROWS = """
SELECT zone_id AS zone, timestamp, value, vuln_severity FROM dh
UNION ALL
SELECT 0, timestamp, CAST(sum(value) AS BIGINT), vuln_severity FROM dh GROUP BY timestamp, vuln_severity"""
WIN = """
SELECT s.days, s.zone, x.timestamp, x.value, x.vuln_severity
FROM (SELECT DISTINCT days, zone FROM bl WHERE type IN ('history', 'trend_summary')) s
JOIN zr x ON x.zone = s.zone
 AND x.timestamp BETWEEN CAST(DATE '1998-03-10' - s.days AS TIMESTAMP) AND TIMESTAMP '1998-03-10 23:59:59'"""
QS = """
SELECT * FROM (VALUES
  ('q0', (SELECT least(count(DISTINCT severity), 4) FROM fx_vulns), NULL),
  ('q1', (SELECT count(*) FROM fx_workloads WHERE name LIKE 'zzz%'), NULL),
  ('q2', NULL, 'TABLE_OR_VIEW_NOT_FOUND'),
  ('', NULL, 'Query is required')) q(query, n, err)"""

RESULTS = """
SELECT template_id, block_idx, type,
  CASE WHEN type = 'divider' THEN 'ok' WHEN err IS NOT NULL THEN 'error' WHEN coalesce(n, 0) = 0 THEN 'empty'
       ELSE 'ok' END AS status,
  CASE WHEN type = 'divider' THEN NULL WHEN err IS NOT NULL THEN 'Error: ' || err
       WHEN coalesce(n, 0) = 0 THEN CASE WHEN type IN ('history', 'trend_summary') THEN 'No history data returned'
                                         ELSE 'No data returned' END
       WHEN type = 'table' THEN 'Displaying ' || CAST(n AS VARCHAR) || ' records' END AS message,
  CASE WHEN type <> 'divider' THEN CAST(coalesce(n, 0) AS BIGINT) END AS n_rows
FROM (
  SELECT bl.template_id, bl.block_idx, bl.type,
    CASE WHEN bl.type IN ('history', 'trend_summary') THEN wc.n ELSE qs.n END AS n,
    CASE WHEN bl.type IN ('traffic_lights', 'vertical_bar', 'horizontal_bar', 'pie_chart', 'table') THEN qs.err END
      AS err
  FROM bl
  LEFT JOIN (SELECT days, zone, count(*) AS n FROM win GROUP BY days, zone) wc
    ON bl.type IN ('history', 'trend_summary') AND wc.days = bl.days AND wc.zone = bl.zone
  LEFT JOIN qs ON bl.type IN ('traffic_lights', 'vertical_bar', 'horizontal_bar', 'pie_chart', 'table')
    AND qs.query = bl.query)"""
_RESULT_VIEWS = {
    "dh": DH,
    "bl": BL.replace("coalesce(query, '') AS query",
                     "CASE query WHEN 'q0' THEN 'q0' WHEN 'q1' THEN 'q1' WHEN 'q2' THEN 'q2' ELSE '' END AS query"),
    "zr": ZROWS, "win": WIN, "qs": QS}

oracle("block_results", RESULTS, **_RESULT_VIEWS)
oracle("report_bundle_rows", RESULTS, **_RESULT_VIEWS)
oracle("report_bundle", f"""
SELECT CAST(template_id AS BIGINT) AS template_id, 'run-1' AS run_id, 'success' AS status, count(*) AS n_rows, true AS has_bytes
FROM ({RESULTS}) GROUP BY template_id""", **_RESULT_VIEWS)

oracle("run_reports_trends", f"""
SELECT bl.template_id, bl.block_idx, t.* FROM bl JOIN ({trend_sql('win', ['days', 'zone'])}) t
  ON t.days = bl.days AND t.zone = bl.zone
WHERE bl.type = 'trend_summary'""", dh=DH, bl=BL, zr=ZROWS, win=WIN)

oracle("run_reports_series", """
SELECT bl.template_id, bl.block_idx, w.days, w.zone, w.timestamp, w.value, w.vuln_severity
FROM bl JOIN win w ON w.days = bl.days AND w.zone = bl.zone WHERE bl.type = 'history'""", dh=DH, bl=BL, zr=ZROWS, win=WIN)

oracle("query_block", """
SELECT f."Severity", f."Vulnerabilities", p.pct,
  f."Severity" || ' (' || format('{:,}', f."Vulnerabilities") || ') - ' || printf('%.1f', p.pct) || '%' AS label
FROM f JOIN (
  SELECT "Severity", CASE WHEN tot > 0 THEN CAST("Vulnerabilities" AS DOUBLE) / tot * 100.0 ELSE 0.0 END AS pct
  FROM f CROSS JOIN (SELECT CAST(sum("Vulnerabilities") AS DOUBLE) AS tot FROM f)) p ON p."Severity" = f."Severity"
""", f="""SELECT v.severity AS "Severity", count(*) AS "Vulnerabilities"
          FROM fx_workloads w JOIN fx_edges e ON w.workload_id = e.workload_id
          JOIN fx_vulns v ON e.vuln_id = v.vuln_id GROUP BY v.severity ORDER BY "Severity" DESC LIMIT 4""")

_TILES = """
SELECT pos, n, label, value, value_text,
  coalesce(CASE label WHEN 'Critical' THEN '#d32f2f' WHEN 'High' THEN '#ffa000' WHEN 'Medium' THEN '#388e3c'
           WHEN 'Low' THEN '#1976d2' WHEN 'Negligible' THEN '#757575' WHEN 'Informational' THEN '#00bcd4' END,
           ['#7b1fa2', '#00796b', '#c2185b', '#512da8', '#0097a7', '#689f38', '#5d4037', '#455a64', '#f57c00',
            '#303f9f'][pos % 10 + 1]) AS color,
  x0, x0 + bw AS x1, (x0 + (x0 + bw)) / 2 AS x_center, 0.8::DOUBLE AS label_y, 0.35::DOUBLE AS value_y
FROM (SELECT *, 0.01::DOUBLE + pos * (bw + 0.01::DOUBLE) AS x0 FROM (
  SELECT *, (1.0::DOUBLE - 0.01::DOUBLE * (n + 1)) / n AS bw FROM (
    SELECT "Severity" AS label, "Vulnerabilities" AS value, format('{:,}', "Vulnerabilities") AS value_text,
      CAST(row_number() OVER (ORDER BY "Severity") - 1 AS INTEGER) AS pos, count(*) OVER () AS n
    FROM (SELECT severity AS "Severity", count(*) AS "Vulnerabilities" FROM fx_vulns
          GROUP BY severity ORDER BY "Severity" DESC LIMIT 4))))"""
oracle("query_block_tiles", _TILES)


# P3 picks the first numeric column as the value: here ``bucket``.
oracle("query_block_bars", """
SELECT "Severity" AS category, bucket AS value, "Vulnerabilities",
  CAST(coalesce(sum(bucket) OVER (PARTITION BY "Severity" ORDER BY "Severity", bucket, "Vulnerabilities"
       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS stack_base,
  CASE "Severity" WHEN 'Critical' THEN '#d32f2f' WHEN 'High' THEN '#ffa000' WHEN 'Medium' THEN '#388e3c'
       WHEN 'Low' THEN '#1976d2' WHEN 'Negligible' THEN '#757575' WHEN 'Informational' THEN '#00bcd4' END AS color,
  'h' AS orientation
FROM (SELECT severity AS "Severity", vuln_id % 3 AS bucket, count(*) AS "Vulnerabilities"
      FROM fx_vulns GROUP BY severity, vuln_id % 3)""")

# The run's blocks: only query q0 has rows to draw.
_Q0 = """SELECT severity AS "Severity", count(*) AS "Vulnerabilities" FROM fx_vulns
  GROUP BY severity ORDER BY "Severity" DESC LIMIT 4"""
_USERS = "(SELECT template_id, block_idx, type FROM bl WHERE query = 'q0')"
_COLOR = """CASE "Severity" WHEN 'Critical' THEN '#d32f2f' WHEN 'High' THEN '#ffa000' WHEN 'Medium' THEN '#388e3c'
  WHEN 'Low' THEN '#1976d2' WHEN 'Negligible' THEN '#757575' WHEN 'Informational' THEN '#00bcd4' END"""

oracle("run_reports_tiles", f"SELECT u.template_id, u.block_idx, t.* FROM {_USERS} u CROSS JOIN ({_TILES}) t "
       "WHERE u.type = 'traffic_lights'", bl=BL)
oracle("run_reports_bars", f"""
SELECT u.template_id, u.block_idx, CASE u.type WHEN 'horizontal_bar' THEN 'h' ELSE 'v' END AS orientation,
  "Severity" AS category, CAST("Vulnerabilities" AS DOUBLE) AS value, 0.0::DOUBLE AS stack_base, {_COLOR} AS color
FROM {_USERS} u CROSS JOIN q0 WHERE u.type IN ('vertical_bar', 'horizontal_bar')""", bl=BL, q0=_Q0)
oracle("run_reports_pies", f"""
SELECT u.template_id, u.block_idx, p.value, p.pct,
  p.sev || ' (' || format('{{:,}}', p.value) || ') - ' || printf('%.1f', p.pct) || '%' AS label
FROM {_USERS} u CROSS JOIN (
  SELECT "Severity" AS sev, "Vulnerabilities" AS value,
    CASE WHEN tot > 0 THEN CAST("Vulnerabilities" AS DOUBLE) / tot * 100.0 ELSE 0.0 END AS pct
  FROM q0 CROSS JOIN (SELECT CAST(sum("Vulnerabilities") AS DOUBLE) AS tot FROM q0)) p
WHERE u.type = 'pie_chart'""", bl=BL, q0=_Q0)
oracle("run_reports_tables", f"""
SELECT u.template_id, u.block_idx,
  '{{"Severity":' || CAST(to_json("Severity") AS VARCHAR) || ',"Vulnerabilities":' || "Vulnerabilities" || '}}' AS row
FROM {_USERS} u CROSS JOIN q0 WHERE u.type = 'table'""", bl=BL, q0=_Q0)
_RUN_LOG = """
SELECT id, template_id, filename, file_path, file_size, status, error_message, generated_at FROM fx_reports
UNION ALL
SELECT (SELECT max(id) FROM fx_reports) + row_number() OVER (ORDER BY id), id,
  translate(name, ' /', '__') || '_20300101_060000.pdf', '/reports/' || translate(name, ' /', '__') || '_20300101_060000.pdf',
  NULL, 'success', NULL, TIMESTAMP '2030-01-01 06:00:00' FROM fx_templates"""
oracle("run_reports_log", """
SELECT l.* EXCLUDE (rn, k) FROM (
  SELECT l.*, row_number() OVER (PARTITION BY l.template_id ORDER BY generated_at DESC NULLS LAST, l.id DESC) AS rn,
    CASE WHEN t.id IS NULL THEN NULL WHEN coalesce(t.schedule_retain_count, 0) = 0 THEN 10
         ELSE greatest(t.schedule_retain_count, 0) END AS k
  FROM lg l LEFT JOIN fx_templates t ON t.id = l.template_id) l
WHERE k IS NULL OR rn <= k""", lg=_RUN_LOG)

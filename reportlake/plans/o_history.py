"""Oracle SQL: history operators."""

from reportlake.plans.fixture_sql import SEV_CASE
from reportlake.plans.oracle import SEVERITIES, SEV_RANK, oracle, trend_sql

oracle("trend_insights", f"SELECT * FROM ({trend_sql('fx_history', ['zone_id'])})")

oracle("trend_insights_by_customer",
       f"SELECT * FROM ({trend_sql('fx_customer_history', ['customer_id'])})")

oracle("trend_insights_all_zones", f"SELECT * FROM ({trend_sql('rollup', [])})",
       rollup="""SELECT timestamp, CAST(sum(value) AS BIGINT) AS value, vuln_severity
                 FROM fx_history GROUP BY timestamp, vuln_severity""")

oracle("insight_table", f"""
SELECT customer_id, severity AS "Severity", format('{{:,}}', start_value) AS "31 Days Ago",
  format('{{:,}}', end_value) AS "Today",
  CASE trend WHEN 'improved' THEN format('{{:,}}', change) || ' (' || printf('%+.1f', pct_change) || '%) ↓'
             WHEN 'worsened' THEN '+' || format('{{:,}}', change) || ' (' || printf('%+.1f', pct_change) || '%) ↑'
             ELSE format('{{:,}}', change) || ' (0%)' END AS "Change"
FROM ({trend_sql('fx_customer_history', ['customer_id'])})""")

oracle("history_window_sydney", """
SELECT * FROM (SELECT o.o_orderdate AS timestamp, {sev} AS vuln_severity, n.n_regionkey + 1 AS zone_id, count(*) AS value
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey
  GROUP BY 1, 2, 3)
WHERE timestamp BETWEEN timezone('UTC', timezone('Australia/Sydney', TIMESTAMP '1998-03-26 00:00:00'))
  AND timezone('UTC', timezone('Australia/Sydney', TIMESTAMP '1998-04-02 23:59:59'))""".replace("{sev}", SEV_CASE))

oracle("fmt_trend_change", f"""
SELECT customer_id, severity,
  CASE trend WHEN 'improved' THEN format('{{:,}}', change) || ' (' || printf('%+.1f', pct_change) || '%) ↓'
             WHEN 'worsened' THEN '+' || format('{{:,}}', change) || ' (' || printf('%+.1f', pct_change) || '%) ↑'
             ELSE format('{{:,}}', change) || ' (0%)' END AS change_text
FROM ({trend_sql('fx_customer_history', ['customer_id'])})""")

oracle("history_window", """
SELECT * FROM fx_history
WHERE timestamp BETWEEN TIMESTAMP '1997-02-03 00:00:00' AND TIMESTAMP '1998-03-10 23:59:59' AND zone_id = 2""")

oracle("history_window_all_zones", """
SELECT * FROM fx_customer_history
WHERE timestamp BETWEEN TIMESTAMP '1998-02-07 00:00:00' AND TIMESTAMP '1998-03-10 23:59:59'""")

oracle("all_zones_rollup", """
SELECT timestamp, CAST(sum(value) AS BIGINT) AS value, vuln_severity
FROM fx_history GROUP BY timestamp, vuln_severity""")

oracle("history_by_zone_name", """
SELECT h.* FROM fx_history h
WHERE h.zone_id IN (SELECT max_by(id, id) FROM fx_zones WHERE name = 'EUROPE' GROUP BY name)""")

oracle("severity_rank", f"""
SELECT *, CAST({SEV_RANK.format(c='vuln_severity')} AS INT) AS severity_rank
FROM fx_history WHERE vuln_severity IN {SEVERITIES}""")

oracle("history_series", """
SELECT zone_id, timestamp, value, vuln_severity,
  CASE vuln_severity WHEN 'Critical' THEN '#d32f2f' WHEN 'High' THEN '#ffa000'
       WHEN 'Medium' THEN '#388e3c' WHEN 'Low' THEN '#1976d2' WHEN 'Negligible' THEN '#757575'
       WHEN 'Informational' THEN '#00bcd4' END AS color
FROM fx_history""")

oracle("trend_color", f"""
SELECT customer_id, severity AS "Severity",
  CASE trend WHEN 'improved' THEN '#2e7d32' WHEN 'worsened' THEN '#c62828' END AS color
FROM ({trend_sql('fx_customer_history', ['customer_id'])})""")

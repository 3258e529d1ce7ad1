"""The fixture views in DuckDB SQL, for the oracle side of each check.

Each entry mirrors ``reportlake.sources.fixtures``; ``with_fx`` prefixes an
oracle query with the CTEs it needs (and their dependencies).
"""

from __future__ import annotations

import re

SEV_CASE = ("CASE o_orderpriority WHEN '1-URGENT' THEN 'Critical' WHEN '2-HIGH' THEN 'High' "
            "WHEN '3-MEDIUM' THEN 'Medium' WHEN '5-LOW' THEN 'Low' ELSE 'Unrated' END")


def _iso(ts: str) -> str:
    return f"strftime({ts}, '%Y-%m-%dT%H:%M:%S')"


def _plus_min(ts: str, minutes: str) -> str:
    return f"({ts} + to_minutes(CAST({minutes} AS BIGINT)))"


FX_SQL: dict[str, str] = {
    "fx_history": f"""
SELECT CAST(date_trunc('month', o.o_orderdate) AS TIMESTAMP) AS timestamp, count(*) AS value,
       {SEV_CASE} AS vuln_severity, n.n_regionkey + 1 AS zone_id
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
JOIN nation n ON c.c_nationkey = n.n_nationkey
GROUP BY 1, 3, 4""",
    "fx_customer_history": f"""
SELECT o_custkey AS customer_id, o_orderdate AS timestamp,
       CAST(floor(o_totalprice) AS BIGINT) AS value, {SEV_CASE} AS vuln_severity
FROM orders""",
    "fx_zones": "SELECT r_regionkey + 1 AS id, r_name AS name FROM region",
    "fx_templates": f"""
SELECT c_custkey AS id, c_name AS name,
  CASE WHEN c_custkey % 19 = 18 THEN NULL
       ELSE '{{"global": {{"customer": "' || c_name || '"}}}}' END AS config_yaml,
  CASE WHEN c_custkey % 10 = 0 THEN 0 ELSE 1 END AS schedule_enabled,
  CASE c_custkey % 5 WHEN 0 THEN 'daily' WHEN 1 THEN 'weekly' WHEN 2 THEN 'monthly'
       WHEN 3 THEN 'daily' ELSE NULL END AS schedule_frequency,
  CAST(CASE WHEN c_custkey % 11 = 10 THEN NULL ELSE c_custkey % 24 END AS INT) AS schedule_hour,
  CAST(CASE WHEN c_custkey % 13 = 12 THEN NULL ELSE c_custkey % 7 END AS INT) AS schedule_day_of_week,
  CAST(CASE WHEN c_custkey % 17 = 16 THEN NULL ELSE c_custkey % 28 + 1 END AS INT) AS schedule_day_of_month,
  CASE c_custkey % 4 WHEN 0 THEN 'UTC' WHEN 1 THEN 'Australia/Sydney' WHEN 2 THEN 'Not/AZone'
       ELSE NULL END AS schedule_timezone,
  CAST(CASE c_custkey % 6 WHEN 0 THEN NULL WHEN 1 THEN 0 ELSE c_custkey % 6 END AS INT) AS schedule_retain_count,
  CASE WHEN c_custkey % 8 = 0 THEN NULL WHEN c_custkey % 8 = 1 THEN 'garbage'
       WHEN c_custkey % 8 = 2 THEN ''
       ELSE {_iso(_plus_min("TIMESTAMP '2024-04-01 08:00:00'", "(c_custkey * 7) % 150"))} ||
            CASE WHEN c_custkey % 8 IN (3, 4) THEN '+00:00' WHEN c_custkey % 8 = 5 THEN 'Z'
                 WHEN c_custkey % 8 = 6 THEN '' ELSE '+10:00' END END AS schedule_last_run,
  {_iso(_plus_min("TIMESTAMP '2023-01-01 00:00:00'", "c_custkey"))} || '+00:00' AS created_at,
  {_iso(_plus_min("TIMESTAMP '2023-06-01 00:00:00'", "(c_custkey * 37) % 100000"))} || '+00:00' AS updated_at
FROM customer""",
    "fx_reports": """
SELECT o_orderkey AS id,
  CASE WHEN o_orderkey % 50 = 0 THEN o_custkey + 1000000 ELSE o_custkey END AS template_id,
  'run_' || CAST(o_orderkey AS VARCHAR) || '.pdf' AS filename,
  '/reports/run_' || CAST(o_orderkey AS VARCHAR) || '.pdf' AS file_path,
  CASE WHEN o_orderstatus = 'F' THEN NULL ELSE CAST(floor(o_totalprice) AS BIGINT) END AS file_size,
  CASE WHEN o_orderstatus = 'F' THEN 'failed' ELSE 'success' END AS status,
  CASE WHEN o_orderstatus = 'F' THEN 'error: ' || o_orderpriority END AS error_message,
  o_orderdate AS generated_at
FROM orders""",
    "fx_blocks": """
SELECT c.c_custkey AS template_id, CAST(b.block_idx AS INT) AS block_idx,
  CASE (c.c_custkey + b.block_idx * 3) % 5 WHEN 0 THEN 'full' WHEN 1 THEN 'half' WHEN 2 THEN 'half'
       WHEN 3 THEN NULL ELSE 'half' END AS width,
  CASE (c.c_custkey + b.block_idx) % 8 WHEN 0 THEN 'history' WHEN 1 THEN 'trend_summary'
       WHEN 2 THEN 'traffic_lights' WHEN 3 THEN 'vertical_bar' WHEN 4 THEN 'horizontal_bar'
       WHEN 5 THEN 'pie_chart' WHEN 6 THEN 'table' ELSE 'divider' END AS type
FROM customer c CROSS JOIN (VALUES (0), (1), (2), (3), (4), (5)) AS b(block_idx)""",
    "fx_blocks_full": """
SELECT template_id, block_idx, width, type,
  CASE WHEN (template_id + block_idx) % 4 = 0 THEN NULL ELSE 'Block ' || CAST(block_idx AS VARCHAR) END AS title,
  CASE WHEN template_id % 3 = 0 THEN NULL ELSE 'About ' || type END AS description,
  CAST(CASE WHEN type = 'history' THEN CASE WHEN template_id % 3 = 0 THEN NULL ELSE template_id % 40 + 1 END
            WHEN type = 'trend_summary' THEN 7 END AS INT) AS days,
  CAST(CASE WHEN type IN ('history', 'trend_summary') THEN template_id % 6 END AS INT) AS zone_id,
  CASE WHEN type IN ('traffic_lights', 'vertical_bar', 'horizontal_bar', 'pie_chart', 'table')
       THEN CASE WHEN template_id % 7 = 0 THEN NULL ELSE 'q' || CAST(template_id % 3 AS VARCHAR) END END AS query,
  CASE WHEN template_id % 2 = 0 THEN NULL ELSE template_id % 4 = 1 END AS show_legend,
  CAST(CASE WHEN type IN ('vertical_bar', 'horizontal_bar') THEN (template_id % 14) * 50 + 150 END AS INT) AS chart_height
FROM fx_blocks""",
    "fx_workloads": "SELECT p_partkey AS workload_id, p_name AS name FROM part",
    "fx_edges": "SELECT l_partkey AS workload_id, l_orderkey AS vuln_id FROM lineitem",
    "fx_vulns": f"SELECT o_orderkey AS vuln_id, {SEV_CASE} AS severity FROM orders",
    "fx_old_schedules": """
SELECT s_suppkey AS id, s_name AS name, '{}' AS config_yaml, 1 AS enabled, 'daily' AS frequency,
  CAST(s_suppkey % 24 AS INT) AS hour, CAST(NULL AS INT) AS day_of_week, CAST(NULL AS INT) AS day_of_month,
  'UTC' AS timezone, CAST(s_suppkey % 12 AS INT) AS retain_count, CAST(NULL AS VARCHAR) AS last_run,
  '2022-01-01T00:00:00+00:00' AS created_at, '2022-01-01T00:00:00+00:00' AS updated_at
FROM supplier""",
    "fx_old_reports": """
SELECT o_orderkey AS id, o_orderkey % 120 AS schedule_id,
  'old_' || CAST(o_orderkey AS VARCHAR) || '.pdf' AS filename,
  '/old/old_' || CAST(o_orderkey AS VARCHAR) || '.pdf' AS file_path,
  CAST(floor(o_totalprice) AS BIGINT) AS file_size, 'success' AS status,
  CAST(NULL AS VARCHAR) AS error_message, o_orderdate AS generated_at
FROM orders""",
    "fx_iso": f"""
SELECT event_id, CASE event_id % 5 WHEN 0 THEN {_iso("ts")} || 'Z' WHEN 1 THEN {_iso("ts")}
       WHEN 2 THEN 'not-a-date-but-long' WHEN 3 THEN '' ELSE NULL END AS iso
FROM events""",
    "fx_ticks": """
SELECT DISTINCT make_timestamp(year(ts), month(ts), day(ts), hour(ts),
       CAST(floor(minute(ts) / 30) * 30 AS BIGINT), 0) + INTERVAL 84 DAY AS tick
FROM events""",
}


def _deps(name: str) -> list[str]:
    body = FX_SQL[name]
    found = [d for d in FX_SQL if d != name and re.search(rf"\b{d}\b", body)]
    out: list[str] = []
    for d in found:
        for dd in _deps(d) + [d]:
            if dd not in out:
                out.append(dd)
    return out


def with_fx(body: str, extra: dict[str, str] | None = None) -> str:
    """Prefix ``body`` with CTEs for every fixture (and extra CTE) it names."""
    extra = extra or {}
    names: list[str] = []
    scan = body + " ".join(extra.values())
    for n in FX_SQL:
        if re.search(rf"\b{n}\b", scan):
            for d in _deps(n) + [n]:
                if d not in names:
                    names.append(d)
    ctes = [f"{n} AS ({FX_SQL[n].strip()})" for n in names]
    ctes += [f"{n} AS ({sql.strip()})" for n, sql in extra.items()]
    body = body.strip()
    if not ctes:
        return body
    if re.match(r"(?i)^WITH\s", body):  # merge with the body's own CTE list
        return "WITH " + ",\n".join(ctes) + ",\n" + body[5:]
    return "WITH " + ",\n".join(ctes) + "\n" + body

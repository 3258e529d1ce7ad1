"""Oracle SQL: sources. The oracle of an envelope reader is the view the
envelopes were made from, written without JSON."""

from reportlake.plans.o_frames import parse_sql
from reportlake.plans.oracle import oracle

oracle("entity_items", """
SELECT l_orderkey AS envelope_id,
  CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS INTEGER) AS pos,
  CASE l_returnflag WHEN 'A' THEN 'Critical' WHEN 'R' THEN 'High' ELSE 'Low' END AS "Severity",
  CAST(trunc(l_quantity) AS BIGINT) AS "Vulnerabilities",
  CASE WHEN l_orderkey % 7 = 0 THEN l_linenumber END AS extra, CAST(NULL AS VARCHAR) AS error
FROM lineitem WHERE l_orderkey % 11 <> 0
UNION ALL
SELECT DISTINCT l_orderkey, CAST(NULL AS INTEGER), CAST(NULL AS VARCHAR), CAST(NULL AS BIGINT), CAST(NULL AS INTEGER),
  'Unexpected API response format (no ''items'' key)'
FROM lineitem WHERE l_orderkey % 11 = 0""")

oracle("history_rows", """
SELECT zone_id, CAST(year(timestamp) AS INTEGER) AS year,
  CAST(row_number() OVER (PARTITION BY zone_id, year(timestamp) ORDER BY timestamp, vuln_severity, value) - 1
       AS INTEGER) AS pos,
  timestamp, value, vuln_severity, CAST(NULL AS VARCHAR) AS error
FROM fx_history
WHERE NOT (zone_id = 3 AND year(timestamp) = 1999) AND NOT (zone_id = 4 AND year(timestamp) = 2000)
  AND NOT (zone_id = 2 AND year(timestamp) = 1997)
UNION ALL
SELECT DISTINCT zone_id, CAST(year(timestamp) AS INTEGER), CAST(NULL AS INTEGER), CAST(NULL AS TIMESTAMP),
  CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR), 'All arrays must be of the same length'
FROM fx_history WHERE zone_id = 2 AND year(timestamp) = 1997 AND (SELECT count(*) FROM fx_history
  WHERE zone_id = 2 AND year(timestamp) = 1997) > 1
UNION ALL
SELECT DISTINCT zone_id, CAST(year(timestamp) AS INTEGER), CAST(NULL AS INTEGER), CAST(NULL AS TIMESTAMP),
  CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR), 'Unexpected response format (no ''data'' key)'
FROM fx_history WHERE zone_id = 3 AND year(timestamp) = 1999""")

_ZONES = """
SELECT c.c_custkey AS tenant_id, 0 AS pos, n.n_regionkey + 1 AS id, r.r_name AS name
FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
UNION ALL
SELECT c.c_custkey, 1, c.c_nationkey + 100, n.n_name FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
UNION ALL
SELECT c.c_custkey, 2, 999, r.r_name
FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
WHERE c.c_custkey % 9 = 0"""

oracle("zone_rows", """
SELECT tenant_id, CAST(pos AS INTEGER) AS pos, id, name, CAST(NULL AS VARCHAR) AS error FROM z WHERE tenant_id % 11 <> 0
UNION ALL
SELECT c_custkey, NULL, NULL, NULL, 'Unexpected response format' FROM customer c
JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
WHERE c_custkey % 11 = 0""", z=_ZONES)
oracle("zone_dim", "SELECT tenant_id, CAST(pos AS INTEGER) AS pos, id, name FROM z", z=_ZONES)
oracle("zone_by_name", "SELECT tenant_id, name, max_by(id, pos) AS id FROM z GROUP BY tenant_id, name", z=_ZONES)

_BLOCKS = """
SELECT b.template_id, b.block_idx, t.name AS customer,
  CASE WHEN t.id % 3 = 0 THEN 'au1' ELSE 'us2' END AS region,
  CASE WHEN t.id % 2 = 0 THEN 'landscape' ELSE 'portrait' END AS orientation, CAST(NULL AS VARCHAR) AS logo_path,
  b.type, b.query, CAST(NULL AS VARCHAR) AS id, b.days, CAST(NULL AS BOOLEAN) AS markers, b.zone_id, b.title,
  b.description, b.show_legend, b.chart_height, coalesce(b.width, 'full') AS width
FROM fx_blocks_full b JOIN fx_templates t ON b.template_id = t.id"""
oracle("template_blocks", _BLOCKS)
oracle("template_blocks_json", _BLOCKS)

oracle("catalog_scan", f"SELECT event_id, iso, timezone('UTC', {parse_sql('iso')}) AS iso_ts FROM fx_iso")


# Envelope (2, 1997) has one value less than its other columns, (3, 1999) no data, (4, 2000) no values.
oracle("normalize_records", """
SELECT zone_id, y AS year,
  CAST(CASE WHEN gone OR uneven THEN 0 ELSE n END AS INTEGER) AS n_records,
  CAST(CASE WHEN gone OR uneven OR bare THEN 0 ELSE n END AS INTEGER) AS n_values,
  CAST(CASE WHEN gone OR uneven OR bare THEN 0 ELSE total END AS BIGINT) AS total,
  CASE WHEN uneven THEN 'All arrays must be of the same length' END AS error
FROM (SELECT zone_id, CAST(year(timestamp) AS INTEGER) AS y, count(*) AS n, sum(value) AS total,
    zone_id = 3 AND year(timestamp) = 1999 AS gone, zone_id = 2 AND year(timestamp) = 1997 AS uneven,
    zone_id = 4 AND year(timestamp) = 2000 AS bare
  FROM fx_history GROUP BY zone_id, year(timestamp))""")


def _json_object(fields: dict[str, str]) -> str:
    """JSON text of an object without its null fields, in SQL."""
    parts = ", ".join(f"'\"{name}\":' || CAST(to_json({e}) AS VARCHAR)" for name, e in fields.items())
    return f"'{{' || array_to_string(list_filter([{parts}], lambda x: x IS NOT NULL), ',') || '}}'"


oracle("pack_templates", f"""
SELECT b.template_id, '{{"global":' || g.doc || ',"template_blocks":[' || b.docs || ']}}' AS config_yaml
FROM (SELECT template_id, string_agg(doc, ',' ORDER BY block_idx) AS docs FROM (
    SELECT template_id, block_idx, {_json_object({
        "type": "type", "query": "query", "days": "days", "zone_id": "zone_id", "title": "title",
        "description": "description", "show_legend": "show_legend", "chart_height": "chart_height",
        "width": "coalesce(width, 'full')"})} AS doc
    FROM fx_blocks_full) GROUP BY template_id) b
JOIN (SELECT id, {_json_object({
    "customer": "name", "region": "CASE WHEN id % 3 <> 0 THEN 'us2' END",
    "orientation": "CASE WHEN id % 2 = 0 THEN 'landscape' END"})} AS doc FROM fx_templates) g ON g.id = b.template_id""")

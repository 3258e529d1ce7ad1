"""Oracle SQL: frame operators and scalar functions."""

from reportlake.plans.oracle import SEV_RANK, oracle  # noqa: F401
from reportlake.plans.fixture_sql import SEV_CASE
from reportlake.sources.tables import TABLES

SEV_COLOR = ("CASE {c} WHEN 'Critical' THEN '#d32f2f' WHEN 'High' THEN '#ffa000' "
             "WHEN 'Medium' THEN '#388e3c' WHEN 'Low' THEN '#1976d2' WHEN 'Negligible' THEN '#757575' "
             "WHEN 'Informational' THEN '#00bcd4' END")
PALETTE = ("['#7b1fa2', '#00796b', '#c2185b', '#512da8', '#0097a7', "
           "'#689f38', '#5d4037', '#455a64', '#f57c00', '#303f9f']")
ISO_RE = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}(:\d{2}(:\d{2}(\.\d{1,6})?)?)?)?(Z|[+-]\d{2}:?\d{2})?$"


def parse_sql(c: str) -> str:
    """ISO text -> TIMESTAMPTZ; naive text is read as UTC whatever DuckDB's zone."""
    return (f"CASE WHEN NOT regexp_matches({c}, '{ISO_RE}') THEN NULL "
            f"WHEN regexp_matches({c}, '(Z|[+-]\\d{{2}}:?\\d{{2}})$') THEN try_cast({c} AS TIMESTAMPTZ) "
            f"ELSE timezone('UTC', try_cast({c} AS TIMESTAMP)) END")


_DESC = " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, column_name, column_type, row_number() OVER () AS pos "
    f"FROM (DESCRIBE SELECT * FROM {t})" for t in TABLES)
oracle("detect_columns", f"""
WITH c AS (
  SELECT table_name, column_name, pos,
    (column_type IN ('BIGINT', 'INTEGER', 'DOUBLE', 'BOOLEAN', 'FLOAT', 'SMALLINT', 'TINYINT', 'HUGEINT',
                     'REAL', 'UBIGINT', 'UINTEGER', 'USMALLINT', 'UTINYINT') OR column_type LIKE 'DECIMAL%') AS num
  FROM ({_DESC}))
SELECT table_name,
  coalesce(min_by(column_name, pos) FILTER (WHERE NOT num), min_by(column_name, pos)) AS cat_col,
  coalesce(min_by(column_name, pos) FILTER (WHERE num), max(column_name) FILTER (WHERE pos = 2)) AS val_col
FROM c GROUP BY table_name""")

_PIE = """
SELECT f.*, p.pct,
  coalesce(CAST(f.{cat} AS VARCHAR), 'None') || ' (' || format('{{:,}}', CAST(f.{val} AS BIGINT)) || ') - '
    || printf('%.1f', p.pct) || '%' AS label
FROM f JOIN (
  SELECT f2.*, CASE WHEN t.tot > 0 THEN CAST(CAST(f2.{val} AS BIGINT) AS DOUBLE) / t.tot * 100.0 ELSE 0.0 END AS pct
  FROM f f2 {join_tot}
) p ON {on}"""

oracle("pie_shares", _PIE.format(
    cat="vuln_severity", val="value",
    join_tot="JOIN (SELECT customer_id, CAST(sum(value) AS DOUBLE) AS tot FROM f GROUP BY 1) t USING (customer_id)",
    on="p.customer_id = f.customer_id AND p.vuln_severity = f.vuln_severity"),
    f="SELECT customer_id, vuln_severity, count(*) AS value FROM fx_customer_history GROUP BY 1, 2")

oracle("pie_shares_single_frame", _PIE.format(
    cat="Severity", val="Vulnerabilities",
    join_tot='CROSS JOIN (SELECT CAST(sum("Vulnerabilities") AS DOUBLE) AS tot FROM f) t',
    on='p."Severity" = f."Severity"'),
    f="""SELECT v.severity AS "Severity", CAST(count(*) AS BIGINT) AS "Vulnerabilities"
         FROM fx_workloads w JOIN fx_edges e ON w.workload_id = e.workload_id
         JOIN fx_vulns v ON e.vuln_id = v.vuln_id GROUP BY v.severity""")

oracle("has_severity", f"""
SELECT o_custkey AS customer_id,
  bool_or(CASE WHEN o_custkey % 3 = 0 THEN o_orderpriority ELSE {SEV_CASE} END
          IN ('Critical', 'High', 'Medium', 'Low', 'Negligible', 'Informational')) AS has_severity
FROM orders GROUP BY o_custkey""")

oracle("record_counts", """
SELECT template_id, count(*) AS n_records, 'Displaying ' || CAST(count(*) AS VARCHAR) || ' records' AS caption
FROM fx_reports GROUP BY template_id""")

oracle("traffic_light_tiles", f"""
SELECT zone_id, pos, n, label, value, value_text,
  coalesce({SEV_COLOR.format(c='label')}, {PALETTE}[pos % 10 + 1]) AS color,
  x0, x0 + bw AS x1, (x0 + (x0 + bw)) / 2 AS x_center, 0.8::DOUBLE AS label_y, 0.35::DOUBLE AS value_y
FROM (
  SELECT *, 0.01::DOUBLE + pos * (bw + 0.01::DOUBLE) AS x0 FROM (
    SELECT *, (1.0::DOUBLE - 0.01::DOUBLE * (n + 1)) / n AS bw FROM (
      SELECT zone_id, vuln_severity AS label, CAST(sum(value) AS BIGINT) AS value,
        format('{{:,}}', CAST(sum(value) AS BIGINT)) AS value_text,
        CAST(row_number() OVER (PARTITION BY zone_id ORDER BY vuln_severity) - 1 AS INTEGER) AS pos,
        count(*) OVER (PARTITION BY zone_id) AS n
      FROM fx_history GROUP BY zone_id, vuln_severity)))""")

oracle("bar_series", f"""
SELECT o_custkey AS customer_id, {SEV_CASE} AS category, CAST(floor(o_totalprice) AS BIGINT) AS value, o_orderkey,
  CAST(coalesce(sum(CAST(floor(o_totalprice) AS BIGINT)) OVER (
     PARTITION BY o_custkey, {SEV_CASE} ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
     AS BIGINT) AS stack_base,
  {SEV_COLOR.format(c=SEV_CASE)} AS color, 'v' AS orientation
FROM orders""")

_UF = """SELECT user_id, event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || 'Z' AS iso_z,
  CASE event_id % 5 WHEN 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || 'Z' WHEN 1 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S')
       WHEN 2 THEN 'not-a-date-but-long' WHEN 3 THEN '' ELSE NULL END AS iso_mix,
  CASE WHEN user_id % 3 = 0 THEN NULL ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+02:00' END AS iso_off,
  event_type FROM events"""
_COLS = ["iso_z", "iso_mix", "iso_off", "event_type"]


def _decision(c: str, rule: str) -> str:
    first = f"arg_min({c}, event_id) FILTER (WHERE {c} IS NOT NULL)"
    shape = f"regexp_replace(substr(nullif({c}, ''), 1, 19), '[0-9]', '9', 'g') || substr(nullif({c}, ''), 20)"
    dash8 = f" AND substr({first}, 8, 1) = '-'" if rule == "screen" else ""
    return (f"coalesce({first} IS NOT NULL AND length({first}) >= 19 AND substr({first}, 5, 1) = '-'{dash8} "
            f"AND contains({first}, 'T') AND min({shape}) = max({shape}) "
            f"AND bool_and(nullif({c}, '') IS NULL OR ({parse_sql(f'nullif({c}, {chr(39)}{chr(39)})')}) IS NOT NULL), "
            f"false)")


def _dt_cols(rule: str) -> str:
    parts = [f"SELECT user_id, '{c}' AS \"column\", {_decision(c, rule)} AS is_datetime FROM uf GROUP BY user_id"
             for c in _COLS]
    return " UNION ALL ".join(parts)


oracle("datetime_columns", _dt_cols("screen"), uf=_UF)
oracle("datetime_columns_print", _dt_cols("print"), uf=_UF)

_fmt = "strftime(try_strptime(substr({c}, 1, 19), '%Y-%m-%dT%H:%M:%S'), '%b %-d, %Y, %-I:%M %p')"
oracle("fmt_datetime_columns", "SELECT uf.user_id, uf.event_id, " + ", ".join(
    f"CASE WHEN d.{c} THEN {_fmt.format(c='uf.' + c)} ELSE uf.{c} END AS {c}" for c in _COLS)
    + " FROM uf JOIN (SELECT user_id, " + ", ".join(f"{_decision(c, 'screen')} AS {c}" for c in _COLS)
    + " FROM uf GROUP BY user_id) d USING (user_id)", uf=_UF)

_print = ("CASE WHEN coalesce({c}, '') = '' THEN 'nan' "
          "ELSE strftime(try_strptime(substr({c}, 1, 19), '%Y-%m-%dT%H:%M:%S'), '%b %d %Y %H:%M') END")
oracle("fmt_datetime_columns_print", "SELECT uf.user_id, uf.event_id, " + ", ".join(
    f"CASE WHEN d.{c} THEN {_print.format(c='uf.' + c)} ELSE uf.{c} END AS {c}" for c in _COLS)
    + " FROM uf JOIN (SELECT user_id, " + ", ".join(f"{_decision(c, 'print')} AS {c}" for c in _COLS)
    + " FROM uf GROUP BY user_id) d USING (user_id)", uf=_UF)

_CUST = [("c_custkey", "coalesce(CAST(c_custkey AS VARCHAR), 'None')"),
         ("c_name", "coalesce(c_name, 'None')"),
         ("c_nationkey", "coalesce(CAST(c_nationkey AS VARCHAR), 'None')"),
         ("c_acctbal", "coalesce(CAST(c_acctbal AS VARCHAR), 'nan')"),
         ("c_mktsegment", "coalesce(c_mktsegment, 'None')")]
oracle("column_widths", "SELECT CAST(pos AS INTEGER) AS pos, \"column\", CAST(max_len AS INTEGER) AS max_len, "
       "w * (100.0::DOUBLE / s) AS width FROM w CROSS JOIN s",
       m="SELECT " + ", ".join(f"max(length({e})) AS l{i}" for i, (_, e) in enumerate(_CUST)) + " FROM customer",
       u=" UNION ALL ".join(f"SELECT {i} AS pos, '{c}' AS \"column\", "
                            f"least(greatest({len(c)}, coalesce(l{i}, 0)), 40) AS max_len FROM m"
                            for i, (c, _) in enumerate(_CUST)),
       tt="SELECT sum(max_len) AS total FROM u",
       w="SELECT pos, \"column\", max_len, greatest(CAST(max_len AS DOUBLE) / CAST(total AS DOUBLE) * 100.0::DOUBLE, "
         "100.0::DOUBLE * 0.08::DOUBLE) AS w FROM u CROSS JOIN tt",
       s="SELECT list_reduce(list(w ORDER BY pos), lambda a, b: a + b) AS s FROM w")

oracle("fmt_thousands", """
SELECT o_orderkey, format('{:,}', CAST(floor(o_totalprice) * CASE WHEN o_orderkey % 2 = 0 THEN -1 ELSE 1 END AS BIGINT))
  AS text FROM orders""")

oracle("iso_to_display", f"""
SELECT event_id, CASE WHEN iso IS NULL OR iso = '' THEN ''
  ELSE coalesce(strftime(timezone('Australia/Sydney', {parse_sql('iso')}), '%d/%b/%Y %H:%M'), substr(iso, 1, 16))
  END AS display FROM fx_iso""")

oracle("truncate_cells", """
SELECT page_id, CASE WHEN length(url) > 40 THEN substr(url, 1, 38) || '..' ELSE url END AS url FROM pages""")

oracle("report_filename", """
SELECT r.id, CASE WHEN r.status = 'failed'
    THEN 'failed_' || CAST(r.template_id AS VARCHAR) || '_' || strftime(r.generated_at, '%Y%m%d_%H%M%S') || '.pdf'
    ELSE translate(t.name || ' a/b', ' /', '__') || '_' || strftime(r.generated_at, '%Y%m%d_%H%M%S') || '.pdf'
  END AS filename
FROM fx_reports r JOIN fx_templates t ON r.template_id = t.id""")

oracle("clip_error", "SELECT doc_id, substr(text, 1, 500) AS error_message FROM documents")

oracle("severity_color", f"""
SELECT o_orderkey, {SEV_CASE} AS severity,
  coalesce({SEV_COLOR.format(c=SEV_CASE)}, {PALETTE}[o_orderkey % 10 + 1]) AS color FROM orders""")

oracle("cell_text", """
SELECT c_custkey, CAST(c_custkey AS VARCHAR) AS c_custkey_text,
  coalesce(CAST(c_acctbal AS VARCHAR), 'nan') AS c_acctbal_text,
  coalesce(CAST(c_acctbal * 10000 AS VARCHAR), 'nan') AS big_text,
  coalesce(CAST(c_acctbal / 10000000 AS VARCHAR), 'nan') AS small_text,
  coalesce(CAST(CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE c_acctbal END AS VARCHAR), 'nan') AS gappy_text,
  CASE WHEN c_acctbal > 0 THEN 'True' ELSE 'False' END AS positive_text,
  coalesce(CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_mktsegment END, 'None') AS seg_text
FROM customer""")

_PF = "strftime(try_strptime(substr({c}, 1, 19), '%Y-%m-%dT%H:%M:%S'), '%b %d %Y %H:%M')"
_W_COLS = ["event_id", "iso_z", "iso_mix", "iso_off", "event_type"]


def _cell_len(c: str) -> str:
    if c == "event_id":
        return "length(coalesce(CAST(uf.event_id AS VARCHAR), 'None'))"
    return (f"CASE WHEN d.{c} THEN length(coalesce({_PF.format(c='uf.' + c)}, 'nan')) "
            f"ELSE length(coalesce(uf.{c}, 'None')) END")


oracle("column_widths_per_frame", """
SELECT user_id, CAST(pos AS INTEGER) AS pos, "column", CAST(max_len AS INTEGER) AS max_len,
  w * (100.0::DOUBLE / s) AS width
FROM ww JOIN ss USING (user_id)""",
       uf=_UF,
       d="SELECT user_id, " + ", ".join(f"{_decision(c, 'print')} AS {c}" for c in _W_COLS[1:])
         + " FROM uf GROUP BY user_id",
       m="SELECT uf.user_id, " + ", ".join(f"max({_cell_len(c)}) AS l{i}" for i, c in enumerate(_W_COLS))
         + " FROM uf JOIN d USING (user_id) GROUP BY uf.user_id",
       u=" UNION ALL ".join(f"SELECT user_id, {i} AS pos, '{c}' AS \"column\", "
                            f"least(greatest({len(c)}, coalesce(l{i}, 0)), 40) AS max_len FROM m"
                            for i, c in enumerate(_W_COLS)),
       tt="SELECT user_id, sum(max_len) AS total FROM u GROUP BY user_id",
       ww="SELECT u.user_id, pos, \"column\", max_len, greatest(CAST(max_len AS DOUBLE) / CAST(total AS DOUBLE) "
          "* 100.0::DOUBLE, 100.0::DOUBLE * 0.08::DOUBLE) AS w FROM u JOIN tt USING (user_id)",
       ss="SELECT user_id, list_reduce(list(w ORDER BY pos), lambda a, b: a + b) AS s FROM ww GROUP BY user_id")

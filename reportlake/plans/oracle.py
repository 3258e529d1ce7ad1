"""DuckDB oracle SQL for the registered queries.

Written independently of the Spark code, from the rules of the inventory.
Fixture views come from ``fixture_sql.with_fx``. DuckDB's ``sum(BIGINT)`` is
HUGEINT, so sums are cast back; ``arg_min/arg_max`` are avoided in favour of
``row_number`` with explicit null placement.
"""

from __future__ import annotations

from reportlake.plans.fixture_sql import with_fx

ORACLE: dict[str, str] = {}


def oracle(name: str, body: str, **extra: str) -> None:
    ORACLE[name] = with_fx(body, extra or None)


SEVERITIES = "('Critical', 'High', 'Medium', 'Low', 'Negligible', 'Informational')"
SEV_RANK = ("list_position(['Critical', 'High', 'Medium', 'Low', 'Negligible', 'Informational'], "
            "{c})")


def trend_sql(src: str, keys: list[str], ts: str = "timestamp", value: str = "value",
              sev: str = "vuln_severity") -> str:
    """A1 in SQL: first/last row by row_number with nulls last, value tiebreak."""
    k = ", ".join(keys)
    kp = (k + ", ") if keys else ""
    part = f"PARTITION BY {kp}{sev}"
    return f"""
SELECT {kp}severity, start_value, end_value, end_value - start_value AS change,
  CASE WHEN start_value > 0 THEN CAST(end_value - start_value AS DOUBLE) / CAST(start_value AS DOUBLE) * 100.0
       WHEN end_value > 0 THEN 100.0 ELSE 0.0 END AS pct_change,
  CASE WHEN end_value - start_value < 0 THEN 'improved'
       WHEN end_value - start_value > 0 THEN 'worsened' ELSE 'unchanged' END AS trend
FROM (
  SELECT {kp}{sev} AS severity,
    max(CASE WHEN rn_first = 1 THEN CAST(trunc({value}) AS BIGINT) END) AS start_value,
    max(CASE WHEN rn_last = 1 THEN CAST(trunc({value}) AS BIGINT) END) AS end_value,
    count(*) AS n
  FROM (
    SELECT *, row_number() OVER ({part} ORDER BY {ts} ASC NULLS LAST, {value} ASC) AS rn_first,
              row_number() OVER ({part} ORDER BY {ts} DESC NULLS FIRST, {value} DESC) AS rn_last
    FROM {src} WHERE {sev} IN {SEVERITIES} AND {value} IS NOT NULL
  ) GROUP BY {kp}{sev}
) WHERE n >= 2"""


def all_oracles() -> dict[str, str]:
    from reportlake.plans import o_history, o_catalog, o_frames, o_blocks, o_sources  # noqa: F401
    from reportlake.plans import o_schedule, o_maintenance, o_streaming, o_reports  # noqa: F401
    return dict(ORACLE)

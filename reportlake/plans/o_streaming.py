"""Oracle SQL: streaming. T2's merged table has a closed form (the latest
fetch containing month m is fetch floor(m / 3)); T3 must equal the batch
trend (A1) on that table."""

from reportlake.plans.oracle import oracle, trend_sql

_MERGED = """
SELECT zone_id, vuln_severity, timestamp, CAST(value + floor(m / 3) AS BIGINT) AS value,
  TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(floor(m / 3) AS INTEGER)) AS fetched_at
FROM (
  SELECT *, (year(timestamp) - year(t0)) * 12 + month(timestamp) - month(t0) AS m
  FROM fx_history CROSS JOIN (SELECT min(timestamp) AS t0 FROM fx_history))"""

oracle("ingest_history_stream", _MERGED)
oracle("trend_stream", f"SELECT * FROM ({trend_sql('mg', ['zone_id'])})", mg=_MERGED)

_RECENT = """
SELECT * FROM (SELECT *, max(timestamp) OVER (PARTITION BY zone_id, vuln_severity) AS newest FROM mg)
WHERE timestamp >= newest - to_days(400)"""
oracle("trend_stream_window", f"SELECT * FROM ({trend_sql('recent', ['zone_id'])})", mg=_MERGED, recent=_RECENT)

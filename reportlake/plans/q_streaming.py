"""Registered streaming queries (T2, T3). Each lands the fetch files it
streams from the fixture history, in a fresh folder under the session's
checkpoint folder."""

from __future__ import annotations

from reportlake.plans.registry import query
from reportlake.session import scratch_path
from reportlake.sources import fixtures as FX
from reportlake.streaming import history_stream as HS


@query("ingest_history_stream")
def q_ingest(spark, d):
    base = scratch_path(spark, "ingest")
    HS.land_history_fetches(FX.fx_history(spark, d), f"{base}/in", revise=True)
    return HS.ingest_history_stream(spark, f"{base}/in", f"{base}/out", f"{base}/ckpt")


@query("trend_stream")
def q_trend_stream(spark, d):
    base = scratch_path(spark, "trend")
    HS.land_history_fetches(FX.fx_history(spark, d), f"{base}/in", revise=True)
    return HS.trend_stream(spark, f"{base}/in", f"{base}/out", f"{base}/ckpt", keys=["zone_id"])


@query("trend_stream_window")
def q_trend_stream_window(spark, d):
    """Only the points of the last 400 days of each zone and severity count."""
    base = scratch_path(spark, "trend-window")
    HS.land_history_fetches(FX.fx_history(spark, d), f"{base}/in", revise=True)
    return HS.trend_stream(spark, f"{base}/in", f"{base}/out", f"{base}/ckpt", keys=["zone_id"],
                           max_files_per_trigger=4, window_days=400)

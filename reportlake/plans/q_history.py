"""Registered history queries."""

from __future__ import annotations

import datetime as dt

from reportlake.functions import scalars as S
from reportlake.operators import history as H
from reportlake.plans.registry import query
from reportlake.sources import fixtures as FX


@query("trend_insights")
def q_trend_insights(spark, d):
    return H.trend_insights(FX.fx_history(spark, d), keys=["zone_id"])


@query("trend_insights_by_customer")
def q_trend_insights_by_customer(spark, d):
    return H.trend_insights(FX.fx_customer_history(spark, d), keys=["customer_id"])


@query("trend_insights_all_zones")
def q_trend_insights_all_zones(spark, d):
    return H.trend_insights(H.all_zones_rollup(FX.fx_history(spark, d)))


@query("insight_table")
def q_insight_table(spark, d):
    ins = H.trend_insights(FX.fx_customer_history(spark, d), keys=["customer_id"])
    return H.insight_table(ins, keys=["customer_id"])


@query("history_window")
def q_history_window(spark, d):
    return H.history_window(FX.fx_history(spark, d), now=dt.datetime(1998, 3, 10, 9, 30),
                            days=400, zone_id=2)


@query("history_window_sydney")
def q_history_window_sydney(spark, d):
    """A week over the end of daylight saving on 1998-03-29, in local days."""
    from reportlake.plans.q_reports import fx_daily_history
    return H.history_window(fx_daily_history(spark, d), now=dt.datetime(1998, 4, 2, 9, 0), days=7,
                            tz="Australia/Sydney")


@query("fmt_trend_change")
def q_fmt_trend_change(spark, d):
    t = H.trend_insights(FX.fx_customer_history(spark, d), keys=["customer_id"])
    return t.select("customer_id", "severity",
                    S.fmt_trend_change("change", "pct_change", "trend").alias("change_text"))


@query("history_window_all_zones")
def q_history_window_all(spark, d):
    return H.history_window(FX.fx_customer_history(spark, d), now=dt.datetime(1998, 3, 10, 9, 30),
                            days=31, zone_id=None)


@query("all_zones_rollup")
def q_all_zones_rollup(spark, d):
    return H.all_zones_rollup(FX.fx_history(spark, d))


@query("history_by_zone_name")
def q_history_by_zone_name(spark, d):
    return H.history_by_zone_name(FX.fx_history(spark, d), FX.fx_zones(spark, d), "EUROPE")


@query("severity_rank")
def q_severity_rank(spark, d):
    return H.with_severity_rank(FX.fx_history(spark, d))


@query("history_series")
def q_history_series(spark, d):
    return H.history_series(FX.fx_history(spark, d), keys=["zone_id"])


@query("trend_color")
def q_trend_color(spark, d):
    ins = H.trend_insights(FX.fx_customer_history(spark, d), keys=["customer_id"])
    return H.insight_table(ins, keys=["customer_id"]).select(
        "customer_id", "Severity", S.trend_color("Change").alias("color"))

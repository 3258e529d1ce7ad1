"""Registered schedule queries."""

from __future__ import annotations

import datetime as dt

from reportlake.operators import schedule as SC
from reportlake.plans.registry import query
from reportlake.sources import fixtures as FX

NOW = dt.datetime(2024, 4, 1, 10, 30)  # a Monday, UTC


@query("due_flags")
def q_due_flags(spark, d):
    return SC.due_flags(FX.fx_templates(spark, d).where("schedule_enabled = 1"), NOW)


@query("due_templates")
def q_due_templates(spark, d):
    return SC.due_templates(FX.fx_templates(spark, d), NOW).select("id", "name", "schedule_timezone")


@query("schedule_violations")
def q_schedule_violations(spark, d):
    return SC.schedule_violations(FX.fx_templates(spark, d))


@query("due_by_tick")
def q_due_by_tick(spark, d):
    return SC.due_by_tick(FX.fx_templates(spark, d), FX.fx_ticks(spark, d))


@query("due_by_tick_after_runs")
def q_due_by_tick_after_runs(spark, d):
    """Continuing from every template's stored last run."""
    return SC.due_by_tick(FX.fx_templates(spark, d), FX.fx_ticks(spark, d), after_last_run=True)

"""Physical-plan checks: pushdown, exchange counts, no single-partition or
cartesian steps in keyed operators."""

import datetime as dt

from conftest import SF_TINY
from reportlake.operators import catalog as C
from reportlake.operators import frames as FR
from reportlake.operators import history as H
from reportlake.operators import schedule as SC
from reportlake.plans import q_frames as QF
from reportlake.sources import fixtures as FX


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_history_window_pushes_filter_to_scan(spark):
    df = H.history_window(FX.fx_customer_history(spark, SF_TINY), dt.datetime(1998, 3, 10, 9, 30), 31)
    p = plan(df)
    assert "PushedFilters: [IsNotNull(o_orderdate), GreaterThanOrEqual(o_orderdate" in p
    assert "ReadSchema: struct<o_custkey:bigint,o_totalprice:double,o_orderdate:timestamp_ntz,o_orderpriority" in p


def test_keyed_trend_has_one_exchange(spark):
    df = H.trend_insights(FX.fx_customer_history(spark, SF_TINY), keys=["customer_id"])
    p = plan(df)
    assert p.count("Exchange hashpartitioning") == 1
    assert "partial_min_by" in p
    assert "SortAggregate" not in p  # integer values: the packed decimal order keeps it hash-based
    assert "SinglePartition" not in p


def test_keyed_operators_never_single_partition(spark):
    frames = [
        FR.pie_shares(QF.severity_frames(spark, SF_TINY), "vuln_severity", "value", keys=["customer_id"]),
        FR.traffic_light_tiles(QF.zone_frames(spark, SF_TINY), "vuln_severity", "value", ["vuln_severity"],
                               keys=["zone_id"]),
        C.retention_expired(FX.fx_reports(spark, SF_TINY), FX.fx_templates(spark, SF_TINY)),
        C.recent_reports(FX.fx_reports(spark, SF_TINY)),
        C.latest_report(FX.fx_reports(spark, SF_TINY)),
    ]
    for df in frames:
        p = plan(df)
        assert "SinglePartition" not in p, p


def test_recent_reports_limits_before_shuffle(spark):
    p = plan(C.recent_reports(FX.fx_reports(spark, SF_TINY)))
    assert "WindowGroupLimit" in p


def test_due_by_tick_has_no_cartesian(spark):
    p = plan(SC.due_by_tick(FX.fx_templates(spark, SF_TINY), FX.fx_ticks(spark, SF_TINY)))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_severity_counts_pre_aggregates_edges(spark):
    df = C.severity_counts(FX.fx_workloads(spark, SF_TINY), FX.fx_edges(spark, SF_TINY), FX.fx_vulns(spark, SF_TINY))
    p = plan(df)
    assert "TakeOrderedAndProject" in p
    assert p.count("HashAggregate") >= 6  # workloads, per-vulnerability and per-severity (partial + final)


def test_bucketed_run_log_needs_no_shuffle(spark, tmp_path):
    from reportlake.sources.catalog_io import write_bucketed
    r = write_bucketed(FX.fx_reports(spark, SF_TINY), "rl_test_runs_b", "template_id", 8,
                       path=str(tmp_path / "runs"))
    t = write_bucketed(FX.fx_templates(spark, SF_TINY).withColumnRenamed("id", "template_id"),
                       "rl_test_templates_b", "template_id", 8,
                       path=str(tmp_path / "templates")).withColumnRenamed("template_id", "id")
    assert "Exchange" not in plan(C.latest_report(r))
    assert "Exchange hashpartitioning(template_id" not in plan(C.recent_reports(r))
    assert C.latest_report(r).count() == C.latest_report(FX.fx_reports(spark, SF_TINY)).count()
    assert t.count() == FX.fx_templates(spark, SF_TINY).count()

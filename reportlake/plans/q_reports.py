"""Registered composite queries (B1, B2)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from reportlake.operators import maintenance as M
from reportlake.plans import reports as R
from reportlake.plans.registry import query
from reportlake.session import scratch_path
from reportlake.sources import bundle as BU
from reportlake.sources import fixtures as FX
from reportlake.sources.tables import read_table

NOW = dt.datetime(1998, 3, 10, 9, 30)
# Block query library of the run fixture (query name in fx_blocks_full -> text).
QUERY_TEXT = {
    "q0": ("SELECT severity AS Severity, count(*) AS Vulnerabilities FROM rl_vulns "
           "GROUP BY severity ORDER BY Severity DESC LIMIT 4"),
    "q1": "SELECT name FROM rl_workloads WHERE name LIKE 'zzz%'",
    "q2": "SELECT * FROM rl_no_such_table",
}
DEFAULT_BLOCK_QUERY = (
    "SELECT v.severity AS Severity, count(*) AS Vulnerabilities "
    "FROM rl_workloads k JOIN rl_edges e ON k.workload_id = e.workload_id "
    "JOIN rl_vulns v ON e.vuln_id = v.vuln_id GROUP BY v.severity ORDER BY Severity DESC LIMIT 4")


def fx_daily_history(spark, d):
    """Daily vulnerability counts per severity and zone."""
    o = read_table(spark, d, "orders").select("o_custkey", "o_orderdate", "o_orderpriority")
    c = read_table(spark, d, "customer").select("c_custkey", "c_nationkey")
    n = read_table(spark, d, "nation").select("n_nationkey", "n_regionkey")
    j = (o.join(c, o.o_custkey == c.c_custkey)
         .join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")))  # 25-row dim
    return (j.groupBy(F.col("o_orderdate").alias("timestamp"),
                      FX.severity_of(F.col("o_orderpriority")).alias("vuln_severity"),
                      (F.col("n_regionkey") + 1).alias("zone_id"))
            .agg(F.count(F.lit(1)).alias("value")))


def _views(spark, d):
    return {"rl_vulns": FX.fx_vulns(spark, d), "rl_workloads": FX.fx_workloads(spark, d),
            "rl_edges": FX.fx_edges(spark, d)}


def _run(spark, d):
    b = FX.fx_blocks_full(spark, d)
    q = F.col("query")
    for name, text in QUERY_TEXT.items():
        q = F.when(F.col("query") == name, F.lit(text)).otherwise(q)
    b = b.withColumn("query", q)
    return R.run_reports(spark, b, fx_daily_history(spark, d), NOW, views=_views(spark, d),
                         queries=QUERY_TEXT.values())


@query("block_results")
def q_block_results(spark, d):
    return _run(spark, d)["results"]


@query("run_reports_series")
def q_run_series(spark, d):
    return _run(spark, d)["series"]


@query("run_reports_tiles")
def q_run_tiles(spark, d):
    return _run(spark, d)["tiles"]


@query("run_reports_bars")
def q_run_bars(spark, d):
    return _run(spark, d)["bars"]


@query("run_reports_pies")
def q_run_pies(spark, d):
    return _run(spark, d)["pies"]


@query("run_reports_tables")
def q_run_tables(spark, d):
    return _run(spark, d)["tables"]


@query("run_reports_log")
def q_run_log(spark, d):
    """The run log after a scheduled run of every template."""
    t = FX.fx_templates(spark, d)
    rows = R.run_rows(_run(spark, d)["results"], t, dt.datetime(2030, 1, 1, 6, 0))
    return M.append_runs(FX.fx_reports(spark, d), t, rows)["runs"]


@query("run_reports_trends")
def q_run_trends(spark, d):
    return _run(spark, d)["trends"]


@query("query_block")
def q_query_block(spark, d):
    return R.query_block(spark, {"type": "pie_chart", "query": DEFAULT_BLOCK_QUERY}, views=_views(spark, d))


@query("query_block_tiles")
def q_query_block_tiles(spark, d):
    return R.query_block(spark, {"type": "traffic_lights", "query": QUERY_TEXT["q0"]}, views=_views(spark, d))


@query("query_block_bars")
def q_query_block_bars(spark, d):
    sql = ("SELECT severity AS Severity, vuln_id % 3 AS bucket, count(*) AS Vulnerabilities "
           "FROM rl_vulns GROUP BY severity, vuln_id % 3")
    return R.query_block(spark, {"type": "horizontal_bar", "query": sql}, views=_views(spark, d))



@query("report_bundle")
def q_report_bundle(spark, d):
    """The run rows of a written bundle: a row for each template, from the manifest."""
    results = _run(spark, d)["results"]
    rows = BU.write_bundle(results, scratch_path(spark, "bundle"), "run-1")
    return rows.select("template_id", "run_id", "status", "n_rows", (F.col("file_size") > 0).alias("has_bytes"))


@query("report_bundle_rows")
def q_report_bundle_rows(spark, d):
    """The result rows read back from a bundle that was written twice: the second write alone."""
    results, path = _run(spark, d)["results"], scratch_path(spark, "bundle")
    BU.write_bundle(results.where("status = 'error'"), path, "run-2")
    BU.write_bundle(results, path, "run-2")
    return BU.read_bundle(spark, path, "run-2")

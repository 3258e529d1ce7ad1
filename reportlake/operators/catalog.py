"""Report-catalogue operators: templates x schedules x run log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reportlake import constants as K
from reportlake.functions import scalars as S


def run_order() -> list[Column]:
    """Newest run first: generated_at descending (nulls last), then id."""
    return [F.col("generated_at").desc_nulls_last(), F.col("id").desc()]


def retain_limit(retain) -> Column:
    """``retain_count or 10``: null and 0 both mean 10."""
    r = F.col(retain) if isinstance(retain, str) else retain
    return F.when(r.isNull() | (r == 0), F.lit(K.DEFAULT_RETAIN)).otherwise(r)


def _run_key(prefix: str = "") -> Column:
    """Total order of runs, newest greatest: (has time, generated_at, id)."""
    g, i = F.col(prefix + "generated_at"), F.col(prefix + "id")
    return F.struct(g.isNotNull().alias("k0"), g.alias("k1"), i.alias("k2"))


# ---------------------------------------------------------------- filters
def active_schedules(t: DataFrame) -> DataFrame:
    """Templates with ``schedule_enabled = 1``."""
    return t.where(F.col("schedule_enabled") == 1)


def template_by_id(t: DataFrame, template_id: int) -> DataFrame:
    """Point lookup; pushed to the scan as an equality filter."""
    return t.where(F.col("id") == F.lit(template_id))


def downloadable_reports(r: DataFrame, files: DataFrame, path: str = "file_path") -> DataFrame:
    """Successful runs whose file is present in the sink listing."""
    return r.where(F.col("status") == "success").join(files.select(path), path, "left_semi")


def templates_by_recency(t: DataFrame) -> DataFrame:
    """All templates, most recently updated first (O1)."""
    return t.orderBy(F.col("updated_at").desc_nulls_last(), F.col("id").desc())


# ---------------------------------------------------------------- joins
def report_catalog(r: DataFrame, t: DataFrame) -> DataFrame:
    """Run log with its template name, newest first (J1). Inner join: runs of
    deleted templates vanish. The names side is a projection of the
    catalogue; AQE turns the join into a broadcast only when its runtime size
    is under the threshold, else it stays a shuffle join (skew-split)."""
    names = t.select(F.col("id").alias("_tid"), F.col("name").alias("template_name"))
    return (r.join(names, F.col("template_id") == F.col("_tid"), "inner").drop("_tid")
            .orderBy(*run_order()))


def orphan_reports(r: DataFrame, t: DataFrame) -> DataFrame:
    """Runs whose template no longer exists."""
    return r.join(t.select(F.col("id").alias("_tid")), F.col("template_id") == F.col("_tid"), "left_anti")


# ---------------------------------------------------------------- windows
def latest_report(r: DataFrame) -> DataFrame:
    """Newest run per template (W1): ``max_by`` over the run order, a partial
    (map-side) aggregate, so a template with most runs never lands whole in
    one task."""
    cols = [c for c in r.columns if c != "template_id"]
    best = F.max_by(F.struct(*cols), _run_key())
    return r.groupBy("template_id").agg(best.alias("_r")).select("template_id", "_r.*")


def recent_reports(r: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` newest runs per template, with their rank (W3). The
    ``row_number() <= n`` filter becomes a WindowGroupLimit that keeps n rows
    per template before and after the shuffle."""
    w = Window.partitionBy("template_id").orderBy(*run_order())
    return r.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def mark_expired(r: DataFrame, t: DataFrame) -> DataFrame:
    """Every run with ``_expired``: is it beyond the newest K of its template?
    K = retain count, null or 0 -> 10, negative -> 0 (everything expires);
    failures count; runs without a time are the oldest; nothing of an unknown
    template expires.

    Runs are counted per template and day and the counts summed newest day
    first, which gives each template the day that holds its K-th run: earlier
    days expire, later ones stay. Only the runs of those days are ranked, for the
    K-th run itself; then every run is compared with its template's cut. The run
    log is never shuffled or sorted whole."""
    k = F.greatest(retain_limit("schedule_retain_count"), F.lit(0)).cast("bigint")
    lim = t.select(F.col("id").alias("_tid"), k.alias("_k"))
    day = F.coalesce(F.to_date("generated_at"), F.lit("0001-01-01").cast("date"))  # no time: the oldest day
    newer = (Window.partitionBy("_tid").orderBy(F.col("_day").desc())
             .rowsBetween(Window.unboundedPreceding, -1))
    days = r.groupBy(F.col("template_id").alias("_tid"), day.alias("_day")).agg(F.count(F.lit(1)).alias("_n"))
    days = days.join(lim, "_tid").withColumn("_newer", F.coalesce(F.sum("_n").over(newer), F.lit(0)))
    rest = F.col("_k") - F.col("_newer")  # runs of the day that stay
    holds = ((rest > 0) & (rest <= F.col("_n"))) | ((F.col("_k") == 0) & (F.col("_newer") == 0))
    cut = days.where(holds).select("_tid", F.col("_day").alias("_cut"), rest.alias("_rest"), "_n")

    split = cut.where((F.col("_rest") > 0) & (F.col("_rest") < F.col("_n")))
    inside = r.select("template_id", "id", "generated_at").join(
        split, (F.col("template_id") == F.col("_tid")) & (day == F.col("_cut")))
    rank = F.row_number().over(Window.partitionBy("template_id").orderBy(*run_order()))
    kth = inside.withColumn("_rank", rank).where(F.col("_rank") == F.col("_rest")).select(
        F.col("template_id").alias("_tid"), _run_key().alias("_kth"))
    cut = cut.join(kth, "_tid", "left").select(F.col("_tid"), "_cut", "_rest", "_kth")
    j = r.join(cut, F.col("template_id") == F.col("_tid"), "left")
    gone = (day < F.col("_cut")) | ((day == F.col("_cut")) & ((F.col("_rest") == 0) | (_run_key() < F.col("_kth"))))
    return j.select(*r.columns, F.coalesce(gone, F.lit(False)).alias("_expired"))


def retention_expired(r: DataFrame, t: DataFrame) -> DataFrame:
    """Runs beyond the newest K of their template (W2); see :func:`mark_expired`."""
    return mark_expired(r, t).where("_expired").drop("_expired")


def template_overview(t: DataFrame, r: DataFrame) -> DataFrame:
    """Every template with its latest run (or none), status icon and schedule
    label (J2): latest-per-template aggregate, then one left outer join --
    replaces one lookup per template."""
    last = latest_report(r.select("template_id", "id", "status", "generated_at")).select(
        F.col("template_id").alias("_tid"), F.col("id").alias("last_run_id"),
        F.col("status").alias("last_status"), F.col("generated_at").alias("last_generated_at"))
    j = t.join(last, F.col("id") == F.col("_tid"), "left")
    return j.select(
        "id", "name", "last_run_id", "last_status", "last_generated_at",
        F.when(F.col("last_status").isNotNull(), S.status_icon("last_status")).alias("last_icon"),
        S.schedule_label("schedule_enabled", "schedule_frequency", "schedule_hour",
                         "schedule_timezone", "schedule_day_of_week",
                         "schedule_day_of_month").alias("schedule_label"),
    )


# ---------------------------------------------------------------- matching
def severity_counts(workloads: DataFrame, edges: DataFrame, vulns: DataFrame,
                    limit: int | None = 4, order: str = "lexical") -> DataFrame:
    """The default block query (J3): workloads affected by vulnerabilities,
    matched pairs counted per severity, severity descending, top ``limit``.

    Counted exactly as the inner join would (duplicates multiply), but with
    eager aggregation: workloads collapse to a count per id, edges to a
    weight per vulnerability, so the join with ``vulns`` sees one row per
    vulnerability instead of one per edge. Each join goes through AQE
    (runtime broadcast when small, skew split otherwise).
    """
    wc = workloads.groupBy("workload_id").agg(F.count(F.lit(1)).alias("_wn"))
    per_vuln = (edges.join(wc, "workload_id")
                .groupBy("vuln_id").agg(F.sum("_wn").alias("_w")))
    per_sev = (per_vuln.join(vulns.select("vuln_id", "severity"), "vuln_id")
               .groupBy(F.col("severity").alias("Severity"))
               .agg(F.sum("_w").cast("bigint").alias("Vulnerabilities")))
    if order == "rank":
        from reportlake.operators.history import severity_rank
        key = F.when(severity_rank("Severity") == 0, 99).otherwise(severity_rank("Severity"))
        per_sev = per_sev.orderBy(key.asc(), F.col("Severity").desc())
    else:
        per_sev = per_sev.orderBy(F.col("Severity").desc_nulls_last())
    return per_sev.limit(limit) if limit else per_sev

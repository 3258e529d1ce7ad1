"""Hot keys: one template / customer holding a third of all rows. Results
must stay exact (against brute-force windows) with the skew-safe plans."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from reportlake.operators import catalog as C
from reportlake.operators import frames as FR
from reportlake.operators import history as H


@pytest.fixture(scope="module")
def runs(spark):
    n = 60_000
    ids = spark.range(n)
    return ids.select(
        "id",
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 997 + 1).alias("template_id"),
        (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
         + F.make_dt_interval(F.lit(0), F.lit(0), (F.col("id") * 7919 % 50_000).cast("long"))).alias("generated_at"),
        F.when(F.col("id") % 5 == 0, "failed").otherwise("success").alias("status"))


@pytest.fixture(scope="module")
def templates(spark):
    return spark.range(0, 998).select(F.col("id"), F.when(F.col("id") % 4 == 0, None).otherwise(
        F.col("id") % 150).cast("int").alias("schedule_retain_count"))


def test_retention_exact_under_skew(spark, runs, templates):
    lim = templates.select(F.col("id").alias("template_id"), C.retain_limit("schedule_retain_count").alias("k"))
    w = Window.partitionBy("template_id").orderBy(F.col("generated_at").desc(), F.col("id").desc())
    want = runs.withColumn("rn", F.row_number().over(w)).join(lim, "template_id").where("rn > k").select("id")
    got = C.retention_expired(runs, templates).select("id")
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    # retain counts above the editor bound (100) take the exact path and agree too
    assert templates.where("schedule_retain_count > 100").count() > 0


def test_latest_and_recent_under_skew(spark, runs):
    w = Window.partitionBy("template_id").orderBy(F.col("generated_at").desc(), F.col("id").desc())
    want = runs.withColumn("rn", F.row_number().over(w))
    latest = C.latest_report(runs).select("template_id", "id")
    assert latest.exceptAll(want.where("rn = 1").select("template_id", "id")).count() == 0
    p = C.recent_reports(runs)._jdf.queryExecution().executedPlan().toString()
    # the per-template limit runs before the exchange as well as after it
    assert p.count("WindowGroupLimit") == 2


def test_trend_exact_under_skew(spark, runs):
    h = runs.select(F.col("template_id").alias("customer_id"), F.col("generated_at").alias("timestamp"),
                    (F.col("id") % 101).alias("value"),
                    F.when(F.col("id") % 2 == 0, "High").otherwise("Low").alias("vuln_severity"))
    got = H.trend_insights(h, keys=["customer_id"]).select("customer_id", "severity", "start_value", "end_value")
    first = Window.partitionBy("customer_id", "vuln_severity").orderBy("timestamp", "value")
    last = Window.partitionBy("customer_id", "vuln_severity").orderBy(F.col("timestamp").desc(), F.col("value").desc())
    b = (h.withColumn("a", F.row_number().over(first)).withColumn("z", F.row_number().over(last))
         .groupBy("customer_id", F.col("vuln_severity").alias("severity"))
         .agg(F.max(F.when(F.col("a") == 1, F.col("value"))).alias("start_value"),
              F.max(F.when(F.col("z") == 1, F.col("value"))).alias("end_value"), F.count(F.lit(1)).alias("n"))
         .where("n >= 2").drop("n"))
    assert got.exceptAll(b).count() == 0 and b.exceptAll(got).count() == 0


def test_bar_offsets_exact_under_skew(spark, runs):
    f = runs.select("template_id", "id", "status", (F.col("id") % 13).alias("amount"))
    got = FR.bar_series(f, "status", "amount", order_by=["id"], keys=["template_id"])
    w = Window.partitionBy("template_id", "status").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    want = f.select("template_id", "id", F.coalesce(F.sum("amount").over(w), F.lit(0)).alias("stack_base"))
    g = got.select("template_id", "id", "stack_base")
    assert g.exceptAll(want).count() == 0 and want.exceptAll(g).count() == 0


def test_tiles_positions_exact_under_skew(spark, runs):
    f = runs.select("template_id", "id", "status", (F.col("id") % 13).alias("amount"))
    got = FR.traffic_light_tiles(f, "status", "amount", order_by=["id"], keys=["template_id"])
    w = Window.partitionBy("template_id").orderBy("id")
    want = f.select("template_id", (F.row_number().over(w) - 1).cast("int").alias("pos"),
                    F.count(F.lit(1)).over(Window.partitionBy("template_id")).alias("n"),
                    F.col("amount").alias("value"))
    g = got.select("template_id", "pos", "n", "value")
    assert g.exceptAll(want).count() == 0 and want.exceptAll(g).count() == 0


def _any_order_frame(spark, n=4000):
    """Text order with ties, nulls and case; a third of the rows in one group, a third of those one repeated row."""
    i = F.col("id")
    return spark.range(n).select(
        F.when(i % 3 == 0, F.lit("hot")).when(i % 50 == 1, None).otherwise(F.concat(F.lit("g"), i % 17)).alias("g"),
        F.when(i % 9 == 0, F.lit("same")).when(i % 11 == 2, None).otherwise(F.sha2(i.cast("string"), 256)).alias("name"),
        F.when(i % 9 == 0, 3).when(i % 13 == 4, None).otherwise(i % 101).cast("bigint").alias("v"))


@pytest.mark.parametrize("keys", [["g"], []])
@pytest.mark.parametrize("ranges,sample", [(256, 4096), (5, 40)])
def test_sums_before_on_any_order_are_exact(spark, monkeypatch, keys, ranges, sample):
    from reportlake.operators import ordinals as O
    monkeypatch.setattr(O, "RANGES", ranges)
    monkeypatch.setattr(O, "RANGE_SAMPLE", sample)
    df = _any_order_frame(spark)
    total = [F.col(c).asc_nulls_last() for c in dict.fromkeys(["name", *keys, "g", "v"])]
    w = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(*total).rowsBetween(Window.unboundedPreceding, -1)
    for weight, plain in ((None, F.lit(1)), ("v", F.coalesce("v", F.lit(0)))):
        want = df.withColumn("b", F.coalesce(F.sum(plain).over(w), F.lit(0)))
        got = O.sums_before(df, keys, ["name"], "b", weight)
        assert got.columns == want.columns
        assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    empty = O.sums_before(df.where("v > 1000"), keys, ["name"], "b")
    assert empty.isEmpty()


def test_tiles_and_bars_of_any_order_sort_no_frame_in_one_task(spark):
    df = _any_order_frame(spark)
    for out in (FR.traffic_light_tiles(df, "name", "v", order_by=["name", "g"]),
                FR.bar_series(df, "g", "v", order_by=["name"], keys=[])):
        plan = out._jdf.queryExecution().executedPlan().toString()
        windows = [line for line in plan.splitlines() if "Window [" in line]
        assert windows and all("_range" in line for line in windows), windows
    tiles = FR.traffic_light_tiles(df, "name", "v", order_by=["name", "g"])
    assert sorted(r.pos for r in tiles.select("pos").collect()) == list(range(df.count()))

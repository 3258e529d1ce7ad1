"""Invariants over the fixture data and random frames."""

import datetime as dt
import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import SF_TINY
from reportlake.operators import blocks as B
from reportlake.operators import catalog as C
from reportlake.operators import history as H
from reportlake.operators import maintenance as M
from reportlake.operators.ordinals import dense_positions
from reportlake.plans.q_sources import template_globals
from reportlake.sources import catalog_io as IO
from reportlake.sources import fixtures as FX
from reportlake.sources import templates as TP


def test_retention_partitions_the_log(spark):
    r, t = FX.fx_reports(spark, SF_TINY), FX.fx_templates(spark, SF_TINY)
    exp = C.retention_expired(r, t)
    kept = r.join(exp.select("id"), "id", "left_anti")
    assert kept.count() + exp.count() == r.count()
    assert exp.join(kept, "id").count() == 0
    # no template keeps more than its limit
    lim = t.select(F.col("id").alias("template_id"), C.retain_limit("schedule_retain_count").alias("k"))
    over = kept.groupBy("template_id").count().join(lim, "template_id").where("count > k")
    assert over.count() == 0


def test_retention_of_any_limit(spark):
    """Against a sort per template, with null times, ties and a hot template."""
    rnd = random.Random(3)
    limits = {1: -5, 2: 0, 3: None, 4: 1, 5: 100, 6: 101, 7: 10 ** 6, 8: 25}
    times = [None, *(dt.datetime(2024, 1, 1) + dt.timedelta(hours=h) for h in range(0, 400, 7))]
    rows = [(i, 8 if i % 3 == 0 else rnd.randint(1, 9), rnd.choice(times)) for i in range(1500)]
    r = spark.createDataFrame(rows, "id bigint, template_id bigint, generated_at timestamp_ntz")
    t = spark.createDataFrame(list(limits.items()), "id bigint, schedule_retain_count int")
    want = set()
    for tid, k in limits.items():
        k = max(k or 10, 0)
        mine = sorted((x for x in rows if x[1] == tid), reverse=True,
                      key=lambda x: ((x[2] - dt.datetime(2000, 1, 1)).total_seconds() if x[2] else -1, x[0]))
        want |= {x[0] for x in mine[k:]}
    assert {x.id for x in C.retention_expired(r, t).collect()} == want


def test_pairing_covers_every_block_once(spark):
    blocks = FX.fx_blocks(spark, SF_TINY)
    p = B.pair_half_blocks(blocks)
    assert p.count() == blocks.count()
    rows = p.groupBy("template_id", "layout_row").agg(F.sort_array(F.collect_list("slot")).alias("s"))
    shapes = {tuple(r.s) for r in rows.collect()}
    assert shapes <= {("full",), ("alone",), ("left", "right")}


def test_pack_then_parse_is_identity(spark):
    blocks = FX.fx_blocks_full(spark, SF_TINY)
    for fmt in ("json", "yaml"):
        docs = TP.pack_templates(blocks, template_globals(spark, SF_TINY), fmt=fmt)
        back = TP.template_blocks(docs.withColumnRenamed("template_id", "id"))
        cols = ["template_id", "block_idx", "type", "title", "description", "days", "zone_id", "query",
                "show_legend", "chart_height"]
        a = blocks.select(*cols, F.coalesce("width", F.lit("full")).alias("width"))
        b = back.select(*cols, "width")
        assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_dense_positions_match_row_number(spark):
    rnd = random.Random(7)
    rows = [(g, k) for g in range(5) for k in rnd.sample(range(10_000), 300)]
    df = spark.createDataFrame(rows, "g long, k long")
    got = dense_positions(df, key="k", group="g")
    want = df.withColumn("pos", F.row_number().over(Window.orderBy("g", "k")))
    assert got.exceptAll(want.select(*got.columns)).count() == 0


def test_migration_ids_are_fresh_and_dense(spark):
    t, r = FX.fx_templates(spark, SF_TINY), FX.fx_reports(spark, SF_TINY)
    t2, r2 = M.migrate_legacy(t, r, FX.fx_old_schedules(spark, SF_TINY), FX.fx_old_reports(spark, SF_TINY))
    max_t = t.agg(F.max("id")).first()[0]
    new_ids = sorted(x.id for x in t2.where(F.col("id") > max_t).collect())
    assert new_ids == list(range(max_t + 1, max_t + 1 + len(new_ids)))
    assert r2.select("id").distinct().count() == r2.count()


def test_upsert_empty_change_does_not_stamp(spark):
    t = FX.fx_templates(spark, SF_TINY)
    ch = M.change_rows(t.limit(1), "update", F.lit(1), F.col("id"), {})
    out = M.upsert_templates(t, ch, "2030-01-01T00:00:00+00:00")
    assert out.where(F.col("updated_at") == "2030-01-01T00:00:00+00:00").count() == 0
    assert out.count() == t.count()


def test_load_catalog_parses_iso(spark, tmp_path):
    t = spark.createDataFrame([(1, "2024-01-05T09:07:00+00:00", "bad")], "id long, created_at string, updated_at string")
    r = spark.createDataFrame([(1, 1, "2024-01-05T09:07:00Z")], "id long, template_id long, generated_at string")
    t.write.parquet(str(tmp_path / "report_templates"))
    r.write.parquet(str(tmp_path / "generated_reports"))
    t2, r2 = IO.load_catalog(spark, str(tmp_path))
    row = t2.first()
    assert row.created_at_ts == dt.datetime(2024, 1, 5, 9, 7) and row.updated_at_ts is None
    assert r2.first().generated_at_ts == dt.datetime(2024, 1, 5, 9, 7)


def test_chunked_running_sum_matches_window(spark):
    rnd = random.Random(11)
    rows = [(g, c, k, rnd.randint(-50, 50)) for g in range(3) for c in "ab"
            for k in rnd.sample(range(5_000), 200)]
    df = spark.createDataFrame(rows, "g long, c string, k long, v long")
    from reportlake.operators.ordinals import running_sum_before
    got = running_sum_before(df, ["g", "c"], "k", "v", "base")
    w = Window.partitionBy("g", "c").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    want = df.withColumn("base", F.coalesce(F.sum("v").over(w), F.lit(0)))
    assert got.exceptAll(want.select(*got.columns)).count() == 0
    assert want.exceptAll(got.select(*want.columns)).count() == 0


def test_positions_of_sparse_and_null_keys(spark):
    """Keys over the whole 64-bit range, a null key, a null group."""
    rnd = random.Random(9)
    rows = [(g, rnd.choice((-1, 1)) * rnd.getrandbits(rnd.choice((3, 17, 33, 49, 60)))) for g in (None, 1, 2, 1 << 40)
            for _ in range(300)]
    rows = sorted(set(rows), key=repr) + [(2, None)]
    df = spark.createDataFrame(rows, "g long, k long")
    order = [F.col("g").asc_nulls_last(), F.col("k").asc_nulls_last()]
    want = df.withColumn("pos", F.row_number().over(Window.orderBy(*order)))
    got = dense_positions(df, key="k", group="g")
    assert got.exceptAll(want.select(*got.columns)).count() == 0 and got.count() == len(rows)
    per = dense_positions(df, key="k", group="g", per_group=True)
    want = df.withColumn("pos", F.row_number().over(Window.partitionBy("g").orderBy(*order)))
    assert per.exceptAll(want.select(*per.columns)).count() == 0 and per.count() == len(rows)


def test_frames_lose_no_null_row(spark):
    """Null keys, orders and categories, an all-null frame, column names the operators use."""
    from reportlake.operators import frames as FR
    df = spark.createDataFrame([(None, "High", 3, 1), (None, None, 2, None), (1, "Low", 5, 2), (2, None, None, 4)],
                               "k int, category string, value long, pos int")
    assert FR.pie_shares(df, "category", "value", keys=["k"]).count() == 4
    tiles = FR.traffic_light_tiles(df, "category", "value", ["pos"], keys=["k"])
    assert sorted((r.k or 0, r.pos, r.n) for r in tiles.collect()) == [(0, 0, 2), (0, 1, 2), (1, 0, 1), (2, 0, 1)]
    bars = FR.bar_series(df, "category", "value", ["value"], keys=["k"])
    assert bars.columns == ["k", "category", "value", "stack_base", "color", "orientation"]
    assert all(r.stack_base == 0 for r in bars.collect())
    flags = {r.k: r.has_severity for r in FR.has_severity(df, "category", ["k"]).collect()}
    assert flags == {None: True, 1: True, 2: False}
    n = spark.createDataFrame([("High", 1), ("Low", 2)], "severity string, n long")
    assert FR.traffic_light_tiles(n, "severity", "n", ["severity"]).count() == 2
    text = spark.createDataFrame([(None, 1, "2024-01-01T00:00:00"), (1, 2, None)], "k int, o int, t string")
    assert FR.fmt_datetime_columns(text, "o", ["k"]).count() == 2
    assert FR.column_widths(text, keys=["k"]).select("k").distinct().count() == 2


def test_trend_without_its_columns_is_empty(spark):
    df = spark.createDataFrame([(1, 2)], "zone_id int, value long")
    out = H.trend_insights(df, keys=["zone_id"])
    assert out.count() == 0
    assert out.columns == ["zone_id", "severity", "start_value", "end_value", "change", "pct_change", "trend"]


def test_window_of_a_zone_over_a_clock_change():
    """Sydney leaves daylight saving on 2024-04-07: the window's ends have different offsets."""
    lo, hi = H.utc_bounds(dt.datetime(2024, 4, 10, 9, 0), 7, "Australia/Sydney")
    assert (lo, hi) == (dt.datetime(2024, 4, 2, 13, 0), dt.datetime(2024, 4, 10, 13, 59, 59))


def test_hours_out_of_range_never_fire(spark):
    from reportlake.operators.schedule import due_by_tick
    rows = [(i, 1, "daily", h, None, None, "UTC") for i, h in enumerate((-1, 0, 23, 24, None))]
    t = spark.createDataFrame(rows, "id int, schedule_enabled int, schedule_frequency string, schedule_hour int, "
                                    "schedule_day_of_week int, schedule_day_of_month int, schedule_timezone string")
    ticks = spark.sql("SELECT explode(sequence(TIMESTAMP_NTZ'2024-01-01 00:00:00', TIMESTAMP_NTZ'2024-01-02 23:00:00', "
                      "INTERVAL 1 HOUR)) AS tick")
    fired = sorted((r.template_id, str(r.local_date)) for r in due_by_tick(t, ticks).collect())
    assert fired == [(1, "2024-01-01"), (1, "2024-01-02"), (2, "2024-01-01"), (2, "2024-01-02")]
    assert due_by_tick(t, ticks.where("false")).count() == 0


def test_appending_prunes_only_what_it_touches(spark):
    from reportlake.operators.maintenance import append_runs
    r = spark.sql("SELECT id, id % 2 + 1 AS template_id, 'f' AS filename, 'p' AS file_path, 1L AS file_size, "
                  "'success' AS status, CAST(NULL AS STRING) AS error_message, "
                  "TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, CAST(id AS INT)) AS generated_at "
                  "FROM range(1, 41)")
    t = spark.createDataFrame([(1, "a b", 3, None, None), (2, "b", 3, None, None)],
                              "id long, name string, schedule_retain_count int, schedule_last_run string, updated_at string")
    at = dt.datetime(2024, 2, 1)
    runs = spark.createDataFrame(
        [(1, 1, at, "success", None, 5, False), (2, 1, at, "exception", "x", None, False), (3, 9, at, "success", None, 5, True)],
        "seq long, template_id long, started_at timestamp_ntz, outcome string, error string, file_size long, scheduled boolean")
    out = append_runs(r, t, runs, last_run_id=99)
    assert [(x.id, x.filename) for x in out["new"].collect()] == [(100, "a_b_20240201_000000.pdf")]
    kept = out["runs"].groupBy("template_id").count().collect()
    assert {x.template_id: x["count"] for x in kept} == {1: 3, 2: 20}
    assert out["expired"].count() == 18

"""Golden cases worked out from the reference's rules (FIXTURES.md section 3)."""

import datetime as dt
import math

import pytest

from conftest import SF_SMALL
from reportlake.functions import scalars as S
from reportlake.operators import blocks as B
from reportlake.operators import catalog as C
from reportlake.operators import frames as FR
from reportlake.operators import history as H
from reportlake.operators import schedule as SC
from reportlake.sources import fixtures as FX

T0, T1 = dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 31)

TREND_CASES = [  # start, end, pct_change, change text
    (400, 401, 0.25, "+1 (+0.2%) ↑"),
    (0, 5, 100.0, "+5 (+100.0%) ↑"),
    (0, 0, 0.0, "0 (0%)"),
    (2000, 1500, -25.0, "-500 (-25.0%) ↓"),
    (8000, 8001, 0.0125, "+1 (+0.0%) ↑"),
    (1000000, 1, -99.9999, "-999,999 (-100.0%) ↓"),
    (-5, 3, 100.0, "+8 (+100.0%) ↑"),
    (-5, -9, 0.0, "-4 (+0.0%) ↓"),
]


def test_trend_text_goldens(spark):
    rows = []
    for i, (a, b, _, _) in enumerate(TREND_CASES):
        rows += [(i, T0, a, "High"), (i, T1, b, "High")]
    h = spark.createDataFrame(rows, "case int, timestamp timestamp_ntz, value bigint, vuln_severity string")
    ins = H.trend_insights(h, keys=["case"])
    got = {r.case: r for r in H.insight_table(ins, keys=["case"]).join(ins, "case").collect()}
    for i, (a, b, pct, text) in enumerate(TREND_CASES):
        assert got[i].start_value == a and got[i].end_value == b
        assert math.isclose(got[i].pct_change, pct, rel_tol=1e-12, abs_tol=1e-12)
        assert got[i].Change == text


def test_trend_edge_rules(spark):
    rows = [
        (T0, 5, "Low"),                                   # one row -> absent
        (T0, 1, "critical"), (T1, 2, "critical"),         # lower case -> absent
        (T0, 3, "Medium"), (None, 9, "Medium"), (T1, 4, "Medium"),  # null timestamp is the end
    ]
    h = spark.createDataFrame(rows, "timestamp timestamp_ntz, value bigint, vuln_severity string")
    out = H.trend_insights(h).collect()
    assert [(r.severity, r.start_value, r.end_value) for r in out] == [("Medium", 3, 9)]


def test_trend_on_fixture_zone_1(spark):
    out = H.trend_insights(FX.fx_history(spark, SF_SMALL), keys=["zone_id"])
    assert out.count() == 20
    z1 = {r.severity: r for r in out.where("zone_id = 1").collect()}
    assert (z1["Critical"].start_value, z1["Critical"].end_value) == (6, 1)
    assert z1["Critical"].change == -5 and z1["Critical"].pct_change == -83.33333333333334
    assert (z1["High"].start_value, z1["High"].end_value, z1["High"].change) == (6, 11, 5)
    assert (z1["Low"].start_value, z1["Low"].end_value) == (6, 6)
    assert (z1["Medium"].start_value, z1["Medium"].end_value) == (6, 6)


def test_severity_counts_golden(spark):
    out = C.severity_counts(FX.fx_workloads(spark, SF_SMALL), FX.fx_edges(spark, SF_SMALL),
                            FX.fx_vulns(spark, SF_SMALL)).collect()
    assert [(r.Severity, r.Vulnerabilities) for r in out] == [
        ("Unrated", 12056), ("Medium", 12118), ("Low", 12017), ("High", 12034)]


@pytest.mark.parametrize("vals,labels", [
    ([1, 3], ["a (1) - 25.0%", "b (3) - 75.0%"]),
    ([0, 0], ["a (0) - 0.0%", "b (0) - 0.0%"]),
    ([2.9, 1.1], ["a (2) - 50.0%", "b (1) - 25.0%"]),
    ([1, 399], ["a (1) - 0.2%", "b (399) - 99.8%"]),
])
def test_pie_labels(spark, vals, labels):
    df = spark.createDataFrame([("a", float(vals[0])), ("b", float(vals[1]))], "cat string, v double")
    got = sorted(r.label for r in FR.pie_shares(df, "cat", "v").collect())
    assert got == labels


@pytest.mark.parametrize("lengths,widths", [
    ([4, 40, 6], [8.0, 80.0, 12.0]),
    ([1, 55, 9], [7.5472, 75.4717, 16.9811]),
])
def test_column_widths(spark, lengths, widths):
    row = tuple("x" * n for n in lengths)
    df = spark.createDataFrame([row], "a string, b string, c string")
    got = [r.width for r in FR.column_widths(df, width=100.0).orderBy("pos").collect()]
    assert [round(w, 4) for w in got] == widths


def test_truncate(spark):
    df = spark.createDataFrame([("y" * 40,), ("z" * 41,)], "s string")
    got = [r.t for r in df.select(S.truncate_cell("s").alias("t")).collect()]
    assert got == ["y" * 40, "z" * 38 + ".."]


def test_tiles_geometry(spark):
    df = spark.createDataFrame([(c, i) for i, c in enumerate(["Critical", "High", "Foo", "Bar"])],
                               "cat string, v long")
    t = FR.traffic_light_tiles(df, "cat", "v", order_by=["v"]).orderBy("pos").collect()
    want = [(0.01, 0.2475, 0.12875), (0.2575, 0.495, 0.37625), (0.505, 0.7425, 0.62375), (0.7525, 0.99, 0.87125)]
    for r, (x0, x1, xc) in zip(t, want):
        assert math.isclose(r.x0, x0) and math.isclose(r.x1, x1) and math.isclose(r.x_center, xc)
    assert [r.color for r in t] == ["#d32f2f", "#ffa000", "#c2185b", "#512da8"]  # severity, else palette[i]


def test_half_block_pairing(spark):
    widths = ["half", "half", "half", "full", "half", "half"]
    df = spark.createDataFrame([(1, i, w) for i, w in enumerate(widths)], "template_id long, block_idx int, width string")
    got = [(r.layout_row, r.slot) for r in B.pair_half_blocks(df).orderBy("block_idx").collect()]
    assert got == [(0, "left"), (0, "right"), (1, "alone"), (2, "full"), (3, "left"), (3, "right")]


def test_window_bounds():
    start, end = H.window_bounds(dt.datetime(2024, 3, 10, 9, 30), 7)
    assert start == dt.datetime(2024, 3, 3, 0, 0, 0) and end == dt.datetime(2024, 3, 10, 23, 59, 59)
    assert (end.date() - start.date()).days + 1 == 8


def test_display_date(spark):
    cases = [("2024-01-05T09:07:00", "05/Jan/2024 20:07"), ("2024-01-05T09:07:00Z", "05/Jan/2024 20:07"),
             ("2024-07-05T09:07:00+02:00", "05/Jul/2024 17:07"), ("not-a-date-but-long", "not-a-date-but-l"),
             ("bad", "bad"), ("", ""), (None, "")]
    df = spark.createDataFrame([(c,) for c, _ in cases], "s string")
    got = [r.d for r in df.select(S.iso_to_display("s", "Australia/Sydney").alias("d")).collect()]
    assert got == [want for _, want in cases]


def test_python_number_text(spark):
    vals = [0.25, 0.15, 0.35, -0.05, 2.675]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    got = [r.t for r in df.select(S.fixed1("v").alias("t")).collect()]
    assert got == [f"{v:.1f}" for v in vals]
    reps = [0.0, -0.0, 1e7, 1.5e-05, 123456789.125, 1e16, 0.00012, 2.0, 711.56, 1e-4, 9999999.0, 1.2345e20,
            float("nan"), float("inf")]
    df = spark.createDataFrame([(v,) for v in reps], "v double")
    got = [r.t for r in df.select(S.py_repr_double("v").alias("t")).collect()]
    assert got == [repr(v) for v in reps]
    df = spark.createDataFrame([(-999999,), (1234567,), (0,)], "v long")
    assert [r.t for r in df.select(S.fmt_thousands("v").alias("t")).collect()] == ["-999,999", "1,234,567", "0"]


def _template(**kw):
    base = dict(id=1, name="t", schedule_enabled=1, schedule_frequency="daily", schedule_hour=9,
                schedule_day_of_week=None, schedule_day_of_month=None, schedule_timezone="UTC",
                schedule_last_run=None)
    base.update(kw)
    return base


DUE_SCHEMA = ("id long, name string, schedule_enabled int, schedule_frequency string, schedule_hour int, "
              "schedule_day_of_week int, schedule_day_of_month int, schedule_timezone string, "
              "schedule_last_run string")


@pytest.mark.parametrize("now,kw,due", [
    (dt.datetime(2024, 4, 1, 9, 59), {}, True),
    (dt.datetime(2024, 4, 1, 10, 0), {}, False),
    (dt.datetime(2024, 4, 1, 9, 59, 59), {"schedule_last_run": "2024-04-01T09:00:00"}, False),   # 3599 s
    (dt.datetime(2024, 4, 1, 9, 30), {"schedule_last_run": "2024-04-01T08:30:00Z"}, True),        # 3600 s
    (dt.datetime(2024, 4, 1, 9, 30), {"schedule_last_run": "2024-04-02T08:30:00+00:00"}, False),  # future
    (dt.datetime(2024, 4, 1, 9, 30), {"schedule_last_run": "garbage"}, True),
    (dt.datetime(2024, 4, 1, 9, 30), {"schedule_frequency": "weekly"}, False),                   # null weekday
    (dt.datetime(2024, 4, 1, 9, 30), {"schedule_frequency": "weekly", "schedule_day_of_week": 0}, True),
    (dt.datetime(2024, 4, 1, 9, 30), {"schedule_timezone": "Not/AZone"}, True),                  # as UTC
    (dt.datetime(2024, 4, 1, 9, 30), {"schedule_frequency": None}, False),
])
def test_due_rule(spark, now, kw, due):
    t = spark.createDataFrame([tuple(_template(**kw).values())], DUE_SCHEMA)
    assert SC.due_flags(t, now).first().due is due


def test_due_across_fall_back(spark):
    # Sydney 02:xx happens twice on 2024-04-07; the second pass is within the
    # same wall-clock hour of the last run, so it stays suppressed.
    t = spark.createDataFrame([tuple(_template(schedule_hour=2, schedule_timezone="Australia/Sydney").values())],
                              DUE_SCHEMA)
    ticks = spark.createDataFrame([(dt.datetime(2024, 4, 6, 15, 0) + dt.timedelta(minutes=30 * i),)
                                   for i in range(6)], "tick timestamp_ntz")
    got = [(r.local_date, r.tick) for r in SC.due_by_tick(t, ticks).collect()]
    assert got == [(dt.date(2024, 4, 7), dt.datetime(2024, 4, 6, 15, 0))]


def test_retention_rules(spark):
    r = spark.createDataFrame(
        [(i, 1, dt.datetime(2024, 1, 1) + dt.timedelta(days=i // 2), "failed" if i % 3 else "success")
         for i in range(1, 15)], "id long, template_id long, generated_at timestamp_ntz, status string")
    t = spark.createDataFrame([(1, 0)], "id long, schedule_retain_count int")
    exp = sorted(x.id for x in C.retention_expired(r, t).collect())
    # K = 10 (0 means 10); newest first by (generated_at desc, id desc): ids 14..5 kept
    assert exp == [1, 2, 3, 4]


def test_retention_fixture_count(spark):
    assert C.retention_expired(FX.fx_reports(spark, SF_SMALL), FX.fx_templates(spark, SF_SMALL)).count() == 6855


def test_fixed1_matches_python_on_ties_and_random(spark):
    import random
    rnd = random.Random(5)
    vals = [k / 40 for k in range(-400, 400)] + [rnd.uniform(-1e4, 1e4) for _ in range(3000)] + [-0.0, 1e20]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    out = df.select("v", S.fixed1("v").alias("a"), S.fixed1("v", signed=True).alias("b")).collect()
    assert all(r.a == f"{r.v:.1f}" and r.b == f"{r.v:+.1f}" for r in out)

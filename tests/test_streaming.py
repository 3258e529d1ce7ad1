"""Structured Streaming operators (T2, T3) on landed fetch files."""

import datetime as dt
import json

from pyspark.sql import functions as F

from conftest import SF_TINY
from reportlake.operators import history as H
from reportlake.sources import fixtures as FX
from reportlake.streaming import history_stream as HS


def _rows(df, cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_ingest_replay_is_idempotent_and_revisions_win(spark, tmp_path):
    h = FX.fx_history(spark, SF_TINY)
    inp, out, ck = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")
    HS.land_history_fetches(h, inp, revise=True)
    first = _rows(HS.ingest_history_stream(spark, inp, out, ck), ["zone_id", "vuln_severity", "timestamp", "value"])
    again = _rows(HS.ingest_history_stream(spark, inp, out, ck), ["zone_id", "vuln_severity", "timestamp", "value"])
    assert first == again  # nothing new: the checkpointed offsets are not replayed twice
    # a later fetch revises one point; the merged view picks it up
    z, sev, ts, v = first[0]
    rec = {"zone_id": z, "timestamp": ts.isoformat(), "value": v + 1000, "vuln_severity": sev,
           "fetched_at": "2030-01-01T00:00:00", "fetch": 999}
    (tmp_path / "in" / "late.json").write_text(json.dumps(rec) + "\n")
    merged = HS.ingest_history_stream(spark, inp, out, ck)
    got = merged.where((F.col("zone_id") == z) & (F.col("vuln_severity") == sev) & (F.col("timestamp") == ts)).first()
    assert got.value == v + 1000
    assert merged.count() == len(first)


TREND = ["zone_id", "severity", "start_value", "end_value", "change", "pct_change", "trend"]


def _land(path, **rec):
    row = {"zone_id": 1, "vuln_severity": "Critical", "value": 1, "timestamp": "1990-01-01T00:00:00",
           "fetched_at": "2030-01-01T00:00:00", "fetch": 999} | rec
    path.write_text(json.dumps(row) + "\n")


def test_stream_trend_equals_batch_on_the_merged_table(spark, tmp_path):
    """Files out of order, later fetches that revise, points far behind the others, and nulls."""
    h = FX.fx_history(spark, SF_TINY)
    inp, out, ck = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")
    HS.land_history_fetches(h, inp, revise=True)
    got = HS.trend_stream(spark, inp, out, ck, keys=["zone_id"], max_files_per_trigger=7)
    merged = HS.ingest_history_stream(spark, inp, str(tmp_path / "t2"), str(tmp_path / "ck2"))
    first = merged.where("zone_id = 2 and vuln_severity = 'High'").orderBy("timestamp").first()
    assert _rows(got, TREND) == _rows(H.trend_insights(merged, keys=["zone_id"]), TREND)
    _land(tmp_path / "in" / "late.json", value=999999)
    _land(tmp_path / "in" / "none.json", zone_id=2, vuln_severity="High", value=None, timestamp=first.timestamp.isoformat())
    _land(tmp_path / "in" / "stale.json", zone_id=3, value=-5, fetched_at="1980-01-01T00:00:00",
          timestamp=first.timestamp.isoformat())
    _land(tmp_path / "in" / "timeless.json", zone_id=3, vuln_severity="Low", value=77, timestamp=None)
    _land(tmp_path / "in" / "nameless.json", zone_id=None, value=5)
    _land(tmp_path / "in" / "nameless2.json", zone_id=None, value=9, timestamp="1991-01-01T00:00:00")
    again = HS.trend_stream(spark, inp, out, ck, keys=["zone_id"], max_files_per_trigger=2)
    merged = HS.ingest_history_stream(spark, inp, str(tmp_path / "t2"), str(tmp_path / "ck2"))
    assert _rows_of_nulls(again) == _rows_of_nulls(H.trend_insights(merged, keys=["zone_id"]))
    assert again.where("zone_id = 1 and severity = 'Critical'").first().start_value == 999999
    assert again.where("zone_id = 3 and severity = 'Low'").first().end_value == 77
    assert again.where("zone_id is null").first().change == 4


def _rows_of_nulls(df):
    return sorted((tuple(r[c] for c in TREND) for r in df.collect()), key=repr)


def test_stream_trend_keeps_one_window(spark, tmp_path):
    """Points older than the window do not count, whatever batch they come in; a batch reads its own files."""
    h = FX.fx_history(spark, SF_TINY)
    inp, out, ck = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")
    HS.land_history_fetches(h, inp, revise=True)
    got = HS.trend_stream(spark, inp, out, ck, keys=["zone_id"], max_files_per_trigger=5, window_days=400)
    merged = HS.ingest_history_stream(spark, inp, str(tmp_path / "t2"), str(tmp_path / "ck2"))

    def recent(m):
        newest = m.groupBy("zone_id", "vuln_severity").agg(F.max("timestamp").alias("newest"))
        return m.join(newest, ["zone_id", "vuln_severity"]).where("timestamp >= newest - interval 400 days").drop("newest")
    assert _rows(got, TREND) == _rows(H.trend_insights(recent(merged), keys=["zone_id"]), TREND)
    assert _rows(got, TREND) != _rows(H.trend_insights(merged, keys=["zone_id"]), TREND)
    _land(tmp_path / "in" / "late.json", value=999999)
    again = HS.trend_stream(spark, inp, out, ck, keys=["zone_id"], window_days=400)
    assert _rows(again, TREND) == _rows(got, TREND)
    state = spark.read.format("statestore").option("stateVarName", "points").load(ck)
    newest = merged.where("zone_id = 1 and vuln_severity = 'Critical'").agg(F.max("timestamp")).first()[0]
    kept = state.where("key.zone_id = 1 and key.vuln_severity = 'Critical'").select("user_map_key.at").collect()
    assert kept and all(r["at"] >= (newest - dt.datetime(1970, 1, 1)).total_seconds() * 1e6 - 400 * 86_400e6 for r in kept)
    epochs = [p.name for p in (tmp_path / "out").iterdir() if p.name.startswith("epoch=")]
    last = max(epochs, key=lambda n: int(n.split("=")[1]))
    assert spark.read.parquet(f"{out}/{last}").count() == 1  # the late row's pair alone


def test_compaction_keeps_the_merged_view(spark, tmp_path):
    h = FX.fx_history(spark, SF_TINY)
    inp, out, ck = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")
    HS.land_history_fetches(h, inp, revise=True)
    full = HS.ingest_history_stream(spark, inp, out, ck)
    cols = ["zone_id", "vuln_severity", "timestamp", "value"]
    staged = HS.compact_history_table(spark, out, str(tmp_path / "compacted-1"))
    via_compacted = HS.read_history_table(spark, out, str(tmp_path / "compacted-1"))
    assert _rows(via_compacted, cols) == _rows(full, cols)
    assert staged.count() == full.count()
    # a later revision arrives after the compaction; the compacted view sees it
    z, sev, ts, v = _rows(full, cols)[0]
    rec = {"zone_id": z, "timestamp": ts.isoformat(), "value": v + 7, "vuln_severity": sev,
           "fetched_at": "2031-01-01T00:00:00", "fetch": 1000}
    (tmp_path / "in" / "later.json").write_text(json.dumps(rec) + "\n")
    HS.ingest_history_stream(spark, inp, out, ck)
    got = HS.read_history_table(spark, out, str(tmp_path / "compacted-1"))
    row = got.where((F.col("zone_id") == z) & (F.col("vuln_severity") == sev) & (F.col("timestamp") == ts)).first()
    assert row.value == v + 7
    again = HS.compact_history_table(spark, out, str(tmp_path / "compacted-2"), previous=str(tmp_path / "compacted-1"))
    assert _rows(again, cols) == _rows(got, cols)

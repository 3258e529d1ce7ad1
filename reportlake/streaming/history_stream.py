"""History arriving as successive, overlapping fetches.

The reference re-fetches a whole N-day window on every poll. Here each fetch
is a landed JSON file; Structured Streaming reads the folder incrementally.

* T2 ``ingest_history_stream``: every micro-batch is reduced to the latest
  value per (zone, severity, timestamp) and written under
  ``out/batch=<epoch>`` with overwrite, so a replayed epoch rewrites the same
  folder (exactly-once with the checkpointed source offsets). Readers merge on
  read: ``max_by(value, fetched_at)`` per key across batches -- a later fetch
  revises an earlier one, also across batches (``dropDuplicates`` would keep
  the first fetch instead).
* T3 ``trend_stream``: the trend (A1) kept current by keyed state: every key and
  severity remembers the latest value of each of its points, within a window of
  days before its newest one. A micro-batch reads its own files and the state of
  the pairs in them, nothing else; a later fetch revises, however late it comes.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from reportlake import constants as K
from reportlake.operators.history import trend_columns
from reportlake.operators.ordinals import with_scalar

FETCH_SCHEMA = ("zone_id INT, timestamp TIMESTAMP_NTZ, value BIGINT, vuln_severity STRING, "
                "fetched_at TIMESTAMP_NTZ, fetch INT")
KEYS = ["zone_id", "vuln_severity", "timestamp"]


def land_history_fetches(history: DataFrame, path: str, window_months: int = 6, step_months: int = 3,
                         revise: bool = False) -> None:
    """Write a monthly history as overlapping fetches: fetch ``w`` covers
    months [step*w, step*w + window - 1] (months counted from the first month)
    and is fetched on day ``w``; with ``revise`` every fetch reports
    ``value + w`` (later fetches revise earlier ones)."""
    ts = F.col("timestamp")
    first = history.agg(F.min("timestamp").alias("_t0"))
    h = with_scalar(history, first)
    m = (F.year(ts) - F.year("_t0")) * 12 + F.month(ts) - F.month("_t0")
    lo = F.greatest(F.lit(0), F.ceil((m - (window_months - 1)) / step_months))
    hi = F.floor(m / step_months)
    f = h.select("*", F.explode(F.sequence(lo.cast("int"), hi.cast("int"))).alias("fetch"))
    f = f.select("zone_id", "timestamp",
                 (F.col("value") + (F.col("fetch") if revise else F.lit(0))).cast("bigint").alias("value"),
                 "vuln_severity",
                 (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.col("fetch"))).alias("fetched_at"),
                 "fetch")
    f.repartition("fetch").write.mode("overwrite").json(path)


def _history_source(spark: SparkSession, in_dir: str, max_files: int | None) -> DataFrame:
    r = spark.readStream.schema(FETCH_SCHEMA)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.json(in_dir)


def latest_per_key(fetches: DataFrame) -> DataFrame:
    """The latest fetch's value of every (zone, severity, timestamp)."""
    return fetches.groupBy(*KEYS).agg(
        F.max_by("value", "fetched_at").alias("value"), F.max("fetched_at").alias("fetched_at"))


def ingest_history_stream(spark: SparkSession, in_dir: str, out_dir: str, checkpoint: str,
                          max_files_per_trigger: int | None = 1) -> DataFrame:
    """Run the ingest until the landed files are consumed (availableNow) and
    return the merged table (T2)."""
    def upsert(batch: DataFrame, epoch: int) -> None:
        latest_per_key(batch).write.mode("overwrite").parquet(f"{out_dir}/batch={epoch}")

    q = (_history_source(spark, in_dir, max_files_per_trigger).writeStream
         .foreachBatch(upsert).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return read_history_table(spark, out_dir)


def read_history_table(spark: SparkSession, out_dir: str, compacted: str | None = None) -> DataFrame:
    """Merge-on-read view of the ingested history: latest fetch per key.

    With ``compacted`` (written by :func:`compact_history_table`) only batch
    folders newer than the last folded epoch are read -- a literal filter on
    the ``batch`` partition column, so older folders are pruned -- and merged
    with the compacted rows."""
    t = spark.read.parquet(out_dir)
    if compacted:
        c = spark.read.parquet(compacted)
        folded = c.agg(F.max("batch")).first()[0]  # one scalar: the last folded epoch
        if folded is not None:
            t = t.where(F.col("batch") > F.lit(folded)).unionByName(c.select(*t.columns))
    return t.groupBy(*KEYS).agg(F.max_by("value", F.struct("fetched_at", "batch")).alias("value"),
                                F.max("fetched_at").alias("fetched_at"))


def compact_history_table(spark: SparkSession, out_dir: str, target: str,
                          previous: str | None = None) -> DataFrame:
    """Fold every ingested batch (and an earlier compaction ``previous``) into
    one table written to a fresh folder ``target``, stamped with the last
    folded epoch. A failed compaction leaves the previous one untouched;
    readers switch to ``target`` once it is written, and batch folders up to
    that epoch may then be dropped."""
    last = spark.read.parquet(out_dir).agg(F.max("batch")).first()[0]
    merged = read_history_table(spark, out_dir, previous)
    merged.withColumn("batch", F.lit(last).cast("int")).write.mode("overwrite").parquet(target)
    return spark.read.parquet(target)


class TrendPoints(StatefulProcessor):
    """Points of one (keys, severity): the latest fetch's value of every (zone,
    timestamp), as map state. Rows give the first and last point (A1's start and
    end) and the number of points that have a value.

    With ``window_days``, points older than that before the newest one of the pair
    are dropped: as the newest only moves on, they can never count again, so the
    state holds one window, and the result does not depend on how the fetches were
    cut into batches."""

    def __init__(self, keys: Sequence[str], window_days: int | None):
        self.keys, self.window_days = list(keys), window_days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.points = handle.getMapState("points", "zone INT, at BIGINT", "value BIGINT, fetched BIGINT")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = {k: v for k, v in self.points.iterator()}
        before = dict(known)
        for batch in rows:
            for zone, at, value, fetched in zip(*(batch[c].tolist() for c in ("zone", "at", "value", "fetched"))):
                k = (_none(zone), _none(at))
                if k not in known or (known[k][1] is None or fetched is not None and fetched >= known[k][1]):
                    known[k] = (_none(value), _none(fetched))
        if self.window_days is not None:
            newest = max((at for _, at in known if at is not None), default=None)
            least = None if newest is None else newest - self.window_days * 86_400_000_000
            known = {k: v for k, v in known.items() if k[1] is not None and k[1] >= least}
        for k in before.keys() - known.keys():
            self.points.removeKey(k)
        for k, v in known.items():
            if before.get(k) != v:
                self.points.updateValue(k, v)
        # A1's order: no timestamp comes last, ties go by value.
        order = [((at is None, at or 0), v) for (_, at), (v, _) in known.items() if v is not None]
        out = dict(zip(self.keys + ["vuln_severity"], ([x] for x in key)))
        out |= {"first": [min(order)[1] if order else None], "last": [max(order)[1] if order else None],
                "n": [len(order)]}
        yield pd.DataFrame(out).astype({"first": "Int64", "last": "Int64", "n": "int64"})

    def close(self) -> None:
        pass


def _none(x):
    return None if pd.isna(x) else int(x)


@contextmanager
def _state_store(spark: SparkSession):
    """Map state lives in the RocksDB store; a query keeps the store it was started with."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def trend_stream(spark: SparkSession, in_dir: str, out_dir: str, checkpoint: str,
                 keys: Sequence[str] = ("zone_id",), max_files_per_trigger: int | None = 1,
                 window_days: int | None = None) -> DataFrame:
    """Run T3 over the landed fetches (availableNow) and return the trend rows.

    Equal to the batch trend (A1) of T2's table, of the points at most
    ``window_days`` before the newest one of their (keys, severity); without
    ``window_days`` of all points, whose number the state then grows with. A
    micro-batch writes the pairs it touched into a folder of its epoch, so a
    replayed epoch rewrites only its own; the current trend of a pair is that of
    the newest epoch that has one. Late and repeated fetches, null values (a
    revision to null takes the point out), null keys and null timestamps (last in
    the order; outside of every window) are taken as A1 and T2 take them."""
    keys = list(keys)
    group = [*keys, "vuln_severity"]
    rows = _history_source(spark, in_dir, max_files_per_trigger).where(F.col("vuln_severity").isin(K.SEVERITY_ORDER))
    rows = rows.select(*dict.fromkeys(group), F.col("zone_id").alias("zone"), F.unix_micros(
        F.col("timestamp").cast("timestamp")).alias("at"), "value", F.unix_micros(
        F.col("fetched_at").cast("timestamp")).alias("fetched"))
    types = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in group)

    def land(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out_dir}/epoch={epoch}")

    with _state_store(spark):
        ends = rows.groupBy(*group).transformWithStateInPandas(
            TrendPoints(keys, window_days), outputStructType=f"{types}, first BIGINT, last BIGINT, n BIGINT",
            outputMode="Update", timeMode="None")
        q = (ends.writeStream.foreachBatch(land).outputMode("update").option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
        q.awaitTermination()
    newest = spark.read.parquet(out_dir).groupBy(*group).agg(
        F.max_by(F.struct("first", "last", "n"), "epoch").alias("t"))
    return trend_columns(newest.select(*keys, F.col("vuln_severity").alias("severity"), "t.*").where("n >= 2"),
                         keys, "first", "last")

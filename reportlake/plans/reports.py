"""Report runs as Spark jobs (B1, B2).

A block's query is Spark SQL over registered views (B1). A run over many
templates (B2) computes each distinct source once -- a distinct query,
or a distinct (days, zone) history window -- and joins the small results to
the blocks that use them, instead of one fetch per block.

Queries are told apart by their plans, not their texts. Each runs once, as jobs of
its own under a tag, and its rows are written to the shared folder, from where
every kind of block reads them. A query that fails, when it is planned or while it
runs, is the outcome of the blocks that use it; the rest of the run goes on.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reportlake import constants as K
from reportlake.functions import scalars as S
from reportlake.operators import blocks as B
from reportlake.operators import frames as FR
from reportlake.operators import history as H
from reportlake.session import scratch_path

#: Queries of a run that are sent off at the same time.
AT_ONCE = 4

HISTORY_TYPES = ["history", "trend_summary"]


def register_views(spark: SparkSession, views: Mapping[str, DataFrame]) -> None:
    for name, df in views.items():
        df.createOrReplaceTempView(name)


def query_block(spark: SparkSession, block: Mapping, views: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """Run one block's query and feed the operator its type names (B1).
    Columns are picked by P3 (first non-numeric = category, first numeric =
    value). Bars and tiles need a row order; a SQL result has none, so rows
    are ordered by the category and then every other column -- a total,
    repeatable order."""
    if views:
        register_views(spark, views)
    frame = spark.sql(block["query"])
    ty = block.get("type") or "table"
    cat, val = FR.detect_columns(frame.schema)
    order = [cat] + [c for c in frame.columns if c != cat] if cat else list(frame.columns)
    if ty == "pie_chart":
        return FR.pie_shares(frame, cat, val)
    if ty in ("vertical_bar", "horizontal_bar"):
        return FR.bar_series(frame, cat, val, order_by=order, horizontal=ty == "horizontal_bar")
    if ty == "traffic_lights":
        single = len(frame.columns) == 1
        return FR.traffic_light_tiles(frame, None if single else cat, frame.columns[0] if single else val,
                                      order_by=order)
    if ty == "history":
        return H.history_series(frame)
    if ty == "trend_summary":
        return H.trend_insights(frame)
    return frame


def _error_condition(e: Exception) -> str:
    cond = getattr(e, "getCondition", None) or getattr(e, "getErrorClass", None)
    return (cond() if cond else None) or type(e).__name__


@dataclass
class Source:
    """One query of a run: its written rows, or the condition it failed with."""

    frame: DataFrame | None = None
    n_rows: int | None = None
    error: str | None = None


def _same_plan(a: DataFrame, b: DataFrame) -> bool:
    return a.schema == b.schema and a.sameSemantics(b)


def distinct_plans(spark: SparkSession, texts: Iterable[str]) -> tuple[list[DataFrame], dict[str, int], dict[str, str]]:
    """The distinct plans of the texts, which plan each text has, and the condition of
    each text that cannot be planned. Plans are compared in canonical form: white
    space, case of key words and names of aliases inside do not matter."""
    frames: list[DataFrame] = []
    by_hash: dict[int, list[int]] = {}
    plan_of, errors = {}, {}
    for q in dict.fromkeys(texts):
        if not q:
            errors[q] = K.MSG_NO_QUERY
            continue
        try:
            frame = spark.sql(q)
            found = by_hash.setdefault(frame.semanticHash(), [])
            same = [i for i in found if _same_plan(frames[i], frame)]
        except Exception as e:  # noqa: BLE001 - a broken query is a block outcome, not a failure
            errors[q] = _error_condition(e)
            continue
        if not same:
            same = [len(frames)]
            found += same
            frames.append(frame)
        plan_of[q] = same[0]
    return frames, plan_of, errors


def _materialised(spark: SparkSession, frame: DataFrame, tag: str) -> Source:
    """The rows of one query, written once; columns go by position, so names may repeat."""
    path, counted = scratch_path(spark, "query"), Observation()
    plain = frame.toDF(*[f"c{i}" for i in range(len(frame.columns))])
    plain = plain.select(*[F.col(f.name).cast("string") if isinstance(f.dataType, T.NullType) else F.col(f.name)
                           for f in plain.schema])
    spark.addTag(tag)
    try:
        plain.observe(counted, F.count(F.lit(1)).alias("n")).write.parquet(path)
    except Exception as e:  # noqa: BLE001 - a query that fails while it runs is a block outcome
        return Source(error=_error_condition(e))
    finally:
        spark.removeTag(tag)
    return Source(spark.read.schema(plain.schema).parquet(path).toDF(*frame.columns), counted.get["n"])


def run_queries(spark: SparkSession, texts: Iterable[str]) -> tuple[list[Source], dict[str, int], dict[str, str]]:
    """Run every distinct plan of the texts once, ``AT_ONCE`` at a time; the jobs of
    plan i carry the tag ``report-query-i``."""
    frames, plan_of, errors = distinct_plans(spark, texts)

    def one(i: int) -> Source:
        return _materialised(spark, frames[i], f"report-query-{i}")

    with ThreadPoolExecutor(AT_ONCE) as pool:
        runs = [pool.submit(inheritable_thread_target(spark)(one), i) for i in range(len(frames))]
        return [r.result() for r in runs], plan_of, errors


def query_sources(spark: SparkSession, sources: list[Source], plan_of: Mapping[str, int],
                  errors: Mapping[str, str]) -> DataFrame:
    """One row per query text: plan, rows, columns, error, renderable."""
    rows = [(q, None, None, None, e, None) for q, e in errors.items()]
    for q, i in plan_of.items():
        x = sources[i]
        if x.error:
            rows.append((q, None, None, None, x.error, None))
        else:
            cat, val = FR.detect_columns(x.frame.schema)
            rows.append((q, i, x.n_rows, len(x.frame.columns), None, cat is not None and val is not None))
    return spark.createDataFrame(
        rows, "query string, plan int, n_rows bigint, n_cols int, error string, renderable boolean")


def _of_plan(frame: DataFrame, plan: int, text: str) -> DataFrame:
    """``frame`` with its plan's number as a join key. A constant key would be folded
    away and leave a product of blocks and rows; this one hangs on a text column
    (of which it takes nothing), so the join stays an equi-join."""
    nothing = F.coalesce(F.length(F.substr(F.col(text), F.lit(1), F.lit(0))), F.lit(0))
    return frame.select((F.lit(plan) + nothing).alias("plan"), "*")


def block_frames(blocks: DataFrame, sources: list[Source]) -> dict[str, DataFrame]:
    """What the query blocks draw: ``tiles``, ``bars``, ``pies`` and ``tables``, each
    with the block's key; ``blocks`` have the ``plan`` of their query. Every plan's
    rows go through the operator once, whatever the number of blocks that use
    them; values of bars are doubles and table rows JSON text, as queries differ
    in their columns."""
    kinds: dict[str, list[DataFrame]] = {"tiles": [], "bars": [], "pies": [], "tables": []}
    for i, source in enumerate(sources):
        f = source.frame
        if f is None:
            continue
        if len({c.lower() for c in f.columns}) == len(f.columns):
            table = f.select(F.to_json(F.struct(*[f[c] for c in f.columns]), {"ignoreNullFields": "false"}).alias("row"))
            kinds["tables"].append(_of_plan(table, i, "row"))
        cat, val = FR.detect_columns(f.schema)
        if cat is None or val is None or len({c.lower() for c in f.columns}) < len(f.columns):
            continue
        order = [cat] + [c for c in f.columns if c != cat]
        kinds["tiles"].append(_of_plan(FR.traffic_light_tiles(f, cat, val, order_by=order), i, "value_text"))
        bars = FR.bar_series(f, cat, val, order_by=order).select(
            F.col("category").cast("string").alias("category"), F.col("value").cast("double").alias("value"),
            F.col("stack_base").cast("double").alias("stack_base"), "color")
        kinds["bars"].append(_of_plan(bars, i, "color"))
        pies = FR.pie_shares(f, cat, val).select(F.col(val).cast("bigint").alias("value"), "pct", "label")
        kinds["pies"].append(_of_plan(pies, i, "label"))
    types = {"tiles": ["traffic_lights"], "bars": ["vertical_bar", "horizontal_bar"], "pies": ["pie_chart"],
             "tables": ["table"]}
    out = {}
    for kind, frames in kinds.items():
        if frames:
            every = frames[0]
            for f in frames[1:]:
                every = every.unionByName(f)
            mine = blocks.where(F.col("type").isin(types[kind]))
            if kind == "bars":
                mine = mine.withColumn("orientation", F.when(F.col("type") == "horizontal_bar", "h").otherwise("v"))
            out[kind] = mine.join(every, "plan").drop("query", "type", "plan")
    return out


def run_rows(results: DataFrame, templates: DataFrame, started_at: dt.datetime, scheduled: bool = True) -> DataFrame:
    """One run per template for ``maintenance.append_runs``: a failing block does not
    fail its report, and a template without blocks still gets its run."""
    done = results.groupBy("template_id").agg(F.count(F.lit(1)).alias("n_blocks"))
    t = templates.select(F.col("id").alias("template_id")).join(done, "template_id", "left")
    return t.select(F.col("template_id").alias("seq"), "template_id", S.ntz(started_at).alias("started_at"),
                    F.lit("success").alias("outcome"), F.lit(None).cast("string").alias("error"),
                    F.lit(None).cast("bigint").alias("file_size"), F.lit(scheduled).alias("scheduled"))


def history_sources(h: DataFrame, specs: DataFrame, now: dt.datetime) -> DataFrame:
    """Rows of every distinct (days, zone) window: each spec expands to its
    days+1 local dates and equi-joins the history on (zone, date) -- zone 0
    meaning the all-zones roll-up -- instead of a range join. Bounds follow
    P1: [today - days 00:00:00, today 23:59:59]."""
    today = now.date()
    end = dt.datetime.combine(today, dt.time(23, 59, 59))
    dates = specs.select("days", "zone", F.explode(F.sequence(
        F.date_sub(F.lit(today), F.col("days")), F.lit(today))).alias("_d"))
    # Per-zone rows and the all-zones roll-up (zone 0) in one pass: grouping
    # sets over (timestamp, severity, zone) and (timestamp, severity).
    oldest = specs.agg(F.date_sub(F.lit(today), F.max("days")).cast("timestamp_ntz")).scalar()
    h = h.where((F.col("timestamp") >= oldest) & (F.col("timestamp") <= S.ntz(end)))
    gs = h.groupingSets([["timestamp", "vuln_severity", "zone_id"], ["timestamp", "vuln_severity"]],
                        "timestamp", "vuln_severity", "zone_id")
    both = gs.agg(F.sum("value").cast("bigint").alias("value"), F.grouping_id().alias("_g")).select(
        F.when(F.col("_g") == 0, F.col("zone_id")).otherwise(F.lit(0)).alias("zone_id"),
        "timestamp", "value", "vuln_severity", F.to_date("timestamp").alias("_d"))
    j = both.join(dates, (both["zone_id"] == dates["zone"]) & (both["_d"] == dates["_d"]))
    return j.select("days", "zone", "timestamp", "value", "vuln_severity")


def run_reports(spark: SparkSession, blocks: DataFrame, history: DataFrame, now: dt.datetime,
                views: Mapping[str, DataFrame] | None = None,
                queries: Iterable[str] | None = None) -> dict[str, DataFrame]:
    """Many templates in one run (B2): P7 defaults, distinct sources once, A1
    per history window, A8 outcome per block. ``queries`` is the library of
    query texts (text is planning input, so the caller passes it); a block
    whose text is not in it reports that. Without a library the distinct texts
    of the blocks are read one after the other, as each is a query to plan.
    The queries run when this is called (:func:`run_queries`).

    Returns ``results`` (block outcomes), ``trends`` (per trend block),
    ``series`` (per history block) and the frames of :func:`block_frames`;
    :func:`run_rows` turns the results into rows of the run log."""
    if views:
        register_views(spark, views)
    b = B.block_defaults(blocks)
    hb = b.where(F.col("type").isin(HISTORY_TYPES)).select(
        "template_id", "block_idx", "type", "days", F.coalesce(F.col("zone_id"), F.lit(0)).alias("zone"))
    specs = hb.select("days", "zone").distinct()
    src = history_sources(history, specs, now)
    src_counts = src.groupBy("days", "zone").agg(F.count(F.lit(1)).alias("n_rows"))
    trends_by_spec = H.trend_insights(src, keys=["days", "zone"])
    trends = hb.where(F.col("type") == "trend_summary").join(trends_by_spec, ["days", "zone"]) \
        .drop("type")
    series = hb.where(F.col("type") == "history").join(src, ["days", "zone"]).drop("type")
    # Each block row meets only the small per-source table it uses (one row
    # per distinct window / query text); the three block groups are then
    # unioned -- no join of the block table with itself.
    h_rows = hb.join(src_counts, ["days", "zone"], "left").select(
        "template_id", "block_idx", "type", F.coalesce("n_rows", F.lit(0)).alias("n_rows"),
        F.lit(3).alias("n_cols"), F.lit(None).cast("string").alias("error"), F.lit(True).alias("renderable"))
    qb = b.where(~F.col("type").isin(*HISTORY_TYPES, "divider")).select("template_id", "block_idx", "type", "query")
    texts = ["", *queries] if queries is not None else (
        r.query for r in qb.select("query").distinct().toLocalIterator())
    sources, plan_of, errors = run_queries(spark, texts)
    found = query_sources(spark, sources, plan_of, errors).withColumn("_known", F.lit(True))
    q_rows = qb.join(found, "query", "left").withColumn(
        "error", F.when(F.col("_known").isNull(), F.lit("UNKNOWN_QUERY")).otherwise(F.col("error"))).select(
        *h_rows.columns)
    other = b.where(F.col("type") == "divider").select(
        "template_id", "block_idx", "type", F.lit(None).cast("bigint").alias("n_rows"),
        F.lit(None).cast("int").alias("n_cols"), F.lit(None).cast("string").alias("error"),
        F.lit(None).cast("boolean").alias("renderable"))
    results = B.block_outcomes(h_rows.unionByName(q_rows).unionByName(other))
    drawn = qb.join(found.where("plan is not null").select("query", "plan"), "query")
    return {"results": results, "trends": trends, "series": series} | block_frames(drawn, sources)

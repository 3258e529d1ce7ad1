"""Report-block operators: defaults, half-width pairing, per-block status."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reportlake import constants as K

BLOCK_FIELDS = {
    "type": "string", "width": "string", "title": "string", "description": "string",
    "days": "int", "zone_id": "int", "query": "string", "show_legend": "boolean",
    "chart_height": "int",
}


def with_block_fields(blocks: DataFrame) -> DataFrame:
    """Add absent optional block settings as typed nulls (schema-on-read)."""
    for c, t in BLOCK_FIELDS.items():
        if c not in blocks.columns:
            blocks = blocks.withColumn(c, F.lit(None).cast(t))
    return blocks


def block_defaults(blocks: DataFrame, idx: str = "block_idx") -> DataFrame:
    """Fill the generator's defaults (P7): type 'table', title 'Element i+1',
    description '', width 'full', days 7 for history and always 31 for trend,
    legend on, query ''; plus the target width fraction (full 1.0, else 0.48)."""
    b = with_block_fields(blocks)
    ty = F.coalesce(F.col("type"), F.lit("table"))
    width = F.coalesce(F.col("width"), F.lit("full"))
    days = (F.when(ty == "history", F.coalesce(F.col("days"), F.lit(K.HISTORY_DEFAULT_DAYS)))
            .when(ty == "trend_summary", F.lit(K.TREND_DAYS)))
    keep = [c for c in b.columns if c not in BLOCK_FIELDS]
    return b.select(
        *keep, ty.alias("type"),
        F.coalesce(F.col("title"), F.concat(F.lit("Element "), (F.col(idx) + 1).cast("string"))).alias("title"),
        F.coalesce(F.col("description"), F.lit("")).alias("description"),
        width.alias("width"),
        days.cast("int").alias("days"),
        F.col("zone_id"),
        F.coalesce(F.col("query"), F.lit("")).alias("query"),
        F.coalesce(F.col("show_legend"), F.lit(True)).alias("show_legend"),
        F.col("chart_height"),
        F.when(width == "full", F.lit(1.0)).otherwise(F.lit(K.HALF_WIDTH_FRACTION)).alias("width_fraction"),
    )


def pair_half_blocks(blocks: DataFrame, key: str = "template_id", idx: str = "block_idx") -> DataFrame:
    """Layout rows (W5): two adjacent half-width blocks share a row (left,
    right); a half block without a half partner is alone; others are full.
    Gaps and islands: inside each run of halves the blocks pair 1-2, 3-4, ...

    All windows share one partitioning (the template) and one order, so the
    plan has a single exchange."""
    w = Window.partitionBy(key).orderBy(idx)
    half = F.coalesce(F.col("width"), F.lit("full")) == "half"
    r = F.row_number().over(w)
    b = blocks.select(key, idx, half.alias("_half"), r.alias("_r"))
    b = b.select("*",
                 F.coalesce(F.max(F.when(~F.col("_half"), F.col("_r"))).over(w), F.lit(0)).alias("_island_start"),
                 F.coalesce(F.lead("_half").over(w), F.lit(False)).alias("_next_half"))
    hpos = F.col("_r") - F.col("_island_start")
    slot = (F.when(~F.col("_half"), "full")
            .when(hpos % 2 == 1, F.when(F.col("_next_half"), "left").otherwise("alone"))
            .otherwise("right"))
    b = b.withColumn("slot", slot)
    row_start = F.when(F.col("slot") == "right", 0).otherwise(1)
    return b.select(key, idx, (F.sum(row_start).over(w) - 1).cast("int").alias("layout_row"), "slot")


#: Block types that become a chart; a block of an unknown type fetches its query but draws nothing.
DRAWN = ("traffic_lights", "vertical_bar", "horizontal_bar", "pie_chart", "history")


def block_outcomes(rows: DataFrame, keys=("template_id", "block_idx")) -> DataFrame:
    """Status and message per block row (A8) from its own columns: ``type``,
    ``n_rows``, ``n_cols``, ``error``, ``renderable`` (nulls where not
    fetched). A divider needs no data; a failing block does not fail the
    report."""
    keys = list(keys)
    ty = F.coalesce(F.col("type"), F.lit("table"))
    hist = ty.isin("history", "trend_summary")
    unrenderable = ~ty.isin(*DRAWN, "table", "trend_summary") | (
        ty.isin(*DRAWN) & ~F.coalesce(F.col("renderable"), F.lit(True)))
    status = (F.when(ty == "divider", "ok")
              .when(F.col("error").isNotNull(), "error")
              .when(F.coalesce(F.col("n_rows"), F.lit(0)) == 0, "empty")
              .when(F.col("n_cols") == 0, "empty")
              .when(unrenderable, "error")
              .otherwise("ok"))
    msg = (F.when(ty == "divider", F.lit(None).cast("string"))
           .when(F.col("error").isNotNull(), F.concat(F.lit("Error: "), F.col("error")))
           .when(F.coalesce(F.col("n_rows"), F.lit(0)) == 0,
                 F.when(hist, K.MSG_NO_HISTORY).otherwise(K.MSG_NO_DATA))
           .when(F.col("n_cols") == 0, K.MSG_EMPTY)
           .when(unrenderable, K.MSG_NO_CHART)
           .when(ty == "table", F.concat(F.lit("Displaying "), F.col("n_rows").cast("string"), F.lit(" records"))))
    return rows.select(*keys, ty.alias("type"), status.alias("status"), msg.alias("message"),
                       F.when(ty != "divider", F.coalesce(F.col("n_rows"), F.lit(0))).cast("bigint").alias("n_rows"))



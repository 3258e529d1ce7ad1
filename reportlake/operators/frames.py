"""Presentation-frame operators: column roles, shares, tiles, bars, widths,
datetime detection. Every operator takes ``keys`` so one job serves every
frame (block x customer x ...) at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reportlake import constants as K
from reportlake.functions import scalars as S
from reportlake.operators.ordinals import (
    dense_positions, null_safe_join, running_sum_before, sums_before, with_scalar)


def _lit_key(keys: Sequence[str]) -> tuple[list[str], bool]:
    return (list(keys), False) if keys else (["_one"], True)


def _totals_join(df: DataFrame, totals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Attach per-frame aggregates: joined on the frame keys (a null key is a
    frame like any other), or with ``keys=()`` (one row) as scalar subqueries."""
    if keys:
        return null_safe_join(df, totals, keys)
    return with_scalar(df, totals)


# ---------------------------------------------------------------- P3
def is_numeric_type(t: T.DataType) -> bool:
    """pandas ``is_numeric_dtype``: numbers and booleans are numeric."""
    return isinstance(t, (T.NumericType, T.BooleanType))


def detect_columns(schema: T.StructType) -> tuple[str | None, str | None]:
    """Category = first non-numeric column, value = first numeric one;
    fallbacks column 0 / column 1 (P3). Schema only, no job."""
    cat = val = None
    names = [f.name for f in schema.fields]
    for f in schema.fields:
        if is_numeric_type(f.dataType):
            val = val or f.name
        else:
            cat = cat or f.name
    if cat is None and names:
        cat = names[0]
    if val is None and len(names) > 1:
        val = names[1]
    return cat, val


# ---------------------------------------------------------------- A3
def pie_shares(df: DataFrame, cat: str, val: str, keys: Sequence[str] = ()) -> DataFrame:
    """Slice shares and labels (A3): pct = int(value) / total * 100 (0 when
    total <= 0; the total is untruncated); label ``{cat} ({v:,}) - {pct:.1f}%``.
    Totals are a partial aggregate per frame joined back."""
    tot = df.groupBy(*keys).agg(F.sum(val).cast("double").alias("_total"))
    j = _totals_join(df, tot, keys)
    v = F.col(val).cast("bigint")
    pct = F.when(F.col("_total") > 0, v.cast("double") / F.col("_total") * F.lit(100.0)).otherwise(F.lit(0.0))
    catx = F.coalesce(F.col(cat).cast("string"), F.lit("None"))
    return (j.withColumn("pct", pct)
            .withColumn("label", F.concat(catx, F.lit(" ("), S.fmt_thousands(v), F.lit(") - "),
                                          S.fixed1("pct"), F.lit("%")))
            .drop("_total"))


# ---------------------------------------------------------------- A5, A6
def has_severity(df: DataFrame, cat: str | None, keys: Sequence[str] = ()) -> DataFrame:
    """Does the category column hold any known severity name (A5)?"""
    if cat is None or cat not in df.columns:
        return df.groupBy(*keys).agg(F.lit(False).alias("has_severity"))
    known = F.bool_or(F.col(cat).isin(K.SEVERITY_ORDER))
    return df.groupBy(*keys).agg(F.coalesce(known, F.lit(False)).alias("has_severity"))


def record_counts(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Rows per frame and the caption text."""
    return (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_records"))
            .withColumn("caption", F.concat(F.lit("Displaying "), F.col("n_records").cast("string"),
                                            F.lit(" records"))))


# ---------------------------------------------------------------- W4
def _positions(df: DataFrame, order_by: Sequence[str], keys: Sequence[str], name: str) -> DataFrame:
    """Every row with its 1-based position in its frame by ``order_by`` (nulls
    last), so that a frame of most of the rows is never sorted in one task: an
    integer order over runs of its values, any other over sampled ranges."""
    if len(order_by) == 1 and isinstance(df.schema[order_by[0]].dataType, T.IntegralType):
        # An integer order may repeat values: positions of the distinct values, weighted by their rows.
        order = order_by[0]
        sizes = df.groupBy(*keys, order).agg(F.count(F.lit(1)).alias("_w"))
        first = running_sum_before(sizes, keys, order, "_w", "_first").drop("_w")
        w = Window.partitionBy(*keys, order).orderBy(*[F.col(c).asc_nulls_last() for c in df.columns])
        return (null_safe_join(df, first, [*keys, order])
                .withColumn(name, F.col("_first") + F.row_number().over(w)).drop("_first"))
    return sums_before(df, keys, order_by, name).withColumn(name, (F.col(name) + 1).cast("bigint"))


def traffic_light_tiles(df: DataFrame, cat: str | None, val: str, order_by: Sequence[str],
                        keys: Sequence[str] = ()) -> DataFrame:
    """One tile per row (W4): position, label, value text, colour and box
    geometry for n tiles with padding 0.01. ``cat=None`` is a single-column
    frame: blank labels, value centred."""
    pad = F.lit(K.TILE_BOX_PADDING)
    needed = dict.fromkeys([*keys, *([cat] if cat else []), val, *order_by])
    placed = _positions(df.select(*needed), order_by, keys, "_pos")
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    placed = _totals_join(placed, counts, keys)
    n, pos = F.col("_n"), (F.col("_pos") - 1).cast("int")
    bw = (F.lit(1.0) - pad * (n + 1)) / n
    x0 = pad + pos * (bw + pad)
    label = F.lit("") if not cat else F.coalesce(F.col(cat).cast("string"), F.lit("None"))
    return placed.select(
        *keys, pos.alias("pos"), n.alias("n"), label.alias("label"),
        F.col(val).cast("bigint").alias("value"),
        S.fmt_thousands(val).alias("value_text"),
        (S.severity_color(label, pos)).alias("color"),
        x0.alias("x0"), (x0 + bw).alias("x1"), ((x0 + (x0 + bw)) / 2).alias("x_center"),
        F.lit(K.TILE_LABEL_Y if cat else None).cast("double").alias("label_y"),
        F.lit(K.TILE_VALUE_Y if cat else K.TILE_VALUE_Y_SINGLE).alias("value_y"),
    )


# ---------------------------------------------------------------- O4
def bar_series(df: DataFrame, cat: str, val: str, order_by: Sequence[str], horizontal: bool = False,
               keys: Sequence[str] = ()) -> DataFrame:
    """Bar segments (O4): repeated categories stack, so each row is a segment
    with its stack offset = running sum of earlier segments of the same
    category. Colour is the severity colour when the category names one.

    With a single integral ``order_by`` column (unique per frame and
    category) the offset uses chunked prefix sums, with any other order sums
    over sampled ranges, so a frame holding most of the data is never sorted in
    one task."""
    vtype = df.schema[val].dataType
    integral = len(order_by) == 1 and isinstance(df.schema[order_by[0]].dataType, T.IntegralType)
    if integral:
        base = running_sum_before(df, [*keys, cat], order_by[0], val, "_base")
    else:
        needed = dict.fromkeys([*keys, cat, val, *order_by])
        base = sums_before(df.select(*needed), [*keys, cat], order_by, "_base", val)
    named = {"category": cat, "value": val}
    rest = [c for c in order_by if c not in (cat, val, *keys, *named)]  # no column twice
    return base.select(
        *keys, F.col(cat).alias("category"), F.col(val).alias("value"), *rest,
        F.col("_base").cast(vtype).alias("stack_base"),
        S.severity_color(cat).alias("color"),
        F.lit("h" if horizontal else "v").alias("orientation"),
    )


# ---------------------------------------------------------------- A7, F4
def _dt_shape_ok(first: Column, rule: str) -> Column:
    ok = (F.length(first) >= 19) & (F.substring(first, 5, 1) == "-") & (F.instr(first, "T") > 0)
    if rule == "screen":
        ok = ok & (F.substring(first, 8, 1) == "-")
    return ok


def _shape(c: Column) -> Column:
    """Layout of an ISO text: digits of the wall-clock part masked, the
    offset kept, so '+02:00' and '+05:00' count as different layouts."""
    return F.concat(F.regexp_replace(F.substring(c, 1, 19), "[0-9]", "9"), F.substr(c, F.lit(20)))


def datetime_columns(df: DataFrame, order_by: str, keys: Sequence[str] = (),
                     rule: str = "screen", columns: Sequence[str] | None = None) -> DataFrame:
    """Which string columns hold ISO datetimes, per frame.

    A column qualifies when its first non-null value (by ``order_by``) has the
    ISO shape (length >= 19, '-' at 5 (and 8 on screen), a 'T') and every
    non-null value parses with that same layout; otherwise it is left alone.
    One aggregate over all columns at once: ``min_by`` for the first value,
    min/max of the digit-masked layout, ``bool_and`` for parsing -- all
    partial aggregates."""
    cols = list(columns) if columns is not None else [
        f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name not in keys]
    aggs = []
    for c in cols:
        x = F.col(c)
        filled = F.when(x != "", x)  # '' parses to NaT, like a null
        aggs += [F.min_by(x, F.when(x.isNotNull(), F.col(order_by))).alias(f"_f_{c}"),
                 F.min(_shape(filled)).alias(f"_lo_{c}"), F.max(_shape(filled)).alias(f"_hi_{c}"),
                 F.bool_and(filled.isNull() | S.parse_iso_utc(filled).isNotNull()).alias(f"_p_{c}")]
    a = df.groupBy(*keys).agg(*aggs)
    entries = []
    for c in cols:
        first = F.col(f"_f_{c}")
        dec = (first.isNotNull() & _dt_shape_ok(first, rule) & (F.col(f"_lo_{c}") == F.col(f"_hi_{c}"))
               & F.coalesce(F.col(f"_p_{c}"), F.lit(False)))
        entries.append(F.struct(F.lit(c).alias("column"), dec.alias("is_datetime")))
    return a.select(*keys, F.inline(F.array(*entries)))


def fmt_datetime_columns(df: DataFrame, order_by: str, keys: Sequence[str] = (),
                         rule: str = "screen", columns: Sequence[str] | None = None) -> DataFrame:
    """Rewrite the datetime columns A7 picks, per frame (F4): screen
    ``MMM d, yyyy, h:mm a``, print ``MMM dd yyyy HH:mm``; other columns
    unchanged. Decisions (one row per frame) are joined back to the rows."""
    cols = list(columns) if columns is not None else [
        f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name not in keys]
    dec = (datetime_columns(df, order_by, keys, rule, cols)
           .groupBy(*keys).pivot("column", cols).agg(F.first("is_datetime")))
    dec = dec.select(*keys, *[F.col(f"`{c}`").alias(f"_d_{c}") for c in cols])
    j = _totals_join(df, dec, keys)
    return j.select(*[F.when(F.col(f"_d_{c}"), S.fmt_datetime_text(c, rule)).otherwise(F.col(c)).alias(c)
                      if c in cols else F.col(c) for c in df.columns])


# ---------------------------------------------------------------- A4
def text_of(df: DataFrame, c: str) -> Column:
    """The printed text of a column's cells (F11), by the column's type."""
    t = df.schema[c].dataType
    if isinstance(t, (T.DoubleType, T.FloatType)):
        return S.cell_text(c, "double")
    if isinstance(t, T.BooleanType):
        return S.cell_text(c, "bool")
    return S.cell_text(c, "other")


def column_widths(df: DataFrame, width: float = 1.0, keys: Sequence[str] = (),
                  datetime_order_by: str | None = None) -> DataFrame:
    """Proportional column widths of the printed table (A4).

    Per column: max(len(header), longest cell text) capped at 40; widths
    proportional to those; each raised to 8 % of the page; all rescaled to
    fit. With ``datetime_order_by`` the string columns first go through F4's
    print rule (ISO datetime columns become ``MMM dd yyyy HH:mm``, missing
    values 'nan'), as the printed table does. One aggregate computes every
    column's max length in a single pass; the rest is arithmetic on one row
    per frame, summed left to right like the reference."""
    if datetime_order_by is not None:
        df = fmt_datetime_columns(df, datetime_order_by, keys, rule="print")
    cols = [c for c in df.columns if c not in keys]
    a = df.groupBy(*keys).agg(*[F.max(F.length(text_of(df, c))).alias(f"_l{i}") for i, c in enumerate(cols)])
    lens = [F.least(F.greatest(F.lit(len(c)), F.coalesce(F.col(f"_l{i}"), F.lit(0))), F.lit(K.MAX_CELL_CHARS))
            for i, c in enumerate(cols)]
    arr = F.array(*[x.cast("int") for x in lens])
    total = F.aggregate(arr, F.lit(0), lambda acc, x: acc + x)
    total = F.when(total == 0, 1).otherwise(total)
    wd = F.lit(float(width))
    raw = F.transform(arr, lambda x: F.greatest(x.cast("double") / total.cast("double") * wd,
                                               wd * F.lit(K.MIN_COLUMN_FRACTION)))
    b = a.select(*keys, arr.alias("_len"), raw.alias("_w"))
    s = F.aggregate(F.col("_w"), F.lit(0.0), lambda acc, x: acc + x)
    b = b.withColumn("_scale", wd / s)
    names = F.array(*[F.lit(c) for c in cols])
    return b.select(*keys, F.posexplode(F.arrays_zip(names.alias("column"), F.col("_len").alias("max_len"),
                                                     F.col("_w").alias("w"))).alias("pos", "z"), "_scale") \
        .select(*keys, F.col("pos").cast("int").alias("pos"), F.col("z.column").alias("column"),
                F.col("z.max_len").alias("max_len"), (F.col("z.w") * F.col("_scale")).alias("width"))

"""Landed API envelopes (JSON text per row) -> typed rows.

All parsing is ``from_json`` / ``get_json_object`` / ``json_object_keys`` in
the JVM; one row per envelope in, its records out (``posexplode``), so the
work spreads with the envelopes. A malformed envelope becomes a row with an
``error`` message instead of failing the job, as the reference turns it into a
message.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reportlake import constants as K
from reportlake.functions import scalars as S

ITEMS_SCHEMA = "struct<entities: map<string,string>, items: array<map<string,string>>>"


def _has_key(body: Column, key: str) -> Column:
    return F.coalesce(F.array_contains(F.json_object_keys(body), F.lit(key)), F.lit(False))


def entity_items(raw: DataFrame, columns: dict[str, str], body: str = "body",
                 keys: Sequence[str] = ()) -> DataFrame:
    """Open ``items`` envelopes.

    With ``entities`` present and items non-empty, only fields named in
    ``entities`` survive (absent ones stay null); otherwise all fields are
    kept. ``columns`` declares the output columns and their types (values are
    JSON scalars, cast with ``try_cast``). No ``items`` key -> one row with the
    reference's error text. Output: keys, pos, the columns, error."""
    # Parse once into a column; the row builder below refers to it several
    # times and the projection keeps it from being re-evaluated per use.
    parsed = raw.select(*keys, F.from_json(F.col(body), ITEMS_SCHEMA).alias("_p"),
                        _has_key(F.col(body), "items").alias("_has_items"))
    p = F.col("_p")
    has_items = F.col("_has_items")
    allowed = F.map_keys(p["entities"])
    filt = p["entities"].isNotNull() & (F.size(p["items"]) > 0)
    items = F.when(filt, F.transform(p["items"], lambda m: F.map_filter(
        m, lambda k, v: F.array_contains(allowed, k)))).otherwise(p["items"])
    # One pass: every envelope becomes an array of output rows (its items, or
    # one error row) that ``inline`` expands -- no second scan for errors.
    ok_rows = F.transform(items, lambda m, i: F.struct(
        i.alias("pos"), *[F.try_element_at(m, F.lit(c)).try_cast(t).alias(c) for c, t in columns.items()],
        F.lit(None).cast("string").alias("error")))
    bad_rows = F.array(F.struct(
        F.lit(None).cast("int").alias("pos"), *[F.lit(None).cast(t).alias(c) for c, t in columns.items()],
        F.lit(K.MSG_NO_ITEMS).alias("error")))
    return parsed.select(*keys, F.inline(F.when(has_items, ok_rows).otherwise(bad_rows)))


def normalize_records(data: Column, element: T.StructType) -> tuple[Column, Column]:
    """``data`` JSON text -> (array of records, error) (S2): a list of records
    as is; a dict of equal-length column arrays zipped by position; anything
    else -> empty. Unequal column lengths -> error."""
    txt = F.trim(data)
    as_list = F.from_json(data, T.ArrayType(element))
    col_schema = T.StructType([T.StructField(f.name, T.ArrayType(f.dataType)) for f in element.fields])
    cols = F.from_json(data, col_schema)
    present = [F.when(cols[f.name].isNotNull(), F.size(cols[f.name])) for f in element.fields]
    lens = F.array_compact(F.array(*present))
    equal = F.coalesce(F.array_max(lens) == F.array_min(lens), F.lit(True))
    zipped = F.arrays_zip(*[F.coalesce(cols[f.name], F.array_repeat(F.lit(None).cast(f.dataType),
                                                                      F.coalesce(F.array_max(lens), F.lit(0))))
                            .alias(f.name) for f in element.fields])
    zipped = zipped.cast(T.ArrayType(element))
    empty = F.array().cast(T.ArrayType(element))
    recs = (F.when(F.startswith(txt, F.lit("[")), F.coalesce(as_list, empty))
            .when(F.startswith(txt, F.lit("{")) & equal, zipped)
            .otherwise(empty))
    err = F.when(F.startswith(txt, F.lit("{")) & ~equal, F.lit("All arrays must be of the same length"))
    return recs, err


HISTORY_ELEMENT = T.StructType([T.StructField("timestamp", T.StringType()),
                                T.StructField("value", T.LongType()),
                                T.StructField("vuln_severity", T.StringType())])
HISTORY_COLUMNS = ["timestamp", "value", "vuln_severity"]


def history_rows(raw: DataFrame, body: str = "body", keys: Sequence[str] = ()) -> DataFrame:
    """Open history envelopes (S3): ``data`` as records or as columns; no
    ``data`` key -> error row; an envelope lacking any of timestamp / value /
    vuln_severity yields no rows (the chart and trend have nothing to use).
    Timestamps are ISO text -> TIMESTAMP_NTZ (UTC wall clock)."""
    b = F.col(body)
    pre = raw.select(*keys, F.get_json_object(b, "$.data").alias("_data"), _has_key(b, "data").alias("_has_data"))
    data, has_data = F.col("_data"), F.col("_has_data")
    txt = F.trim(data)
    rec_keys = F.from_json(data, "array<map<string,string>>")
    present = (F.when(F.startswith(txt, F.lit("[")), F.array_distinct(F.flatten(
                   F.transform(rec_keys, lambda m: F.map_keys(m)))))
               .otherwise(F.json_object_keys(data)))
    complete = F.coalesce(F.forall(F.array(*[F.lit(c) for c in HISTORY_COLUMNS]),
                                   lambda c: F.array_contains(present, c)), F.lit(False))
    recs, err = normalize_records(data, HISTORY_ELEMENT)
    ok_rows = F.transform(recs, lambda r, i: F.struct(
        i.alias("pos"), S.parse_iso_utc(r["timestamp"]).alias("timestamp"), r["value"].alias("value"),
        r["vuln_severity"].alias("vuln_severity"), F.lit(None).cast("string").alias("error")))
    bad_rows = F.array(F.struct(
        F.lit(None).cast("int").alias("pos"), F.lit(None).cast("timestamp_ntz").alias("timestamp"),
        F.lit(None).cast("bigint").alias("value"), F.lit(None).cast("string").alias("vuln_severity"),
        F.when(~has_data, F.lit(K.MSG_NO_DATA_KEY)).otherwise(err).alias("error")))
    rows = F.when(~has_data | err.isNotNull(), bad_rows).when(complete, ok_rows)
    return pre.select(*keys, F.inline(rows))


ZONE_ELEMENT = "array<struct<id: int, name: string>>"


def zone_dim(raw: DataFrame, body: str = "body", keys: Sequence[str] = ()) -> DataFrame:
    """Zones envelope -> (keys, pos, id, name); other fields dropped."""
    return zone_rows(raw, body, keys).where(F.col("error").isNull()).drop("error")


def zone_rows(raw: DataFrame, body: str = "body", keys: Sequence[str] = ()) -> DataFrame:
    """As :func:`zone_dim`, with one row holding the error text for every
    envelope without ``data`` (other columns null)."""
    pre = raw.select(*keys, F.from_json(F.col(body), f"struct<data: {ZONE_ELEMENT}>").alias("_p"),
                     _has_key(F.col(body), "data").alias("_has"))
    ok = F.transform(F.col("_p.data"), lambda z, i: F.struct(
        i.alias("pos"), z["id"].alias("id"), z["name"].alias("name"), F.lit(None).cast("string").alias("error")))
    bad = F.array(F.struct(F.lit(None).cast("int").alias("pos"), F.lit(None).cast("int").alias("id"),
                           F.lit(None).cast("string").alias("name"), F.lit(K.MSG_NO_ZONES).alias("error")))
    return pre.select(*keys, F.inline(F.when(F.col("_has"), ok).otherwise(bad)))

"""Catalogue maintenance as DataFrame transformations: legacy migration,
upserts, schedule edits, appending runs with retention, deletes. Each returns
new DataFrames; writing them back (Parquet overwrite / MERGE where the table
format allows) is the caller's sink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reportlake import constants as K
from reportlake.functions import scalars as S
from reportlake.operators.catalog import mark_expired
from reportlake.operators.ordinals import dense_positions, numbered, with_scalar

UPDATABLE = {
    "name": "string", "config_yaml": "string", "schedule_enabled": "int", "schedule_frequency": "string",
    "schedule_hour": "int", "schedule_day_of_week": "int", "schedule_day_of_month": "int",
    "schedule_timezone": "string", "schedule_retain_count": "int", "schedule_last_run": "string",
}
# Column defaults of a freshly created template.
INSERT_DEFAULTS = {"schedule_enabled": 0, "schedule_timezone": "UTC", "schedule_retain_count": K.DEFAULT_RETAIN}

LEGACY_RENAME = {
    "name": "name", "config_yaml": "config_yaml", "enabled": "schedule_enabled",
    "frequency": "schedule_frequency", "hour": "schedule_hour", "day_of_week": "schedule_day_of_week",
    "day_of_month": "schedule_day_of_month", "timezone": "schedule_timezone",
    "retain_count": "schedule_retain_count", "last_run": "schedule_last_run",
    "created_at": "created_at", "updated_at": "updated_at",
}
RUN_COLUMNS = ["template_id", "filename", "file_path", "file_size", "status", "error_message", "generated_at"]


def iso_utc_text(ts) -> Column:
    """Python ``datetime.isoformat()`` of an aware UTC instant."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    frac = F.date_format(ts, "SSSSSS")
    body = F.when(frac == "000000", F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")) \
        .otherwise(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    return F.concat(body, F.lit("+00:00"))


def _after_last(rows: DataFrame, table: DataFrame, last_id: int | None) -> DataFrame:
    """``rows`` with ``_last``: the highest id of ``table``, or ``last_id`` if that is higher."""
    return with_scalar(rows, table.agg(F.greatest(F.max("id"), F.lit(last_id or 0)).cast("bigint").alias("_last")))


# ---------------------------------------------------------------- U1
def migrate_legacy(t: DataFrame, r: DataFrame, old_s: DataFrame, old_r: DataFrame, last_template_id: int | None = None,
                   last_run_id: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Old schedules become templates with new ids (last id + position by old
    id; ``last_template_id`` and ``last_run_id`` as in :func:`append_runs`); their reports are re-pointed to the new ids and get new ids in
    (schedule, report) order; both are appended. Reports whose schedule is
    missing are lost (inner join). The old tables are numbered and written once
    each (:func:`numbered`); what is appended reads that."""
    s = numbered(old_s, ["id"])
    s = _after_last(s, t, last_template_id).withColumn("_new_id", (F.col("_last") + F.col("pos")).cast("bigint"))
    mig_t = s.select(F.col("_new_id").alias("id"),
                     *[F.col(old).alias(new) for old, new in LEGACY_RENAME.items() if old in old_s.columns])
    id_map = s.select(F.col("id").alias("_old_sid"), F.col("_new_id").alias("template_id"))
    rr = old_r.join(id_map, old_r["schedule_id"] == id_map["_old_sid"]).drop("_old_sid", "schedule_id")
    rr = numbered(rr, ["template_id", "id"])
    rr = _after_last(rr, r, last_run_id)
    mig_r = rr.select((F.col("_last") + F.col("pos")).cast("bigint").alias("id"),
                      *[c for c in RUN_COLUMNS if c in rr.columns])
    return (t.unionByName(mig_t, allowMissingColumns=True),
            r.unionByName(mig_r, allowMissingColumns=True))


# ---------------------------------------------------------------- U2
def change_rows(df: DataFrame, op: str, seq: Column, target: Column | None,
                values: dict[str, Column | tuple[Column, Column]]) -> DataFrame:
    """Build change rows: every updatable column gets a value and a
    ``set_<col>`` flag -- a null value with the flag on means *set to null*.
    ``values`` maps a column to its value (flag on) or to (value, flag)."""
    cols = [seq.cast("bigint").alias("seq"), F.lit(op).alias("op"),
            (target if target is not None else F.lit(None)).cast("bigint").alias("id")]
    for c, ty in UPDATABLE.items():
        v = values.get(c)
        val, flag = (v if isinstance(v, tuple) else (v, F.lit(v is not None)))
        cols.append((val if val is not None else F.lit(None)).cast(ty).alias(c))
        cols.append(flag.alias(f"set_{c}"))
    return df.select(*cols)


def upsert_templates(t: DataFrame, changes: DataFrame, now_text: str, last_id: int | None = None) -> DataFrame:
    """Apply updates (only flagged columns; several changes to one id apply in
    ``seq`` order) and inserts (new ids last + position by ``seq``, creation
    defaults; ``last_id`` as in :func:`append_runs`). ``updated_at`` is stamped only when something was set; unknown
    ids change nothing."""
    now = F.lit(now_text)
    upd = changes.where(F.col("op") == "update")
    aggs = []
    for c in UPDATABLE:
        aggs += [F.max_by(c, F.when(F.col(f"set_{c}"), F.col("seq"))).alias(f"_v_{c}"),
                 F.bool_or(f"set_{c}").alias(f"_s_{c}")]
    a = upd.groupBy(F.col("id").alias("_cid")).agg(*aggs)
    j = t.join(a, t["id"] == a["_cid"], "left")
    flag = {c: F.coalesce(F.col(f"_s_{c}"), F.lit(False)) for c in UPDATABLE}
    any_set = F.lit(False)
    for c in UPDATABLE:
        any_set = any_set | flag[c]
    out_cols = []
    for c in t.columns:
        if c in UPDATABLE:
            out_cols.append(F.when(flag[c], F.col(f"_v_{c}")).otherwise(t[c]).alias(c))
        elif c == "updated_at":
            out_cols.append(F.when(any_set, now).otherwise(t[c]).alias(c))
        else:
            out_cols.append(t[c])
    updated = j.select(*out_cols)

    ins = dense_positions(changes.where(F.col("op") == "insert"), key="seq")
    ins = _after_last(ins, t, last_id)
    ins_cols = [(F.col("_last") + F.col("pos")).cast("bigint").alias("id")]
    for c, ty in UPDATABLE.items():
        dflt = INSERT_DEFAULTS.get(c)
        v = F.when(F.col(f"set_{c}"), F.col(c)).otherwise(F.lit(dflt).cast(ty))
        ins_cols.append(v.cast(ty).alias(c))
    ins_cols += [now.alias("created_at"), now.alias("updated_at")]
    inserted = ins.select(*ins_cols)
    return updated.unionByName(inserted, allowMissingColumns=True)


# ---------------------------------------------------------------- U3
def apply_schedules(t: DataFrame, s: DataFrame, now_text: str) -> DataFrame:
    """Schedule edits (U3): set all schedule fields at once (zone default UTC,
    retain default 10), or with ``disable_only`` just switch it off."""
    off = F.col("disable_only")
    sets = ~off
    vals = {
        "schedule_enabled": F.when(off, 0).otherwise(F.when(F.col("enabled"), 1).otherwise(0)),
        "schedule_frequency": F.col("frequency"), "schedule_hour": F.col("hour"),
        "schedule_day_of_week": F.col("day_of_week"), "schedule_day_of_month": F.col("day_of_month"),
        "schedule_timezone": F.coalesce(F.col("timezone"), F.lit("UTC")),
        "schedule_retain_count": F.coalesce(F.col("retain_count"), F.lit(K.DEFAULT_RETAIN)),
    }
    cols = [F.col("seq").cast("bigint").alias("seq"), F.lit("update").alias("op"), F.col("id").cast("bigint")]
    for c, ty in UPDATABLE.items():
        v = vals.get(c)
        cols.append((v if v is not None else F.lit(None)).cast(ty).alias(c))
        flag = F.lit(True) if c == "schedule_enabled" else (sets if v is not None else F.lit(False))
        cols.append(flag.alias(f"set_{c}"))
    return upsert_templates(t, s.select(*cols), now_text)


# ---------------------------------------------------------------- U4
def append_runs(r: DataFrame, t: DataFrame, runs: DataFrame, last_run_id: int | None = None) -> dict[str, DataFrame]:
    """Append run rows and apply retention (U4).

    ``runs``: seq (unique), template_id, started_at, outcome (success |
    failed | no_token | exception), error, file_size, scheduled. A manual run
    that throws, and any run of an unknown template, leaves no row. New ids are
    the last id + position by ``seq``; pass ``last_run_id`` (the highest id ever
    given) where runs may have been deleted, as an autoincrement key never gives
    an id twice. A generated or failed report keeps its normal file name; a
    missing token or an exception gives ``failed_<id>_<stamp>.pdf``. Scheduled
    errors are clipped to 500 characters, manual ones kept whole. Scheduled
    successes and generation failures stamp ``schedule_last_run``; missing token
    / exception and manual runs do not.

    The new rows are numbered and written once. Retention touches only the
    templates that got a row; the others' runs pass. Returns ``runs`` (surviving log),
    ``expired``, ``templates`` (stamped) and ``new``."""
    names = t.select(F.col("id").alias("_tid"), F.col("name").alias("_tname"))
    oc = F.col("outcome")
    written = runs.join(names, runs["template_id"] == names["_tid"]).where(F.col("scheduled") | (oc != "exception"))
    n = _after_last(numbered(written, ["seq"]), r, last_run_id)
    no_file = oc.isin("no_token", "exception")
    err = (F.when(oc == "no_token", F.lit("No API token configured"))
           .when(oc.isin("failed", "exception"),
                 F.when(F.col("scheduled"), S.clip_error("error")).otherwise(F.col("error"))))
    fname = S.report_filename("_tname", "started_at", "template_id", no_file)
    new = n.select(
        (F.col("_last") + F.col("pos")).cast("bigint").alias("id"), F.col("template_id").cast("bigint"),
        fname.alias("filename"), F.concat(F.lit("/reports/"), fname).alias("file_path"),
        F.when(oc == "success", F.col("file_size")).cast("bigint").alias("file_size"),
        F.when(oc == "success", "success").otherwise("failed").alias("status"),
        err.alias("error_message"), F.col("started_at").alias("generated_at"))
    touched = n.select(F.col("template_id").alias("_w")).distinct()
    subject = t.join(touched, F.col("id") == F.col("_w"), "left_semi")
    marked = mark_expired(r.unionByName(new, allowMissingColumns=True), subject)
    survivors, expired = marked.where("not _expired").drop("_expired"), marked.where("_expired").drop("_expired")
    stamps = (runs.where(F.col("scheduled") & oc.isin("success", "failed"))
              .groupBy(F.col("template_id").alias("_sid")).agg(F.max("started_at").alias("_stamp")))
    tj = t.join(stamps, t["id"] == stamps["_sid"], "left")
    templates = tj.select(*[
        (F.when(F.col("_stamp").isNotNull(), iso_utc_text("_stamp")).otherwise(t[c]).alias(c)
         if c in ("schedule_last_run", "updated_at") else t[c]) for c in t.columns])
    return {"runs": survivors, "expired": expired, "templates": templates, "new": new}


# ---------------------------------------------------------------- U5
def delete_templates(t: DataFrame, r: DataFrame, ids: DataFrame) -> dict[str, DataFrame]:
    """Remove templates by id with their runs (the cascade the schema
    declares) and list the files to delete (U5)."""
    k = ids.select(F.col("id").alias("_did"))
    return {
        "templates": t.join(k, t["id"] == k["_did"], "left_anti"),
        "runs": r.join(k, r["template_id"] == k["_did"], "left_anti"),
        "files": r.join(k, r["template_id"] == k["_did"], "left_semi").select("id", "file_path"),
    }


def delete_runs(r: DataFrame, ids: DataFrame) -> dict[str, DataFrame]:
    """Remove runs by id and list their files."""
    k = ids.select(F.col("id").alias("_did"))
    return {"runs": r.join(k, r["id"] == k["_did"], "left_anti"),
            "files": r.join(k, r["id"] == k["_did"], "left_semi").select("id", "file_path")}

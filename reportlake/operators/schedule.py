"""Schedule operators: due decision at an instant (P5), over a table of poll
ticks (T1), and data-quality checks against the editor's bounds (P8)."""

from __future__ import annotations

import datetime as dt
import functools
import zoneinfo

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reportlake import constants as K
from reportlake.functions import scalars as S


@functools.lru_cache(maxsize=1)
def _python_zones() -> frozenset[str]:
    return frozenset(zoneinfo.available_timezones())


def valid_zones(spark: SparkSession | None = None) -> list[str]:
    """Zone names both the reference (Python zoneinfo) and the JVM accept.
    A fixed metadata list (a few hundred names), used as an IN-set."""
    zones = set(_python_zones())
    try:
        jvm = (spark or SparkSession.getActiveSession())._jvm
        zones &= set(jvm.java.time.ZoneId.getAvailableZoneIds())
    except Exception:  # noqa: BLE001 - no JVM handle (e.g. Connect): Python's list
        pass
    return sorted(zones)


def effective_zone(tz: Column, zones: list[str]) -> Column:
    """The template's zone; null, empty or unknown -> UTC (unknown zones
    raise in the JVM, so they are screened out first)."""
    return F.when(tz.isin(zones), tz).otherwise(F.lit("UTC"))


def _frequency_matches(freq: Column, local: Column, dow: Column, dom: Column) -> Column:
    """daily; weekly on its weekday (0 = Monday); monthly on its day. A null
    weekday/day never matches."""
    return F.coalesce(
        F.when(freq == "daily", F.lit(True))
        .when(freq == "weekly", F.weekday(local) == dow)
        .when(freq == "monthly", F.dayofmonth(local) == dom)
        .otherwise(F.lit(False)),
        F.lit(False))


def local_instant(now_utc: dt.datetime, zones: list[str]) -> Column:
    """``now_utc`` as the wall clock of the template's zone."""
    return F.convert_timezone(F.lit("UTC"), effective_zone(F.col("schedule_timezone"), zones), S.ntz(now_utc))


def due_condition(now_utc: dt.datetime, zones: list[str] | None = None) -> Column:
    """Due decision at instant ``now_utc`` over a template's columns (P5).

    Per row: local now in the template's zone; frequency and hour set; local
    hour equals the schedule hour; a parseable last run (naive = UTC) less
    than 3600 s of *local wall clock* ago (or in the future) suppresses; then
    daily / weekly / monthly. Per-row zone conversion, no joins."""
    zones = zones if zones is not None else valid_zones()
    tz, local_now = effective_zone(F.col("schedule_timezone"), zones), local_instant(now_utc, zones)
    freq = F.col("schedule_frequency")
    last = S.parse_iso_utc(F.col("schedule_last_run"))
    last_local = F.convert_timezone(F.lit("UTC"), tz, last)
    recent = last.isNotNull() & (F.timestamp_diff("MICROSECOND", last_local, local_now)
                                 < F.lit(K.MIN_RUN_GAP_SECONDS * 1_000_000))
    due = (freq.isNotNull() & (freq != "") & F.col("schedule_hour").isNotNull()
           & (F.hour(local_now) == F.col("schedule_hour")) & ~recent
           & _frequency_matches(freq, local_now, F.col("schedule_day_of_week"), F.col("schedule_day_of_month")))
    return F.coalesce(due, F.lit(False))


def due_flags(t: DataFrame, now_utc: dt.datetime, zones: list[str] | None = None) -> DataFrame:
    """Local time and due decision for every template at ``now_utc`` (P5)."""
    zones = zones if zones is not None else valid_zones()
    return t.select("id", local_instant(now_utc, zones).alias("local_now"), due_condition(now_utc, zones).alias("due"))


def due_templates(t: DataFrame, now_utc: dt.datetime, zones: list[str] | None = None) -> DataFrame:
    """Enabled templates that must run at ``now_utc`` (P4 + P5)."""
    active = t.where(F.col("schedule_enabled") == 1)
    return active.where(due_condition(now_utc, zones))


def _day_rule(freq: Column, dow: Column, dom: Column) -> Column:
    """The rule a template's dates must satisfy; null (never) without its weekday or day."""
    return (F.when(freq == "daily", F.lit("d")).when(freq == "weekly", F.concat(F.lit("w"), dow.cast("string")))
            .when(freq == "monthly", F.concat(F.lit("m"), dom.cast("string"))))


def _hour_floor(ts: Column) -> Column:
    return F.make_timestamp_ntz(F.year(ts), F.month(ts), F.dayofmonth(ts), F.hour(ts), F.lit(0), F.lit(0))


def _first_allowed(zones: list[str], after_last_run: bool) -> Column:
    """The wall clock from which a template may run again; null: at once."""
    last = S.parse_iso_utc(F.col("schedule_last_run"))
    local = F.convert_timezone(F.lit("UTC"), effective_zone(F.col("schedule_timezone"), zones), last)
    gap = F.make_dt_interval(secs=F.lit(K.MIN_RUN_GAP_SECONDS))
    return local + gap if after_last_run else F.lit(None).cast("timestamp_ntz")


def due_by_tick(t: DataFrame, ticks: DataFrame, zones: list[str] | None = None,
                after_last_run: bool = False) -> DataFrame:
    """The hourly poll as data (T1): (template, local date, tick) firings over
    a table of poll instants (UTC), starting with no last run, or with
    ``after_last_run`` from each template's ``schedule_last_run``.

    A template fires at the first tick of each local date whose local hour is
    its schedule hour (the 3600 s rule suppresses the rest of that hour, also
    across a DST fall-back). That instant depends only on (zone, hour, date),
    so it is computed once on a small calendar -- distinct (zone, hour) of the
    templates x the dates of the tick range -- where local hour H becomes a
    UTC interval [u0, u1) (a repeated hour spans two UTC hours, a skipped one
    is empty) and ticks are equi-joined on the UTC hour bucket. Templates then
    equi-join the calendar on (zone, hour) and keep the dates their
    frequency allows: each date carries the rules it satisfies (daily, its
    weekday, its day of month) and the rule is part of the join key. No
    templates x ticks product; zone conversions scale with the calendar, not
    with the catalogue. Hours outside 0-23 never fire; no ticks, no rows. Lazy.

    A stored last run holds back every tick less than 3600 s of wall clock after
    it (or before it, if it lies ahead). Only the date on which that gap ends
    inside the schedule hour can have a firing other than its first tick: those
    (template, date) pairs, one a template at most, meet the ticks of their hour.
    """
    zones = zones if zones is not None else valid_zones()
    start = ticks.agg(F.date_sub(F.to_date(F.min("tick")), 1)).scalar()
    end = ticks.agg(F.date_add(F.to_date(F.max("tick")), 1)).scalar()
    freq, h = F.col("schedule_frequency"), F.col("schedule_hour")
    act = (t.where((F.col("schedule_enabled") == 1) & freq.isin(K.FREQUENCIES) & h.between(0, 23))
           .select(F.col("id").alias("template_id"), effective_zone(F.col("schedule_timezone"), zones).alias("_tz"),
                   _first_allowed(zones, after_last_run).alias("_from"), h.alias("_h"), _day_rule(freq, F.col("schedule_day_of_week"),
                                            F.col("schedule_day_of_month")).alias("_rule")))
    cal = (act.select("_tz", "_h").distinct()
           .select("_tz", "_h", F.explode(F.sequence(start, end)).alias("local_date")))
    local_start = F.make_timestamp_ntz(F.year("local_date"), F.month("local_date"), F.dayofmonth("local_date"),
                                       F.col("_h"), F.lit(0), F.lit(0))
    u0 = F.convert_timezone(F.col("_tz"), F.lit("UTC"), local_start)
    u1 = F.convert_timezone(F.col("_tz"), F.lit("UTC"), local_start + F.make_dt_interval(hours=F.lit(1)))
    cal = cal.select("_tz", "_h", "local_date", u0.alias("_u0"), u1.alias("_u1"))
    buckets = F.filter(F.array(*[_hour_floor(F.col("_u0")) + F.make_dt_interval(hours=F.lit(i)) for i in range(3)]),
                       lambda b: b < F.col("_u1"))
    cal = cal.select("_tz", "_h", "local_date", "_u0", "_u1", F.explode(buckets).alias("_bucket"))
    tk = ticks.select("tick", _hour_floor(F.col("tick")).alias("_bucket"))
    polled = cal.join(tk, "_bucket").where((F.col("tick") >= F.col("_u0")) & (F.col("tick") < F.col("_u1")))
    fires = polled.groupBy("_tz", "_h", "local_date").agg(F.min("tick").alias("tick"))
    date = F.col("local_date")
    fires = fires.withColumn("_rule", F.explode(F.array(
        F.lit("d"), F.concat(F.lit("w"), F.weekday(date).cast("string")),
        F.concat(F.lit("m"), F.dayofmonth(date).cast("string")))))
    found = act.join(fires, ["_tz", "_h", "_rule"])
    if not after_last_run:
        return found.select("template_id", "local_date", "tick")
    free = F.coalesce(F.convert_timezone(F.lit("UTC"), F.col("_tz"), F.col("tick")) >= F.col("_from"), F.lit(True))
    held = ~free & (F.to_date("_from") == date) & (F.hour("_from") == F.col("_h"))
    later = (found.where(held).drop("tick").join(polled.select("_tz", "_h", "local_date", "tick"), ["_tz", "_h", "local_date"])
             .where(free).groupBy("template_id", "local_date").agg(F.min("tick").alias("tick")))
    return found.where(free).select("template_id", "local_date", "tick").unionByName(later)


def schedule_violations(t: DataFrame, zones: list[str] | None = None) -> DataFrame:
    """One row per (template, broken rule) against the editor's bounds (P8):
    name/config present; frequency in daily/weekly/monthly; hour 0-23;
    weekday 0-6; month day 1-28; retain 1-100; known zone. A missing value is
    a violation only where the enabled schedule needs it."""
    zones = zones if zones is not None else valid_zones()
    en = F.col("schedule_enabled") == 1
    f, h = F.col("schedule_frequency"), F.col("schedule_hour")
    dow, dom = F.col("schedule_day_of_week"), F.col("schedule_day_of_month")
    ret, tz = F.col("schedule_retain_count"), F.col("schedule_timezone")
    rules = [
        ("name_missing", F.col("name").isNull()),
        ("config_missing", F.col("config_yaml").isNull()),
        ("frequency", (f.isNotNull() & ~f.isin(K.FREQUENCIES)) | (en & f.isNull())),
        ("hour", (h.isNotNull() & ~h.between(0, 23)) | (en & h.isNull())),
        ("day_of_week", (dow.isNotNull() & ~dow.between(0, 6)) | (en & (f == "weekly") & dow.isNull())),
        ("day_of_month", (dom.isNotNull() & ~dom.between(1, 28)) | (en & (f == "monthly") & dom.isNull())),
        ("retain_count", ret.isNotNull() & ~ret.between(1, 100)),
        ("timezone", tz.isNotNull() & ~tz.isin(zones)),
    ]
    arr = F.array_compact(F.array(*[F.when(F.coalesce(cond, F.lit(False)), F.lit(name)) for name, cond in rules]))
    return t.select("id", F.explode(arr).alias("rule"))


def block_violations(blocks: DataFrame) -> DataFrame:
    """Block settings outside the editor's bounds (P8): history days 1-31,
    chart height 200-800 in steps of 50."""
    d, ch = F.col("days"), F.col("chart_height")
    rules = [
        ("days", (F.col("type") == "history") & d.isNotNull() & ~d.between(1, 31)),
        ("chart_height", ch.isNotNull() & (~ch.between(200, 800) | (ch % 50 != 0))),
    ]
    arr = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules]))
    return blocks.select("template_id", "block_idx", F.explode(arr).alias("rule"))

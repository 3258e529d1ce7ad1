"""Scalar Column -> Column functions (display text, colours, labels).

All built-in expressions (whole-stage codegen), including the Python-exact
number texts (``{:,}``, ``.1f``, ``repr(float)``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from reportlake import constants as K


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ntz(value) -> Column:
    """A TIMESTAMP_NTZ literal from a naive datetime, independent of the
    Python process's and the session's time zones."""
    return F.lit(value.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp_ntz")


# ---------------------------------------------------------------- numbers
def fmt_thousands(x) -> Column:
    """Integer with comma grouping, as Python's ``{:,}`` (F1)."""
    return F.format_string("%,d", _c(x).cast("bigint"))


def fixed1(x, signed: bool = False) -> Column:
    """``{x:.1f}`` / ``{x:+.1f}`` exactly as Python writes them.

    Python rounds the exact binary value half-even (0.25 -> 0.2, 0.15 ->
    0.1). ``format_number`` formats through ``java.text.DecimalFormat``, which
    (since JDK 8) also rounds the exact binary value half-even, whereas
    ``format_string('%.1f')`` rounds the shortest decimal text half-up and
    differs. Grouping commas are dropped; '+' is added for non-negative
    values (negative zero keeps its '-', as in Python)."""
    v = _c(x).cast("double")
    body = F.regexp_replace(F.format_number(v, 1), ",", "")
    if signed:
        body = F.when(F.startswith(body, F.lit("-")), body).otherwise(F.concat(F.lit("+"), body))
    special = (F.when(F.isnan(v), F.lit("+nan" if signed else "nan"))
               .when(v == float("inf"), F.lit("+inf" if signed else "inf"))
               .when(v == float("-inf"), F.lit("-inf")))
    return F.when(v.isNull(), F.lit(None).cast("string")).otherwise(F.coalesce(special, body))


def fmt_trend_change(change, pct, trend) -> Column:
    """Change text with arrow (F2)."""
    change, pct, trend = _c(change), _c(pct), _c(trend)
    body = F.concat(F.when(change > 0, "+").otherwise(""), fmt_thousands(change),
                    F.lit(" ("), fixed1(pct, signed=True), F.lit("%) "))
    return (F.when(trend == "improved", F.concat(body, F.lit(K.ARROW_DOWN)))
            .when(trend == "worsened", F.concat(body, F.lit(K.ARROW_UP)))
            .otherwise(F.concat(fmt_thousands(change), F.lit(" (0%)"))))


def py_repr_double(x) -> Column:
    """Python ``repr(float)`` text for a DOUBLE column, JVM-side.

    The JVM prints plain text only for 1e-3 <= |x| < 1e7; Python prints plain
    for 1e-4 <= |x| < 1e16 and otherwise ``d.ddde+XX``. The JVM's scientific
    form is re-laid out accordingly.
    """
    x = _c(x).cast("double")
    s = x.cast("string")
    pat = r"^(-?)(\d)\.(\d+)E(-?\d+)$"
    sign = F.regexp_extract(s, pat, 1)
    lead = F.regexp_extract(s, pat, 2)
    frac = F.regexp_replace(F.regexp_extract(s, pat, 3), "0+$", "")
    e = F.regexp_extract(s, pat, 4).cast("int")
    digits = F.concat(lead, frac)
    nd = F.length(digits)
    small_plain = F.concat(sign, F.lit("0."), F.repeat(F.lit("0"), -e - 1), digits)
    big_plain = F.when(
        nd <= e + 1,
        F.concat(sign, digits, F.repeat(F.lit("0"), e + 1 - nd), F.lit(".0")),
    ).otherwise(F.concat(sign, F.left(digits, e + 1), F.lit("."), F.substr(digits, e + 2)))
    sci = F.concat(sign, lead, F.when(frac == "", "").otherwise(F.concat(F.lit("."), frac)),
                   F.lit("e"), F.when(e < 0, "-").otherwise("+"),
                   F.lpad(F.abs(e).cast("string"), 2, "0"))
    is_sci = F.instr(s, "E") > 0
    return (F.when(x.isNull(), F.lit(None).cast("string"))
            .when(F.isnan(x), "nan")
            .when(x == float("inf"), "inf")
            .when(x == float("-inf"), "-inf")
            .when(~is_sci, s)
            .when(e == -4, small_plain)
            .when((e >= 7) & (e <= 15), big_plain)
            .otherwise(sci))


def cell_text(x, kind: str) -> Column:
    """Text of one table cell as the printed table shows it.

    kind: 'double' (null -> 'nan', repr digits), 'bool' (True/False, null ->
    'None'), 'int' / 'string' / other (null -> 'None').
    """
    x = _c(x)
    if kind == "double":
        return F.coalesce(py_repr_double(x), F.lit("nan"))
    if kind == "bool":
        return F.when(x.isNull(), "None").when(x, "True").otherwise("False")
    return F.coalesce(x.cast("string"), F.lit("None"))


# ---------------------------------------------------------------- dates
ISO_SHAPE = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}(:\d{2}(:\d{2}(\.\d{1,6})?)?)?)?(Z|[+-]\d{2}:?\d{2})?$"


def parse_iso_utc(s) -> Column:
    """ISO-8601 text -> UTC wall-clock TIMESTAMP_NTZ; naive text is UTC;
    anything else -> null. Assumes the session time zone is UTC."""
    s = _c(s)
    ok = s.rlike(ISO_SHAPE)
    return F.when(ok, F.try_to_timestamp(s).cast("timestamp_ntz"))


def iso_to_display(s, tz: str | Column = "UTC") -> Column:
    """ISO text -> local ``dd/Mon/yyyy HH:MM`` (F3); ''/null -> '';
    unparseable -> its first 16 characters."""
    s = _c(s)
    tzc = F.lit(tz) if isinstance(tz, str) else tz
    local = F.convert_timezone(F.lit("UTC"), tzc, parse_iso_utc(s))
    return (F.when(s.isNull() | (s == ""), "")
            .otherwise(F.coalesce(F.date_format(local, "dd/MMM/yyyy HH:mm"), F.substring(s, 1, 16))))


SCREEN_DT_FORMAT = "MMM d, yyyy, h:mm a"
PRINT_DT_FORMAT = "MMM dd yyyy HH:mm"


def fmt_datetime_text(s, rule: str = "screen") -> Column:
    """Rewrite an ISO datetime text in its own offset (F4): the wall-clock part
    is formatted; screen keeps nulls, print writes 'nan'."""
    s = _c(s)
    wall = F.try_to_timestamp(F.substring(s, 1, 19), F.lit("yyyy-MM-dd'T'HH:mm:ss")).cast("timestamp_ntz")
    out = F.date_format(wall, SCREEN_DT_FORMAT if rule == "screen" else PRINT_DT_FORMAT)
    return out if rule == "screen" else F.coalesce(out, F.lit("nan"))


# ---------------------------------------------------------------- text
def truncate_cell(s, limit: int = K.MAX_CELL_CHARS) -> Column:
    """Longer than ``limit`` -> first limit-2 characters + '..' (F5)."""
    s = _c(s)
    return F.when(F.length(s) > limit, F.concat(F.substring(s, 1, limit - 2), F.lit(".."))).otherwise(s)


def report_filename(name, ts, template_id=None, failed_without_file=None) -> Column:
    """``<name>_yyyyMMdd_HHmmss.pdf`` with ' ' and '/' -> '_' (F6);
    failures without a file are ``failed_<id>_<stamp>.pdf``."""
    stamp = F.date_format(_c(ts), "yyyyMMdd_HHmmss")
    normal = F.concat(F.translate(_c(name), " /", "__"), F.lit("_"), stamp, F.lit(".pdf"))
    if failed_without_file is None:
        return normal
    failed = F.concat(F.lit("failed_"), _c(template_id).cast("string"), F.lit("_"), stamp, F.lit(".pdf"))
    return F.when(_c(failed_without_file), failed).otherwise(normal)


def clip_error(s, limit: int = K.ERROR_TEXT_CHARS) -> Column:
    """Error text cut to 500 characters (F7, scheduled path)."""
    return F.substring(_c(s), 1, limit)


# ---------------------------------------------------------------- colours, labels
def severity_color_map() -> Column:
    return F.create_map(*[v for k, c in K.SEVERITY_COLORS.items() for v in (F.lit(k), F.lit(c))])


def palette() -> Column:
    return F.array(*[F.lit(c) for c in K.DEFAULT_COLORS])


def severity_color(cat, pos=None) -> Column:
    """Severity colour, else palette[pos % 10] (F8); no position -> null."""
    sev = F.try_element_at(severity_color_map(), _c(cat).cast("string"))
    if pos is None:
        return sev
    fallback = F.element_at(palette(), (F.pmod(_c(pos), F.lit(len(K.DEFAULT_COLORS))) + 1).cast("int"))
    return F.coalesce(sev, fallback)


def _two_digits(n: Column) -> Column:
    """Python's ``{:02d}``: at least two places, never cut."""
    digits = F.abs(n).cast("string")
    return F.when(n < 0, F.concat(F.lit("-"), digits)).when(F.length(digits) < 2, F.concat(F.lit("0"), digits)) \
        .otherwise(digits)


def schedule_label(enabled, frequency, hour, tz, day_of_week, day_of_month) -> Column:
    """``Daily at 09:00 UTC`` / ``Weekly (Mon) at ..`` / ``Monthly (Day d) at ..``
    (F9); disabled -> 'No schedule configured'. The reference fails on a null
    frequency or hour of an enabled schedule; those give null here."""
    en, f, h = _c(enabled), _c(frequency), _c(hour)
    dow, dom, tz = _c(day_of_week), _c(day_of_month), _c(tz)
    cap = F.concat(F.upper(F.substring(f, 1, 1)), F.lower(F.substr(f, F.lit(2))))
    days = F.array(*[F.lit(d) for d in K.WEEKDAY_NAMES])
    idx = F.when(dow >= 0, dow + 1).otherwise(dow)  # negative indexes count from the end
    label = (F.when((cap == "Weekly") & dow.isNotNull(),
                    F.concat(cap, F.lit(" ("), F.try_element_at(days, idx.cast("int")), F.lit(")")))
             .when((cap == "Monthly") & dom.isNotNull() & (dom != 0),
                   F.concat(cap, F.lit(" (Day "), dom.cast("string"), F.lit(")")))
             .otherwise(cap))
    text = F.concat(label, F.lit(" at "), _two_digits(h), F.lit(":00 "),
                    F.coalesce(tz, F.lit("None")))
    active = en.isNotNull() & (en.cast("int") != 0)
    return (F.when(~active | en.isNull(), F.lit(K.MSG_NO_SCHEDULE))
            .when(f.isNull() | h.isNull(), F.lit(None).cast("string"))
            .otherwise(text))


def status_icon(status) -> Column:
    """success -> check mark, anything else -> cross."""
    return F.when(_c(status) == "success", K.ICON_SUCCESS).otherwise(K.ICON_FAILURE)


def trend_color(change_text) -> Column:
    """Green for a falling count, red for a rising one."""
    t = _c(change_text)
    return (F.when(F.instr(t, K.ARROW_DOWN) > 0, K.COLOR_IMPROVED)
            .when(F.instr(t, K.ARROW_UP) > 0, K.COLOR_WORSENED))

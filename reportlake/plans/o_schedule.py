"""Oracle SQL: schedule operators."""

from reportlake.plans.o_frames import parse_sql
from reportlake.plans.oracle import oracle

TZ_EFF = ("CASE WHEN schedule_timezone IN (SELECT name FROM pg_timezone_names()) "
          "THEN schedule_timezone ELSE 'UTC' END")
NOW = "TIMESTAMPTZ '2024-04-01 10:30:00+00:00'"

_DUE = f"""
WITH a AS (
  SELECT *, timezone(tz_eff, {NOW}) AS local_now,
    timezone(tz_eff, {parse_sql('schedule_last_run')}) AS last_local
  FROM (SELECT *, {TZ_EFF} AS tz_eff FROM fx_templates WHERE schedule_enabled = 1))
SELECT id, local_now,
  coalesce(schedule_frequency IS NOT NULL AND schedule_frequency <> '' AND schedule_hour IS NOT NULL
    AND hour(local_now) = schedule_hour
    AND NOT coalesce(last_local IS NOT NULL AND date_diff('microsecond', last_local, local_now) < 3600000000, false)
    AND coalesce(CASE schedule_frequency WHEN 'daily' THEN true
                   WHEN 'weekly' THEN isodow(local_now) - 1 = schedule_day_of_week
                   WHEN 'monthly' THEN day(local_now) = schedule_day_of_month ELSE false END, false),
    false) AS due
FROM a"""

oracle("due_flags", _DUE)
oracle("due_templates", """
SELECT t.id, t.name, t.schedule_timezone FROM fx_templates t JOIN d ON t.id = d.id WHERE d.due""", d=_DUE)

oracle("schedule_violations", """
SELECT id, rule FROM (
  SELECT id, 'name_missing' AS rule FROM fx_templates WHERE name IS NULL
  UNION ALL SELECT id, 'config_missing' FROM fx_templates WHERE config_yaml IS NULL
  UNION ALL SELECT id, 'frequency' FROM fx_templates
    WHERE (schedule_frequency IS NOT NULL AND schedule_frequency NOT IN ('daily', 'weekly', 'monthly'))
       OR (schedule_enabled = 1 AND schedule_frequency IS NULL)
  UNION ALL SELECT id, 'hour' FROM fx_templates
    WHERE (schedule_hour IS NOT NULL AND NOT schedule_hour BETWEEN 0 AND 23)
       OR (schedule_enabled = 1 AND schedule_hour IS NULL)
  UNION ALL SELECT id, 'day_of_week' FROM fx_templates
    WHERE (schedule_day_of_week IS NOT NULL AND NOT schedule_day_of_week BETWEEN 0 AND 6)
       OR (schedule_enabled = 1 AND schedule_frequency = 'weekly' AND schedule_day_of_week IS NULL)
  UNION ALL SELECT id, 'day_of_month' FROM fx_templates
    WHERE (schedule_day_of_month IS NOT NULL AND NOT schedule_day_of_month BETWEEN 1 AND 28)
       OR (schedule_enabled = 1 AND schedule_frequency = 'monthly' AND schedule_day_of_month IS NULL)
  UNION ALL SELECT id, 'retain_count' FROM fx_templates
    WHERE schedule_retain_count IS NOT NULL AND NOT schedule_retain_count BETWEEN 1 AND 100
  UNION ALL SELECT id, 'timezone' FROM fx_templates
    WHERE schedule_timezone IS NOT NULL AND schedule_timezone NOT IN (SELECT name FROM pg_timezone_names()))""")

# Brute force: every enabled template against every tick, first tick per local date.
oracle("due_by_tick", f"""
WITH t AS (SELECT *, {TZ_EFF} AS tz_eff FROM fx_templates
           WHERE schedule_enabled = 1 AND schedule_frequency IN ('daily', 'weekly', 'monthly')),
x AS (SELECT t.id, t.schedule_frequency AS f, t.schedule_hour AS h, t.schedule_day_of_week AS dow,
             t.schedule_day_of_month AS dom, k.tick, timezone(t.tz_eff, timezone('UTC', k.tick)) AS lt
      FROM t CROSS JOIN fx_ticks k)
SELECT id AS template_id, CAST(lt AS DATE) AS local_date, min(tick) AS tick FROM x
WHERE hour(lt) = h AND (f = 'daily' OR (f = 'weekly' AND isodow(lt) - 1 = dow) OR (f = 'monthly' AND day(lt) = dom))
GROUP BY 1, 2""")

# The same with the 3600 s of wall clock after the stored last run held back.
oracle("due_by_tick_after_runs", f"""
WITH t AS (SELECT *, {TZ_EFF} AS tz_eff FROM fx_templates
           WHERE schedule_enabled = 1 AND schedule_frequency IN ('daily', 'weekly', 'monthly')),
x AS (SELECT t.id, t.schedule_frequency AS f, t.schedule_hour AS h, t.schedule_day_of_week AS dow,
             t.schedule_day_of_month AS dom, k.tick, timezone(t.tz_eff, timezone('UTC', k.tick)) AS lt,
             timezone(t.tz_eff, {parse_sql('schedule_last_run')}) AS last_local
      FROM t CROSS JOIN fx_ticks k)
SELECT id AS template_id, CAST(lt AS DATE) AS local_date, min(tick) AS tick FROM x
WHERE hour(lt) = h AND (f = 'daily' OR (f = 'weekly' AND isodow(lt) - 1 = dow) OR (f = 'monthly' AND day(lt) = dom))
  AND NOT coalesce(date_diff('microsecond', last_local, lt) < 3600000000, false)
GROUP BY 1, 2""")

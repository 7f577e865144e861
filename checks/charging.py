"""Charging queries with their SQL."""

from __future__ import annotations

from checks.base import AS_OF, check, near, r, with_views
from checks.battery import fan
from voltlake import fixtures as X
from voltlake.plans import charging

_MODE = "CASE WHEN b.pack_current > 0 THEN 'charging' WHEN b.pack_current < 0 THEN 'discharging' ELSE 'idle' END"
_CROSS = """SELECT *, coalesce(pack_current >= 1 AND prev < 1, false) AS s, coalesce(pack_current < 1 AND prev >= 1, false) AS e FROM (
    SELECT *, lag(pack_current) OVER (PARTITION BY device_no ORDER BY msg_ts, event_id) AS prev FROM bms_dense)"""
_CROSSED = """SELECT * FROM (SELECT *, CAST(sum(CAST(s AS INT)) OVER (PARTITION BY device_no ORDER BY msg_ts, event_id) AS BIGINT) AS session_id FROM cross_rows)
  WHERE session_id > 0 AND (pack_current >= 1 OR e)"""
_BY_CURRENT = f"""SELECT *, (epoch_us(charge_end_time) - epoch_us(charge_start_time)) / 3600000000.0 AS charging_hours,
  CASE WHEN end_soc > start_soc THEN {r('(end_soc - start_soc) / nullif((epoch_us(charge_end_time) - epoch_us(charge_start_time)) / 3600000000.0, 0)', 2)} ELSE 0 END AS soc_per_hour
FROM (SELECT b.device_no, b.car_type, session_id, min(msg_ts) FILTER (s) AS charge_start_time, max(msg_ts) FILTER (e) AS charge_end_time,
  min(soc) FILTER (s) AS start_soc, max(soc) FILTER (e) AS end_soc, avg(pack_volt * pack_current) AS avg_charging_power, avg(mod_avg_temp) AS avg_charging_temp,
  avg(g.speed) AS avg_speed, avg(g.fuel_pct) AS avg_fuel_pct FROM crossed b {near('speed fuel_pct', 300)} GROUP BY 1, 2, 3)"""

_KEPT = """SELECT * FROM (SELECT *, soc - lag(soc) OVER w AS change, lag(soc) OVER w AS soc0, lag(msg_ts) OVER w AS ts0 FROM bms_dense WHERE soc IS NOT NULL
    WINDOW w AS (PARTITION BY device_no ORDER BY msg_ts, event_id)) WHERE abs(change) >= 0.05"""
_GROUPED = """SELECT *, CAST(coalesce(sum(CASE WHEN change < 0 THEN 1 ELSE 0 END) OVER (PARTITION BY device_no ORDER BY msg_ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS session_id FROM kept"""
_OPENED = """SELECT *, min(CASE WHEN change > 0.05 AND pack_current > 0.5 THEN (msg_ts, event_id) END) OVER (PARTITION BY device_no, session_id) AS opener,
    bool_or(change < 0) OVER (PARTITION BY device_no, session_id) AS closed FROM grouped"""
_SPANS = """SELECT device_no, session_id, min(ts0) AS start_time, max(msg_ts) AS end_time, arg_min(soc0, (msg_ts, event_id)) AS start_soc,
    arg_max(soc, (msg_ts, event_id)) AS end_soc, sum(epoch_us(msg_ts) - epoch_us(ts0)) / 60000000.0 AS duration_minutes
  FROM opened WHERE closed AND change > 0 AND (msg_ts, event_id) >= opener GROUP BY 1, 2"""
_SESS = """SELECT device_no, session_id, start_time, end_time, start_soc, end_soc, end_soc - start_soc AS soc_increase, duration_minutes, avg_current, avg_voltage,
    avg_current * avg_voltage * duration_minutes / 60 / 1000 AS energy_kwh, avg_current > 2 AS is_fast_charging
  FROM spans JOIN LATERAL (SELECT avg(pack_current) AS avg_current, avg(pack_volt) AS avg_voltage FROM bms_dense b WHERE b.device_no = spans.device_no
    AND b.msg_ts BETWEEN start_time - INTERVAL 60 SECOND AND end_time + INTERVAL 60 SECOND) ON TRUE"""
SESSION_CTES = dict(kept=_KEPT, grouped=_GROUPED, opened=_OPENED, spans=_SPANS, sessions=_SESS)
_DOUBLES = "soc_increase duration_minutes avg_current avg_voltage energy_kwh"


def _sessions(s, d):
    return charging.charging_sessions(X.bms_dense(s, d))


CHECKS = [
    check("charging_patterns", lambda s, d: charging.charging_patterns(X.bms(s, d), X.gps(s, d), fan_out=True),
          with_views(f"SELECT b.event_id, b.device_no, b.car_type, b.msg_ts, b.soc, b.pack_current, b.pack_volt, {_MODE} AS charging_status, g.speed, g.lat, g.lng, g.fuel_pct FROM bms b {fan('<')} WHERE b.pack_current IS NOT NULL", "bms", "gps"), "lat lng"),
    check("charging_by_hour", lambda s, d: charging.charging_by_hour(X.bms(s, d), AS_OF),
          with_views("SELECT CAST(hour(msg_ts) AS INT) AS hour, count(*) FILTER (pack_current > 0) AS charging_rows, avg(pack_current) FILTER (pack_current > 0) AS avg_charging_current, avg(soc) FILTER (pack_current > 0) AS avg_charging_soc FROM bms WHERE msg_ts >= TIMESTAMP '2024-01-01' GROUP BY 1", "bms"),
          "avg_charging_current avg_charging_soc"),
    check("charging_sessions_by_current", lambda s, d: charging.charging_sessions_by_current(X.bms_dense(s, d), X.gps(s, d)),
          with_views(_BY_CURRENT, "bms_dense", "gps", cross_rows=_CROSS, crossed=_CROSSED),
          "avg_charging_power avg_charging_temp avg_speed avg_fuel_pct charging_hours"),
    check("charging_sessions", _sessions, with_views("SELECT * FROM sessions", "bms_dense", **SESSION_CTES), _DOUBLES),
    check("charging_summary", lambda s, d: charging.charging_summary(_sessions(s, d)),
          with_views("""SELECT device_no, count(*) AS total_sessions, sum(duration_minutes) / 60 AS total_charging_time_hours, sum(energy_kwh) AS total_energy_kwh,
  count(*) FILTER (is_fast_charging) AS fast_charging_sessions, count(*) FILTER (NOT is_fast_charging) AS slow_charging_sessions, avg(energy_kwh) AS avg_charging_efficiency,
  avg(soc_increase) AS avg_soc_increase, avg(duration_minutes) AS avg_duration_minutes FROM sessions GROUP BY 1""", "bms_dense", **SESSION_CTES),
          "total_charging_time_hours total_energy_kwh avg_charging_efficiency avg_soc_increase avg_duration_minutes"),
    check("charging_session_details", lambda s, d: charging.session_details(_sessions(s, d)),
          with_views("""SELECT device_no, row_number() OVER (PARTITION BY device_no ORDER BY start_time, session_id) AS session_no, CAST(start_time AS DATE) AS date, soc_increase,
  duration_minutes, avg_current, avg_voltage, energy_kwh, is_fast_charging FROM sessions""", "bms_dense", **SESSION_CTES), _DOUBLES),
    check("charging_outliers", lambda s, d: charging.charging_outliers(_sessions(s, d)),
          with_views("""SELECT device_no, session_id, soc_per_kwh, z AS z_score, z > 2 AS is_anomaly FROM (SELECT *, CASE WHEN sd > 1e-9 THEN abs(soc_per_kwh - m) / sd ELSE 0 END AS z FROM (
  SELECT *, avg(soc_per_kwh) OVER (PARTITION BY device_no) AS m, stddev_pop(soc_per_kwh) OVER (PARTITION BY device_no) AS sd FROM (
  SELECT device_no, session_id, CASE WHEN energy_kwh > 0 THEN soc_increase / energy_kwh ELSE 0 END AS soc_per_kwh FROM sessions) WHERE soc_per_kwh > 0 AND soc_per_kwh < 100))""", "bms_dense", **SESSION_CTES),
          "soc_per_kwh z_score"),
    check("charging_heatmap", lambda s, d: charging.charging_heatmap(_sessions(s, d)),
          with_views("""SELECT CAST(g.id % 24 AS INT) AS hour, CAST(g.id // 24 AS INT) AS day, coalesce(sum(energy_kwh), 0) AS energy_kwh, count(session_id) AS sessions
FROM range(168) g(id) LEFT JOIN sessions ON hour(start_time) = g.id % 24 AND dayofweek(start_time) = g.id // 24 GROUP BY 1, 2""", "bms_dense", **SESSION_CTES), "energy_kwh"),
]

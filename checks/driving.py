"""Driving, session, segment and monthly queries with their SQL."""

from __future__ import annotations

from checks.base import check, graded, near, r, with_views
from voltlake import fixtures as X
from voltlake.plans import driving, fleet

_PATTERN = """CASE WHEN speed > 80 THEN 'highway' WHEN speed > 40 THEN 'urban_highway' WHEN speed > 20 THEN 'urban'
    WHEN speed > 5 THEN 'slow_urban' ELSE 'stationary' END"""
_FROM = """CASE WHEN speed >= 80 THEN 'highway' WHEN speed >= 50 THEN 'urban_highway' WHEN speed >= 20 THEN 'urban'
    WHEN speed >= 5 THEN 'slow_urban' ELSE 'stationary' END"""
_PERF = f"""SELECT {_FROM} AS driving_mode, car_type, count(*) AS data_points, avg(soc) AS avg_soc, avg(soh) AS avg_soh, avg(power_w) AS avg_power,
    stddev_samp(power_w) AS power_variability, avg(mod_avg_temp) AS avg_temp, min(mod_avg_temp) AS min_temp, max(mod_avg_temp) AS max_temp,
    avg(speed) AS avg_speed, avg(fuel_pct) AS avg_fuel_pct, avg(abs(pack_current) / nullif(speed, 0)) AS soc_consumption_rate,
    max(mod_avg_temp) - min(mod_avg_temp) AS temp_range
  FROM (SELECT b.*, abs(b.pack_volt * b.pack_current) AS power_w, g.speed, g.fuel_pct FROM bms b {near('speed fuel_pct', 300)} WHERE b.pack_current < 0)
  WHERE speed > 0 GROUP BY 1, 2"""
_PERF_DOUBLES = "avg_soc avg_soh avg_power power_variability avg_temp avg_speed avg_fuel_pct soc_consumption_rate"

_US = "epoch_us"
_STEPS = """SELECT device_no, event_id, msg_ts, odometer - lag(odometer) OVER w AS diff, lag(msg_ts) OVER w AS ts0,
    (epoch_us(msg_ts) - epoch_us(lag(msg_ts) OVER w)) / 60000000.0 AS gap FROM bms_dense WHERE odometer IS NOT NULL
    WINDOW w AS (PARTITION BY device_no ORDER BY msg_ts, event_id)"""
_MARKED = """SELECT *, CASE WHEN diff > 0 THEN 0 WHEN diff <= -1 AND diff > -50 THEN 0 WHEN diff <= -50 OR gap >= 30 THEN 1 ELSE 0 END AS brk FROM steps"""
_SESSIONS = """SELECT device_no, session_id, sum(diff) FILTER (diff > 0) AS distance_km, min(ts0) FILTER (diff > 0) AS start_time,
    coalesce(max(ts0) FILTER (brk = 1), max(msg_ts)) AS end_time FROM (
    SELECT *, CAST(coalesce(sum(brk) OVER (PARTITION BY device_no ORDER BY msg_ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS session_id FROM marked)
  GROUP BY 1, 2 HAVING sum(diff) FILTER (diff > 0) > 0"""
_TRIPS = "SELECT *, (epoch_us(end_time) - epoch_us(start_time)) / 1000000.0 AS driving_seconds FROM sess"
_TRIP_CTES = dict(steps=_STEPS, marked=_MARKED, sess=_SESSIONS, trips=_TRIPS)


def _trips(s, d):
    return driving.driving_sessions(X.bms_dense(s, d, odometer=True))


# Segments: positions of the SOC readings, then everything between two of them.
_POS = "SELECT *, row_number() OVER (PARTITION BY device_no ORDER BY msg_ts, event_id) AS pos FROM {view}"
_FILL = """SELECT p.*, coalesce(p.soh, n.soh) AS near_soh FROM pos p LEFT JOIN LATERAL (SELECT q.soh FROM pos q
    WHERE q.device_no = p.device_no AND q.soh IS NOT NULL AND abs(epoch_us(q.msg_ts) - epoch_us(p.msg_ts)) <= 60000000
    ORDER BY abs(epoch_us(q.msg_ts) - epoch_us(p.msg_ts)), q.pos > p.pos, abs(q.pos - p.pos) LIMIT 1) n ON TRUE"""
_PAIRS = """SELECT device_no, row_number() OVER w AS segment_no, pos AS pos0, lead(pos) OVER w AS pos1, msg_ts AS start_time, lead(msg_ts) OVER w AS end_time,
    soc AS soc_start, lead(soc) OVER w AS soc_end, near_soh AS soh, (pack_volt + lead(pack_volt) OVER w) / 2 AS pack_volt
  FROM fill WHERE soc IS NOT NULL WINDOW w AS (PARTITION BY device_no ORDER BY pos)"""
_KEPT = """SELECT *, soc_end - soc_start AS soc_change, (epoch_us(end_time) - epoch_us(start_time)) / 60000000.0 AS minutes FROM pairs
  WHERE end_time IS NOT NULL AND strftime(start_time, '%Y-%m') = strftime(end_time, '%Y-%m')
    AND abs(soc_end - soc_start) >= 0.05 AND (epoch_us(end_time) - epoch_us(start_time)) / 60000000.0 >= 2"""
_INSIDE = """SELECT k.device_no, k.segment_no, p.pos, p.pack_current, CASE WHEN p.pos > k.pos0 THEN p.odometer - q.odometer END AS diff
  FROM kept k JOIN pos p ON p.device_no = k.device_no AND p.pos BETWEEN k.pos0 AND k.pos1
  LEFT JOIN pos q ON q.device_no = p.device_no AND q.pos = p.pos - 1"""
_FOLDED = """SELECT device_no, segment_no, coalesce(sum(diff) FILTER (diff > 0 AND resets = 0), 0) AS distance_km,
    list_sort(list(pack_current))[count(*) // 2 + 1] AS pack_current
  FROM (SELECT *, sum(CASE WHEN diff <= -50 THEN 1 ELSE 0 END) OVER (PARTITION BY device_no, segment_no ORDER BY pos) AS resets FROM inside) GROUP BY 1, 2"""
_SEGS = """SELECT device_no, segment_no, CASE WHEN distance_km > 0.05 AND soc_change < 0 THEN 'drive' ELSE 'stand' END AS main_activity,
    CASE WHEN distance_km > 0.05 AND soc_change < 0 AND distance_km >= {long} THEN 'long' WHEN distance_km > 0.05 AND soc_change < 0 THEN 'short'
      WHEN soc_change > 0.1 AND pack_current > 5 THEN 'charge' WHEN minutes >= 5 THEN 'park' ELSE 'stop' END AS sub_activity,
    CASE WHEN month(start_time) BETWEEN 3 AND 5 THEN 'spring' WHEN month(start_time) BETWEEN 6 AND 8 THEN 'summer'
      WHEN month(start_time) BETWEEN 9 AND 11 THEN 'fall' ELSE 'winter' END AS season,
    start_time, end_time, soh, pack_volt, pack_current, soc_start, soc_end, soc_change, distance_km,
    pack_volt * pack_current * minutes / 60 / 1000 AS energy_kwh
  FROM kept JOIN folded USING (device_no, segment_no)"""


def seg_ctes(view: str, long: float = 100) -> dict[str, str]:
    return dict(pos=_POS.format(view=view), fill=_FILL, pairs=_PAIRS, kept=_KEPT, inside=_INSIDE, folded=_FOLDED,
                segs=_SEGS.format(long=long))


def _dense_segs(s, d, **kw):
    return driving.segments(X.bms_dense(s, d, odometer=True), **kw)


def _long_segs(s, d):
    return driving.segments(X.bms_long(s, d, odometer=True))


_DRIVES = "(SELECT * FROM segs WHERE main_activity = 'drive' AND distance_km > 0)"
_SEG_DOUBLES = "pack_volt pack_current soc_change distance_km energy_kwh"

# Efficiency steps on the same positions (odometer and current are present in every row).
_EFF = """SELECT device_no, event_id, msg_ts, CASE WHEN change < 0 AND km > 0 THEN -change / km END AS soc_per_km,
    CASE WHEN NOT coalesce(change < 0 AND km > 0, false) AND change > 0 AND pack_current > 5 THEN change / CASE WHEN minutes > 0 THEN minutes ELSE 1 END END AS soc_per_min
  FROM (SELECT *, soc - lag(soc) OVER w AS change, odometer - lag(odometer) OVER w AS km,
    (epoch_us(msg_ts) - epoch_us(lag(msg_ts) OVER w)) / 60000000.0 AS minutes
    FROM {view} WHERE soc IS NOT NULL WINDOW w AS (PARTITION BY device_no ORDER BY msg_ts, event_id))"""

_MONTHLY = """SELECT device_no, car_type, CAST(date_trunc('month', msg_ts) AS DATE) AS month, avg(soh) AS avg_soh, avg(mod_avg_temp) AS avg_temp,
    avg((max_cell_volt - min_cell_volt) / pack_volt * 100) AS avg_balance_index, count(*) AS data_points FROM bms_long GROUP BY 1, 2, 3"""


def _rate(c: str, name: str) -> str:
    prev = f"lag({c}) OVER w"
    return f"CASE WHEN {prev} > 0 THEN ({c} - {prev}) / {prev} * 100 ELSE 0 END AS {name}"


_SOH_LABELS = ("stable", "slight_degradation", "moderate_degradation", "severe_degradation")
_LONG_TERM = f"""SELECT *, {graded('soh_change_rate', (-1, -3, -5), _SOH_LABELS)} AS soh_trend,
  {graded('temp_change_rate', (5, 10), ('stable', 'moderate_increase', 'rapid_increase'), '<=')} AS temp_trend,
  {graded('balance_change_rate', (10, 20), ('stable', 'moderate_imbalance', 'rapid_imbalance'), '<=')} AS balance_trend
FROM (SELECT *, {_rate('avg_soh', 'soh_change_rate')}, {_rate('avg_temp', 'temp_change_rate')}, {_rate('avg_balance_index', 'balance_change_rate')}
  FROM monthly WINDOW w AS (PARTITION BY device_no ORDER BY month))"""
_VEHICLE_MONTHS = f"""SELECT *, {graded('soh_change_rate', (-1, -3, -5), _SOH_LABELS)} AS soh_trend,
  {graded('efficiency_change_rate', (5, 10), ('stable', 'moderate_increase', 'rapid_increase'), '<=')} AS efficiency_trend
FROM (SELECT *, {_rate('avg_soh', 'soh_change_rate')}, {_rate('avg_efficiency', 'efficiency_change_rate')} FROM (
  SELECT m.device_no, m.month, m.avg_soh, e.avg_efficiency, e.avg_charging_eff, coalesce(t.total_distance, 0) AS total_distance, coalesce(t.trip_count, 0) AS trip_count
  FROM (SELECT device_no, CAST(date_trunc('month', msg_ts) AS DATE) AS month, avg(soh) AS avg_soh FROM bms_long GROUP BY 1, 2) m
  LEFT JOIN (SELECT device_no, CAST(date_trunc('month', msg_ts) AS DATE) AS month, avg(soc_per_km) AS avg_efficiency, avg(soc_per_min) AS avg_charging_eff FROM eff GROUP BY 1, 2) e
    ON e.device_no = m.device_no AND e.month = m.month
  LEFT JOIN (SELECT device_no, CAST(date_trunc('month', end_time) AS DATE) AS month, sum(distance_km) AS total_distance, count(*) AS trip_count FROM {_DRIVES} GROUP BY 1, 2) t
    ON t.device_no = m.device_no AND t.month = m.month) WINDOW w AS (PARTITION BY device_no ORDER BY month))"""

_PERIODS = {
    "day": "strftime(end_time, '%Y-%m-%d')", "month": "strftime(end_time, '%Y-%m')",
    "season": "CASE WHEN month(end_time) BETWEEN 3 AND 5 THEN 'spring' WHEN month(end_time) BETWEEN 6 AND 8 THEN 'summer' WHEN month(end_time) BETWEEN 9 AND 11 THEN 'fall' ELSE 'winter' END",
}


def _distance(period: str, view: str):
    order = "list_position(['spring', 'summer', 'fall', 'winter'], period)" if period == "season" else "period"
    source = _dense_segs if view == "bms_dense" else _long_segs
    return check(
        f"distance_by_{period}", lambda s, d: driving.distance_by(source(s, d), period),
        with_views(f"""SELECT *, sum(distance) OVER (PARTITION BY device_no ORDER BY {order}) AS cumulative
FROM (SELECT device_no, {_PERIODS[period]} AS period, sum(distance_km) AS distance FROM {_DRIVES} GROUP BY 1, 2)""", view, **seg_ctes(view)),
        "distance cumulative",
    )


CHECKS = [
    check("driving_patterns", lambda s, d: driving.driving_patterns(X.bms(s, d), X.gps(s, d)),
          with_views(f"""SELECT *, CASE WHEN power_variability < 1000 AND temp_range < 10 THEN 'stable' WHEN power_variability < 2000 AND temp_range < 15 THEN 'moderate' ELSE 'variable' END AS performance_stability
FROM (SELECT device_no, car_type, {_PATTERN} AS driving_mode, avg(power_w) AS avg_power, stddev_samp(power_w) AS power_variability, avg(mod_avg_temp) AS avg_temp,
    max(mod_avg_temp) - min(mod_avg_temp) AS temp_range, avg(CASE WHEN prev_soc > soc THEN (prev_soc - soc) / nullif(abs(power_w), 0) * 1000 END) AS soc_efficiency, count(*) AS data_points
  FROM (SELECT b.*, g.speed FROM (SELECT *, {r('pack_volt * pack_current', 2)} AS power_w, lag(soc) OVER (PARTITION BY device_no ORDER BY msg_ts, event_id) AS prev_soc FROM bms WHERE soc IS NOT NULL) b {near('speed')})
  GROUP BY 1, 2, 3 HAVING count(*) >= 5)""", "bms", "gps"),
          "avg_power power_variability avg_temp soc_efficiency"),
    check("driving_performance", lambda s, d: driving.driving_performance(X.bms(s, d), X.gps(s, d)),
          with_views("SELECT * FROM perf", "bms", "gps", perf=_PERF), _PERF_DOUBLES),
    check("driving_performance_overview", lambda s, d: driving.driving_performance_overview(driving.driving_performance(X.bms(s, d), X.gps(s, d))),
          with_views(f"""SELECT driving_mode, car_type, count(*) AS data_points, {', '.join(f"{r(f'avg({c})', 2)} AS {c}" for c in ('avg_soc', 'avg_soh', 'avg_power', 'avg_temp', 'avg_speed', 'avg_fuel_pct'))},
  {r('stddev_samp(avg_power)', 2)} AS power_variability, {r('min(min_temp)', 2)} AS min_temp, {r('max(max_temp)', 2)} AS max_temp,
  {r('avg(soc_consumption_rate)', 2)} AS soc_consumption_rate, {r('max(avg_temp) - min(avg_temp)', 2)} AS temp_range FROM perf GROUP BY 1, 2""", "bms", "gps", perf=_PERF)),
    check("driving_performance_summary", lambda s, d: driving.driving_performance_summary(driving.driving_performance(X.bms(s, d), X.gps(s, d))),
          with_views(f"SELECT car_type, count(DISTINCT driving_mode) AS driving_modes_count, {r('avg(avg_power)', 2)} AS overall_avg_power, {r('avg(avg_temp)', 2)} AS overall_avg_temp, {r('avg(soc_consumption_rate)', 2)} AS overall_consumption_rate FROM perf GROUP BY 1", "bms", "gps", perf=_PERF)),
    check("driving_sessions", _trips, with_views("SELECT * FROM trips", "bms_dense", **_TRIP_CTES), "distance_km driving_seconds"),
    check("driving_summary", lambda s, d: driving.driving_summary(X.bms_dense(s, d, odometer=True), _trips(s, d)),
          with_views("""SELECT device_no, min_odometer, max_odometer, total_distance, session_count, total_seconds,
  CASE WHEN w // 3600 > 0 THEN (w // 3600) || 'h ' || (w % 3600 // 60) || 'm ' || (w % 60) || 's' WHEN w % 3600 // 60 > 0 THEN (w % 3600 // 60) || 'm ' || (w % 60) || 's' ELSE (w % 60) || 's' END AS formatted_time,
  coalesce(total_distance / nullif(total_seconds / 3600, 0), 0) AS avg_speed
FROM (SELECT s.*, coalesce(t.km, 0) AS total_distance, coalesce(t.n, 0) AS session_count, coalesce(t.sec, 0) AS total_seconds, CAST(floor(round(coalesce(t.sec, 0), 6)) AS BIGINT) AS w
  FROM (SELECT device_no, min(odometer) AS min_odometer, max(odometer) AS max_odometer FROM bms_dense GROUP BY 1) s
  LEFT JOIN (SELECT device_no, sum(distance_km) AS km, count(*) AS n, sum(driving_seconds) AS sec FROM trips GROUP BY 1) t USING (device_no))""", "bms_dense", **_TRIP_CTES),
          "total_distance total_seconds avg_speed"),
    check("daily_distance", lambda s, d: driving.daily_distance(X.bms(s, d, odometer=True)),
          with_views("SELECT device_no, CAST(msg_ts AS DATE) AS date, sum(diff) AS distance_km FROM (SELECT *, odometer - lag(odometer) OVER (PARTITION BY device_no ORDER BY msg_ts, event_id) AS diff FROM bms WHERE odometer IS NOT NULL) WHERE diff > 0 GROUP BY 1, 2", "bms"), "distance_km"),
    check("segments", _dense_segs, with_views("SELECT * FROM segs", "bms_dense", **seg_ctes("bms_dense")), _SEG_DOUBLES),
    check("segments_long_trips", lambda s, d: _dense_segs(s, d, long_km=1.5).groupBy("sub_activity").count(),
          with_views("SELECT sub_activity, count(*) AS count FROM segs GROUP BY 1", "bms_dense", **seg_ctes("bms_dense", 1.5))),
    check("segments_by_month", lambda s, d: _long_segs(s, d), with_views("SELECT * FROM segs", "bms_long", **seg_ctes("bms_long")), _SEG_DOUBLES),
    check("segment_summary", lambda s, d: driving.segment_summary(_dense_segs(s, d), X.bms_dense(s, d, odometer=True)),
          with_views("""SELECT c.*, m.total_distance, CAST(ceil((epoch_us(end_time) - epoch_us(start_time)) / 86400000000.0) AS BIGINT) AS total_days,
  CASE WHEN total_distance >= 100 THEN 'long' ELSE 'short' END AS driving_type
FROM (SELECT device_no, min(start_time) AS start_time, max(end_time) AS end_time, count(*) AS total_segments, count(*) FILTER (sub_activity = 'charge') AS total_charging_sessions,
    count(*) FILTER (main_activity = 'drive') AS total_driving_sessions, count(*) FILTER (sub_activity = 'stop') AS total_idle_sessions,
    count(*) FILTER (sub_activity = 'park') AS total_parking_sessions FROM segs GROUP BY 1) c
JOIN (SELECT device_no, max(odometer) - min(odometer) AS total_distance FROM bms_dense GROUP BY 1) m USING (device_no)""", "bms_dense", **seg_ctes("bms_dense")), "total_distance"),
    _distance("day", "bms_dense"), _distance("month", "bms_long"), _distance("season", "bms_long"),
    check("trip_histogram", lambda s, d: driving.trip_histogram(_dense_segs(s, d)),
          with_views(f"""SELECT CAST(i AS INT) AS bin_no, name, (SELECT count(*) FROM {_DRIVES} WHERE distance_km >= lo AND distance_km < hi) AS trips
FROM (VALUES (0, '0~1', 0, 1), (1, '1~3', 1, 3), (2, '3~5', 3, 5), (3, '5~10', 5, 10), (4, '10~20', 10, 20), (5, '20~50', 20, 50), (6, '50+', 50, 1e18)) v(i, name, lo, hi)""", "bms_dense", **seg_ctes("bms_dense"))),
    check("trip_length_share", lambda s, d: driving.trip_length_share(_dense_segs(s, d)),
          with_views(f"SELECT count(*) FILTER (distance_km < 5) AS short_trips, count(*) FILTER (distance_km >= 5) AS long_trips FROM {_DRIVES}", "bms_dense", **seg_ctes("bms_dense"))),
    check("activity_share", lambda s, d: driving.activity_share(_dense_segs(s, d)),
          with_views("SELECT count(*) FILTER (main_activity = 'drive') AS driving, count(*) FILTER (main_activity <> 'drive') AS stopped FROM segs", "bms_dense", **seg_ctes("bms_dense"))),
    check("efficiency_by_month", lambda s, d: driving.efficiency_by_month(_long_segs(s, d)),
          with_views(f"SELECT strftime(end_time, '%Y-%m') AS month, {r('sum(distance_km) / sum(abs(energy_kwh))', 2)} AS efficiency FROM {_DRIVES} WHERE energy_kwh <> 0 GROUP BY 1", "bms_long", **seg_ctes("bms_long"))),
    check("step_efficiency", lambda s, d: driving.step_efficiency(driving.efficiency_steps(X.bms_dense(s, d, odometer=True))),
          with_views("SELECT device_no, coalesce(avg(soc_per_km), 0) AS avg_driving_efficiency, coalesce(avg(soc_per_min), 0) AS avg_charging_efficiency, count(soc_per_km) AS drive_steps, count(soc_per_min) AS charge_steps FROM eff GROUP BY 1", "bms_dense", eff=_EFF.format(view="bms_dense")),
          "avg_driving_efficiency avg_charging_efficiency"),
    check("monthly_performance", lambda s, d: driving.monthly_performance(X.bms_long(s, d)),
          with_views("SELECT * FROM monthly", "bms_long", monthly=_MONTHLY), "avg_soh avg_temp avg_balance_index"),
    check("long_term_trends", lambda s, d: driving.long_term_trends(driving.monthly_performance(X.bms_long(s, d))),
          with_views(_LONG_TERM, "bms_long", monthly=_MONTHLY),
          "avg_soh avg_temp avg_balance_index soh_change_rate temp_change_rate balance_change_rate"),
    check("monthly_vehicle_trends", lambda s, d: driving.monthly_vehicle_trends(
        X.bms_long(s, d, odometer=True), driving.efficiency_steps(X.bms_long(s, d, odometer=True)), _long_segs(s, d)),
          with_views(_VEHICLE_MONTHS, "bms_long", eff=_EFF.format(view="bms_long"), **seg_ctes("bms_long")),
          "avg_soh avg_efficiency avg_charging_eff total_distance soh_change_rate efficiency_change_rate"),
    check("vehicle_baseline", lambda s, d: fleet.vehicle_baseline(
        X.bms_long(s, d, odometer=True), driving.efficiency_steps(X.bms_long(s, d, odometer=True))),
          with_views("""SELECT * FROM (SELECT b.device_no, b.car_type, avg(soh) AS baseline_soh, arg_min(odometer, (msg_ts, event_id)) AS baseline_odometer, max(odometer) AS baseline_max_odometer,
    count(*) AS baseline_data_count FROM bms_long b JOIN firsts f USING (device_no) WHERE epoch_us(msg_ts) - epoch_us(t0) < 30 * 86400000000 GROUP BY 1, 2)
  LEFT JOIN (SELECT device_no, avg(soc_per_km) AS baseline_efficiency, avg(soc_per_min) AS baseline_charging_eff FROM eff JOIN firsts USING (device_no)
    WHERE epoch_us(msg_ts) - epoch_us(t0) < 30 * 86400000000 GROUP BY 1) USING (device_no)""", "bms_long", eff=_EFF.format(view="bms_long"), firsts="SELECT device_no, min(msg_ts) AS t0 FROM bms_long GROUP BY 1"),
          "baseline_soh baseline_efficiency baseline_charging_eff"),
]

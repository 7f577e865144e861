"""Fleet, ranking and anomaly queries with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import (
    ANOMALIES, AS_OF, GRADES, HEALTH_INDEX, LATEST, VEHICLES, check, graded, health_scores, near, r, with_views,
)
from voltlake import fixtures as X
from voltlake.functions import expr as E
from voltlake.operators import select as D
from voltlake.plans import anomaly, fleet, ranking


def _vehicles(spark, d):
    return fleet.vehicle_performance(X.bms(spark, d), X.gps(spark, d))


def _rankings(spark, d):
    return ranking.vehicle_rankings(_vehicles(spark, d))


def _summary(spark, d):
    return fleet.vehicle_summary(X.bms(spark, d, odometer=True), X.gps(spark, d), AS_OF)


def _snapshot(spark, d):
    return fleet.device_snapshot(X.bms(spark, d, odometer=True), X.gps(spark, d))


def _points(spark, d):
    from voltlake.sources.points import to_points

    places = to_points(X.gps(spark, d), ["lat", "lng", "speed", "fuel_pct"], "time", "gps", extra=("gps_id",))
    return X.points(spark, d).unionByName(places.withColumnRenamed("gps_id", "event_id"))


_GPS_POINTS = "\n UNION ALL ".join(
    f"SELECT gps_id AS event_id, 'gps' AS measurement, device_no, car_type, time, '{f}' AS field, {f} AS value FROM gps"
    for f in ("lat", "lng", "speed", "fuel_pct")
)
_ALL_POINTS = f"SELECT * FROM points UNION ALL {_GPS_POINTS}"

_DASH = f"""SELECT car_type, count(*) AS total_vehicles, count(*) FILTER (pack_current > 0) AS charging_now,
    count(*) FILTER (speed > 0) AS moving_now, {r('avg(soc)', 2)} AS avg_soc, {r('avg(soh)', 2)} AS avg_soh,
    {r('100.0 * count(*) FILTER (soh < 80) / count(*)', 2)} AS "low_SOH_pct",
    {r('100.0 * count(*) FILTER (mod_avg_temp > 45) / count(*)', 2)} AS high_temp_pct,
    {r('100.0 * count(*) FILTER (cell_balance_index > 1.5) / count(*)', 2)} AS high_imbalance_pct,
    max(msg_ts) AS last_updated
  FROM (SELECT b.*, g.speed FROM latest b {near('speed')}) GROUP BY car_type"""


def _weighted(c):
    return f"{r(f'sum({c} * total_vehicles) / sum(total_vehicles)', 2)} AS {c}"


_FIGURES = ("avg_soc", "avg_soh", '"low_SOH_pct"', "high_temp_pct", "high_imbalance_pct")
FLEET_DASHBOARD = with_views(
    f"""SELECT * FROM stats UNION ALL
SELECT 'TOTAL', CAST(sum(total_vehicles) AS BIGINT), CAST(sum(charging_now) AS BIGINT), CAST(sum(moving_now) AS BIGINT),
  {', '.join(_weighted(c) for c in _FIGURES)}, max(last_updated) FROM stats""",
    "bms", "gps", latest=LATEST, stats=_DASH,
)

_RANKED = f"""SELECT *,
    row_number() OVER (ORDER BY overall_score DESC, vehicle_id) AS overall_rank,
    row_number() OVER (ORDER BY latest_soh DESC, vehicle_id) AS soh_rank,
    row_number() OVER (ORDER BY latest_soc DESC, vehicle_id) AS soc_rank,
    percent_rank() OVER (ORDER BY overall_score) * 100 AS pct
  FROM (SELECT vehicle_id, vehicle_type, latest_soh, latest_soc, cell_balance_index AS avg_efficiency,
    {r('latest_soh * 0.50 + latest_soc * 0.30 + greatest(0, 100 - cell_balance_index) * 0.20', 2)} AS overall_score FROM vehicles)"""
_CATEGORY = graded("pct", (90, 75, 50), ("TOP_10", "HIGH_PERFORMANCE", "AVERAGE", "NEEDS_ATTENTION"))
_RANKINGS = f"SELECT * EXCLUDE (pct), {_CATEGORY} AS performance_category FROM ranked"
_RANK_CTES = dict(latest=LATEST, vehicles=VEHICLES, ranked=_RANKED, rankings=_RANKINGS)

_HEALTH = f"""SELECT device_no, car_type, health AS composite_health_index,
    {graded('health', (95, 90, 85, 80), ('excellent', 'very_good', 'good', 'fair', 'needs_attention'))} AS health_grade
  FROM (SELECT device_no, car_type, {HEALTH_INDEX} AS health FROM (SELECT *, {health_scores('std')}
    FROM (SELECT *, stddev_samp(pack_volt) OVER (PARTITION BY car_type, device_no ORDER BY msg_ts, event_id ROWS BETWEEN 10 PRECEDING AND CURRENT ROW) AS std,
        row_number() OVER (PARTITION BY car_type, device_no ORDER BY msg_ts DESC, event_id DESC) AS rn
      FROM bms WHERE soh IS NOT NULL) WHERE rn = 1))"""
_JUDGED = ANOMALIES.replace("FROM bms WHERE", "FROM latest WHERE")
_SUMMARY = f"""SELECT b.device_no AS vehicle_id, b.car_type AS vehicle_type, b.soc AS latest_soc, b.soh AS latest_soh,
    b.odometer AS total_odometer, b.pack_volt, b.pack_current, b.pack_volt * b.pack_current AS power_w, b.mod_avg_temp,
    b.cell_balance_index, h.composite_health_index, h.health_grade, g.lat AS latest_lat, g.lng AS latest_lng,
    g.speed AS latest_speed, g.fuel_pct AS latest_fuel_pct, greatest(b.msg_ts, coalesce(g.time, b.msg_ts)) AS last_updated,
    b.msg_ts AS bms_time, j.anomaly_type, j.risk_level,
    CASE WHEN b.pack_current > 0 THEN 'charging' WHEN b.pack_current < 0 AND g.speed > 5 THEN 'driving' ELSE 'idle' END AS vehicle_status,
    CASE WHEN greatest(b.msg_ts, coalesce(g.time, b.msg_ts)) >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY THEN 'HIGH'
      WHEN greatest(b.msg_ts, coalesce(g.time, b.msg_ts)) >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY THEN 'MEDIUM' ELSE 'LOW' END AS data_quality
  FROM latest b {near('time lat lng speed fuel_pct')}
  LEFT JOIN health h ON h.device_no = b.device_no AND h.car_type = b.car_type
  LEFT JOIN judged j ON j.event_id = b.event_id"""
_SUM_CTES = dict(latest=LATEST, health=_HEALTH, judged=_JUDGED, summary=_SUMMARY)


def _mean(c, name):
    return f"{r(f'avg({c})', 2)} AS {name}"


_OVERVIEW = f"""SELECT count(*) AS total_vehicles, {_mean('latest_soc', 'avg_soc')}, {_mean('latest_soh', 'avg_soh')},
  {_mean('composite_health_index', 'avg_health_index')}, {_mean('cell_balance_index', 'avg_cell_balance')},
  {_mean('pack_volt', 'avg_voltage')}, {_mean('pack_current', 'avg_current')}, {_mean('mod_avg_temp', 'avg_temp')},
  {_mean('latest_speed', 'avg_speed')}, {_mean('latest_fuel_pct', 'avg_fuel_pct')},
  {', '.join(f"count(*) FILTER (last_updated >= TIMESTAMP '{AS_OF}' - INTERVAL {n} DAY) AS active_vehicles_{n}d" for n in (7, 14, 30))},
  {', '.join(f"count(*) FILTER (health_grade = '{g}') AS {n}" for g, n in (('excellent', 'excellent_health'), ('very_good', 'very_good_health'), ('good', 'good_health'), ('fair', 'fair_health'), ('needs_attention', 'needs_attention')))},
  {', '.join(f"count(*) FILTER (risk_level = '{x}') AS {x}_anomalies" for x in ('critical', 'high', 'medium'))},
  {', '.join(f"{r(f'''avg(composite_health_index) FILTER (vehicle_type = '{t}')''', 2)} AS {t.lower()}_avg_health" for t in ('BONGO3', 'GV60', 'PORTER2'))},
  count(*) FILTER (cell_balance_index > 1.5) AS high_imbalance_vehicles,
  {r('100.0 * count(*) FILTER (epoch_us(newest) - epoch_us(bms_time) <= 300000000) / count(*)', 2)} AS online_5m_pct,
  max(last_updated) AS last_updated
FROM (SELECT *, max(bms_time) OVER (PARTITION BY vehicle_type) AS newest FROM summary)"""


def _last(c, source="bms", ts="msg_ts", key="event_id"):
    return f"arg_max({c}, ({ts}, {key})) FILTER ({c} IS NOT NULL) AS {c}"


_LAST_FIELDS = ("soc", "soh", "pack_volt", "pack_current", "mod_avg_temp", "odometer", "chrg_cable_conn")
_SNAPSHOT = f"""SELECT b.device_no AS vehicle_id, b.car_type AS vehicle_type, soc AS latest_soc, soh AS latest_soh,
    pack_volt, pack_current, mod_avg_temp, odometer, speed, lat, lng, {graded('soh', (95, 85, 70), GRADES)} AS performance_grade,
    last_updated, CASE WHEN speed > 5 THEN 'moving' WHEN pack_current > 0.5 THEN 'charging' ELSE 'stopped' END AS vehicle_status,
    pack_current > 0.5 AS is_charging, chrg_cable_conn = 1 AS is_cable_connected,
    CAST(NULL AS BOOLEAN) AS is_fast_charging, CAST(NULL AS BOOLEAN) AS is_slow_charging,
    CASE WHEN pack_current > 0.5 THEN 'charging' WHEN chrg_cable_conn = 1 THEN 'connected' ELSE 'disconnected' END AS charging_status,
    speed > 5 AS is_moving, CASE WHEN pack_current > 0.5 THEN pack_volt * pack_current / 1000 ELSE 0 END AS charging_power,
    pack_volt * pack_current AS power_w
  FROM (SELECT device_no, max(car_type) AS car_type, {', '.join(_last(c) for c in _LAST_FIELDS)}, max(msg_ts) AS last_updated FROM bms GROUP BY device_no) b
  LEFT JOIN (SELECT device_no, {', '.join(_last(c, ts='time', key='gps_id') for c in ('speed', 'lat', 'lng'))} FROM gps GROUP BY device_no) g
    ON b.device_no = g.device_no"""

_STATE = f"""SELECT device_no, max(car_type) AS car_type,
  {', '.join(_last(c) for c in ('soh', 'soc', 'pack_volt', 'pack_current', 'mod_avg_temp', 'odometer', 'max_cell_volt', 'min_cell_volt'))},
  max(msg_ts) AS last_updated FROM bms GROUP BY device_no"""
_IND = """SELECT *, greatest(0, least(100, soh * 0.4 + soc * 0.2 + greatest(0, 100 - abs(mod_avg_temp - 25) * 2) * 0.2
      + greatest(0, 100 - cell_balance_index * 10) * 0.2)) AS composite_health_index
  FROM (SELECT *, CASE WHEN pack_volt > 0 AND max_cell_volt <> 0 AND min_cell_volt <> 0 THEN (max_cell_volt - min_cell_volt) / pack_volt * 100 ELSE 0 END AS cell_balance_index FROM state)"""
_Z = {"soh": "soh", "health": "composite_health_index", "balance": "cell_balance_index", "temp": "mod_avg_temp"}
_ZBASE = "SELECT car_type, " + ", ".join(
    f"avg({s}) FILTER ({s} > 0) AS baseline_{n}, stddev_samp({s}) FILTER ({s} > 0) AS std_{n}" for n, s in _Z.items()
) + " FROM ind GROUP BY car_type"
_ZROWS = "SELECT i.*, " + ", ".join(f"baseline_{n}" for n in _Z) + ", " + ", ".join(
    f"CASE WHEN std_{n} > 0 THEN abs(({s} - baseline_{n}) / std_{n}) ELSE 0 END AS {n}_zscore" for n, s in _Z.items()
) + " FROM ind i JOIN zbase z ON i.car_type = z.car_type"
_ZALL = f"""SELECT *, CASE {' '.join(f"WHEN {n}_zscore > 2.5 THEN '{n}_anomaly'" for n in _Z)} ELSE 'normal' END AS anomaly_type,
  CASE WHEN max_zscore > 3 THEN 'critical' WHEN max_zscore > 2.5 THEN 'high' WHEN max_zscore > 2 THEN 'medium' ELSE 'low' END AS risk_level
  FROM (SELECT *, greatest({', '.join(f'{n}_zscore' for n in _Z)}) AS max_zscore FROM zrows)"""
_TWO = [f"{n}_zscore" for n in _Z] + [f"baseline_{n}" for n in _Z] + ["max_zscore", "composite_health_index", "cell_balance_index"]
_ZFOUND = f"""SELECT device_no, car_type, soh, mod_avg_temp, last_updated, anomaly_type, risk_level,
  {', '.join(f'{r(c, 2)} AS {c}' for c in _TWO)} FROM zall WHERE anomaly_type <> 'normal'"""
_Z_CTES = dict(state=_STATE, ind=_IND, zbase=_ZBASE, zrows=_ZROWS, zall=_ZALL, zfound=_ZFOUND)


def _zscores(spark, d):
    return anomaly.zscore_anomalies(X.bms(spark, d, odometer=False))


_SCORE_STATE = """SELECT * REPLACE (coalesce(soh, 0) AS soh, coalesce(soc, 0) AS soc, coalesce(odometer, 0) AS odometer),
    CASE WHEN pack_volt > 0 AND max_cell_volt > 0 AND min_cell_volt > 0 THEN (max_cell_volt - min_cell_volt) / pack_volt * 100 ELSE 0 END AS cell_balance_index
  FROM state"""
_SCORED = f"""SELECT *, CASE WHEN soh >= 90 THEN 100 WHEN soh >= 80 THEN 80 + (soh - 80) * 2 WHEN soh >= 70 THEN 60 + (soh - 70) * 2
      WHEN soh >= 60 THEN 40 + (soh - 60) * 2 ELSE soh * 0.67 END AS s1,
    CASE WHEN health >= 90 THEN 100 WHEN health >= 80 THEN 80 + (health - 80) WHEN health >= 70 THEN 60 + (health - 70)
      WHEN health >= 60 THEN 40 + (health - 60) ELSE health * 0.67 END AS s2,
    CASE WHEN idx <= 0.5 THEN 100 WHEN idx <= 1 THEN 90 - (idx - 0.5) * 20 WHEN idx <= 2 THEN 80 - (idx - 1) * 10
      WHEN idx <= 3 THEN 70 - (idx - 2) * 10 ELSE greatest(20, 60 - (idx - 3) * 5) END AS s3,
    CASE WHEN days <= 7 THEN 100 WHEN days <= 30 THEN 80 WHEN days <= 90 THEN 60 ELSE 40 END AS s4,
    CASE WHEN odometer >= 10000 THEN 100 WHEN odometer >= 5000 THEN 80 + (odometer - 5000) / 5000 * 20
      WHEN odometer >= 1000 THEN 60 + (odometer - 1000) / 4000 * 20 WHEN odometer >= 100 THEN 40 + (odometer - 100) / 900 * 20
      ELSE odometer / 100 * 40 END AS s5
  FROM (SELECT *, cell_balance_index AS idx, soh * 0.6 + soc * 0.2 + greatest(0, 100 - cell_balance_index) * 0.2 AS health,
    (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(last_updated)) / 86400000000.0 AS days FROM scorestate)"""

CHECKS = [
    check("fleet_dashboard", lambda s, d: fleet.fleet_dashboard(X.bms(s, d), X.gps(s, d)), FLEET_DASHBOARD),
    check("vehicle_performance", _vehicles, with_views("SELECT * FROM vehicles", "bms", "gps", latest=LATEST, vehicles=VEHICLES),
          "cell_balance_index lat lng"),
    check("vehicle_rankings", _rankings, with_views("SELECT * FROM rankings", "bms", "gps", **_RANK_CTES), "avg_efficiency"),
    check("top_vehicles", lambda s, d: ranking.top_vehicles(_rankings(s, d), "soh", 20, 50),
          with_views("SELECT * FROM rankings ORDER BY latest_soh DESC, vehicle_id LIMIT 20", "bms", "gps", **_RANK_CTES), "avg_efficiency"),
    check("category_counts", lambda s, d: ranking.category_counts(_rankings(s, d)),
          with_views("SELECT performance_category, count(*) AS vehicles FROM rankings GROUP BY 1", "bms", "gps", **_RANK_CTES)),
    check("performance_page", lambda s, d: D.paginate(_vehicles(s, d), "latest_soh", "vehicle_id", "desc", 2, 25),
          with_views("SELECT * FROM vehicles ORDER BY latest_soh DESC, vehicle_id LIMIT 25 OFFSET 25", "bms", "gps", latest=LATEST, vehicles=VEHICLES),
          "cell_balance_index lat lng"),
    check("performance_page_rn", lambda s, d: D.paginate_rn(_vehicles(s, d).select("vehicle_id", "vehicle_type", "latest_soh"), "latest_soh", "vehicle_id", 3, 20),
          with_views("SELECT * FROM (SELECT vehicle_id, vehicle_type, latest_soh, row_number() OVER (ORDER BY latest_soh DESC, vehicle_id) AS row_num FROM vehicles) WHERE row_num BETWEEN 41 AND 60", "bms", "gps", latest=LATEST, vehicles=VEHICLES)),
    check("page_info", lambda s, d: D.page_info(_vehicles(s, d), 50),
          with_views("SELECT count(*) AS total, CAST(ceil(count(*) / 50.0) AS BIGINT) AS pages FROM latest", "bms", latest=LATEST)),
    check("grade_distribution", lambda s, d: fleet.grade_distribution(_vehicles(s, d)),
          with_views(f"SELECT performance_grade, count(*) AS vehicle_count, {r('count(*) * 100.0 / sum(count(*)) OVER ()', 2)} AS percentage FROM vehicles GROUP BY 1", "bms", "gps", latest=LATEST, vehicles=VEHICLES)),
    check("vehicle_summary", _summary, with_views("SELECT * FROM summary", "bms", "gps", **_SUM_CTES),
          "power_w cell_balance_index latest_lat latest_lng"),
    check("fleet_overview", lambda s, d: fleet.fleet_overview(_summary(s, d), AS_OF), with_views(_OVERVIEW, "bms", "gps", **_SUM_CTES)),
    check("vehicle_comparison", lambda s, d: fleet.vehicle_comparison(_summary(s, d), "gv60"),
          with_views("SELECT vehicle_id, latest_soc, latest_soh, composite_health_index, cell_balance_index, health_grade, anomaly_type, risk_level, last_updated FROM summary WHERE vehicle_type = 'GV60'", "bms", "gps", **_SUM_CTES), "cell_balance_index"),
    check("health_rank", lambda s, d: fleet.health_rank(_summary(s, d)),
          with_views("SELECT vehicle_id, vehicle_type, latest_soh, composite_health_index, cell_balance_index, row_number() OVER (ORDER BY composite_health_index DESC, vehicle_id) AS health_rank FROM summary", "bms", "gps", **_SUM_CTES), "cell_balance_index"),
    check("type_comparison", lambda s, d: fleet.type_comparison(_summary(s, d)),
          with_views("SELECT vehicle_type AS car_type, count(*) AS vehicle_count, avg(latest_soh) AS avg_soh, avg(composite_health_index) AS avg_health_index, avg(cell_balance_index) AS avg_balance_index, count(*) FILTER (health_grade = 'excellent') AS excellent_count, count(*) FILTER (health_grade = 'needs_attention') AS needs_attention_count FROM summary GROUP BY 1", "bms", "gps", **_SUM_CTES),
          "avg_soh avg_health_index avg_balance_index"),
    check("spec_comparison", lambda s, d: fleet.spec_comparison(X.bms(s, d)),
          with_views(f"""SELECT *, {r('avg_pack_volt * avg_pack_current / 1000', 2)} AS estimated_battery_capacity_kwh,
  {r('avg_soc * 10', 0)} AS estimated_range_km, {r('avg_pack_volt / nullif(avg_pack_current, 0)', 2)} AS actual_efficiency_kmkwh,
  {r('100 - actual_avg_soh', 2)} AS efficiency_degradation_rate,
  {graded('actual_avg_soh', (90, 80, 70), ('Excellent', 'Good', 'Fair', 'Poor'))} AS battery_life_prediction
FROM (SELECT car_type, count(DISTINCT device_no) AS vehicle_count, {_mean('soh', 'actual_avg_soh')},
  {_mean('pack_volt * pack_current / 1000', 'actual_avg_power')}, {_mean('mod_avg_temp', 'actual_avg_temp')},
  {r('avg((max_cell_volt - min_cell_volt) / pack_volt * 100)', 3)} AS actual_avg_cell_balance, {_mean('pack_volt', 'avg_pack_volt')},
  {_mean('abs(pack_current)', 'avg_pack_current')}, {_mean('soc', 'avg_soc')}
  FROM bms WHERE soh IS NOT NULL AND pack_volt > 0 GROUP BY car_type)""", "bms")),
    check("device_snapshot", _snapshot, with_views(_SNAPSHOT, "bms", "gps"), "charging_power power_w lat lng"),
    check("status_counts", lambda s, d: fleet.status_counts(_snapshot(s, d)),
          with_views("""SELECT count(*) AS total_devices, count(*) FILTER (is_charging) AS charging_devices, count(*) FILTER (is_moving) AS moving_devices,
  count(*) FILTER (is_cable_connected AND NOT coalesce(is_charging, false)) AS cable_only_devices,
  count(*) FILTER (NOT is_cable_connected AND NOT coalesce(is_charging, false)) AS disconnected_devices,
  count(*) FILTER (is_cable_connected IS NULL) AS unknown_devices FROM snap""", "bms", "gps", snap=_SNAPSHOT)),
    check("fleet_summary", lambda s, d: fleet.fleet_summary(_points(s, d), _snapshot(s, d)),
          with_views(f"""SELECT {', '.join(f"avg(value) FILTER (field = '{f}') AS {n}" for f, n in (('soc', 'avg_soc'), ('soh', 'avg_soh'), ('mod_avg_temp', 'avg_temp'), ('pack_volt', 'avg_voltage'), ('pack_current', 'avg_current'), ('odometer', 'avg_odometer'), ('speed', 'avg_speed')))},
  CAST(NULL AS DOUBLE) AS max_temp, CAST(NULL AS DOUBLE) AS min_temp, (SELECT avg(power_w) FROM snap) AS avg_power FROM allpoints""",
                     "bms", "gps", "points", snap=_SNAPSHOT, allpoints=_ALL_POINTS),
          "avg_soc avg_soh avg_temp avg_voltage avg_current avg_odometer avg_speed avg_power"),
    check("point_counts", lambda s, d: fleet.point_counts(_points(s, d)),
          with_views("SELECT car_type, measurement, count(*) AS points FROM allpoints GROUP BY ALL UNION ALL SELECT 'TOTAL', measurement, count(*) FROM allpoints GROUP BY ALL", "bms", "gps", "points", allpoints=_ALL_POINTS)),
    check("avg_soc_soh", lambda s, d: fleet.avg_soc_soh(X.points(s, d)),
          with_views("SELECT car_type, avg(value) FILTER (field = 'soc' AND value BETWEEN 0 AND 100) AS avg_soc, avg(value) FILTER (field = 'soh' AND value BETWEEN 0 AND 100) AS avg_soh, count(DISTINCT device_no) AS devices FROM points GROUP BY 1", "bms", "points"), "avg_soc avg_soh"),
    check("list_devices", lambda s, d: fleet.list_devices(X.bms(s, d)),
          with_views("SELECT DISTINCT car_type, device_no FROM bms", "bms")),
    check("devices_of_type", lambda s, d: fleet.devices_of_type(X.gps(s, d), X.bms(s, d), "PORTER2").groupBy("device_no").agg(F.count("*").alias("gps_rows")),
          with_views("SELECT device_no, count(*) AS gps_rows FROM gps WHERE device_no IN (SELECT device_no FROM bms WHERE car_type = 'PORTER2') GROUP BY 1", "bms", "gps")),
    check("available_months", lambda s, d: fleet.available_months(X.bms_long(s, d)),
          with_views("SELECT DISTINCT strftime(msg_ts, '%Y-%m') AS month FROM bms_long", "bms_long")),
    check("latest_by_field", lambda s, d: fleet.latest_by_field(X.points(s, d)),
          with_views("SELECT device_no, field, arg_max(value, (time, event_id)) AS value, max(time) AS time FROM points GROUP BY 1, 2", "points")),
    check("device_list", lambda s, d: fleet.device_list(X.points(s, d), "gv60"),
          with_views(f"""SELECT device_no, soc, soh, 'UNKNOWN' AS vehicle_status, {graded('soh', (95, 85, 70), ('A', 'B', 'C', 'D'))} AS performance_grade
FROM (SELECT device_no, coalesce(arg_max(value, (time, event_id)) FILTER (field = 'soc'), 0) AS soc,
  coalesce(arg_max(value, (time, event_id)) FILTER (field = 'soh'), 0) AS soh FROM points WHERE car_type = 'GV60' GROUP BY 1)""", "points")),
    check("staleness", lambda s, d: fleet.staleness(_vehicles(s, d), "2024-01-30 23:58:00"),
          with_views("""SELECT vehicle_id, last_updated, CAST(floor((epoch_us(TIMESTAMP '2024-01-30 23:58:00') - epoch_us(last_updated)) / 1000000.0) AS BIGINT) AS seconds_since_update,
  floor((epoch_us(TIMESTAMP '2024-01-30 23:58:00') - epoch_us(last_updated)) / 1000000.0) < 3600 AS is_active FROM vehicles""", "bms", "gps", latest=LATEST, vehicles=VEHICLES)),
    check("hourly_performance", lambda s, d: fleet.hourly_performance(X.bms(s, d), AS_OF),
          with_views("SELECT CAST(hour(msg_ts) AS INT) AS hour_of_day, avg(soc) AS avg_soc, avg(soh) AS avg_soh, avg(mod_avg_temp) AS avg_temp, count(*) AS data_points FROM bms WHERE msg_ts >= TIMESTAMP '2024-01-24' GROUP BY 1", "bms"), "avg_soc avg_soh avg_temp"),
    check("device_history", lambda s, d: fleet.device_history(X.bms(s, d), AS_OF),
          with_views(f"""SELECT *, {graded('record_count', (100, 50), ('high', 'medium', 'low'))} AS data_quality FROM (
  SELECT device_no, CAST(msg_ts AS DATE) AS date, avg(soc) AS avg_soc, avg(soh) AS avg_soh, avg(pack_volt) AS avg_pack_volt,
    avg(pack_current) AS avg_pack_current, avg(mod_avg_temp) AS avg_mod_temp, count(*) AS record_count
  FROM bms WHERE msg_ts >= TIMESTAMP '2024-01-01' AND soc IS NOT NULL AND soh IS NOT NULL GROUP BY 1, 2
  QUALIFY row_number() OVER (PARTITION BY device_no ORDER BY date DESC) <= 30)""", "bms"),
          "avg_soc avg_soh avg_pack_volt avg_pack_current avg_mod_temp"),
    check("rule_anomalies", lambda s, d: anomaly.rule_anomalies(X.bms(s, d)),
          with_views("SELECT * FROM judged WHERE anomaly_type <> 'normal'", "bms", judged=ANOMALIES), "anomaly_severity"),
    check("top_anomalies", lambda s, d: D.top_k(
        anomaly.labelled(anomaly.rule_anomalies(X.bms(s, d))).withColumn("anomaly_severity", E.rounded("anomaly_severity", 6)),
        ["anomaly_severity", "msg_ts"], "event_id", 50),
          with_views(f"""SELECT *, CASE anomaly_type WHEN 'low_soh' THEN '저 SOH' WHEN 'high_imbalance' THEN '고 불균형' WHEN 'high_temperature' THEN '고온'
  WHEN 'low_temperature' THEN '저온' WHEN 'low_voltage' THEN '저전압' WHEN 'high_voltage' THEN '고전압' WHEN 'extreme_current' THEN '극한 전류' ELSE anomaly_type END AS anomaly_label
FROM (SELECT * REPLACE ({r('anomaly_severity', 6)} AS anomaly_severity) FROM judged WHERE anomaly_type <> 'normal') ORDER BY anomaly_severity DESC, msg_ts DESC, event_id LIMIT 50""", "bms", judged=ANOMALIES)),
    check("anomaly_stats", lambda s, d: anomaly.anomaly_stats(anomaly.rule_anomalies(X.bms(s, d))),
          with_views(f"SELECT risk_level, anomaly_type, count(*) AS occurrence_count, count(DISTINCT device_no) AS affected_vehicles, {r('avg(anomaly_severity)', 2)} AS avg_severity, max(anomaly_severity) AS max_severity FROM judged WHERE anomaly_type <> 'normal' GROUP BY 1, 2", "bms", judged=ANOMALIES), "max_severity"),
    check("anomaly_by_car_type", lambda s, d: anomaly.anomaly_by_car_type(anomaly.rule_anomalies(X.bms(s, d))),
          with_views(f"SELECT car_type, count(*) AS total_anomalies, {', '.join(f'''count(*) FILTER (risk_level = '{x}') AS {x}_count''' for x in ('critical', 'high', 'medium', 'low'))}, {r('avg(anomaly_severity)', 2)} AS avg_severity FROM judged WHERE anomaly_type <> 'normal' GROUP BY 1", "bms", judged=ANOMALIES)),
    check("zscore_anomalies", lambda s, d: _zscores(s, d).drop("anomaly_description"),
          with_views("SELECT * FROM zfound", "bms", **_Z_CTES)),
    check("anomaly_distribution", lambda s, d: anomaly.anomaly_distribution(_zscores(s, d)),
          with_views(f"SELECT anomaly_type, count(*) AS total, {', '.join(f'''count(*) FILTER (risk_level = '{x}') AS {x}''' for x in ('critical', 'high', 'medium', 'low'))} FROM zfound GROUP BY 1", "bms", **_Z_CTES)),
    check("score_vehicle", lambda s, d: ranking.score_vehicle(X.bms(s, d, odometer=True), AS_OF),
          with_views(f"""SELECT device_no, car_type, soh, soc, pack_volt, pack_current, mod_avg_temp, odometer, cell_balance_index,
  health AS composite_health_index, last_updated, overall_score, {graded('overall_score', (90, 80, 70, 60), ('우수', '양호', '보통', '주의', '불량'))} AS performance_grade
FROM (SELECT *, {r('s1 * 0.3 + s2 * 0.25 + s3 * 0.2 + s4 * 0.15 + s5 * 0.1', 2)} AS overall_score FROM scored)""", "bms", state=_STATE, scorestate=_SCORE_STATE, scored=_SCORED),
          "cell_balance_index composite_health_index"),
]

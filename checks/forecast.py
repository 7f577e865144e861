"""Forecast and model queries with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import check, r, with_views
from voltlake import fixtures as X
from voltlake.plans import energy, forecast

_RATES = """SELECT *, (first_soh - last_soh) / nullif(days, 0) AS degradation_rate FROM (SELECT device_no, car_type, arg_min(soh, (msg_ts, event_id)) AS first_soh, arg_max(soh, (msg_ts, event_id)) AS last_soh,
    (epoch_us(max(msg_ts)) - epoch_us(min(msg_ts))) / 86400000000.0 AS days, count(*) AS points FROM bms_long WHERE soh IS NOT NULL GROUP BY 1, 2) WHERE points >= 2"""
_COMPARED = """SELECT device_no, car_type, degradation_rate, average_degradation_rate, total_vehicles_compared,
    CASE WHEN degradation_rate > average_degradation_rate * 1.2 THEN 'worse' WHEN degradation_rate < average_degradation_rate * 0.8 THEN 'better' ELSE 'average' END AS comparison
  FROM (SELECT *, avg(degradation_rate) OVER (PARTITION BY car_type) AS average_degradation_rate, count(*) OVER (PARTITION BY car_type) AS total_vehicles_compared
    FROM rates WHERE degradation_rate > 0)"""
_CONF = f"""SELECT device_no, n AS points, CASE WHEN n < 10 THEN 0.3 ELSE {r('least(1, n / 50.0) * 0.6 + greatest(0.1, 1 - sd / 10) * 0.4', 2)} END AS confidence,
    {r('least(1, n / 100.0)', 2)} AS count_confidence FROM (SELECT device_no, count(*) AS n, stddev_pop(soh) AS sd FROM bms_long WHERE soh > 0 GROUP BY 1)"""
_LINES = """SELECT device_no, regr_slope(soh, i) AS slope, regr_intercept(soh, i) AS intercept, count(*) AS n, max(msg_ts) AS last_time,
    (epoch_us(max(msg_ts)) - epoch_us(min(msg_ts))) / 86400000000.0 / (count(*) - 1) AS step
  FROM (SELECT *, row_number() OVER (PARTITION BY device_no ORDER BY msg_ts, event_id) - 1 AS i FROM bms_long WHERE soh > 0) GROUP BY 1 HAVING count(*) >= 10"""
_LINEAR = """SELECT device_no, CAST(k AS INT) AS days_from_now, CAST(last_time + to_days(CAST(k AS INT)) AS DATE) AS date,
    greatest(0, least(100, slope * (n - 1 + k / step) + intercept)) AS predicted_soh FROM lines, range(1, 31) t(k)"""
_REPORT = """SELECT device_no, CAST(30 AS INT) AS prediction_days, f.predicted_soh, s.current_soh, t.degradation_rate, c.average_degradation_rate,
    coalesce(c.comparison, 'unknown') AS comparison, x.confidence, h.history_rows,
    CASE WHEN f.predicted_soh < 70 THEN 'high' WHEN f.predicted_soh < 80 THEN 'medium' WHEN c.comparison = 'worse' THEN 'medium' ELSE 'low' END AS priority
  FROM (SELECT * FROM linear WHERE days_from_now = 30) f
  JOIN (SELECT device_no, arg_max(soh, (msg_ts, event_id)) AS current_soh FROM bms_long WHERE soh > 0 GROUP BY 1) s USING (device_no)
  LEFT JOIN rates t USING (device_no) LEFT JOIN compared c USING (device_no) LEFT JOIN conf x USING (device_no)
  LEFT JOIN (SELECT device_no, CAST(least(30, count(*)) AS INT) AS history_rows FROM bms_long WHERE soh > 0 GROUP BY 1) h USING (device_no)"""


# The seasonal model: a row of columns per day, their Gram matrix, Gauss and Jordan's elimination on it.
_BENDS, _WAVES, _RIDGE = 5, 3, 0.0001
_COLUMNS = ["1.0", "t", *[f"greatest(0.0, t - 0.8 * {i + 1} / {_BENDS + 1})" for i in range(_BENDS)],
            *[f"{wave}(day * (2 * pi() * {k + 1} / {forecast.YEAR_DAYS}))" for k in range(_WAVES) for wave in ("sin", "cos")]]
_K = len(_COLUMNS)
_DAILY = "SELECT CAST(msg_ts AS DATE) AS ds, avg(soh) AS y FROM bms_long WHERE soh IS NOT NULL GROUP BY 1 HAVING count(*) >= 5"
_FRAME = "SELECT min(ds) AS origin, CAST(greatest(max(ds) - min(ds), 1) AS DOUBLE) AS span FROM daily"


def _columns_of(date: str, rows: str) -> str:
    day = f"SELECT *, CAST({date} - origin AS DOUBLE) AS day FROM {rows}, frame"
    return f"SELECT *, CAST([{', '.join(_COLUMNS)}] AS DOUBLE[]) AS x FROM (SELECT *, day / span AS t FROM ({day}))"


_AHEAD = """(SELECT device_no, CAST(k AS INT) AS days_from_now, CAST(CAST(max(msg_ts) AS DATE) + to_days(CAST(k AS INT)) AS DATE) AS date
    FROM bms_long, range(1, 31) n(k) WHERE soh IS NOT NULL GROUP BY device_no, k)"""
_DESIGN = f"SELECT list_append(x, y) AS x FROM ({_columns_of('ds', 'daily')})"
_GRAM = f"""SELECT list(line ORDER BY i) AS m FROM (SELECT i, list(v ORDER BY j) AS line FROM (
    SELECT i, j, sum(x[i] * x[j]) AS v FROM design, range(1, {_K + 2}) a(i), range(1, {_K + 2}) b(j) GROUP BY ALL) GROUP BY i)"""
_SOLVED = f"""SELECT 1 AS k, list_transform(range(1, {_K + 1}), lambda i: list_transform(range(1, {_K + 2}),
    lambda j: m[i][j] + CASE WHEN i = j AND i > 1 THEN {_RIDGE} * m[1][1] ELSE 0 END)) AS a FROM gram
  UNION ALL SELECT k + 1, list_transform(range(1, {_K + 1}), lambda i: list_transform(range(1, {_K + 2}),
    lambda j: CASE WHEN i = k THEN a[k][j] / a[k][k] ELSE a[i][j] - a[i][k] * a[k][j] / a[k][k] END)) FROM solved WHERE k <= {_K}"""
_MODEL = f"SELECT list_transform(range(1, {_K + 1}), lambda i: a[i][{_K + 1}]) AS b FROM solved WHERE k = {_K + 1}"
_SIGMA = f"SELECT sqrt(avg((x[{_K + 1}] - list_dot_product(x[1:{_K}], b)) ** 2)) AS sigma FROM design, model"
_SEASONAL_ROWS = f"""SELECT device_no, date, days_from_now, {r('greatest(0, least(100, p))', 2)} AS predicted_soh,
    {r(f'greatest(0, least(100, p - {forecast.Z80} * sigma))', 2)} AS lower_bound, {r(f'greatest(0, least(100, p + {forecast.Z80} * sigma))', 2)} AS upper_bound
  FROM (SELECT *, list_dot_product(x, b) AS p FROM ({_columns_of('date', _AHEAD)}), model, sigma)"""
_SEASONAL = {
    "daily": _DAILY, "frame": _FRAME, "design": _DESIGN, "gram": _GRAM, "solved": _SOLVED, "model": _MODEL, "sigma": _SIGMA,
    "seasonal": _SEASONAL_ROWS,
}


def _recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


def _report(s, d):
    rows = X.bms_long(s, d)
    out = forecast.soh_report(rows, forecast.forecast_soh_linear(rows, 30))
    return out.withColumn("history_rows", F.size("history")).drop("history", "message")


def _seasonal(s, d):
    rows = X.bms_long(s, d)
    model = forecast.fit_soh_seasonal(forecast.daily_soh(rows))
    return forecast.forecast_soh_seasonal(model, forecast.last_dates(rows), 30)


def _seasonal_report(s, d):
    out = forecast.soh_report(X.bms_long(s, d), _seasonal(s, d))
    return out.withColumn("history_rows", F.size("history")).drop("history", "message")


def _features(s, d):
    return energy.energy_features(X.points(s, d))


def _energy_rows(s, d):
    train, test = energy.split_features(_features(s, d))
    model = energy.train_energy_model(train)
    out = energy.predict_energy(model, test)
    return out.select("device_no", "time", energy.LABEL, "predicted_kw")


def _importance(s, d):
    return energy.feature_importance(energy.train_energy_model(_features(s, d), leak_free=True), s)


_WIDE = "SELECT time, device_no, car_type, " + ", ".join(f"avg(value) FILTER (field = '{f}') AS {f}" for f in energy.SENSORS) + " FROM points GROUP BY 1, 2, 3"

CHECKS = [
    check("daily_soh", lambda s, d: forecast.daily_soh(X.bms_long(s, d)),
          with_views("SELECT CAST(msg_ts AS DATE) AS ds, avg(soh) AS y, count(*) AS data_count FROM bms_long WHERE soh IS NOT NULL GROUP BY 1 HAVING count(*) >= 5", "bms_long"), "y"),
    check("degradation_rates", lambda s, d: forecast.degradation_rates(X.bms_long(s, d)),
          with_views("SELECT * FROM rates", "bms_long", rates=_RATES), "days degradation_rate"),
    check("compare_to_fleet", lambda s, d: forecast.compare_to_fleet(forecast.degradation_rates(X.bms_long(s, d))),
          with_views("SELECT * FROM compared", "bms_long", rates=_RATES, compared=_COMPARED), "degradation_rate average_degradation_rate"),
    check("forecast_confidence", lambda s, d: forecast.forecast_confidence(X.bms_long(s, d)),
          with_views("SELECT * FROM conf", "bms_long", conf=_CONF), "confidence count_confidence"),
    check("forecast_soh_linear", lambda s, d: forecast.forecast_soh_linear(X.bms_long(s, d), 30),
          with_views("SELECT * FROM linear", "bms_long", lines=_LINES, linear=_LINEAR), "predicted_soh"),
    check("soh_report", _report,
          with_views("SELECT * FROM report", "bms_long", rates=_RATES, compared=_COMPARED, conf=_CONF, lines=_LINES, linear=_LINEAR, report=_REPORT),
          "predicted_soh degradation_rate average_degradation_rate confidence"),
    check("recent_history", lambda s, d: forecast.recent_history(X.bms_long(s, d)),
          with_views("SELECT device_no, car_type, event_id, msg_ts, soh FROM bms_long WHERE soh > 0 QUALIFY row_number() OVER (PARTITION BY device_no ORDER BY msg_ts DESC, event_id DESC) <= 30", "bms_long")),
    check("forecast_soh_seasonal", _seasonal, _recursive(with_views("SELECT * FROM seasonal", "bms_long", **_SEASONAL))),
    check("soh_report_seasonal", _seasonal_report,
          _recursive(with_views("SELECT * FROM report", "bms_long", rates=_RATES, compared=_COMPARED, conf=_CONF, **_SEASONAL,
                                linear="SELECT device_no, days_from_now, predicted_soh FROM seasonal", report=_REPORT)),
          "degradation_rate average_degradation_rate confidence"),
    check("energy_features", _features,
          with_views(f"""SELECT time, device_no, car_type, {', '.join(energy.SENSORS)}, pack_volt * pack_current AS instant_power_w, pack_volt * pack_current / 1000 AS instant_power_kw,
  CAST(hour(time) AS INT) AS hour, CAST(isodow(time) - 1 AS INT) AS day_of_week, CAST(month(time) AS INT) AS month, CAST(month(time) % 12 // 3 AS INT) AS season,
  CAST(CASE car_type WHEN 'BONGO3' THEN 0 WHEN 'GV60' THEN 1 ELSE 2 END AS INT) AS car_type_encoded
FROM wide WHERE {' AND '.join(f'{f} IS NOT NULL' for f in energy.SENSORS)}""", "points", wide=_WIDE), "instant_power_w instant_power_kw"),
    check("energy_model", _energy_rows),
    check("feature_importance", _importance),
]

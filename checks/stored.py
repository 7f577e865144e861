"""What is read, written and stored: raw files, tables, profiles, models; and the rules behind them, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from checks.base import check, r, with_views
from checks.battery import _SERIES, _series_rows
from checks.fleet import _Z_CTES, _zscores
from checks.forecast import _SEASONAL, _features, _recursive
from checks.quality import _CLEANED, _PROFILE, _PROFILED, _RAW_COLUMNS, _raw_files
from voltlake import fixtures as X
from voltlake import schema as S
from voltlake.functions import expr as E
from voltlake.operators import clean, quality, select, sequence
from voltlake.plans import battery, energy, forecast
from voltlake.session import shared_folder
from voltlake.sources import io


def _place(s) -> str:
    return f"{shared_folder(s)}/stored/{uuid.uuid4().hex}"


def _bounded(name: str, rules, value: str | None = None) -> str:
    """SQL text: the value where it lies within its closed range."""
    value, (low, high) = value or name, rules[name]
    tests = [f"v >= {low!r}"] * (low is not None) + [f"v <= {high!r}"] * (high is not None)
    return f"(SELECT CASE WHEN {' AND '.join(tests)} THEN v END FROM (SELECT CAST({value} AS DOUBLE) AS v)) AS {name}"


# ---------------------------------------------------------------- positions

_GPS = {
    "lat": "CASE WHEN gps_id % 9 = 0 THEN 90.5 ELSE lat END", "lng": "CASE WHEN gps_id % 11 = 0 THEN -180.5 ELSE lng END",
    "speed": "CASE WHEN gps_id % 13 = 0 THEN -1.0 WHEN gps_id % 17 = 0 THEN 301.0 ELSE speed END", "fuel_pct": "fuel_pct + 0.5",
    "direction": "gps_id % 400", "hdop": "gps_id % 55",
}
_GPS_COLUMNS = ["device_no", "time", *_GPS, "car_type"]


def _gps_files(s, d):
    """Position rows as a raw file has them: text, padded ids, two-digit years, values out of range, blanks."""
    rows = X.gps(s, d).select(
        F.concat(F.lit(" "), "device_no").alias("device_no"), F.date_format("time", "yy-MM-dd HH:mm:ss").alias("time"),
        *[F.expr(f"CASE WHEN gps_id % 23 = 0 THEN '' ELSE CAST({text} AS STRING) END").alias(name) for name, text in _GPS.items()],
        "car_type")
    place = _place(s)
    io.write_table(rows, f"{place}/gps", "csv")
    return io.read_gps_csv(s, f"{place}/gps", _GPS_COLUMNS)


def _clean_gps(s, d):
    out = clean.clean_gps(_gps_files(s, d).drop("_corrupt_record"))
    return out.withColumn("time", F.col("time").cast("timestamp_ntz"))


_CLEAN_GPS = f"""SELECT device_no, date_trunc('second', time) AS time, CAST(time AS DATE) AS day, car_type,
  {', '.join(_bounded(name, S.GPS_RULES, f'CASE WHEN gps_id % 23 <> 0 THEN {text} END') for name, text in _GPS.items())} FROM gps"""


# ---------------------------------------------------------------- files and tables


def _read_bms(s, d):
    raw = io.read_bms_csv(s, f"{_raw_files(s, d)}/in", _RAW_COLUMNS)
    return raw.groupBy("car_type").agg(
        F.count("*").alias("rows"), F.count("soc").alias("with_soc"), F.count_if(F.trim("device_no") == "device_no").alias("headers"),
        F.count_distinct("msg_id").alias("ids"))


def _ingest_batch(s, d):
    place = _raw_files(s, d)
    io.ingest_batch(s, f"{place}/in", f"{place}/clean", "bms", _RAW_COLUMNS)
    return s.read.parquet(f"{place}/clean").withColumn("msg_ts", F.col("msg_ts").cast("timestamp_ntz"))


def _written(s, d):
    place = _place(s)
    rows = X.bms(s, d).select("event_id", "device_no", "car_type", "msg_ts", "soc").withColumn("day", F.to_date("msg_ts"))
    io.write_telemetry(rows, place, "overwrite")
    return select.between_time(s.read.parquet(place), "msg_ts", "2024-01-05 06:00:00", "2024-01-09 00:00:00")


def _clustered(s, d):
    rows = X.bms_gaps(s, d).select("event_id", "device_no", "msg_ts", "soc")
    place = _place(s)
    stored = io.write_clustered(rows, f"clustered_{place[-32:]}", place, row_id="event_id", buckets=8, rows_per_slice=256)
    order = ["msg_ts", "event_id"]
    stepped = sequence.lagged(stored, ["device_no"], order, {"prev_soc": "soc"})
    return sequence.unsliced(sequence.running(stepped, ["device_no"], order, sums={"n": F.lit(1)}))


def _profile_file(s, d):
    place = _place(s)
    found = quality.profile(X.bms(s, d), _PROFILED, exact=True)
    io.write_profile(found, place)
    return s.read.schema(found.schema).json(f"{place}/json")


def _materialized(s, d):
    """Two results stored in a database of their own, the second replaced, then listed."""
    name = f"volt_{uuid.uuid4().hex}"
    s.sql(f"CREATE DATABASE {name} LOCATION '{_place(s)}'")
    before = s.catalog.currentDatabase()
    s.catalog.setCurrentDatabase(name)
    try:
        daily = X.bms(s, d).groupBy("car_type", F.to_date("msg_ts").alias("day")).agg(F.count("*").alias("rows"))
        io.materialize(daily, "fleet_daily", ["car_type"])
        io.materialize(daily.where("false"), "fleet_types")
        io.materialize(daily.groupBy("car_type").agg(F.sum("rows").alias("rows")), "fleet_types")
        io.materialize(daily, "dropped")
        io.drop_materialized(s, "dropped")
        tables = [row["name"] for row in io.list_tables(s, "*").collect()]
        parts = [s.table(f"{name}.{table}").select(F.lit(table).alias("name"), "car_type", "rows") for table in tables]
    finally:
        s.catalog.setCurrentDatabase(before)
    return io.bms_all(*parts).groupBy("name", "car_type").agg(F.count("*").alias("stored"), F.sum("rows").alias("rows"))


# ---------------------------------------------------------------- rules and reports

_SCALED = {"soc": "soc * 1.5 - 20", "soh": "soh * 1.1", "pack_volt": "pack_volt * 8", "pack_current": "pack_current * 12",
           "mod_avg_temp": "mod_avg_temp * 2", "max_cell_volt": "max_cell_volt * 200", "odometer": "CAST(event_id % 5 AS DOUBLE) * 500001"}


def _bms_rules(s, d):
    rows = X.bms(s, d).select("event_id", *[F.expr(text).alias(name) for name, text in _SCALED.items()])
    return clean.validate_ranges(rows, "bms")


def _listed(s, d):
    """Lists in two thirds of the values of one column, in a third of another's."""
    rows = X.bms(s, d).selectExpr(
        "CASE WHEN event_id % 3 > 0 THEN concat_ws('|', soc, soh, pack_volt) ELSE 'one' END AS cells",
        "CASE WHEN event_id % 3 = 0 THEN concat_ws(';', soc, pack_volt) ELSE 'one' END AS rare", "device_no")
    found = clean.detect_list_columns(rows)
    counts = rows.agg(*[F.count_if(F.col(name).contains(mark)).alias(name) for name, mark in found.items()])
    return counts.select(F.inline(F.array(*[
        F.struct(F.lit(name).alias("column_name"), F.lit(mark).alias("delimiter"), F.col(name).alias("lists")) for name, mark in found.items()])))


_LISTED = """SELECT column_name, delimiter, count(*) FILTER (contains(value, delimiter)) AS lists
  FROM (SELECT 'cells' AS column_name, CASE WHEN event_id % 3 > 0 THEN concat_ws('|', soc, soh, pack_volt) ELSE 'one' END AS value FROM bms
    UNION ALL SELECT 'rare', CASE WHEN event_id % 3 = 0 THEN concat_ws(';', soc, pack_volt) ELSE 'one' END FROM bms
    UNION ALL SELECT 'device_no', device_no FROM bms), (SELECT unnest([',', '|', ';']) AS delimiter)
  GROUP BY 1, 2 HAVING count(*) FILTER (contains(value, delimiter)) > 0.5 * count(value)"""


def _counts_dropped(s, d):
    rows = X.bms(s, d).select("event_id", F.array("soc", "soh").alias("cell_volt"), F.col("soc").alias("mod_temp_1"))
    counted = clean.add_family_counts(rows).where("cell_volt_count = 2 AND mod_temp_count = 1")
    return clean.drop_family_counts(counted).select("*", F.size("cell_volt").alias("cells")).drop("cell_volt")


def _reports(s, d):
    report = select.to_report(battery.range_counts(X.bms(s, d)), "device_no")
    layout = "device_no string, temp_cold long, temp_optimal long, temp_hot long, soc_low long, soc_medium long, soc_high long"
    return report.select(F.from_json("report", layout).alias("row"), "device_no").select(
        "device_no", (F.col("row.device_no") == F.col("device_no")).alias("named"), *[f"row.{name}" for name in ("temp_cold", "temp_hot", "soc_medium")])


def _extremes(s, d):
    rows = _series_rows(s, d).withColumns({
        name: F.lit(None).cast("double") for name in ("soc", "soh", "pack_volt", "pack_current", "odometer")})
    return battery.battery_summary(rows).select("device_no", "avg_temperature", "avg_temp_max", "avg_temp_min", "avg_temp_internal", "temp_deviation")


_SENTENCES = {
    "soh": ("SOH", "soh", "%"), "health": ("Health index", "composite_health_index", ""),
    "balance": ("Cell balance index", "cell_balance_index", "%"), "temp": ("Battery temperature", "mod_avg_temp", " C"),
}


def _sentence(kind: str, what: str, value: str, unit: str) -> str:
    gap = f"({value} - baseline_{kind})"
    return (f"WHEN anomaly_type = '{kind}_anomaly' THEN format('{what} is {{:.1f}}{unit} {{}} the type average of {{:.1f}}{unit}', "
            f"abs({gap}), CASE WHEN {gap} < 0 THEN 'below' ELSE 'above' END, baseline_{kind})")


_EXPLAINED = f"""SELECT device_no, anomaly_type, CASE {' '.join(_sentence(k, *v) for k, v in _SENTENCES.items())} END AS anomaly_description
  FROM zall WHERE anomaly_type <> 'normal'"""


def _step_seconds(s, d):
    rows = X.bms(s, d).select("event_id", "device_no", "msg_ts")
    stepped = sequence.lagged(sequence.sliced(rows, ["device_no"], "msg_ts", ["event_id"]), ["device_no"], ["msg_ts", "event_id"], {"before": "msg_ts"})
    return stepped.select("event_id", E.abs_diff_s("msg_ts", "before").alias("back"), E.abs_diff_s("before", "msg_ts").alias("forth"))


# ---------------------------------------------------------------- models and sketches


def _saved_model(s, d):
    """The seasonal model saved, loaded, and asked for the days of a month."""
    rows, place = X.bms_long(s, d), _place(s)
    forecast.save_model(forecast.fit_soh_seasonal(forecast.daily_soh(rows)), place)
    days = forecast.horizon_days("2024-06-01", "2024-07-01")
    return forecast.forecast_soh_seasonal(forecast.load_model(place), forecast.last_dates(rows), days)


def _holdout(s, d):
    train, test = energy.split_features(_features(s, d))
    errors = energy.holdout_errors(energy.train_energy_model(train, trees=20, depth=5), train, test)
    return errors.select("train_rows", "holdout_rows", "mean_error", (F.col("model_error") < 0.5 * F.col("mean_error")).alias("learned"))


_SPLIT = """SELECT *, CAST('0x' || left(md5(device_no || '|' || epoch_us(time)), 8) AS BIGINT) % 1000 >= 800 AS held FROM
  (SELECT time, device_no, pack_volt * pack_current / 1000 AS kw FROM bms_points WHERE soc IS NOT NULL AND soh IS NOT NULL)"""
_BMS_POINTS = """SELECT msg_ts AS time, device_no, car_type, avg(soc) AS soc, avg(soh) AS soh, avg(pack_volt) AS pack_volt, avg(pack_current) AS pack_current
  FROM bms GROUP BY ALL"""


def _sketched(s, d):
    """Distinct values per type from sketches of each day's file, beside the exact count."""
    rows = X.bms(s, d).withColumn("file", F.to_date("msg_ts"))
    sketches = quality.distinct_sketches(rows, ["soc", "event_id", "device_no"], by=["car_type", "file"])
    rolled = quality.rollup_distinct(sketches, ["car_type"])
    exact = quality.profile(rows, ["soc", "event_id", "device_no"], exact=True, by=["car_type"])
    both = rolled.join(exact.select("car_type", "column_name", F.col("unique_count").alias("exact")), ["car_type", "column_name"])
    return both.select("car_type", "column_name", "exact", (F.abs(F.col("unique_count") - F.col("exact")) <= 0.05 * F.col("exact")).alias("close"))


def _profile_approximate(s, d):
    found = quality.profile(X.bms(s, d), _PROFILED)
    exact = quality.profile(X.bms(s, d), _PROFILED, exact=True).select("column_name", F.col("unique_count").alias("exact"))
    return found.join(exact, "column_name").select(
        "column_name", "total_count", "null_count", "exact", (F.abs(F.col("unique_count") - F.col("exact")) <= 0.15 * F.col("exact")).alias("close"))


CHECKS = [
    check("clean_gps", _clean_gps, with_views(_CLEAN_GPS, "gps"), "lat lng"),
    check("read_gps_csv", lambda s, d: _gps_files(s, d).groupBy("car_type").agg(F.count("*").alias("rows"), F.count("lat").alias("with_lat"), F.count("_corrupt_record").alias("broken")),
          with_views("SELECT car_type, count(*) AS rows, count(*) FILTER (gps_id % 23 <> 0) AS with_lat, CAST(0 AS BIGINT) AS broken FROM gps GROUP BY 1", "gps")),
    check("read_bms_csv", _read_bms,
          with_views("""SELECT car_type, count(*) AS rows, count(*) FILTER (event_id % 7 <> 0 AND (event_id % 11 = 0 OR event_id % 13 = 0 OR soc IS NOT NULL)) AS with_soc,
  count(*) FILTER (event_id % 50 = 0) AS headers, count(DISTINCT event_id) AS ids FROM bms GROUP BY 1""", "bms")),
    check("ingest_batch", _ingest_batch, with_views(_CLEANED, "bms"), "pack_current soc"),
    check("write_telemetry", _written,
          with_views("SELECT event_id, device_no, car_type, msg_ts, soc, CAST(msg_ts AS DATE) AS day FROM bms WHERE msg_ts >= TIMESTAMP '2024-01-05 06:00:00' AND msg_ts < TIMESTAMP '2024-01-09'", "bms")),
    check("write_clustered", _clustered,
          with_views("""SELECT event_id, device_no, msg_ts, soc, CASE WHEN device_no IS NOT NULL AND msg_ts IS NOT NULL THEN lag(soc) OVER w END AS prev_soc,
  CASE WHEN device_no IS NOT NULL AND msg_ts IS NOT NULL THEN row_number() OVER w END AS n
FROM bms_gaps WINDOW w AS (PARTITION BY device_no, msg_ts IS NULL ORDER BY msg_ts, event_id)""", "bms_gaps")),
    check("write_profile", _profile_file, with_views(f"SELECT * FROM ({_PROFILE})", "bms"), "null_percentage min_val max_val"),
    check("profile_approximate", _profile_approximate, with_views(f"SELECT column_name, total_count, null_count, unique_count AS exact, TRUE AS close FROM ({_PROFILE})", "bms")),
    check("profile_sketches", _sketched,
          with_views(" UNION ALL ".join(f"SELECT car_type, '{c}' AS column_name, count(DISTINCT {c}) AS exact, TRUE AS close FROM bms GROUP BY 1" for c in ("soc", "event_id", "device_no")), "bms")),
    check("materialize", _materialized,
          with_views("""SELECT 'fleet_daily' AS name, car_type, count(DISTINCT CAST(msg_ts AS DATE)) AS stored, count(*) AS rows FROM bms GROUP BY 2
UNION ALL SELECT 'fleet_types', car_type, 1, count(*) FROM bms GROUP BY 2""", "bms")),
    check("validate_bms_rules", _bms_rules,
          with_views(f"SELECT event_id, {', '.join(_bounded(name, S.BMS_RULES, text) for name, text in _SCALED.items())} FROM bms", "bms"), " ".join(_SCALED)),
    check("detect_list_columns", _listed, with_views(_LISTED, "bms")),
    check("family_counts_dropped", _counts_dropped,
          with_views("SELECT event_id, soc AS mod_temp_1, CAST(2 AS INT) AS cells FROM bms WHERE soc IS NOT NULL AND soh IS NOT NULL", "bms")),
    check("to_report", _reports,
          with_views("""SELECT device_no, TRUE AS named, count(*) FILTER (mod_avg_temp < 15) AS temp_cold, count(*) FILTER (mod_avg_temp > 35) AS temp_hot,
  count(*) FILTER (soc >= 20 AND soc < 80) AS soc_medium FROM bms GROUP BY 1""", "bms")),
    check("battery_extremes", _extremes,
          with_views("""SELECT *, CASE WHEN avg_temp_max > 0 AND avg_temp_min > 0 THEN avg_temp_max - avg_temp_min END AS temp_deviation
FROM (SELECT device_no, avg(mod_avg_temp) AS avg_temperature, avg(mod_max_temp) AS avg_temp_max, avg(mod_min_temp) AS avg_temp_min,
  avg(batt_internal_temp) AS avg_temp_internal FROM rows GROUP BY 1)""", "bms_dense", rows=_SERIES), "avg_temperature avg_temp_max avg_temp_min avg_temp_internal temp_deviation"),
    check("explain_anomaly", lambda s, d: _zscores(s, d).select("device_no", "anomaly_type", "anomaly_description"),
          with_views(_EXPLAINED, "bms", **_Z_CTES)),
    check("step_seconds", _step_seconds,
          with_views("SELECT event_id, x AS back, x AS forth FROM (SELECT event_id, abs(epoch_us(msg_ts) - epoch_us(lag(msg_ts) OVER (PARTITION BY device_no ORDER BY msg_ts, event_id))) / 1000000.0 AS x FROM bms)", "bms"), "back forth"),
    check("saved_seasonal_model", _saved_model, _recursive(with_views("SELECT * FROM seasonal", "bms_long", **_SEASONAL))),
    check("energy_holdout", _holdout,
          with_views(f"""SELECT count(*) FILTER (NOT held) AS train_rows, count(*) FILTER (held) AS holdout_rows,
  {r('sqrt(avg((kw - mean) ** 2) FILTER (held))', 4)} AS mean_error, TRUE AS learned
FROM (SELECT *, avg(kw) FILTER (NOT held) OVER () AS mean FROM split)""", "bms", bms_points=_BMS_POINTS, split=_SPLIT), "mean_error", digits=4),
]

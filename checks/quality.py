"""Cleaning, profile and report queries with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from checks.base import check, with_views
from voltlake import fixtures as X
from voltlake.operators import clean, quality
from voltlake.session import shared_folder
from voltlake.sources import io
from voltlake.sources import points as P

_PROFILED = ("event_id", "soc", "soh", "pack_current", "mod_avg_temp", "chrg_cable_conn", "device_no")
_TYPES = {"event_id": "bigint", "chrg_cable_conn": "int", "device_no": "string"}


def _facts(name: str, by: str = "") -> str:
    text = name == "device_no"
    number = "CAST(NULL AS DOUBLE)" if text else f"CAST({name} AS DOUBLE)"
    return f"""SELECT {by}'{name}' AS column_name, '{_TYPES.get(name, 'double')}' AS dtype, count(*) AS total_count, count({name}) AS non_null_count, count(*) - count({name}) AS null_count,
  (count(*) - count({name})) * 100.0 / count(*) AS null_percentage, count(DISTINCT {name}) AS unique_count, count(*) - count(DISTINCT {name}) AS duplicate_count,
  min({number}) AS min_val, max({number}) AS max_val, count(*) FILTER ({number} = 0) AS zero_count, count(*) FILTER ({number} < 0) AS negative_count FROM bms"""


_PROFILE = "\nUNION ALL ".join(_facts(name) for name in _PROFILED)
_ROLL_COLUMNS = ("soc", "soh", "pack_current")
_FILES = "\nUNION ALL ".join(_facts(name, "car_type, CAST(msg_ts AS DATE) AS file, ") + " GROUP BY car_type, CAST(msg_ts AS DATE)" for name in _ROLL_COLUMNS)


def _profile(s, d):
    return quality.profile(X.bms(s, d), _PROFILED, exact=True)


def _rollup(s, d):
    rows = X.bms(s, d).withColumn("file", F.to_date("msg_ts")).select("car_type", "file", *_ROLL_COLUMNS)
    profiles = quality.profile(rows, _ROLL_COLUMNS, exact=True, by=["car_type", "file"])
    return quality.profile_rollup(profiles.withColumns({"kind": F.lit("bms"), "size_mb": F.lit(0.5)}))


def _problems(s, d):
    rows = X.bms(s, d)
    wide = rows.withColumns({"one": F.lit(7), "rare": F.when(F.col("event_id") % 3 == 0, F.col("soc"))})
    return quality.problem_columns(quality.profile(wide.select("one", "rare", "soc", "soh"), exact=True))


_RULES = {"soc": (10, 90), "pack_volt": (None, 480), "pack_current": (-50, 50), "mod_avg_temp": (-10, 60)}


def _texts(s, d):
    ts, e = F.col("ts"), F.col("event_id")
    text = (
        F.when(e % 6 == 0, F.date_format(ts, "yy-MM-dd HH:mm:ss")).when(e % 6 == 1, F.date_format(ts, "yy/MM/dd HH:mm:ss"))
        .when(e % 6 == 2, F.date_format(ts, "yyyy-MM-dd HH:mm:ss")).when(e % 6 == 3, F.date_format(ts, "yy.MM.dd HH:mm:ss"))
        .when(e % 6 == 4, "bad")
    )
    return X.table(s, d, "events").select("event_id", text.alias("text"))


def _raw(s, d):
    """Text rows as they arrive: padded, blank, out of range, repeated header."""
    e = F.col("event_id")
    return X.bms(s, d).select(
        F.when(e % 50 == 0, "device_no").otherwise(F.concat(F.lit(" "), "device_no")).alias("device_no"),
        "car_type", F.date_format("msg_ts", "yy-MM-dd HH:mm:ss").alias("msg_time"),
        F.when(e % 7 == 0, "").when(e % 11 == 0, "n/a").when(e % 13 == 0, "120.5").otherwise(F.col("soc").cast("string")).alias("soc"),
        F.col("pack_current").cast("string").alias("pack_current"), e.cast("string").alias("msg_id"),
    )


_RAW_COLUMNS = ("device_no", "car_type", "msg_time", "soc", "pack_current", "msg_id")
_CLEANED = """SELECT device_no, car_type, strftime(msg_ts, '%y-%m-%d %H:%M:%S') AS msg_time, CASE WHEN event_id % 7 = 0 OR event_id % 11 = 0 OR event_id % 13 = 0 THEN NULL ELSE soc END AS soc,
  pack_current, CAST(event_id AS DOUBLE) AS msg_id, date_trunc('second', msg_ts) AS msg_ts, CAST(msg_ts AS DATE) AS day FROM bms WHERE event_id % 50 <> 0"""


def _raw_files(s, d):
    """The raw rows as CSV files in a new shared folder, one subfolder per vehicle type."""
    place = f"{shared_folder(s)}/raw/{uuid.uuid4().hex}"
    rows = _raw(s, d).select(*_RAW_COLUMNS, F.col("car_type").alias("kind"))
    rows.write.partitionBy("kind").option("header", True).csv(f"{place}/in")
    return place


def _ingested(s, d):
    place = _raw_files(s, d)
    for _ in range(2):  # the second run finds no new file
        io.ingest_incremental(s, f"{place}/in", f"{place}/clean", f"{place}/state", "bms", _RAW_COLUMNS)
    return s.read.parquet(f"{place}/clean").withColumn("msg_ts", F.col("msg_ts").cast("timestamp_ntz"))


def _mixed_files(s, d):
    """Battery files below bms/ without the kind in their name, and position files below GPS/, in one folder."""
    place = f"{shared_folder(s)}/raw/{uuid.uuid4().hex}"
    rows = _raw(s, d).select(*_RAW_COLUMNS, F.col("car_type").alias("kind")).withColumn("car_type", F.lit(None).cast("string"))
    rows.write.partitionBy("kind").option("header", True).csv(f"{place}/in/bms")
    gps = X.gps(s, d).select(F.col("device_no"), F.date_format("time", "yy-MM-dd HH:mm:ss").alias("time"), "lat", "lng", F.col("car_type").alias("kind"))
    gps.write.partitionBy("kind").option("header", True).csv(f"{place}/in/deep/GPS")
    return place


_GPS_COLUMNS = ["device_no", "time", "lat", "lng"]


def _tree_bms(s, d):
    raw = io.read_tree(s, f"{_mixed_files(s, d)}/in", "bms", _RAW_COLUMNS)
    return raw.groupBy("car_type").agg(F.count("*").alias("rows"))


def _tree_gps(s, d):
    raw = io.read_tree(s, f"{_mixed_files(s, d)}/in", "gps", _GPS_COLUMNS)
    return raw.groupBy("car_type").agg(F.count("*").alias("rows"), F.count_distinct("device_no").alias("devices"))


def _ingested_mixed(s, d):
    place = _mixed_files(s, d)
    for _ in range(2):
        io.ingest_incremental(s, f"{place}/in", f"{place}/clean", f"{place}/state", "bms", _RAW_COLUMNS)
    return s.read.parquet(f"{place}/clean").withColumn("msg_ts", F.col("msg_ts").cast("timestamp_ntz"))


def _tree(s, d):
    raw = io.read_tree(s, f"{_mixed_files(s, d)}/in", "bms", _RAW_COLUMNS)
    return raw.groupBy(io.type_from_path("source_file").alias("path_type"), "car_type").agg(F.count("*").alias("rows"))


CHECKS = [
    check("ingest_incremental", _ingested, with_views(_CLEANED, "bms"), "pack_current soc"),
    check("ingest_tree_bms", _tree_bms, with_views("SELECT car_type, count(*) AS rows FROM bms GROUP BY 1", "bms")),
    check("ingest_tree_gps", _tree_gps, with_views("SELECT car_type, count(*) AS rows, count(DISTINCT device_no) AS devices FROM gps GROUP BY 1", "gps")),
    check("ingest_incremental_mixed", _ingested_mixed, with_views(_CLEANED, "bms"), "pack_current soc"),
    check("read_tree", _tree, with_views("SELECT car_type AS path_type, car_type, count(*) AS rows FROM bms GROUP BY 1, 2", "bms")),
    check("profile", _profile, with_views(f"SELECT * FROM ({_PROFILE})", "bms"), "null_percentage min_val max_val"),
    check("profile_rollup", _rollup,
          with_views("""SELECT car_type, 'bms' AS kind, column_name, count(DISTINCT file) AS files, CAST(sum(total_count) AS BIGINT) AS total_rows, sum(0.5::DOUBLE) AS size_mb, CAST(sum(null_count) AS BIGINT) AS null_count,
  min(min_val) AS min_val, max(max_val) AS max_val, avg(null_percentage) AS mean_null_percentage, CAST(sum(zero_count) AS BIGINT) AS zero_count, CAST(sum(negative_count) AS BIGINT) AS negative_count
FROM files GROUP BY 1, 3""", "bms", files=_FILES), "mean_null_percentage"),
    check("problem_columns", _problems,
          with_views("""SELECT * FROM (SELECT 'one' AS column_name, 'single_value' AS problem, CAST(0 AS DOUBLE) AS null_percentage, CAST(1 AS BIGINT) AS unique_count
  UNION ALL SELECT 'rare', 'mostly_null', (count(*) - count(x)) * 100.0 / count(*), count(DISTINCT x) FROM (SELECT CASE WHEN event_id % 3 = 0 THEN soc END AS x FROM bms))""", "bms"), "null_percentage"),
    check("null_report", lambda s, d: quality.null_report({"bms": X.bms(s, d), "gps": X.gps(s, d)}, ["device_no", "soc", "soh", "speed"]),
          with_views("""SELECT 'bms' AS table_name, count(*) AS row_count, count(*) - count(device_no) AS null_device_no, count(*) - count(soc) AS null_soc, count(*) - count(soh) AS null_soh, CAST(NULL AS BIGINT) AS null_speed FROM bms
  UNION ALL SELECT 'gps', count(*), count(*) - count(device_no), NULL, NULL, count(*) - count(speed) FROM gps""", "bms", "gps")),
    check("population_report", lambda s, d: quality.population_report({"bms": X.bms(s, d), "gps": X.gps(s, d), "orders": X.table(s, d, "orders")}),
          with_views("SELECT 'bms' AS table_name, count(*) AS row_count FROM bms UNION ALL SELECT 'gps', count(*) FROM gps UNION ALL SELECT 'orders', count(*) FROM orders", "bms", "gps")),
    check("time_coverage", lambda s, d: quality.time_coverage({"bms": (X.bms(s, d), "msg_ts"), "gps": (X.gps(s, d), "time")}),
          with_views("SELECT 'bms' AS table_name, min(msg_ts) AS first_time, max(msg_ts) AS last_time, count(DISTINCT CAST(msg_ts AS DATE)) AS days FROM bms UNION ALL SELECT 'gps', min(time), max(time), count(DISTINCT CAST(time AS DATE)) FROM gps", "bms", "gps")),
    check("validate_ranges", lambda s, d: clean.validate_ranges(X.bms(s, d).select("event_id", *_RULES), "bms", _RULES),
          with_views("SELECT event_id, CASE WHEN soc BETWEEN 10 AND 90 THEN soc END AS soc, CASE WHEN pack_volt <= 480 THEN pack_volt END AS pack_volt, CASE WHEN pack_current BETWEEN -50 AND 50 THEN pack_current END AS pack_current, CASE WHEN mod_avg_temp BETWEEN -10 AND 60 THEN mod_avg_temp END AS mod_avg_temp FROM bms", "bms")),
    check("fix_year", lambda s, d: _texts(s, d).select("event_id", clean.fix_year("text").cast("timestamp_ntz").alias("fixed")),
          "SELECT event_id, CASE WHEN event_id % 6 < 4 THEN date_trunc('second', ts) END AS fixed FROM events"),
    check("clean_bms", lambda s, d: clean.clean_bms(_raw(s, d)).withColumn("msg_ts", F.col("msg_ts").cast("timestamp_ntz")),
          with_views(_CLEANED, "bms"), "pack_current soc"),
    check("expand_list", lambda s, d: clean.expand_list(
        X.bms(s, d).select("event_id", F.concat_ws("|", "soc", "soh", "pack_volt").alias("cells")), "cells", "|", 3),
          with_views("""SELECT event_id, cells[1] AS cells_1, cells[2] AS cells_2, cells[3] AS cells_3 FROM (SELECT event_id, string_split(concat_ws('|', soc, soh, pack_volt), '|') AS cells FROM bms)""", "bms")),
    check("expand_list_wide", lambda s, d: clean.expand_list(
        X.bms(s, d).select("event_id", F.concat_ws("|", "event_id", "soc", "soh", "pack_volt").alias("cells")), "cells", "|", 2),
          with_views("""SELECT event_id, cells[1] AS cells_1, cells[2] AS cells_2, cells[3] AS cells_3, cells[4] AS cells_4 FROM (SELECT event_id, string_split(concat_ws('|', event_id, soc, soh, pack_volt), '|') AS cells FROM bms)""", "bms")),
    check("family_counts", lambda s, d: clean.add_family_counts(X.bms(s, d).select(
        "event_id", F.array("soc", "soh", "pack_volt").alias("cell_volt"), F.col("soc").alias("mod_temp_1"), F.col("mod_avg_temp").alias("mod_temp_2"),
    )).select("event_id", "cell_volt_count", "mod_temp_count"),
          with_views("SELECT event_id, CAST(1 + (soc IS NOT NULL)::INT + (soh IS NOT NULL)::INT AS INT) AS cell_volt_count, CAST(1 + (soc IS NOT NULL)::INT AS INT) AS mod_temp_count FROM bms", "bms")),
    check("dedupe", lambda s, d: clean.dedupe(X.bms(s, d).select("device_no", "msg_ts").unionByName(X.bms(s, d).select("device_no", "msg_ts")), ["device_no", "msg_ts"]),
          with_views("SELECT DISTINCT device_no, msg_ts FROM bms", "bms")),
    check("to_points", lambda s, d: X.points(s, d), with_views("SELECT * FROM points", "points"), "value"),
    check("pivot_points", lambda s, d: P.pivot_points(X.points(s, d), ["soc", "soh", "pack_volt"]),
          with_views("SELECT time, device_no, car_type, avg(value) FILTER (field = 'soc') AS soc, avg(value) FILTER (field = 'soh') AS soh, avg(value) FILTER (field = 'pack_volt') AS pack_volt FROM points WHERE field IN ('soc', 'soh', 'pack_volt') GROUP BY 1, 2, 3", "points")),
    check("scan_points", lambda s, d: P.scan_points(X.points(s, d), "bms", ["soc", "soh"], "2024-01-10 00:00:00", "2024-01-20 00:00:00", "gv60"),
          with_views("SELECT * FROM points WHERE measurement = 'bms' AND field IN ('soc', 'soh') AND time >= TIMESTAMP '2024-01-10' AND time < TIMESTAMP '2024-01-20' AND car_type = 'GV60'", "points")),
]

"""Telemetry-shaped views over the ``events`` table, used by the registered queries and tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voltlake.operators.sequence import running, settled, sliced, unsliced
from voltlake.schema import CAR_TYPES, POINT_FIELDS

BMS_COLUMNS = (
    "event_id", "device_no", "car_type", "msg_ts", "soc", "soh", "pack_volt", "pack_current",
    "mod_avg_temp", "min_cell_volt", "max_cell_volt", "odometer", "chrg_cable_conn",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _car_type() -> Column:
    kind = F.col("user_id") % 3
    return F.when(kind == 0, CAR_TYPES[0]).when(kind == 1, CAR_TYPES[1]).otherwise(CAR_TYPES[2])


_ODOMETERS: dict[tuple[str, str], DataFrame] = {}


def _with_odometer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with the running odometer, settled once per session and input, as loaded telemetry would be."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _ODOMETERS:
        e = F.col("event_id")
        step = F.when(e % 211 == 0, -1000).when(e % 29 == 0, -20).otherwise(e % 23)
        rows = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
        placed = sliced(rows, ["user_id"], "ts", ["event_id"])
        _ODOMETERS[key] = settled(unsliced(running(placed, ["user_id"], ["ts", "event_id"], sums={"_odo": step})))
    return _ODOMETERS[key]


def bms(spark: SparkSession, sf_dir: str, odometer: bool = False, shift: str = "plain") -> DataFrame:
    """Battery rows; ``shift`` spreads the times: plain, dense (24 h) or long (12 months)."""
    return bms_of(_with_odometer(spark, sf_dir) if odometer else table(spark, sf_dir, "events"), shift)


def bms_of(events: DataFrame, shift: str = "plain") -> DataFrame:
    """Battery rows of a batch or stream of events; an odometer column only where the events carry one."""
    e = F.col("event_id")
    ts = {
        "plain": F.col("ts"),
        "dense": F.expr(
            "TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, "
            "timestampdiff(SECOND, TIMESTAMP_NTZ '2024-01-01 00:00:00', ts) div 30)"
        ),
        "long": F.expr("ts + make_ym_interval(0, cast(event_id % 12 as int))"),
    }[shift]
    columns = [
        "event_id",
        F.col("user_id").cast("string").alias("device_no"),
        _car_type().alias("car_type"),
        ts.alias("msg_ts"),
        F.when(e % 97 != 0, ((e * 53) % 1001).cast("double") / 10).alias("soc"),
        F.when(e % 89 != 0, 60 + ((e * 37) % 401).cast("double") / 10).alias("soh"),
        (250 + (e * 13) % 251).cast("double").alias("pack_volt"),
        (((e * 29) % 1201).cast("double") / 10 - 60).alias("pack_current"),
        ((e * 7) % 80 - 15).cast("double").alias("mod_avg_temp"),
        (3 + (e % 50).cast("double") / 100).alias("min_cell_volt"),
        (3 + (e % 50).cast("double") / 100 + ((e * 11) % 1500).cast("double") / 100).alias("max_cell_volt"),
        F.when(e % 31 != 0, (e % 2).cast("int")).alias("chrg_cable_conn"),
    ]
    if "_odo" in events.columns:
        columns.append((F.col("_odo").cast("double") / 10).alias("odometer"))
    return events.select(*columns)


def bms_dense(spark: SparkSession, sf_dir: str, odometer: bool = False) -> DataFrame:
    return bms(spark, sf_dir, odometer, "dense")


def bms_long(spark: SparkSession, sf_dir: str, odometer: bool = False) -> DataFrame:
    return bms(spark, sf_dir, odometer, "long")


def bms_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Battery rows of a feed that at times lacks device, type or time."""
    e = F.col("event_id")
    return bms(spark, sf_dir).withColumns({
        "device_no": F.when(e % 37 != 0, F.col("device_no")), "car_type": F.when(e % 41 != 0, F.col("car_type")),
        "msg_ts": F.when(e % 43 != 0, F.col("msg_ts")),
    })


def gps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gps_of(table(spark, sf_dir, "events"))


def gps_of(events: DataFrame) -> DataFrame:
    e = F.col("event_id")
    return events.where(e % 5 != 0).select(
        e.alias("gps_id"),
        F.col("user_id").cast("string").alias("device_no"),
        _car_type().alias("car_type"),
        F.expr("ts + make_dt_interval(0, 0, 0, (event_id * 17) % 181 - 90)").alias("time"),
        (33 + (e % 500).cast("double") / 100).alias("lat"),
        (126 + (e % 300).cast("double") / 100).alias("lng"),
        ((e * 3) % 120).cast("double").alias("speed"),
        (e % 101).cast("double").alias("fuel_pct"),
    )


def points(spark: SparkSession, sf_dir: str, shift: str = "plain") -> DataFrame:
    from voltlake.sources.points import to_points

    return to_points(bms(spark, sf_dir, odometer=True, shift=shift), POINT_FIELDS, "msg_ts", extra=("event_id",))


# ---------------------------------------------------------------- the same views as DuckDB text

_TYPE_SQL = "CASE user_id % 3 WHEN 0 THEN 'BONGO3' WHEN 1 THEN 'GV60' ELSE 'PORTER2' END AS car_type"

_DENSE_TS = (
    "TIMESTAMP '2024-01-01 00:00:00' + to_seconds(date_diff('second', "
    "TIMESTAMP '2024-01-01 00:00:00', msg_ts) // 30)"
)

VIEWS = {
    "bms": f"""
  SELECT event_id, CAST(user_id AS VARCHAR) AS device_no, {_TYPE_SQL}, ts AS msg_ts,
    CASE WHEN event_id % 97 = 0 THEN NULL ELSE CAST((event_id * 53) % 1001 AS DOUBLE) / 10 END AS soc,
    CASE WHEN event_id % 89 = 0 THEN NULL ELSE 60 + CAST((event_id * 37) % 401 AS DOUBLE) / 10 END AS soh,
    CAST(250 + (event_id * 13) % 251 AS DOUBLE) AS pack_volt,
    CAST((event_id * 29) % 1201 AS DOUBLE) / 10 - 60 AS pack_current,
    CAST((event_id * 7) % 80 - 15 AS DOUBLE) AS mod_avg_temp,
    3 + CAST(event_id % 50 AS DOUBLE) / 100 AS min_cell_volt,
    3 + CAST(event_id % 50 AS DOUBLE) / 100 + CAST((event_id * 11) % 1500 AS DOUBLE) / 100 AS max_cell_volt,
    CAST(SUM(CASE WHEN event_id % 211 = 0 THEN -1000 WHEN event_id % 29 = 0 THEN -20 ELSE event_id % 23 END)
      OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) / 10 AS odometer,
    CASE WHEN event_id % 31 = 0 THEN NULL ELSE CAST(event_id % 2 AS INT) END AS chrg_cable_conn
  FROM events""",
    "bms_dense": f"""
  SELECT * REPLACE ({_DENSE_TS} AS msg_ts) FROM bms""",
    "bms_long": """
  SELECT * REPLACE (msg_ts + to_months(CAST(event_id % 12 AS INT)) AS msg_ts) FROM bms""",
    "bms_gaps": """
  SELECT * REPLACE (CASE WHEN event_id % 37 <> 0 THEN device_no END AS device_no,
    CASE WHEN event_id % 41 <> 0 THEN car_type END AS car_type, CASE WHEN event_id % 43 <> 0 THEN msg_ts END AS msg_ts) FROM bms""",
    "gps": f"""
  SELECT event_id AS gps_id, CAST(user_id AS VARCHAR) AS device_no, {_TYPE_SQL},
    ts + to_seconds((event_id * 17) % 181 - 90) AS time,
    33 + CAST(event_id % 500 AS DOUBLE) / 100 AS lat, 126 + CAST(event_id % 300 AS DOUBLE) / 100 AS lng,
    CAST((event_id * 3) % 120 AS DOUBLE) AS speed, CAST(event_id % 101 AS DOUBLE) AS fuel_pct
  FROM events WHERE event_id % 5 <> 0""",
    "points": "\n  UNION ALL ".join(
        f"SELECT event_id, 'bms' AS measurement, device_no, car_type, msg_ts AS time, "
        f"'{field}' AS field, {field} AS value FROM bms WHERE {field} IS NOT NULL"
        for field in POINT_FIELDS
    ),
}
_NEEDS = {"bms_dense": ("bms",), "bms_gaps": ("bms",), "bms_long": ("bms",), "points": ("bms",)}


def with_views(body: str, *names: str, **extra: str) -> str:
    """SQL text: the named fixture views and extra CTEs in front of a query."""
    wanted: list[str] = []
    for name in names:
        wanted += [n for n in (*_NEEDS.get(name, ()), name) if n not in wanted]
    ctes = [f"{name} AS ({VIEWS[name]})" for name in wanted]
    ctes += [f"{name} AS ({text})" for name, text in extra.items()]
    return f"WITH {',\n'.join(ctes)}\n{body}"

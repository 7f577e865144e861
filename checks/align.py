"""Alignment, filter and paging operators on their own, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import AS_OF, check, near, r, with_views
from voltlake import fixtures as X
from voltlake.functions import expr as E
from voltlake.operators import align
from voltlake.operators import select as D
from voltlake.plans import fleet
from voltlake.sources import io

_KEYS = ["car_type", "device_no"]
_SPANS = "SELECT event_id AS span, device_no, msg_ts AS start_time, msg_ts + to_seconds(event_id % 7200) AS end_time FROM bms_dense"


def _narrow(s, d):
    return X.bms(s, d).select("event_id", *_KEYS, "msg_ts", "soc")


def _few(s, d):
    """A few battery rows, half of them of one device at one moment."""
    hot = F.col("event_id") % 100 == 0
    return X.bms(s, d).where(F.col("event_id") % 50 == 0).select(
        "event_id", F.when(hot, "hot").otherwise(F.col("device_no")).alias("device_no"),
        F.when(hot, F.lit("2024-01-10 00:00:00").cast("timestamp_ntz")).otherwise(F.col("msg_ts")).alias("msg_ts"),
    )


def _crowd(s, d):
    """All positions, and once more as positions of that device around that moment."""
    rows = X.gps(s, d).select("gps_id", "device_no", "time")
    moved = F.expr("TIMESTAMP_NTZ '2024-01-10 00:00:00' + make_dt_interval(0, 0, 0, gps_id % 200)")
    return rows.unionByName(rows.select("gps_id", F.lit("hot").alias("device_no"), moved.alias("time")))


def _mean_within(s, d):
    rows = X.bms_dense(s, d)
    spans = rows.select(
        F.col("event_id").alias("span"), "device_no", F.col("msg_ts").alias("start_time"),
        F.expr("msg_ts + make_dt_interval(0, 0, 0, event_id % 7200)").alias("end_time"),
    )
    return align.mean_within(spans, rows.select("device_no", "msg_ts", "soc", "pack_volt"), ["device_no"], ["span"], "start_time", "end_time", "msg_ts", ["soc", "pack_volt"], pad_s=60)


def _lineitem_page(s, d):
    rows = X.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    keyed = rows.withColumn("line", F.format_string("%012d-%d", "l_orderkey", "l_linenumber"))
    return D.paginate_rn(keyed, "l_extendedprice", "line", 40, 100)


_LABELS = {"charging": "Charging", "discharging": "Driving"}


def _scalars(s, d):
    return X.bms(s, d).select(
        "event_id", E.operation_mode().alias("mode"), E.label(E.operation_mode(), _LABELS).alias("mode_label"),
        E.season("msg_ts").alias("season"), E.season("msg_ts", "quarter").alias("season_q"), E.day_part("msg_ts").alias("part"),
        E.month_key("msg_ts").alias("month"), E.format_duration(F.col("event_id") * 7).alias("duration"),
        E.power_kw().alias("power_kw"), E.cell_balance_index(0.0).alias("idx"), E.driving_mode("mod_avg_temp", "above").alias("band"),
        E.pct_change("soc", "soh").alias("change"), E.encode_type().alias("type_code"), E.letter_grade("soh").alias("grade"),
        *[x.alias(f"cal_{n}") for n, x in zip(("hour", "dow", "month", "season"), E.calendar_features("msg_ts"))],
    )


_W = "(event_id * 7)"

CHECKS = [
    check("nearest_join", lambda s, d: align.nearest_join(_narrow(s, d), X.gps(s, d), _KEYS, "msg_ts", "time", "event_id", "gps_id", ["gps_id", "time", "speed"]),
          with_views(f"SELECT b.event_id, b.car_type, b.device_no, b.msg_ts, b.soc, g.gps_id, g.time, g.speed FROM bms b {near('gps_id time speed')}", "bms", "gps")),
    check("nearest_join_nulls", lambda s, d: align.nearest_join(X.bms_gaps(s, d).select("event_id", *_KEYS, "msg_ts", "soc"), X.gps(s, d), _KEYS, "msg_ts", "time", "event_id", "gps_id", ["gps_id", "time", "speed"]),
          with_views(f"SELECT b.event_id, b.car_type, b.device_no, b.msg_ts, b.soc, g.gps_id, g.time, g.speed FROM bms_gaps b {near('gps_id time speed')}", "bms_gaps", "gps")),
    check("nearest_join_split", lambda s, d: align.nearest_join(_narrow(s, d), X.gps(s, d), _KEYS, "msg_ts", "time", "event_id", "gps_id", ["gps_id", "time", "speed"], rows_per_slice=128),
          with_views(f"SELECT b.event_id, b.car_type, b.device_no, b.msg_ts, b.soc, g.gps_id, g.time, g.speed FROM bms b {near('gps_id time speed')}", "bms", "gps")),
    check("interval_join", lambda s, d: align.interval_join(_narrow(s, d), X.gps(s, d), ["device_no"], "msg_ts", "time", 300, ["gps_id"], closed=True),
          with_views("SELECT b.event_id, b.car_type, b.device_no, b.msg_ts, b.soc, g.gps_id FROM bms b LEFT JOIN gps g ON g.device_no = b.device_no AND abs(epoch_us(b.msg_ts) - epoch_us(g.time)) <= 300000000", "bms", "gps")),
    check("interval_join_hot", lambda s, d: align.interval_join(_few(s, d), _crowd(s, d), ["device_no"], "msg_ts", "time", 300, ["gps_id"], closed=True, how="inner", rows_per_task=50),
          with_views("""SELECT b.event_id, CASE WHEN b.event_id % 100 = 0 THEN 'hot' ELSE b.device_no END AS device_no,
  CASE WHEN b.event_id % 100 = 0 THEN TIMESTAMP '2024-01-10 00:00:00' ELSE b.msg_ts END AS msg_ts, g.gps_id FROM (SELECT event_id, device_no, msg_ts FROM bms WHERE event_id % 50 = 0) b
  JOIN (SELECT gps_id, 'hot' AS device_no, TIMESTAMP '2024-01-10 00:00:00' + to_seconds(gps_id % 200) AS time FROM gps
    UNION ALL SELECT gps_id, device_no, time FROM gps) g ON g.device_no = CASE WHEN b.event_id % 100 = 0 THEN 'hot' ELSE b.device_no END
  AND abs(epoch_us(CASE WHEN b.event_id % 100 = 0 THEN TIMESTAMP '2024-01-10 00:00:00' ELSE b.msg_ts END) - epoch_us(g.time)) <= 300000000""", "bms", "gps")),
    check("interval_join_hot_left", lambda s, d: align.interval_join(_few(s, d), _crowd(s, d).where("gps_id % 200 between 60 and 90"), ["device_no"], "msg_ts", "time", 75, ["gps_id"], rows_per_task=50),
          with_views("""SELECT b.event_id, b.device_no, b.msg_ts, g.gps_id
  FROM (SELECT event_id, CASE WHEN event_id % 100 = 0 THEN 'hot' ELSE device_no END AS device_no,
    CASE WHEN event_id % 100 = 0 THEN TIMESTAMP '2024-01-10 00:00:00' ELSE msg_ts END AS msg_ts FROM bms WHERE event_id % 50 = 0) b
  LEFT JOIN (SELECT gps_id, 'hot' AS device_no, TIMESTAMP '2024-01-10 00:00:00' + to_seconds(gps_id % 200) AS time FROM gps WHERE gps_id % 200 BETWEEN 60 AND 90
    UNION ALL SELECT gps_id, device_no, time FROM gps WHERE gps_id % 200 BETWEEN 60 AND 90) g
  ON g.device_no = b.device_no AND abs(epoch_us(b.msg_ts) - epoch_us(g.time)) < 75000000""", "bms", "gps")),
    check("mean_within", _mean_within,
          with_views("""SELECT s.span, s.device_no, s.start_time, s.end_time, avg(b.soc) AS mean_soc, avg(b.pack_volt) AS mean_pack_volt FROM spans s JOIN bms_dense b ON b.device_no = s.device_no
  AND b.msg_ts BETWEEN s.start_time - INTERVAL 60 SECOND AND s.end_time + INTERVAL 60 SECOND GROUP BY 1, 2, 3, 4""", "bms_dense", spans=_SPANS), "mean_soc mean_pack_volt"),
    check("with_group_max", lambda s, d: align.with_group_max(_narrow(s, d), "car_type", "msg_ts", "base_ts"),
          with_views("SELECT event_id, car_type, device_no, msg_ts, soc, max(msg_ts) OVER (PARTITION BY car_type) AS base_ts FROM bms", "bms")),
    check("nearest_value", lambda s, d: align.nearest_value(X.bms_dense(s, d).select("event_id", "device_no", "msg_ts", "soc"), ["device_no"], "msg_ts", "event_id", ["soc"], 600),
          with_views("""SELECT b.event_id, b.device_no, b.msg_ts, b.soc, n.soc AS near_soc FROM bms_dense b LEFT JOIN LATERAL (SELECT p.soc FROM bms_dense p WHERE p.device_no = b.device_no AND p.soc IS NOT NULL
  AND abs(epoch_us(b.msg_ts) - epoch_us(p.msg_ts)) <= 600000000 ORDER BY abs(epoch_us(b.msg_ts) - epoch_us(p.msg_ts)), (p.msg_ts, p.event_id) > (b.msg_ts, b.event_id),
  CASE WHEN (p.msg_ts, p.event_id) > (b.msg_ts, b.event_id) THEN p.event_id ELSE -p.event_id END LIMIT 1) n ON TRUE""", "bms_dense")),
    check("filters", lambda s, d: D.in_month(D.last_interval(D.where_opt(X.bms(s, d), car_type="GV60", chrg_cable_conn=1, soc=None), "msg_ts", AS_OF, 7), "msg_ts", "2024-01").select("event_id", "soc"),
          with_views("SELECT event_id, soc FROM bms WHERE car_type = 'GV60' AND chrg_cable_conn = 1 AND msg_ts >= TIMESTAMP '2024-01-24' AND strftime(msg_ts, '%Y-%m') = '2024-01'", "bms")),
    check("between_time", lambda s, d: D.between_time(X.bms(s, d), "msg_ts", "2024-01-05 00:00:00", "2024-01-06 12:00:00").select("event_id", "msg_ts"),
          with_views("SELECT event_id, msg_ts FROM bms WHERE msg_ts >= TIMESTAMP '2024-01-05' AND msg_ts < TIMESTAMP '2024-01-06 12:00:00'", "bms")),
    check("fresh_only", lambda s, d: io.fresh_only(X.bms(s, d).select("event_id", "msg_ts"), "msg_ts", "2024-01-30 12:00:00", 86400),
          with_views("SELECT event_id, msg_ts FROM bms WHERE msg_ts >= TIMESTAMP '2024-01-29 12:00:00'", "bms")),
    check("head_per_key", lambda s, d: D.head_per_key(X.bms(s, d).select("event_id", "device_no", "msg_ts", "soc"), ["device_no"], [F.col("msg_ts").desc(), F.col("event_id").desc()], 5),
          with_views("SELECT event_id, device_no, msg_ts, soc FROM bms QUALIFY row_number() OVER (PARTITION BY device_no ORDER BY msg_ts DESC, event_id DESC) <= 5", "bms")),
    check("latest_rows", lambda s, d: D.latest_rows(X.bms(s, d).select("event_id", "device_no", "msg_ts", "soc", "soh"), ["device_no"], "msg_ts", "event_id"),
          with_views("SELECT event_id, device_no, msg_ts, soc, soh FROM bms QUALIFY row_number() OVER (PARTITION BY device_no ORDER BY msg_ts DESC, event_id DESC) = 1", "bms")),
    check("paginate", lambda s, d: D.paginate(X.table(s, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey", "desc", 3, 50),
          "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 100"),
    check("paginate_rn_ascending", lambda s, d: D.paginate_rn(X.bms(s, d).select("event_id", "soc"), "soc", "event_id", 3, 50, order="asc", ranges=7),
          with_views("SELECT * FROM (SELECT event_id, soc, row_number() OVER (ORDER BY soc NULLS LAST, event_id) AS row_num FROM bms) WHERE row_num BETWEEN 101 AND 150", "bms")),
    check("paginate_after", lambda s, d: D.paginate_after(X.bms(s, d).select("event_id", "soc"), "soc", "event_id", (52.3, 1931), "asc", 70),
          with_views("SELECT event_id, soc FROM bms WHERE soc IS NULL OR (soc, event_id) > (52.3, 1931) ORDER BY soc NULLS LAST, event_id LIMIT 70", "bms")),
    check("paginate_rn", _lineitem_page,
          "SELECT * FROM (SELECT l_orderkey, l_linenumber, l_extendedprice, format('{:012d}-{}', l_orderkey, l_linenumber) AS line, row_number() OVER (ORDER BY l_extendedprice DESC, format('{:012d}-{}', l_orderkey, l_linenumber)) AS row_num FROM lineitem) WHERE row_num BETWEEN 3901 AND 4000"),
    check("order_by_labels", lambda s, d: D.order_by_labels(X.bms(s, d).groupBy(E.operation_mode().alias("mode")).agg(F.count("*").alias("n")), "mode", ["charging", "idle"]),
          with_views("SELECT CASE WHEN pack_current > 0 THEN 'charging' WHEN pack_current < 0 THEN 'discharging' ELSE 'idle' END AS mode, count(*) AS n FROM bms GROUP BY 1", "bms")),
    check("union_all", lambda s, d: io.bms_all(*[D.where_opt(X.bms(s, d), car_type=t).select("event_id", "car_type", "soc") for t in ("BONGO3", "GV60", "PORTER2")]),
          with_views("SELECT event_id, car_type, soc FROM bms", "bms")),
    check("scalar_rules", _scalars,
          with_views(f"""SELECT event_id, CASE WHEN pack_current > 0 THEN 'charging' WHEN pack_current < 0 THEN 'discharging' ELSE 'idle' END AS mode,
  CASE WHEN pack_current > 0 THEN 'Charging' WHEN pack_current < 0 THEN 'Driving' ELSE 'idle' END AS mode_label, 'winter' AS season, 'spring' AS season_q,
  CASE WHEN hour(msg_ts) < 6 THEN 'night' WHEN hour(msg_ts) < 12 THEN 'morning' WHEN hour(msg_ts) < 18 THEN 'afternoon' ELSE 'evening' END AS part,
  strftime(msg_ts, '%Y-%m') AS month, CASE WHEN {_W} // 3600 > 0 THEN ({_W} // 3600) || 'h ' || ({_W} % 3600 // 60) || 'm ' || ({_W} % 60) || 's'
    WHEN {_W} % 3600 // 60 > 0 THEN ({_W} % 3600 // 60) || 'm ' || ({_W} % 60) || 's' ELSE ({_W} % 60) || 's' END AS duration,
  pack_volt * pack_current / 1000 AS power_kw, (max_cell_volt - min_cell_volt) / pack_volt * 100 AS idx,
  CASE WHEN mod_avg_temp > 80 THEN 'highway' WHEN mod_avg_temp > 40 THEN 'urban_highway' WHEN mod_avg_temp > 20 THEN 'urban' WHEN mod_avg_temp > 5 THEN 'slow_urban' ELSE 'stationary' END AS band,
  CASE WHEN soh > 0 THEN (soc - soh) / soh * 100 ELSE 0 END AS change, CAST(CASE car_type WHEN 'BONGO3' THEN 0 WHEN 'GV60' THEN 1 ELSE 2 END AS INT) AS type_code,
  CASE WHEN soh IS NULL THEN NULL WHEN soh >= 95 THEN 'A' WHEN soh >= 85 THEN 'B' WHEN soh >= 70 THEN 'C' ELSE 'D' END AS grade,
  CAST(hour(msg_ts) AS INT) AS cal_hour, CAST(isodow(msg_ts) - 1 AS INT) AS cal_dow, CAST(month(msg_ts) AS INT) AS cal_month, CAST(0 AS INT) AS cal_season FROM bms""", "bms"),
          "power_kw idx change"),
    check("exact_total", lambda s, d: fleet.fleet_dashboard(X.bms(s, d), X.gps(s, d), exact_total=True).select("car_type", "total_vehicles", "avg_soc"),
          with_views(f"""SELECT coalesce(car_type, 'TOTAL') AS car_type, count(*) AS total_vehicles, {r('avg(soc)', 2)} AS avg_soc FROM (SELECT * FROM bms WHERE soc IS NOT NULL AND soh IS NOT NULL AND pack_volt > 0
  QUALIFY row_number() OVER (PARTITION BY car_type, device_no ORDER BY msg_ts DESC, event_id DESC) = 1) GROUP BY ROLLUP (car_type)""", "bms")),
]

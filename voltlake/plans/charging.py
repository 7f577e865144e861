"""Charging sessions by SOC and by current, and what is counted over them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltlake import schema as S
from voltlake.functions import expr as E
from voltlake.functions.expr import rounded
from voltlake.operators.align import mean_within, nearest_value
from voltlake.operators.select import last_interval
from voltlake.operators.sequence import BUCKET, PART, in_sequence, lagged, running, settled, sliced, unsliced
from voltlake.plans.battery import with_position

DEVICE = ["device_no"]


def charging_patterns(bms: DataFrame, gps: DataFrame, fan_out: bool = False, row_id: str = "event_id") -> DataFrame:
    rows = bms.where(F.col("pack_current").isNotNull()).select(
        row_id, "device_no", "car_type", "msg_ts", "soc", "pack_current", "pack_volt",
        E.operation_mode().alias("charging_status"),
    )
    return with_position(rows, gps, fan_out, row_id=row_id)


def charging_by_hour(bms: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    rows = last_interval(bms.where(F.col("pack_current").isNotNull()), "msg_ts", as_of, days)
    on = F.col("pack_current") > 0
    return rows.groupBy(F.hour("msg_ts").alias("hour")).agg(
        F.count_if(on).alias("charging_rows"),
        F.avg(F.when(on, F.col("pack_current"))).alias("avg_charging_current"),
        F.avg(F.when(on, F.col("soc"))).alias("avg_charging_soc"),
    )


def charging_sessions_by_current(
    bms: DataFrame, gps: DataFrame, threshold: float = S.CROSSING_CURRENT,
    row_id: str = "event_id", gps_id: str = "gps_id",
) -> DataFrame:
    """Sessions from the current rising to the threshold until it falls below; open ones keep no end.

    Rows without device or time are in no session.
    """
    order = ["msg_ts", row_id]
    rows = in_sequence(bms, "pack_current", "device_no", "msg_ts").select(
        row_id, "device_no", "car_type", "msg_ts", "soc", "pack_current", "mod_avg_temp", E.power_w().alias("power_w"),
    )
    stepped = lagged(sliced(rows, DEVICE, "msg_ts", [row_id]), DEVICE, order, {"_prev": "pack_current"})
    now, before = F.col("pack_current"), F.col("_prev")
    marked = stepped.withColumns({
        "_start": F.coalesce((now >= threshold) & (before < threshold), F.lit(False)),
        "_end": F.coalesce((now < threshold) & (before >= threshold), F.lit(False)),
    })
    inside = settled(marked.where((now >= threshold) | F.col("_end")))
    numbered = unsliced(running(inside, DEVICE, order, sums={"session_id": F.col("_start").cast("int")}))
    placed = with_position(numbered, gps, False, take=["speed", "fuel_pct"], row_id=row_id, gps_id=gps_id)
    folded = placed.where(F.col("session_id") > 0).groupBy("device_no", "car_type", "session_id").agg(
        F.min(F.when(F.col("_start"), F.col("msg_ts"))).alias("charge_start_time"),
        F.max(F.when(F.col("_end"), F.col("msg_ts"))).alias("charge_end_time"),
        F.min(F.when(F.col("_start"), F.col("soc"))).alias("start_soc"),
        F.max(F.when(F.col("_end"), F.col("soc"))).alias("end_soc"),
        F.avg("power_w").alias("avg_charging_power"), F.avg("mod_avg_temp").alias("avg_charging_temp"),
        F.avg("speed").alias("avg_speed"), F.avg("fuel_pct").alias("avg_fuel_pct"),
    )
    hours = E.seconds_between("charge_start_time", "charge_end_time") / 3600
    gain = F.col("end_soc") - F.col("start_soc")
    return folded.withColumns({
        "charging_hours": hours,
        "soc_per_hour": F.when(gain > 0, rounded(E.safe_div(gain, hours), 2)).otherwise(0.0),
    })


def charging_sessions(bms: DataFrame, row_id: str = "event_id") -> DataFrame:
    """Sessions of rising SOC that begin under current and end with the next fall.

    Between two falls the first rise under current opens the session and every rise after it belongs to
    it.  A session without a closing fall is not reported; rows without device or time are in none.
    """
    order = ["msg_ts", row_id]
    rows = in_sequence(bms, "device_no", "msg_ts").select("device_no", row_id, "msg_ts", "soc", "pack_current", "pack_volt")
    reading = F.when(F.col("soc").isNotNull(), F.struct(F.col("soc").alias("soc"), F.col("msg_ts").alias("ts")))
    stepped = nearest_value(
        rows, DEVICE, "msg_ts", row_id, ["pack_current"], keep_slices=True, befores={"_before": reading}
    ).where(F.col("soc").isNotNull()).select(
        "device_no", row_id, "msg_ts", BUCKET, PART, "soc", "near_pack_current",
        F.col("_before.soc").alias("_soc"), F.col("_before.ts").alias("_ts"),
    )
    change = F.col("soc") - F.col("_soc")
    marked = stepped.where(F.abs(change) >= S.SOC_NOISE).withColumns({
        "_change": change,
        "_fall": (change < 0).cast("int"),
        "_mark": F.when(change < 0, "fall").when((change > S.SOC_NOISE) & (F.col("near_pack_current") > S.OPEN_CURRENT), "open"),
    })
    seen = running(settled(marked), DEVICE, order, sums={"_falls": F.col("_fall")}, lasts={"_state": F.col("_mark")})
    member = (F.col("_change") > 0) & (F.col("_state") == "open")
    closed = seen.groupBy("device_no", (F.col("_falls") - F.col("_fall")).alias("session_id")).agg(
        F.min(F.when(member, F.col("_ts"))).alias("start_time"),
        F.max(F.when(member, F.col("msg_ts"))).alias("end_time"),
        F.min_by("_soc", F.when(member, F.struct(*order))).alias("start_soc"),
        F.max_by("soc", F.when(member, F.struct(*order))).alias("end_soc"),
        F.sum(F.when(member, E.seconds_between("_ts", "msg_ts") / 60)).alias("duration_minutes"),
        F.max("_fall").alias("_closed"),
    ).where((F.col("_closed") == 1) & F.col("start_time").isNotNull()).drop("_closed")
    full = mean_within(
        settled(closed), bms.select("device_no", "msg_ts", "pack_current", "pack_volt"), DEVICE, ["session_id"],
        "start_time", "end_time", "msg_ts", ["pack_current", "pack_volt"], pad_s=S.NEAR_SECONDS,
    )
    amps, volts = F.coalesce("mean_pack_current", F.lit(0.0)), F.coalesce("mean_pack_volt", F.lit(0.0))
    return full.select(
        "device_no", "session_id", "start_time", "end_time", "start_soc", "end_soc",
        (F.col("end_soc") - F.col("start_soc")).alias("soc_increase"), "duration_minutes",
        amps.alias("avg_current"), volts.alias("avg_voltage"),
        (amps * volts * F.col("duration_minutes") / 60 / 1000).alias("energy_kwh"),
        (amps > S.FAST_CURRENT).alias("is_fast_charging"),
    )


def charging_summary(sessions: DataFrame) -> DataFrame:
    fast = F.col("is_fast_charging")
    return sessions.groupBy("device_no").agg(
        F.count("*").alias("total_sessions"),
        (F.sum("duration_minutes") / 60).alias("total_charging_time_hours"),
        F.sum("energy_kwh").alias("total_energy_kwh"),
        F.count_if(fast).alias("fast_charging_sessions"), F.count_if(~fast).alias("slow_charging_sessions"),
        F.avg("energy_kwh").alias("avg_charging_efficiency"),
        F.avg("soc_increase").alias("avg_soc_increase"), F.avg("duration_minutes").alias("avg_duration_minutes"),
    )


def session_details(sessions: DataFrame) -> DataFrame:
    """Sessions numbered per device in time order, with the columns of the time/gain chart."""
    placed = sliced(sessions, DEVICE, "start_time", ["session_id"])
    numbered = running(placed, DEVICE, ["start_time", "session_id"], sums={"session_no": F.lit(1)})
    return numbered.select(
        "device_no", "session_no", F.to_date("start_time").alias("date"), "soc_increase", "duration_minutes",
        "avg_current", "avg_voltage", "energy_kwh", "is_fast_charging",
    )


def charging_outliers(sessions: DataFrame) -> DataFrame:
    """SOC gained per kWh and its z-score per device; above 2 is an outlier."""
    value = F.when(F.col("energy_kwh") > 0, F.col("soc_increase") / F.col("energy_kwh")).otherwise(0.0)
    rows = sessions.withColumn("soc_per_kwh", value).where((F.col("soc_per_kwh") > 0) & (F.col("soc_per_kwh") < 100))
    base = rows.groupBy("device_no").agg(F.avg("soc_per_kwh").alias("_mean"), F.stddev_pop("soc_per_kwh").alias("_std"))
    z = F.when(F.col("_std") > 1e-9, F.abs(F.col("soc_per_kwh") - F.col("_mean")) / F.col("_std")).otherwise(0.0)
    return rows.join(base, "device_no").select(
        "device_no", "session_id", "soc_per_kwh", z.alias("z_score"), (z > 2).alias("is_anomaly")
    )


def charging_heatmap(sessions: DataFrame) -> DataFrame:
    """Energy and sessions per starting hour and weekday (Sunday 0), all 168 cells in one row set."""
    hour, day = F.hour("start_time"), F.dayofweek("start_time") - 1
    counts = sessions.groupBy(hour.alias("hour"), day.alias("day")).agg(
        F.sum("energy_kwh").alias("energy_kwh"), F.count("*").alias("sessions")
    )
    spark = sessions.sparkSession
    grid = spark.range(168).select((F.col("id") % 24).cast("int").alias("hour"), F.floor(F.col("id") / 24).cast("int").alias("day"))
    return grid.join(counts, ["hour", "day"], "left").fillna(0, ["energy_kwh", "sessions"])

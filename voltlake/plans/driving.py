"""Driving modes, driving sessions, segments, distances and monthly performance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltlake import schema as S
from voltlake.functions import expr as E
from voltlake.functions.expr import rounded
from voltlake.operators.align import nearest_value
from voltlake.operators.sequence import BUCKET, PART, in_sequence, lagged, running, settled, sliced, unsliced
from voltlake.plans.battery import with_position

DEVICE = ["device_no"]


def driving_patterns(
    bms: DataFrame, gps: DataFrame, min_rows: int = 5, row_id: str = "event_id", gps_id: str = "gps_id",
) -> DataFrame:
    """Power, temperature and SOC efficiency per device and driving mode."""
    rows = bms.where(F.col("soc").isNotNull()).select(
        row_id, "device_no", "car_type", "msg_ts", "soc", "mod_avg_temp", rounded(E.power_w(), 2).alias("power_w"),
    )
    placed = with_position(
        rows, gps, False, take=["speed"], tolerance_s=S.NEAR_SECONDS, row_id=row_id, gps_id=gps_id, lags={"prev_soc": "soc"})
    drop = F.when(F.col("prev_soc") > F.col("soc"), E.safe_div(F.col("prev_soc") - F.col("soc"), F.abs("power_w")) * 1000)
    return placed.groupBy("device_no", "car_type", E.driving_mode("speed", "above").alias("driving_mode")).agg(
        F.avg("power_w").alias("avg_power"), F.stddev_samp("power_w").alias("power_variability"),
        F.avg("mod_avg_temp").alias("avg_temp"),
        (F.max("mod_avg_temp") - F.min("mod_avg_temp")).alias("temp_range"),
        F.avg(drop).alias("soc_efficiency"), F.count("*").alias("data_points"),
    ).where(F.col("data_points") >= min_rows).withColumn(
        "performance_stability", E.stability_label("power_variability", "temp_range")
    )


def driving_performance(bms: DataFrame, gps: DataFrame, row_id: str = "event_id", gps_id: str = "gps_id") -> DataFrame:
    """Discharging, moving rows per driving mode and type; each battery row counts once."""
    rows = bms.where(F.col("pack_current") < 0).select(
        row_id, "device_no", "car_type", "msg_ts", "soc", "soh", "pack_current", "mod_avg_temp",
        F.abs(E.power_w()).alias("power_w"),
    )
    placed = with_position(rows, gps, False, take=["speed", "fuel_pct"], row_id=row_id, gps_id=gps_id)
    moving = placed.where(F.col("speed") > 0)
    return moving.groupBy(E.driving_mode("speed", "from").alias("driving_mode"), "car_type").agg(
        F.count("*").alias("data_points"), F.avg("soc").alias("avg_soc"), F.avg("soh").alias("avg_soh"),
        F.avg("power_w").alias("avg_power"), F.stddev_samp("power_w").alias("power_variability"),
        F.avg("mod_avg_temp").alias("avg_temp"), F.min("mod_avg_temp").alias("min_temp"),
        F.max("mod_avg_temp").alias("max_temp"), F.avg("speed").alias("avg_speed"),
        F.avg("fuel_pct").alias("avg_fuel_pct"),
        F.avg(E.safe_div(F.abs("pack_current"), "speed")).alias("soc_consumption_rate"),
        (F.max("mod_avg_temp") - F.min("mod_avg_temp")).alias("temp_range"),
    )


def driving_performance_overview(performance: DataFrame) -> DataFrame:
    """Rounded means of the performance rows per mode and type."""
    means = ("avg_soc", "avg_soh", "avg_power", "avg_temp", "avg_speed", "avg_fuel_pct")
    return performance.groupBy("driving_mode", "car_type").agg(
        F.count("*").alias("data_points"),
        *[rounded(F.avg(name), 2).alias(name) for name in means],
        rounded(F.stddev_samp("avg_power"), 2).alias("power_variability"),
        rounded(F.min("min_temp"), 2).alias("min_temp"), rounded(F.max("max_temp"), 2).alias("max_temp"),
        rounded(F.avg("soc_consumption_rate"), 2).alias("soc_consumption_rate"),
        rounded(F.max("avg_temp") - F.min("avg_temp"), 2).alias("temp_range"),
    )


def driving_performance_summary(performance: DataFrame) -> DataFrame:
    return performance.groupBy("car_type").agg(
        F.count_distinct("driving_mode").alias("driving_modes_count"),
        rounded(F.avg("avg_power"), 2).alias("overall_avg_power"),
        rounded(F.avg("avg_temp"), 2).alias("overall_avg_temp"),
        rounded(F.avg("soc_consumption_rate"), 2).alias("overall_consumption_rate"),
    )


# ---------------------------------------------------------------- driving sessions


def driving_sessions(bms: DataFrame, row_id: str = "event_id") -> DataFrame:
    """Trips from odometer steps: a reset, or 30 minutes without a gain, ends one."""
    order = ["msg_ts", row_id]
    rows = in_sequence(bms, "odometer", "device_no", "msg_ts").select("device_no", row_id, "msg_ts", "odometer")
    stepped = lagged(sliced(rows, DEVICE, "msg_ts", [row_id]), DEVICE, order, {"_odo": "odometer", "_ts": "msg_ts"})
    diff = F.col("odometer") - F.col("_odo")
    gap = E.seconds_between("_ts", "msg_ts") / 60
    noise = (diff > S.ODO_RESET) & (diff <= S.ODO_NOISE)
    stop = (diff <= 0) & ~noise & ((diff <= S.ODO_RESET) | (gap >= S.BREAK_MINUTES))
    marked = stepped.withColumns({
        "_gain": F.when(diff > 0, diff), "_break": F.coalesce(stop, F.lit(False)).cast("int"),
    })
    numbered = running(marked, DEVICE, order, sums={"_upto": F.col("_break")})
    session = (F.col("_upto") - F.col("_break")).alias("session_id")
    return numbered.groupBy("device_no", session).agg(
        F.sum("_gain").alias("distance_km"),
        F.min(F.when(F.col("_gain").isNotNull(), F.col("_ts"))).alias("start_time"),
        F.coalesce(F.max(F.when(F.col("_break") == 1, F.col("_ts"))), F.max("msg_ts")).alias("end_time"),
    ).where(F.col("distance_km") > 0).withColumn("driving_seconds", E.seconds_between("start_time", "end_time"))


def driving_summary(bms: DataFrame, sessions: DataFrame) -> DataFrame:
    """Odometer range, total distance, session count and driving time per device."""
    span = bms.groupBy("device_no").agg(F.min("odometer").alias("min_odometer"), F.max("odometer").alias("max_odometer"))
    trips = sessions.groupBy("device_no").agg(
        F.sum("distance_km").alias("total_distance"), F.count("*").alias("session_count"),
        F.sum("driving_seconds").alias("total_seconds"),
    )
    out = span.join(trips, "device_no", "left").fillna(0, ["total_distance", "session_count", "total_seconds"])
    return out.withColumn("formatted_time", E.format_duration(rounded("total_seconds", 6))).withColumn(
        "avg_speed", avg_trip_speed("total_distance", "total_seconds")
    )


def avg_trip_speed(distance: str, seconds: str) -> Column:
    return F.coalesce(E.safe_div(distance, F.col(seconds) / 3600), F.lit(0.0))


def daily_distance(bms: DataFrame, row_id: str = "event_id") -> DataFrame:
    """Odometer gain per device and day."""
    rows = in_sequence(bms, "odometer", "device_no", "msg_ts").select("device_no", row_id, "msg_ts", "odometer")
    stepped = lagged(sliced(rows, DEVICE, "msg_ts", [row_id]), DEVICE, ["msg_ts", row_id], {"_odo": "odometer"})
    gain = F.col("odometer") - F.col("_odo")
    return stepped.where(gain > 0).groupBy("device_no", F.to_date("msg_ts").alias("date")).agg(F.sum(gain).alias("distance_km"))


# ---------------------------------------------------------------- segments


def segments(
    bms: DataFrame, charge_sign: int = 1, long_km: float = S.LONG_KM, row_id: str = "event_id",
) -> DataFrame:
    """Stretch between two successive SOC readings of a device and month, labelled by what happened.

    A row belongs to the segment of the last SOC reading at or before it; a reading itself also ends the
    segment before.  Odometer gains count up to the first reset inside the segment.  Boundary values come
    from the nearest row within a minute that has one.
    """
    order = ["msg_ts", row_id]
    columns = ["pack_volt", "pack_current", "soh", "odometer"]
    rows = in_sequence(bms, "device_no", "msg_ts").select("device_no", row_id, "msg_ts", "soc", *columns)
    counted = settled(nearest_value(
        rows, DEVICE, "msg_ts", row_id, columns, keep_slices=True, sums={"_seg": F.col("soc").isNotNull().cast("int")}
    ))
    # Odometer steps between rows that have a reading.
    with_odo = counted.where(F.col("odometer").isNotNull()).select("device_no", row_id, "msg_ts", BUCKET, PART, "soc", "odometer", "_seg")
    steps = lagged(with_odo, DEVICE, order, {"_odo": "odometer", "_last": "_seg"})
    diff = F.col("odometer") - F.col("_odo")
    inside = (F.col("_seg") == F.col("_last")) | (F.col("soc").isNotNull() & (F.col("_seg") == F.col("_last") + 1))
    reset = (diff <= S.ODO_RESET).cast("int")
    runs = running(steps.withColumns({"_diff": diff, "_reset": F.coalesce(reset, F.lit(0))}), DEVICE, order, sums={"_resets": F.col("_reset")})
    distance = (
        runs.where(inside)
        .groupBy("device_no", F.col("_last").alias("_seg"), (F.col("_resets") - F.col("_reset")).alias("_run"))
        .agg(F.sum(F.when(F.col("_diff") > 0, F.col("_diff")).otherwise(0.0)).alias("_km"))
        .groupBy("device_no", "_seg").agg(F.min_by("_km", "_run").alias("_km"))
    )
    # Each reading closes one segment and opens the next.
    reading = F.col("soc").isNotNull()
    role = F.when(reading, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    shared = unsliced(counted).withColumn("_closing", F.explode(role)).withColumn("_seg", F.col("_seg") - F.col("_closing"))
    opens, closes = reading & (F.col("_closing") == 0), F.col("_closing") == 1

    def at(test: Column, name: str) -> Column:
        return F.max(F.when(test, F.col(name)))

    ends = {
        "start_time": (opens, "msg_ts"), "end_time": (closes, "msg_ts"), "soc_start": (opens, "soc"), "soc_end": (closes, "soc"),
        "soh": (opens, "near_soh"), "_volt_a": (opens, "near_pack_volt"), "_volt_b": (closes, "near_pack_volt"),
        "_amps_a": (opens, "near_pack_current"), "_amps_b": (closes, "near_pack_current"),
        "_km_a": (opens, "near_odometer"), "_km_b": (closes, "near_odometer"),
    }
    # A row per segment and current first: the histogram in which the upper median, sorted[n div 2], is found.
    # It is sorted on disk where it is large; no task holds a segment's currents in a buffer.
    bars = shared.where(F.col("_seg") > 0).groupBy("device_no", "_seg", "pack_current").agg(
        *[at(test, column).alias(name) for name, (test, column) in ends.items()],
        F.count("odometer").alias("_odo_rows"), F.count("pack_current").alias("_n"),
    )
    segment = Window.partitionBy("device_no", "_seg")
    upto = F.sum("_n").over(segment.orderBy("pack_current").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    folded = bars.withColumns({"_upto": upto, "_all": F.sum("_n").over(segment)}).groupBy("device_no", "_seg").agg(
        *[F.max(name).alias(name) for name in ends], F.sum("_odo_rows").alias("_odo_rows"),
        F.min(F.when(F.col("_upto") > F.floor(F.col("_all") / 2), F.col("pack_current"))).alias("_median"),
    ).withColumns({
        "pack_volt": (F.col("_volt_a") + F.col("_volt_b")) / 2, "_edge_current": (F.col("_amps_a") + F.col("_amps_b")) / 2,
        "_edge_km": F.greatest(F.lit(0.0), F.col("_km_b") - F.col("_km_a")),
    })
    minutes = E.seconds_between("start_time", "end_time") / 60
    change = F.col("soc_end") - F.col("soc_start")
    kept = (
        folded.where(F.col("end_time").isNotNull() & (E.month_key("start_time") == E.month_key("end_time")))
        .where((F.abs(change) >= S.SOC_NOISE) & (minutes >= S.SEGMENT_MINUTES))
        .join(distance, ["device_no", "_seg"], "left")
        .withColumns({
            "soc_change": change,
            "distance_km": F.when(F.col("_odo_rows") > 1, F.coalesce("_km", F.lit(0.0))).otherwise(F.col("_edge_km")),
            "pack_current": F.coalesce("_median", "_edge_current"),
        })
    )
    km = F.col("distance_km")
    drives = (km > S.DRIVE_KM) & (F.col("soc_change") < 0)
    charges = (F.col("soc_change") > S.SEGMENT_SOC) & (F.col("pack_current") * charge_sign > S.SEGMENT_CURRENT)
    return kept.select(
        "device_no", F.col("_seg").alias("segment_no"),
        F.when(drives, "drive").otherwise("stand").alias("main_activity"),
        F.when(drives & (km >= long_km), "long").when(drives, "short").when(charges, "charge")
        .when(minutes >= S.PARK_MINUTES, "park").otherwise("stop").alias("sub_activity"),
        E.season("start_time").alias("season"), "start_time", "end_time", "soh", "pack_volt", "pack_current",
        "soc_start", "soc_end", "soc_change", "distance_km",
        (F.col("pack_volt") * F.col("pack_current") * minutes / 60 / 1000).alias("energy_kwh"),
    )


def segment_summary(segs: DataFrame, bms: DataFrame) -> DataFrame:
    """Period, odometer range, trip class and activity counts per device."""
    span = bms.groupBy("device_no").agg((F.max("odometer") - F.min("odometer")).alias("total_distance"))
    sub = F.col("sub_activity")
    counts = segs.groupBy("device_no").agg(
        F.min("start_time").alias("start_time"), F.max("end_time").alias("end_time"),
        F.count("*").alias("total_segments"),
        F.count_if(sub == "charge").alias("total_charging_sessions"),
        F.count_if(F.col("main_activity") == "drive").alias("total_driving_sessions"),
        F.count_if(sub == "stop").alias("total_idle_sessions"),
        F.count_if(sub == "park").alias("total_parking_sessions"),
    )
    return counts.join(span, "device_no").withColumns({
        "total_days": F.ceil(E.seconds_between("start_time", "end_time") / 86_400),
        "driving_type": F.when(F.col("total_distance") >= S.LONG_KM, "long").otherwise("short"),
    })


def _drives(segs: DataFrame) -> DataFrame:
    return segs.where((F.col("main_activity") == "drive") & (F.col("distance_km") > 0))


def distance_by(segs: DataFrame, period: str = "month") -> DataFrame:
    """Driven distance per device and day, month or season, with its running total."""
    key = {
        "day": F.to_date("end_time").cast("string"), "month": E.month_key("end_time"), "season": E.season("end_time"),
    }[period]
    sums = _drives(segs).groupBy("device_no", key.alias("period")).agg(F.sum("distance_km").alias("distance"))
    place = F.col("period")
    if period == "season":
        place = F.array_position(F.array(*[F.lit(s) for s in ("spring", "summer", "fall", "winter")]), F.col("period"))
    line = Window.partitionBy("device_no").orderBy(place)  # one row per period of a device
    return sums.withColumn("cumulative", F.sum("distance").over(line.rowsBetween(Window.unboundedPreceding, 0)))


TRIP_BINS = ((0, 1), (1, 3), (3, 5), (5, 10), (10, 20), (20, 50), (50, None))


def trip_histogram(segs: DataFrame) -> DataFrame:
    """Trips per distance bin, empty bins included."""
    km = F.col("distance_km")
    counts = _drives(segs).agg(*[
        F.count_if(km >= low if high is None else (km >= low) & (km < high)).alias(f"_{i}")
        for i, (low, high) in enumerate(TRIP_BINS)
    ])
    bins = F.array(*[
        F.struct(
            F.lit(i).alias("bin_no"), F.lit(f"{low}+" if high is None else f"{low}~{high}").alias("name"),
            F.col(f"_{i}").alias("trips"),
        ) for i, (low, high) in enumerate(TRIP_BINS)
    ])
    return counts.select(F.inline(bins))


def trip_length_share(segs: DataFrame) -> DataFrame:
    short = F.col("distance_km") < S.SHORT_TRIP_KM
    return _drives(segs).agg(F.count_if(short).alias("short_trips"), F.count_if(~short).alias("long_trips"))


def activity_share(segs: DataFrame) -> DataFrame:
    driving = F.col("main_activity") == "drive"
    return segs.agg(F.count_if(driving).alias("driving"), F.count_if(~driving).alias("stopped"))


def efficiency_by_month(segs: DataFrame) -> DataFrame:
    """km per kWh of a month, segments without energy left out."""
    energy = F.abs("energy_kwh")
    rows = _drives(segs).where(energy > 0)
    return rows.groupBy(E.month_key("end_time").alias("month")).agg(
        rounded(F.sum("distance_km") / F.sum(energy), 2).alias("efficiency")
    )


# ---------------------------------------------------------------- step efficiency


def efficiency_steps(bms: DataFrame, row_id: str = "event_id", min_current: float = S.SEGMENT_CURRENT) -> DataFrame:
    """Per SOC reading: SOC spent per km while driving, SOC gained per minute while charging.

    A reading without device or time follows no other and is left out.
    """
    order = ["msg_ts", row_id]
    rows = in_sequence(bms, "device_no", "msg_ts").select("device_no", row_id, "msg_ts", "soc", "odometer", "pack_current")
    near = nearest_value(rows, DEVICE, "msg_ts", row_id, ["odometer", "pack_current"], keep_slices=True)
    readings = settled(
        near.where(F.col("soc").isNotNull())
        .select("device_no", row_id, "msg_ts", BUCKET, PART, "soc", "near_odometer", "near_pack_current")
    )
    stepped = lagged(readings, DEVICE, order, {"_soc": "soc", "_ts": "msg_ts", "_odo": "near_odometer"})
    change, km = F.col("soc") - F.col("_soc"), F.col("near_odometer") - F.col("_odo")
    minutes = E.seconds_between("_ts", "msg_ts") / 60
    return unsliced(stepped).select(
        "device_no", row_id, "msg_ts",
        F.when((change < 0) & (km > 0), -change / km).alias("soc_per_km"),
        F.when(
            ~F.coalesce((change < 0) & (km > 0), F.lit(False)) & (change > 0) & (F.col("near_pack_current") > min_current),
            change / F.when(minutes > 0, minutes).otherwise(1.0),
        ).alias("soc_per_min"),
    )


def step_efficiency(steps: DataFrame) -> DataFrame:
    return steps.groupBy("device_no").agg(
        F.coalesce(F.avg("soc_per_km"), F.lit(0.0)).alias("avg_driving_efficiency"),
        F.coalesce(F.avg("soc_per_min"), F.lit(0.0)).alias("avg_charging_efficiency"),
        F.count("soc_per_km").alias("drive_steps"), F.count("soc_per_min").alias("charge_steps"),
    )


# ---------------------------------------------------------------- months


def _month() -> Column:
    return F.trunc(F.to_date("msg_ts"), "month").alias("month")


def monthly_performance(bms: DataFrame) -> DataFrame:
    return bms.groupBy("device_no", "car_type", _month()).agg(
        F.avg("soh").alias("avg_soh"), F.avg("mod_avg_temp").alias("avg_temp"),
        F.avg(E.cell_spread() * 100).alias("avg_balance_index"), F.count("*").alias("data_points"),
    )


def long_term_trends(monthly: DataFrame) -> DataFrame:
    """Month-over-month change rates and labels; the window sees one row per device and month."""
    line = Window.partitionBy("device_no").orderBy("month", "car_type")
    rates = {"soh_change_rate": "avg_soh", "temp_change_rate": "avg_temp", "balance_change_rate": "avg_balance_index"}
    out = monthly.withColumns({f"_p_{source}": F.lag(source).over(line) for source in rates.values()})
    out = out.withColumns({name: E.pct_change(source, f"_p_{source}") for name, source in rates.items()})
    return out.drop(*[f"_p_{source}" for source in rates.values()]).withColumns({
        "soh_trend": E.grade("soh_change_rate", (-1, -3, -5), ("stable", "slight_degradation", "moderate_degradation", "severe_degradation")),
        "temp_trend": E.grade("temp_change_rate", (5, 10), ("stable", "moderate_increase", "rapid_increase"), below=True),
        "balance_trend": E.grade("balance_change_rate", (10, 20), ("stable", "moderate_imbalance", "rapid_imbalance"), below=True),
    })


def monthly_vehicle_trends(bms: DataFrame, steps: DataFrame, segs: DataFrame) -> DataFrame:
    """SOH, efficiencies, distance and trips per device and month with month-over-month changes."""
    soh = bms.groupBy("device_no", _month()).agg(F.avg("soh").alias("avg_soh"))
    eff = steps.groupBy("device_no", _month()).agg(
        F.avg("soc_per_km").alias("avg_efficiency"), F.avg("soc_per_min").alias("avg_charging_eff")
    )
    trips = _drives(segs).groupBy("device_no", F.trunc(F.to_date("end_time"), "month").alias("month")).agg(
        F.sum("distance_km").alias("total_distance"), F.count("*").alias("trip_count")
    )
    out = soh.join(eff, ["device_no", "month"], "left").join(trips, ["device_no", "month"], "left")
    out = out.fillna(0, ["total_distance", "trip_count"])
    line = Window.partitionBy("device_no").orderBy("month")
    out = out.withColumns({"_s": F.lag("avg_soh").over(line), "_e": F.lag("avg_efficiency").over(line)})
    out = out.withColumns({
        "soh_change_rate": E.pct_change("avg_soh", "_s"), "efficiency_change_rate": E.pct_change("avg_efficiency", "_e"),
    }).drop("_s", "_e")
    return out.withColumns({
        "soh_trend": E.grade("soh_change_rate", (-1, -3, -5), ("stable", "slight_degradation", "moderate_degradation", "severe_degradation")),
        "efficiency_trend": E.grade("efficiency_change_rate", (5, 10), ("stable", "moderate_increase", "rapid_increase"), below=True),
    })

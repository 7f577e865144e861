"""Fleet dashboards, latest vehicle state, device lists and per-type comparisons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltlake.functions import expr as E
from voltlake.functions.expr import rounded
from voltlake.operators.align import nearest_to_few
from voltlake.operators.select import (
    first_value, head_per_key, last_interval, latest_rows, latest_value, where_opt,
)
from voltlake.operators.sequence import global_row_number, settled
from voltlake.schema import CAR_TYPES

KEYS = ["car_type", "device_no"]


def usable(bms: DataFrame) -> DataFrame:
    return bms.where(F.col("soc").isNotNull() & F.col("soh").isNotNull() & (F.col("pack_volt") > 0))


def latest_vehicles(bms: DataFrame, row_id: str = "event_id") -> DataFrame:
    """Latest complete row per vehicle with its balance index."""
    rows = usable(bms).select(
        *KEYS, "msg_ts", row_id, "soc", "soh", "pack_volt", "pack_current", "mod_avg_temp",
        E.cell_balance_index(0.0).alias("cell_balance_index"),
    )
    return latest_rows(rows, KEYS, "msg_ts", row_id)


def fleet_dashboard(
    bms: DataFrame, gps: DataFrame, include_total: bool = True, exact_total: bool = False,
    row_id: str = "event_id", gps_id: str = "gps_id",
) -> DataFrame:
    """Vehicles, activity and battery shares per type, with a vehicle-weighted TOTAL row.

    TOTAL weights the rounded per-type figures; ``exact_total`` weights the unrounded ones.
    """
    now = nearest_to_few(latest_vehicles(bms, row_id), gps, KEYS, "msg_ts", "time", gps_id, ["speed"])

    def share(test: Column) -> Column:
        return 100.0 * F.count_if(test) / F.nullif(F.count("*"), F.lit(0))

    figures = {
        "avg_soc": F.avg("soc"), "avg_soh": F.avg("soh"),
        "low_SOH_pct": share(F.col("soh") < 80),
        "high_temp_pct": share(F.col("mod_avg_temp") > 45),
        "high_imbalance_pct": share(F.col("cell_balance_index") > 1.5),
    }
    kept = (lambda x: x) if exact_total else (lambda x: rounded(x, 2))
    per_type = now.groupBy("car_type").agg(
        F.count("*").alias("total_vehicles"),
        F.count_if(F.col("pack_current") > 0).alias("charging_now"),
        F.count_if(F.col("speed") > 0).alias("moving_now"),
        *[kept(value).alias(name) for name, value in figures.items()],
        F.max("msg_ts").alias("last_updated"),
    )
    names = F.array("car_type", F.lit("TOTAL")) if include_total else F.array("car_type")
    weight = F.sum("total_vehicles")
    return per_type.withColumn("car_type", F.explode(names)).groupBy("car_type").agg(
        weight.alias("total_vehicles"),
        F.sum("charging_now").alias("charging_now"),
        F.sum("moving_now").alias("moving_now"),
        *[rounded(F.sum(F.col(n) * F.col("total_vehicles")) / weight, 2).alias(n) for n in figures],
        F.max("last_updated").alias("last_updated"),
    )


def vehicle_performance(
    bms: DataFrame, gps: DataFrame, row_id: str = "event_id", gps_id: str = "gps_id",
) -> DataFrame:
    """Latest state per vehicle with the position nearest to it within a minute."""
    at = nearest_to_few(
        latest_vehicles(bms, row_id), gps, KEYS, "msg_ts", "time", gps_id,
        ["time", "speed", "lat", "lng", "fuel_pct"],
    )
    return at.select(
        F.col("device_no").alias("vehicle_id"), F.col("car_type").alias("vehicle_type"),
        F.col("soc").alias("latest_soc"), F.col("soh").alias("latest_soh"),
        "pack_volt", "pack_current", "mod_avg_temp", "cell_balance_index",
        "speed", "lat", "lng", "fuel_pct",
        E.soh_grade("soh").alias("performance_grade"),
        E.vehicle_status("current").alias("vehicle_status"),
        F.greatest("msg_ts", F.coalesce("time", "msg_ts")).alias("last_updated"),
    )


def latest_health(bms: DataFrame, row_id: str = "event_id") -> DataFrame:
    """Health index of each vehicle's latest row; only its last 11 rows leave the scan."""
    rows = bms.where(F.col("soh").isNotNull()).select(
        *KEYS, "msg_ts", row_id, "soh", "pack_volt", "pack_current", "mod_avg_temp", "max_cell_volt", "min_cell_volt",
    )
    recent = head_per_key(rows, KEYS, [F.col("msg_ts").desc(), F.col(row_id).desc()], 11)
    last = recent.groupBy(*KEYS).agg(
        F.max_by(F.struct(*rows.columns[2:]), F.struct("msg_ts", row_id)).alias("_row"),
        F.stddev_samp("pack_volt").alias("_std"),
    ).select(*KEYS, "_row.*", "_std")
    scored = last.withColumns({
        "balance_score": E.balance_score(), "temperature_score": E.temperature_score(),
        "voltage_stability_score": E.voltage_stability_score("_std"),
    })
    return scored.select(*KEYS, rounded(E.composite_health("components"), 2).alias("composite_health_index")).withColumn(
        "health_grade", E.health_grade("composite_health_index")
    )


def vehicle_summary(
    bms: DataFrame, gps: DataFrame, as_of: str, row_id: str = "event_id", gps_id: str = "gps_id",
) -> DataFrame:
    """One row per vehicle: state, position, health, odometer, rule anomaly of the latest row."""
    rows = usable(bms)
    state = latest_rows(
        rows.select(
            *KEYS, "msg_ts", row_id, "soc", "soh", "pack_volt", "pack_current", "mod_avg_temp",
            "odometer", E.cell_balance_index(0.0).alias("cell_balance_index"), E.rule_anomaly().alias("_rule"),
        ), KEYS, "msg_ts", row_id,
    )
    at = nearest_to_few(state, gps, KEYS, "msg_ts", "time", gps_id, ["time", "lat", "lng", "speed", "fuel_pct"])
    full = at.join(latest_health(bms, row_id), KEYS, "left")
    updated = F.greatest("msg_ts", F.coalesce("time", "msg_ts"))
    return full.select(
        F.col("device_no").alias("vehicle_id"), F.col("car_type").alias("vehicle_type"),
        F.col("soc").alias("latest_soc"), F.col("soh").alias("latest_soh"),
        F.col("odometer").alias("total_odometer"), "pack_volt", "pack_current", E.power_w().alias("power_w"),
        "mod_avg_temp", "cell_balance_index", "composite_health_index", "health_grade",
        F.col("lat").alias("latest_lat"), F.col("lng").alias("latest_lng"), F.col("speed").alias("latest_speed"),
        F.col("fuel_pct").alias("latest_fuel_pct"), updated.alias("last_updated"), F.col("msg_ts").alias("bms_time"),
        F.col("_rule.anomaly_type").alias("anomaly_type"),
        E.risk_level("_rule.anomaly_severity").alias("risk_level"),
        E.vehicle_status("speed").alias("vehicle_status"),
        E.recency_quality(updated, as_of).alias("data_quality"),
    )


def fleet_overview(summary: DataFrame, as_of: str, car_types: Sequence[str] | None = None) -> DataFrame:
    """One row of fleet figures from ``vehicle_summary``; a health column for each type, by default all there are."""
    moment = E.as_timestamp(as_of)
    if car_types is None:
        seen = summary.where(F.col("vehicle_type").isNotNull()).select("vehicle_type").distinct().collect()
        car_types = sorted({row[0] for row in seen} | set(CAR_TYPES))

    def active(days: int) -> Column:
        return F.count_if(E.seconds_between("last_updated", moment) <= days * 86_400).alias(f"active_vehicles_{days}d")

    newest = summary.groupBy("vehicle_type").agg(F.max("bms_time").alias("_newest"))
    online = E.seconds_between("bms_time", "_newest") <= 300
    averages = {
        "avg_soc": "latest_soc", "avg_soh": "latest_soh", "avg_health_index": "composite_health_index",
        "avg_cell_balance": "cell_balance_index", "avg_voltage": "pack_volt", "avg_current": "pack_current",
        "avg_temp": "mod_avg_temp", "avg_speed": "latest_speed", "avg_fuel_pct": "latest_fuel_pct",
    }
    return summary.join(newest, "vehicle_type").agg(
        F.count("*").alias("total_vehicles"),
        *[rounded(F.avg(column), 2).alias(name) for name, column in averages.items()],
        active(7), active(14), active(30),
        *[F.count_if(F.col("health_grade") == g).alias(g if "attention" in g else f"{g}_health") for g in E.HEALTH_GRADES],
        *[F.count_if(F.col("risk_level") == r).alias(f"{r}_anomalies") for r in ("critical", "high", "medium")],
        *[
            rounded(F.avg(F.when(F.col("vehicle_type") == t, F.col("composite_health_index"))), 2)
            .alias(f"{t.lower()}_avg_health") for t in car_types
        ],
        F.count_if(F.col("cell_balance_index") > 1.5).alias("high_imbalance_vehicles"),
        rounded(100.0 * F.count_if(online) / F.nullif(F.count("*"), F.lit(0)), 2).alias("online_5m_pct"),
        F.max("last_updated").alias("last_updated"),
    )


def vehicle_comparison(summary: DataFrame, car_type: str) -> DataFrame:
    """Vehicles of one type, best health first."""
    return where_opt(summary, vehicle_type=car_type.upper()).select(
        "vehicle_id", "latest_soc", "latest_soh", "composite_health_index", "cell_balance_index",
        "health_grade", "anomaly_type", "risk_level", "last_updated",
    ).orderBy(F.col("composite_health_index").desc_nulls_last(), "vehicle_id")


def health_rank(summary: DataFrame) -> DataFrame:
    kept = summary.select("vehicle_id", "vehicle_type", "latest_soh", "composite_health_index", "cell_balance_index")
    order = [F.col("composite_health_index").desc_nulls_last(), F.col("vehicle_id").asc()]
    return global_row_number(kept, "health_rank", order)


def type_comparison(summary: DataFrame) -> DataFrame:
    return summary.groupBy(F.col("vehicle_type").alias("car_type")).agg(
        F.count("*").alias("vehicle_count"),
        F.avg("latest_soh").alias("avg_soh"),
        F.avg("composite_health_index").alias("avg_health_index"),
        F.avg("cell_balance_index").alias("avg_balance_index"),
        F.count_if(F.col("health_grade") == "excellent").alias("excellent_count"),
        F.count_if(F.col("health_grade") == "needs_attention").alias("needs_attention_count"),
    )


def grade_distribution(vehicles: DataFrame, grade: str = "performance_grade") -> DataFrame:
    """Vehicles per grade with their share; the total is a window over one row per grade."""
    counts = vehicles.groupBy(grade).agg(F.count("*").alias("vehicle_count"))
    everything = Window.partitionBy(F.lit(0))
    return counts.withColumn("percentage", rounded(F.col("vehicle_count") * 100.0 / F.sum("vehicle_count").over(everything), 2))


def spec_comparison(bms: DataFrame) -> DataFrame:
    """Measured averages per type and the figures derived from them."""
    rows = bms.where(F.col("soh").isNotNull() & (F.col("pack_volt") > 0))
    measured = rows.groupBy("car_type").agg(
        F.count_distinct("device_no").alias("vehicle_count"),
        rounded(F.avg("soh"), 2).alias("actual_avg_soh"),
        rounded(F.avg(E.power_kw()), 2).alias("actual_avg_power"),
        rounded(F.avg("mod_avg_temp"), 2).alias("actual_avg_temp"),
        rounded(F.avg(E.cell_spread() * 100), 3).alias("actual_avg_cell_balance"),
        rounded(F.avg("pack_volt"), 2).alias("avg_pack_volt"),
        rounded(F.avg(F.abs("pack_current")), 2).alias("avg_pack_current"),
        rounded(F.avg("soc"), 2).alias("avg_soc"),
    )
    return measured.select(
        "*",
        rounded(F.col("avg_pack_volt") * F.col("avg_pack_current") / 1000, 2).alias("estimated_battery_capacity_kwh"),
        rounded(F.col("avg_soc") * 10, 0).alias("estimated_range_km"),
        rounded(E.safe_div("avg_pack_volt", "avg_pack_current"), 2).alias("actual_efficiency_kmkwh"),
        rounded(100 - F.col("actual_avg_soh"), 2).alias("efficiency_degradation_rate"),
        E.grade("actual_avg_soh", (90, 80, 70), ("Excellent", "Good", "Fair", "Poor")).alias("battery_life_prediction"),
    )


def device_snapshot(
    bms: DataFrame, gps: DataFrame, row_id: str = "event_id", gps_id: str = "gps_id",
) -> DataFrame:
    """Last known value of every field per device, merged with its last position."""
    fields = [n for n in (
        "soc", "soh", "pack_volt", "pack_current", "mod_avg_temp", "mod_max_temp", "mod_min_temp",
        "batt_internal_temp", "odometer", "chrg_cable_conn", "fast_chrg_port_conn", "slow_chrg_port_conn",
    ) if n in bms.columns]
    battery = bms.groupBy("device_no").agg(
        latest_value("car_type", "msg_ts", row_id).alias("car_type"),
        *[latest_value(name, "msg_ts", row_id).alias(name) for name in fields],
        F.max("msg_ts").alias("last_updated"),
    )
    position = gps.groupBy("device_no").agg(
        *[latest_value(name, "time", gps_id).alias(name) for name in ("speed", "lat", "lng")]
    )
    fast = "fast_chrg_port_conn" if "fast_chrg_port_conn" in fields else None
    slow = "slow_chrg_port_conn" if "slow_chrg_port_conn" in fields else None
    merged = battery.join(position, "device_no", "left").withColumn(
        "_charge", E.charging_status("pack_current", "chrg_cable_conn", fast, slow)
    )
    temps = [n for n in ("mod_avg_temp", "mod_max_temp", "mod_min_temp", "batt_internal_temp") if n in fields]
    return merged.select(
        F.col("device_no").alias("vehicle_id"), F.col("car_type").alias("vehicle_type"),
        F.col("soc").alias("latest_soc"), F.col("soh").alias("latest_soh"), "pack_volt", "pack_current",
        *temps, "odometer", "speed", "lat", "lng",
        E.device_grade("soh").alias("performance_grade"), "last_updated",
        E.vehicle_status("moving").alias("vehicle_status"), "_charge.*",
        (F.col("speed") > 5).alias("is_moving"),
        F.when(F.col("_charge.is_charging"), E.power_kw()).otherwise(0.0).alias("charging_power"),
        E.power_w().alias("power_w"),
    )


def status_counts(snapshot: DataFrame) -> DataFrame:
    """Devices by activity; an unknown cable flag is unknown, not disconnected."""
    idle = ~F.coalesce(F.col("is_charging"), F.lit(False))
    return snapshot.agg(
        F.count("*").alias("total_devices"),
        F.count_if("is_charging").alias("charging_devices"),
        F.count_if("is_moving").alias("moving_devices"),
        F.count_if(F.col("is_cable_connected") & idle).alias("cable_only_devices"),
        F.count_if(~F.col("is_cable_connected") & idle).alias("disconnected_devices"),
        F.count_if(F.col("is_cable_connected").isNull()).alias("unknown_devices"),
    )


def fleet_summary(points: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Averages and extremes over all points, plus the mean power of the devices' last state."""
    def mean(field: str, name: str) -> Column:
        return F.avg(F.when(F.col("field") == field, F.col("value"))).alias(name)

    over_points = points.agg(
        mean("soc", "avg_soc"), mean("soh", "avg_soh"), mean("mod_avg_temp", "avg_temp"),
        mean("pack_volt", "avg_voltage"), mean("pack_current", "avg_current"),
        mean("odometer", "avg_odometer"), mean("speed", "avg_speed"),
        F.max(F.when(F.col("field") == "mod_max_temp", F.col("value"))).alias("max_temp"),
        F.min(F.when(F.col("field") == "mod_min_temp", F.col("value"))).alias("min_temp"),
    )
    power = snapshot.agg(F.avg("power_w").alias("avg_power"))
    both = over_points.unionByName(power, allowMissingColumns=True)  # one row each, folded into one
    return both.agg(*[F.max(name).alias(name) for name in both.columns])


def point_counts(points: DataFrame) -> DataFrame:
    """Field values per type and measurement, with a TOTAL type."""
    per_type = points.groupBy("car_type", "measurement").agg(F.count("value").alias("points"))
    return (
        per_type.withColumn("car_type", F.explode(F.array("car_type", F.lit("TOTAL"))))
        .groupBy("car_type", "measurement").agg(F.sum("points").alias("points"))
    )


def avg_soc_soh(points: DataFrame) -> DataFrame:
    def valid(field: str) -> Column:
        return F.when((F.col("field") == field) & F.col("value").between(0, 100), F.col("value"))

    return points.groupBy("car_type").agg(
        F.avg(valid("soc")).alias("avg_soc"), F.avg(valid("soh")).alias("avg_soh"),
        F.count_distinct("device_no").alias("devices"),
    )


def list_devices(rows: DataFrame, car_type: str | None = None) -> DataFrame:
    return where_opt(rows, car_type=car_type).select("car_type", "device_no").distinct().orderBy("car_type", "device_no")


def devices_of_type(rows: DataFrame, bms: DataFrame, car_type: str) -> DataFrame:
    """Rows of the devices that have ever reported as this type."""
    known = settled(bms.where(F.col("car_type") == car_type).select("device_no").distinct())
    return rows.join(known, "device_no", "left_semi")


def available_months(rows: DataFrame, ts: str = "msg_ts") -> DataFrame:
    return rows.select(E.month_key(ts).alias("month")).where(F.col("month").isNotNull()).distinct().orderBy("month")


def latest_by_field(points: DataFrame, tiebreak: str = "event_id") -> DataFrame:
    return points.groupBy("device_no", "field").agg(
        F.max_by("value", F.struct("time", tiebreak)).alias("value"), F.max("time").alias("time"),
    )


def device_list(points: DataFrame, car_type: str, tiebreak: str = "event_id") -> DataFrame:
    """Devices of a type with last SOC and SOH (0 when never reported) and a letter grade."""
    def last(field: str) -> Column:
        return F.coalesce(
            F.max_by("value", F.when(F.col("field") == field, F.struct("time", tiebreak))), F.lit(0.0)
        ).alias(field)

    rows = points.where(F.col("car_type") == car_type.upper())
    return rows.groupBy("device_no").agg(last("soc"), last("soh")).select(
        "device_no", "soc", "soh", F.lit("UNKNOWN").alias("vehicle_status"), E.letter_grade("soh").alias("performance_grade"),
    )


def staleness(vehicles: DataFrame, as_of: str) -> DataFrame:
    idle = E.staleness("last_updated", as_of)
    return vehicles.select("vehicle_id", "last_updated", idle.alias("seconds_since_update"), (idle < 3600).alias("is_active"))


def hourly_performance(bms: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    return last_interval(bms, "msg_ts", as_of, days).groupBy(F.hour("msg_ts").alias("hour_of_day")).agg(
        F.avg("soc").alias("avg_soc"), F.avg("soh").alias("avg_soh"), F.avg("mod_avg_temp").alias("avg_temp"),
        F.count("*").alias("data_points"),
    )


def device_history(bms: DataFrame, as_of: str, days: int = 30, device_no: str | None = None) -> DataFrame:
    """Daily means of every device over the last days, newest ``days`` days per device."""
    rows = last_interval(where_opt(bms, device_no=device_no), "msg_ts", as_of, days)
    rows = rows.where(F.col("soc").isNotNull() & F.col("soh").isNotNull())
    daily = rows.groupBy("device_no", F.to_date("msg_ts").alias("date")).agg(
        F.avg("soc").alias("avg_soc"), F.avg("soh").alias("avg_soh"), F.avg("pack_volt").alias("avg_pack_volt"),
        F.avg("pack_current").alias("avg_pack_current"), F.avg("mod_avg_temp").alias("avg_mod_temp"),
        F.count("*").alias("record_count"),
    ).withColumn("data_quality", E.count_quality("record_count"))
    return head_per_key(daily, ["device_no"], [F.col("date").desc()], days)


def vehicle_baseline(
    bms: DataFrame, steps: DataFrame, first_days: int = 30, row_id: str = "event_id",
) -> DataFrame:
    """Figures of each vehicle's first days; ``steps`` are the rows of ``driving.efficiency_steps``.

    The first days, one row a vehicle, are written first: their known size decides how they are joined.
    """
    begin = settled(bms.groupBy("device_no").agg(F.min("msg_ts").alias("_first")))
    early = E.seconds_between("_first", "msg_ts") < first_days * 86_400
    rows = bms.join(begin, "device_no").where(early)
    base = rows.groupBy("device_no", "car_type").agg(
        F.avg("soh").alias("baseline_soh"),
        first_value("odometer", "msg_ts", row_id).alias("baseline_odometer"),
        F.max("odometer").alias("baseline_max_odometer"),
        F.count("*").alias("baseline_data_count"),
    )
    first_steps = steps.join(begin, "device_no").where(early).groupBy("device_no").agg(
        F.avg("soc_per_km").alias("baseline_efficiency"), F.avg("soc_per_min").alias("baseline_charging_eff"),
    )
    return base.join(first_steps, "device_no", "left")

"""Cell balance, health, trends and temperature statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltlake.functions import expr as E
from voltlake.functions.expr import rounded
from voltlake.operators.align import interval_join, nearest_join, nearest_value
from voltlake.operators.select import last_interval, latest_rows, latest_value, where_opt
from voltlake.operators.sequence import framed, lagged, sliced, unsliced
from voltlake.schema import FAN_SECONDS

POSITION = ["speed", "lat", "lng", "fuel_pct"]


def with_position(
    rows: DataFrame, gps: DataFrame, fan_out: bool, closed: bool = False, take=POSITION,
    tolerance_s: float = FAN_SECONDS, row_id: str = "event_id", gps_id: str = "gps_id", **looks,
) -> DataFrame:
    """Battery rows with position columns: every match within five minutes, or the nearest one only.

    ``looks`` adds lags and frames along the device to the pass that finds the nearest (see ``nearest_join``).
    """
    if fan_out:
        return interval_join(rows, gps, ["device_no"], "msg_ts", "time", tolerance_s, take, closed)
    return nearest_join(
        rows, gps, ["car_type", "device_no"], "msg_ts", "time", row_id, gps_id, take, tolerance_s,
        keys=["device_no"], **looks,
    )


def balanced_rows(bms: DataFrame) -> DataFrame:
    rows = bms.where(F.col("max_cell_volt").isNotNull() & F.col("min_cell_volt").isNotNull() & (F.col("pack_volt") > 0))
    return rows.withColumn("cell_balance_index", E.cell_balance_index(None))


def cell_balance(bms: DataFrame, gps: DataFrame, fan_out: bool = False, row_id: str = "event_id") -> DataFrame:
    """Balance index per battery row and matched position, with the condition it coincides with."""
    rows = balanced_rows(bms).select(
        row_id, "device_no", "car_type", "msg_ts", "soc", "pack_current", "mod_avg_temp", "cell_balance_index",
        E.imbalance_trigger().alias("imbalance_trigger"),
    )
    return with_position(rows, gps, fan_out, row_id=row_id)


BANDS = ("excellent", "good", "moderate", "poor")


def _band_counts(index: str) -> list[Column]:
    i = F.col(index)
    tests = (i <= 0.5, (i > 0.5) & (i <= 1.0), (i > 1.0) & (i <= 2.0), i > 2.0)
    return [F.count_if(test).alias(f"{band}_balance_count") for band, test in zip(BANDS, tests)]


def balance_status(bms: DataFrame, car_type: str | None = None) -> DataFrame:
    rows = balanced_rows(where_opt(bms, car_type=car_type))
    return rows.agg(
        *_band_counts("cell_balance_index"), F.count("*").alias("total_count"),
        rounded(F.avg("cell_balance_index"), 3).alias("avg_balance_index"),
        rounded(F.stddev_samp("cell_balance_index"), 3).alias("balance_variability"),
    )


def trigger_stats(bms: DataFrame, car_type: str | None = None) -> DataFrame:
    rows = balanced_rows(where_opt(bms, car_type=car_type))
    return rows.groupBy(E.imbalance_trigger().alias("imbalance_trigger")).agg(
        F.count("*").alias("trigger_count"),
        rounded(F.avg("cell_balance_index"), 3).alias("avg_balance_index"),
        rounded(F.avg("mod_avg_temp"), 2).alias("avg_temp"),
        rounded(F.avg("soc"), 2).alias("avg_soc"),
    )


def cell_balance_daily(bms: DataFrame, gps: DataFrame, row_id: str = "event_id", gps_id: str = "gps_id") -> DataFrame:
    """Daily balance statistics per type; each battery row counts once, with its nearest position."""
    rows = balanced_rows(bms).select(
        row_id, "device_no", "car_type", "msg_ts", "soc", "soh", "mod_avg_temp",
        F.col("cell_balance_index").alias("balance_index"),
    )
    placed = with_position(rows, gps, False, take=["speed", "fuel_pct"], row_id=row_id, gps_id=gps_id)
    return placed.groupBy(F.to_date("msg_ts").alias("date"), "car_type").agg(
        F.count("*").alias("data_points"),
        F.avg("balance_index").alias("avg_balance_index"),
        F.stddev_samp("balance_index").alias("balance_variability"),
        F.min("balance_index").alias("min_balance_index"),
        F.max("balance_index").alias("max_balance_index"),
        F.avg("soc").alias("avg_soc"), F.avg("soh").alias("avg_soh"), F.avg("mod_avg_temp").alias("avg_temp"),
        F.avg("speed").alias("avg_speed"), F.avg("fuel_pct").alias("avg_fuel_pct"),
        *_band_counts("balance_index"),
    )


def balance_trend(bms: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    rows = last_interval(balanced_rows(bms), "msg_ts", as_of, days)
    return rows.groupBy(F.to_date("msg_ts").alias("date")).agg(
        F.avg("cell_balance_index").alias("avg_balance_index"),
        F.stddev_samp("cell_balance_index").alias("balance_variability"),
        F.count("*").alias("data_points"),
    )


def trends(bms: DataFrame, gps: DataFrame, fan_out: bool = False, row_id: str = "event_id") -> DataFrame:
    rows = bms.where(F.col("soc").isNotNull() | F.col("soh").isNotNull()).select(
        row_id, "device_no", "car_type", "msg_ts", "soc", "soh", "pack_volt", "pack_current", "mod_avg_temp",
        "max_cell_volt", "min_cell_volt",
    )
    return with_position(rows, gps, fan_out, closed=True, row_id=row_id)


def trends_by_type(bms: DataFrame, as_of: str, days: int = 365, season_by: str = "month") -> DataFrame:
    """SOC by part of day, SOH by season, totals and data quality per type."""
    rows = last_interval(bms, "msg_ts", as_of, days).where(F.col("soc").isNotNull() | F.col("soh").isNotNull())
    part, season = E.day_part("msg_ts"), E.season("msg_ts", season_by)
    return rows.groupBy("car_type").agg(
        *[F.avg(F.when(part == p, F.col("soc"))).alias(f"{p}_avg_soc") for p in ("morning", "afternoon", "evening", "night")],
        *[F.avg(F.when(season == s, F.col("soh"))).alias(f"{s}_avg_soh") for s in ("spring", "summer", "fall", "winter")],
        F.avg("soc").alias("overall_avg_soc"), F.avg("soh").alias("overall_avg_soh"),
        F.avg("mod_avg_temp").alias("overall_avg_temp"), F.count("*").alias("total_records"),
        F.count("soc").alias("valid_soc_count"), F.count("soh").alias("valid_soh_count"),
        rounded(F.count("soc") * 100.0 / F.count("*"), 2).alias("soc_data_quality"),
        rounded(F.count("soh") * 100.0 / F.count("*"), 2).alias("soh_data_quality"),
    )


def bms_response(bms: DataFrame, min_rows: int = 10, row_id: str = "event_id") -> DataFrame:
    """Balance and temperature reaction per device and operation mode."""
    rows = bms.where(F.col("soc").isNotNull() & (F.col("pack_volt") > 0)).select(
        row_id, "device_no", "car_type", "msg_ts", "mod_avg_temp", (E.cell_spread() * 100).alias("voltage_balance"),
        E.operation_mode().alias("operation_mode"),
    )
    stepped = lagged(sliced(rows, ["device_no"], "msg_ts", [row_id]), ["device_no"], ["msg_ts", row_id], {"prev_temp": "mod_avg_temp"})
    return stepped.groupBy("device_no", "car_type", "operation_mode").agg(
        F.avg("voltage_balance").alias("avg_voltage_balance"),
        F.stddev_samp("voltage_balance").alias("voltage_balance_variability"),
        F.avg("mod_avg_temp").alias("avg_temp"),
        F.avg(F.abs(F.col("mod_avg_temp") - F.col("prev_temp"))).alias("temp_response_sensitivity"),
        F.count("*").alias("operation_count"),
    ).where(F.col("operation_count") >= min_rows).withColumn(
        "bms_response_quality", E.response_quality("voltage_balance_variability", "temp_response_sensitivity")
    )


def battery_health(
    bms: DataFrame, gps: DataFrame, latest_only: bool = False, row_id: str = "event_id", gps_id: str = "gps_id",
) -> DataFrame:
    """Component scores and composite health per battery row, with the nearest position."""
    rows = bms.where(F.col("soh").isNotNull()).select(
        row_id, "device_no", "car_type", "msg_ts", "soc", "soh", "pack_volt", "mod_avg_temp", "max_cell_volt", "min_cell_volt",
    )
    spread = {"_std": lambda w: F.stddev_samp("pack_volt").over(w.rowsBetween(-10, Window.currentRow))}

    def scored(rolled: DataFrame, *more: str) -> DataFrame:
        return rolled.withColumns({
            "balance_score": E.balance_score(), "temperature_score": E.temperature_score(),
            "voltage_stability_score": E.voltage_stability_score("_std"),
        }).select(
            row_id, "device_no", "car_type", "msg_ts", "soc", "soh",
            rounded(E.composite_health("components"), 2).alias("composite_health_index"),
            "balance_score", "temperature_score", "voltage_stability_score", *more,
        )

    if latest_only:
        order = ["msg_ts", row_id]
        rolled = unsliced(framed(sliced(rows, ["device_no"], "msg_ts", [row_id]), ["device_no"], order, 10, spread))
        placed = with_position(latest_rows(scored(rolled), ["device_no"], "msg_ts", row_id), gps, False, row_id=row_id, gps_id=gps_id)
    else:
        placed = scored(with_position(rows, gps, False, row_id=row_id, gps_id=gps_id, frames=spread, back=10), *POSITION)
    return placed.withColumn("health_grade", E.health_grade("composite_health_index"))


def temp_volt_response(bms: DataFrame, true_correlation: bool = False, row_id: str = "event_id") -> DataFrame:
    """Change rates against the previous row and the rolling mean of temperature x voltage over 11 rows."""
    rows = bms.where(F.col("mod_avg_temp").isNotNull() & (F.col("pack_volt") > 0)).select(
        row_id, "device_no", "car_type", "msg_ts", "soc", "soh", "pack_volt", "mod_avg_temp", "max_cell_volt", "min_cell_volt",
    )
    columns = {
        "_pt": lambda w: F.lag("mod_avg_temp").over(w),
        "_pv": lambda w: F.lag("pack_volt").over(w),
        "temp_volt_correlation": lambda w: F.avg(F.col("mod_avg_temp") * F.col("pack_volt")).over(w.rowsBetween(-10, 0)),
    }
    if true_correlation:
        columns["temp_volt_pearson"] = lambda w: F.corr("mod_avg_temp", "pack_volt").over(w.rowsBetween(-10, 0))
    out = framed(sliced(rows, ["device_no"], "msg_ts", [row_id]), ["device_no"], ["msg_ts", row_id], 10, columns)
    out = unsliced(out).withColumns({
        "temp_change_rate": E.pct_change("mod_avg_temp", "_pt"), "volt_change_rate": E.pct_change("pack_volt", "_pv"),
    }).drop("_pt", "_pv")
    heat, volt = F.abs("temp_change_rate"), F.abs("volt_change_rate")
    return out.withColumns({
        "temperature_sensitivity": F.when(heat > 10, "high_sensitivity").when(heat > 5, "medium_sensitivity").otherwise("low_sensitivity"),
        "voltage_stability": F.when(volt > 5, "unstable").when(volt > 2, "moderate").otherwise("stable"),
    })


def soc_correlations(bms: DataFrame, min_pairs: int = 2) -> DataFrame:
    """Pearson correlation of SOC with temperature, current and SOH, paired by row; 0 without spread."""
    def pearson(other: str, name: str) -> Column:
        both = F.col("soc").isNotNull() & F.col(other).isNotNull()
        x, y = F.when(both, F.col("soc")), F.when(both, F.col(other))
        flat = (F.min(x) == F.max(x)) | (F.min(y) == F.max(y))
        return F.when((F.count(x) < min_pairs) | flat, 0.0).otherwise(F.corr(x, y)).alias(name)

    return bms.groupBy("device_no").agg(
        pearson("mod_avg_temp", "soc_temp"), pearson("pack_current", "soc_current"), pearson("soh", "soc_soh")
    )


def range_counts(bms: DataFrame) -> DataFrame:
    t, s = F.col("mod_avg_temp"), F.col("soc")
    return bms.groupBy("device_no").agg(
        F.count_if(t < 15).alias("temp_cold"), F.count_if(t.between(15, 35)).alias("temp_optimal"),
        F.count_if(t > 35).alias("temp_hot"), F.count_if(s < 20).alias("soc_low"),
        F.count_if((s >= 20) & (s < 80)).alias("soc_medium"), F.count_if(s >= 80).alias("soc_high"),
    )


def battery_summary(bms: DataFrame, row_id: str = "event_id") -> DataFrame:
    """Averages, last values, evaluations and sample counts per device."""
    fields = {
        "soc": "soc", "soh": "soh", "pack_volt": "voltage", "pack_current": "current", "mod_avg_temp": "temperature",
    }
    extra = {
        "mod_max_temp": "avg_temp_max", "mod_min_temp": "avg_temp_min", "batt_internal_temp": "avg_temp_internal",
    }
    extra = {source: name for source, name in extra.items() if source in bms.columns}
    out = bms.groupBy("device_no").agg(
        *[F.avg(source).alias(f"avg_{name}") for source, name in fields.items()],
        *[latest_value(source, "msg_ts", row_id).alias(f"latest_{name}") for source, name in fields.items()],
        *[F.count(source).alias(f"{name}_points") for source, name in fields.items()],
        F.count("odometer").alias("odometer_points"),
        F.stddev_pop("pack_volt").alias("_std"),
        *[F.avg(source).alias(name) for source, name in extra.items()],
    )
    cells = F.when(F.col("voltage_points") < 2, "N/A")
    for cut, word in zip((0.1, 0.5), E.CELL_WORDS):
        cells = cells.when(F.col("_std") < cut, word)
    health = F.when(F.col("avg_soh").isNull(), "N/A").otherwise(E.grade("avg_soh", (95, 85, 70), E.HEALTH_WORDS))
    out = out.withColumns({"battery_health": health, "cell_balance": cells.otherwise(E.CELL_WORDS[2])}).drop("_std")
    if {"avg_temp_max", "avg_temp_min"} <= set(out.columns):
        both = (F.col("avg_temp_max") > 0) & (F.col("avg_temp_min") > 0)
        out = out.withColumn("temp_deviation", F.when(both, F.col("avg_temp_max") - F.col("avg_temp_min")))
    return out


def temperature_series(bms: DataFrame, row_id: str = "event_id") -> DataFrame:
    """Own temperature with the max, min and internal readings nearest within a minute, else its own."""
    others = ["mod_max_temp", "mod_min_temp", "batt_internal_temp"]
    rows = bms.select(row_id, "device_no", "msg_ts", "mod_avg_temp", *others)
    near = nearest_value(rows, ["device_no"], "msg_ts", row_id, others).where(F.col("mod_avg_temp").isNotNull())
    own = F.col("mod_avg_temp")
    return near.select(
        row_id, "device_no", "msg_ts", own.alias("temp"),
        *[F.coalesce(F.col(f"near_{s}"), own).alias(n) for s, n in zip(others, ("temp_max", "temp_min", "temp_internal"))],
    )


def temperature_events(series: DataFrame) -> DataFrame:
    """Readings with a spread above 5, or hotter than 50, or colder than -5 degrees."""
    return series.where(
        (F.col("temp_max") - F.col("temp_min") > 5) | (F.col("temp") > 50) | (F.col("temp") < -5)
    )

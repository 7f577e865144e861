"""Row layouts, column families and the thresholds every operator shares."""

from __future__ import annotations

from pyspark.sql import types as T

CELLS = 192
MODULES = 18

# Vehicle types, sensor column names, physical ranges, thresholds.
CAR_TYPES = ("BONGO3", "GV60", "PORTER2")

TEXT_COLUMNS = ("device_no", "car_type", "measured_month", "time", "msg_time", "start_time")

BMS_DOUBLES = (
    "soc", "socd", "soh", "pack_volt", "pack_current", "batt_pw", "odometer", "emobility_spd",
    "max_cell_volt", "min_cell_volt", "max_cell_volt_no", "min_cell_volt_no",
    "cellvolt_dispersion", "max_deter_cell_no", "min_deter", "min_deter_cell_no",
    "mod_avg_temp", "mod_max_temp", "mod_min_temp", "batt_internal_temp",
    "batt_coolant_inlet_temp", "batt_ltr_rear_temp", "batt_pra_busbar_temp", "ext_temp",
    "int_temp", "chrg_cnt", "chrg_cnt_q", "cumul_current_chrgd", "cumul_current_dischrgd",
    "cumul_energy_chrgd", "cumul_energy_chrgd_q", "cumul_pw_chrgd", "cumul_pw_dischrgd",
    "op_time", "seq", "msg_id", "acceptable_chrg_pw", "acceptable_dischrg_pw", "trip_chrg_pw",
    "trip_dischrg_pw", "est_chrg_time", "insul_resistance", "inverter_capacity_volt",
    "sub_batt_volt", "airbag_hwire_duty", "drive_motor_spd_1", "drive_motor_spd_2",
    "hvac_list_1", "hvac_list_2",
)
BMS_FLAGS = (
    "chrg_cable_conn", "fast_chrg_port_conn", "slow_chrg_port_conn", "fast_chrg_relay_on",
    "main_relay_conn", "bms_running", "batt_fan_running", "v2l",
)
GPS_DOUBLES = ("direction", "fuel_pct", "hdop", "lat", "lng", "speed")
GPS_TEXT = ("mode", "source", "state", "car_type")

CORE_BMS = ("soc", "soh", "pack_volt", "pack_current", "mod_avg_temp", "odometer")
CORE_GPS = ("lat", "lng", "speed", "direction", "fuel_pct", "hdop")

POINT_FIELDS = (
    "soc", "soh", "pack_volt", "pack_current", "mod_avg_temp", "max_cell_volt",
    "min_cell_volt", "odometer",
)


def _fields(names, kind) -> list[T.StructField]:
    return [T.StructField(name, kind) for name in names]


BMS = T.StructType(
    _fields(("device_no", "car_type"), T.StringType())
    + _fields(("msg_ts",), T.TimestampType())
    + _fields(BMS_DOUBLES, T.DoubleType())
    + _fields(BMS_FLAGS, T.IntegerType())
    + _fields(("cell_volt", "mod_temp"), T.ArrayType(T.DoubleType()))
)
GPS = T.StructType(
    _fields(("device_no", "car_type"), T.StringType())
    + _fields(("time",), T.TimestampType())
    + _fields(GPS_DOUBLES, T.DoubleType())
    + _fields(("mode", "source", "state"), T.StringType())
)
POINT = T.StructType(
    _fields(("measurement", "device_no", "car_type"), T.StringType())
    + _fields(("time",), T.TimestampType())
    + _fields(("field",), T.StringType())
    + _fields(("value",), T.DoubleType())
)

# Raw files hold every value as text; wide families are numbered columns.
BMS_CSV_COLUMNS = (
    TEXT_COLUMNS[:1] + ("measured_month", "time", "msg_time", "start_time")
    + BMS_DOUBLES + BMS_FLAGS
    + tuple(f"cell_volt_{i}" for i in range(1, CELLS + 1))
    + tuple(f"mod_temp_{i}" for i in range(1, MODULES + 1))
    + ("car_type",)
)
GPS_CSV_COLUMNS = (
    "device_no", "time", "direction", "fuel_pct", "hdop", "lat", "lng", "mode", "source",
    "speed", "state", "car_type",
)

# Closed physical ranges; None leaves that side open.  A value outside becomes NULL.
BMS_RULES: dict[str, tuple[float | None, float | None]] = {
    "soc": (0, 100), "socd": (0, 100), "soh": (0, 100),
    "pack_volt": (None, 3000), "max_cell_volt": (None, 3000), "min_cell_volt": (None, 3000),
    "sub_batt_volt": (None, 3000), "inverter_capacity_volt": (None, 3000),
    "mod_avg_temp": (-35, 80), "mod_max_temp": (-35, 80), "mod_min_temp": (-35, 80),
    "batt_internal_temp": (-35, 80), "batt_coolant_inlet_temp": (-35, 80),
    "batt_ltr_rear_temp": (-35, 80), "batt_pra_busbar_temp": (-35, 80),
    "ext_temp": (-35, 80), "int_temp": (-35, 80), "mod_temp": (-35, 80),
    "pack_current": (-500, 500),
    "emobility_spd": (0, 180),
    "cell_volt": (0, 6),
    "cumul_current_chrgd": (None, 1e6), "cumul_current_dischrgd": (None, 1e6),
    "cumul_energy_chrgd": (None, 1e6), "cumul_energy_chrgd_q": (None, 1e6),
    "cumul_pw_chrgd": (None, 1e6), "cumul_pw_dischrgd": (None, 1e6),
    "odometer": (5e-324, 2e6),  # zero itself is out of range
}
GPS_RULES: dict[str, tuple[float | None, float | None]] = {
    "lat": (-90, 90), "lng": (-180, 180), "speed": (0, 300), "direction": (0, 360),
    "fuel_pct": (0, 100), "hdop": (0, 50),
}

# Sessions and segments.
SOC_NOISE = 0.05            # % step that counts as sensor noise
OPEN_CURRENT = 0.5          # A needed to open a charging session
FAST_CURRENT = 2.0          # A mean above which a session is a fast one
CROSSING_CURRENT = 1.0      # A, start and end of a current-based session
ODO_RESET = -50.0           # km step read as an odometer reset
ODO_NOISE = -1.0            # km step read as noise
BREAK_MINUTES = 30.0        # stand-still that ends a driving session
SEGMENT_CURRENT = 5.0       # A beyond which a rising SOC is charging
SEGMENT_SOC = 0.1           # % rise needed for a charging segment
SEGMENT_MINUTES = 2.0       # shorter segments are dropped
PARK_MINUTES = 5.0          # stand-still from here on is parking
DRIVE_KM = 0.05             # distance above which a segment is driving
LONG_KM = 100.0             # a long trip
SHORT_TRIP_KM = 5.0         # trip-share cut
NEAR_SECONDS = 60           # tolerance of a nearest match
FAN_SECONDS = 300           # half-width of the interval join

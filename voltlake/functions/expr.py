"""Column expressions: every scalar rule of the engine as a built-in Spark expression."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Name = str | Column


def c(name: Name) -> Column:
    return F.col(name) if isinstance(name, str) else name


# ---------------------------------------------------------------- numbers and time


def rounded(value: Name, digits: int) -> Column:
    """Half-up rounding that first drops the last-bit noise of a distributed sum."""
    return F.round(F.round(c(value), 8), digits)


def micros(ts: Name) -> Column:
    """Microseconds since 1970 of a timestamp with or without zone (session zone UTC)."""
    return F.unix_micros(c(ts).cast("timestamp"))


def seconds_between(start: Name, end: Name) -> Column:
    """end - start in seconds, with fractions."""
    return (micros(end) - micros(start)) / F.lit(1e6)


def abs_diff_s(a: Name, b: Name) -> Column:
    return F.abs(seconds_between(a, b))


def as_timestamp(value) -> Column:
    """A literal or column as TIMESTAMP_NTZ, the type the telemetry tables use."""
    return (F.lit(value) if isinstance(value, str) else c(value)).cast("timestamp_ntz")


def number(text: Name) -> Column:
    """Text, boolean or number to a finite double; anything else is NULL."""
    raw = c(text).cast("string")
    plain = F.when(F.lower(raw) == "true", 1.0).when(F.lower(raw) == "false", 0.0)
    value = F.coalesce(plain, F.trim(raw).try_cast("double"))
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def safe_div(a: Name, b: Name) -> Column:
    return c(a) / F.nullif(c(b), F.lit(0.0))


def clamp(value: Name, low: float, high: float) -> Column:
    """Value held between the bounds; NULL stays NULL, which ``greatest`` alone would turn into a bound."""
    return F.when(c(value).isNotNull(), F.least(F.lit(high), F.greatest(F.lit(low), c(value))))


def at_least_zero(value: Name) -> Column:
    return F.when(c(value).isNotNull(), F.greatest(F.lit(0.0), c(value)))


def pct_change(value: Name, previous: Name) -> Column:
    """Percent change against a positive previous value, else 0."""
    return F.when(c(previous) > 0, (c(value) - c(previous)) / c(previous) * 100).otherwise(F.lit(0.0))


def format_duration(seconds: Name) -> Column:
    """Seconds as ``1h 2m 3s``, leading zero units left out."""
    whole = F.floor(c(seconds))
    h, m, s = F.floor(whole / 3600), F.floor(F.pmod(whole, F.lit(3600)) / 60), F.pmod(whole, F.lit(60))
    return (
        F.when(h > 0, F.format_string("%dh %dm %ds", h, m, s))
        .when(m > 0, F.format_string("%dm %ds", m, s))
        .otherwise(F.format_string("%ds", s))
    )


# ---------------------------------------------------------------- graded labels


def grade(value: Name, cuts: Sequence[float], labels: Sequence[str], below: bool = False) -> Column:
    """First label whose cut the value reaches (``>=``, or ``<=`` with below=True), else the last; NULL stays NULL."""
    value = c(value)
    chain = F.when(value.isNull(), F.lit(None).cast("string"))
    for cut, label in zip(cuts, labels):
        chain = chain.when(value <= cut if below else value >= cut, label)
    return chain.otherwise(labels[len(cuts)])


def label(code: Name, mapping: Mapping[str, str]) -> Column:
    """Code to display text; unknown codes show themselves."""
    chain = None
    for key, text in mapping.items():
        chain = F.when(c(code) == key, text) if chain is None else chain.when(c(code) == key, text)
    return chain.otherwise(c(code))


# Grade words and display labels of the vehicle reports.
GRADE_WORDS = ("우수", "양호", "보통", "불량")
SCORE_WORDS = ("우수", "양호", "보통", "주의", "불량")
HEALTH_WORDS = ("우수", "양호", "보통", "주의")
CELL_WORDS = ("양호", "보통", "주의")
ANOMALY_LABELS = {
    "low_soh": "저 SOH",
    "high_imbalance": "고 불균형",
    "high_temperature": "고온",
    "low_temperature": "저온",
    "low_voltage": "저전압",
    "high_voltage": "고전압",
    "extreme_current": "극한 전류",
}
HEALTH_GRADES = ("excellent", "very_good", "good", "fair", "needs_attention")
RISK_LEVELS = ("critical", "high", "medium", "low", "normal")


def soh_grade(soh: Name, words: Sequence[str] = GRADE_WORDS) -> Column:
    return grade(soh, (90, 80, 70), words)


def letter_grade(soh: Name) -> Column:
    return grade(soh, (95, 85, 70), ("A", "B", "C", "D"))


def device_grade(soh: Name) -> Column:
    return grade(soh, (95, 85, 70), GRADE_WORDS)


def health_grade(index: Name) -> Column:
    return grade(index, (95, 90, 85, 80), HEALTH_GRADES)


def risk_level(severity: Name) -> Column:
    return grade(severity, (80, 60, 40, 20), RISK_LEVELS)


# ---------------------------------------------------------------- battery


def cell_spread(volt: Name = "pack_volt") -> Column:
    """(max cell - min cell) / pack voltage; NULL where an input is missing or the voltage is not positive."""
    return F.when(c(volt) > 0, (F.col("max_cell_volt") - F.col("min_cell_volt")) / c(volt))


def cell_balance_index(default: float | None = 0.0) -> Column:
    index = cell_spread() * 100
    return index if default is None else F.coalesce(index, F.lit(float(default)))


def power_w() -> Column:
    return F.col("pack_volt") * F.col("pack_current")


def power_kw() -> Column:
    return power_w() / 1000


def balance_score() -> Column:
    return F.coalesce(at_least_zero(100 - cell_spread() * 1000), F.lit(100.0))


def temperature_score(temp: Name = "mod_avg_temp") -> Column:
    temp = c(temp)
    return (
        F.when(temp.between(15, 35), 100.0).when(temp.between(10, 40), 80.0)
        .when(temp.between(5, 45), 60.0).otherwise(40.0)
    )


def voltage_stability_score(rolling_std: Name) -> Column:
    """100 - 10 * rolling deviation, floored at 0; ``greatest`` turns a missing deviation into 0."""
    return F.when(F.col("pack_volt") > 0, F.greatest(F.lit(0.0), 100 - c(rolling_std) * 10)).otherwise(100.0)


def composite_health(variant: str = "components") -> Column:
    """Three health indices: scored components, clipped indicators, or the simple weighting."""
    if variant == "components":
        return (
            F.col("soh") * 0.40 + F.col("balance_score") * 0.25
            + F.col("temperature_score") * 0.20 + F.col("voltage_stability_score") * 0.15
        )
    if variant == "clipped":
        warmth = at_least_zero(100 - F.abs(F.col("mod_avg_temp") - 25) * 2)
        balance = at_least_zero(100 - F.col("cell_balance_index") * 10)
        return clamp(F.col("soh") * 0.4 + F.col("soc") * 0.2 + warmth * 0.2 + balance * 0.2, 0.0, 100.0)
    if variant == "simple":
        balance = at_least_zero(100 - F.col("cell_balance_index"))
        return F.col("soh") * 0.6 + F.col("soc") * 0.2 + balance * 0.2
    raise ValueError(f"unknown health index: {variant}")


def imbalance_trigger() -> Column:
    """What an imbalance coincides with; thresholds are on the balance index in percent."""
    index = F.col("cell_balance_index")
    return (
        F.when((F.abs(F.col("pack_current")) > 10) & (index > 1.5), "high_current_imbalance")
        .when((F.col("mod_avg_temp") > 45) & (index > 1.0), "high_temp_imbalance")
        .when((F.col("soc") < 20) & (index > 1.8), "low_soc_imbalance")
        .otherwise("normal_condition")
    )


def rule_anomaly() -> Column:
    """First matching rule as one struct, so the type and its severity cannot disagree."""
    spread, temp, volt = cell_spread(), F.col("mod_avg_temp"), F.col("pack_volt")
    amps = F.abs(F.col("pack_current"))

    def hit(kind: str, severity: Column) -> Column:
        return F.struct(F.lit(kind).alias("anomaly_type"), severity.cast("double").alias("anomaly_severity"))

    return (
        F.when(F.col("soh") < 90, hit("low_soh", (90 - F.col("soh")) * 2))
        .when(spread > 0.03, hit("high_imbalance", (spread - 0.03) * 1000))
        .when(temp > 50, hit("high_temperature", (temp - 50) * 2))
        .when(temp < 0, hit("low_temperature", F.abs(temp) * 2))
        .when(volt < 300, hit("low_voltage", (300 - volt) * 0.5))
        .when(volt > 450, hit("high_voltage", (volt - 450) * 0.5))
        .when(amps > 50, hit("extreme_current", (amps - 50) * 2))
        .otherwise(hit("normal", F.lit(0.0)))
    )


# ---------------------------------------------------------------- states


def operation_mode(current: Name = "pack_current") -> Column:
    return F.when(c(current) > 0, "charging").when(c(current) < 0, "discharging").otherwise("idle")


def charging_status(
    current: Name = "pack_current", cable: Name = "chrg_cable_conn",
    fast: Name | None = None, slow: Name | None = None,
) -> Column:
    """Charging flags as a struct; an unknown input leaves its flag NULL."""
    charging = c(current) > 0.5
    connected = c(cable) == 1
    nothing = F.lit(None).cast("boolean")
    return F.struct(
        charging.alias("is_charging"),
        connected.alias("is_cable_connected"),
        (nothing if fast is None else c(fast) == 1).alias("is_fast_charging"),
        (nothing if slow is None else c(slow) == 1).alias("is_slow_charging"),
        F.when(charging, "charging").when(connected, "connected").otherwise("disconnected").alias("charging_status"),
    )


def vehicle_status(variant: str = "current", current: Name = "pack_current", speed: Name = "speed") -> Column:
    if variant == "current":
        return F.when(c(current) > 1, "charging").when(c(current) < -1, "discharging").otherwise("idle")
    if variant == "speed":
        return (
            F.when(c(current) > 0, "charging")
            .when((c(current) < 0) & (c(speed) > 5), "driving").otherwise("idle")
        )
    if variant == "moving":
        return F.when(c(speed) > 5, "moving").when(c(current) > 0.5, "charging").otherwise("stopped")
    raise ValueError(f"unknown status rule: {variant}")


def driving_mode(speed: Name = "speed", variant: str = "above") -> Column:
    """Speed band: above 80/40/20/5, or from 80/50/20/5 on; unknown speed stands still."""
    words = ("highway", "urban_highway", "urban", "slow_urban")
    if variant == "above":
        tests = [c(speed) > cut for cut in (80, 40, 20, 5)]
    else:
        tests = [c(speed) >= cut for cut in (80, 50, 20, 5)]
    chain = F.when(tests[0], words[0])
    for test, word in zip(tests[1:], words[1:]):
        chain = chain.when(test, word)
    return chain.otherwise("stationary")


def stability_label(variability: Name, spread: Name) -> Column:
    return (
        F.when((c(variability) < 1000) & (c(spread) < 10), "stable")
        .when((c(variability) < 2000) & (c(spread) < 15), "moderate").otherwise("variable")
    )


def response_quality(variability: Name, sensitivity: Name) -> Column:
    return (
        F.when((c(variability) < 0.5) & (c(sensitivity) < 2), "excellent")
        .when((c(variability) < 1.0) & (c(sensitivity) < 5), "good")
        .when((c(variability) < 2.0) & (c(sensitivity) < 10), "moderate").otherwise("poor")
    )


def recency_quality(updated: Name, as_of: str) -> Column:
    day = F.lit(as_of).cast("date")
    stamp = c(updated).cast("timestamp_ntz")
    return (
        F.when(stamp >= F.date_sub(day, 7).cast("timestamp_ntz"), "HIGH")
        .when(stamp >= F.date_sub(day, 30).cast("timestamp_ntz"), "MEDIUM").otherwise("LOW")
    )


def count_quality(rows: Name) -> Column:
    return grade(rows, (100, 50), ("high", "medium", "low"))


def staleness(updated: Name, as_of: str) -> Column:
    """Whole seconds since the last update; below an hour the vehicle counts as active."""
    return F.floor(seconds_between(updated, as_timestamp(as_of)))


# ---------------------------------------------------------------- calendar


def season(ts: Name, by: str = "month") -> Column:
    if by == "quarter":
        q = F.quarter(c(ts))
        return F.when(q == 1, "spring").when(q == 2, "summer").when(q == 3, "fall").otherwise("winter")
    m = F.month(c(ts))
    return (
        F.when(m.between(3, 5), "spring").when(m.between(6, 8), "summer")
        .when(m.between(9, 11), "fall").otherwise("winter")
    )


def season_number(ts: Name) -> Column:
    """Winter 0, spring 1, summer 2, fall 3."""
    return F.floor(F.pmod(F.month(c(ts)), F.lit(12)) / 3).cast("int")


def day_part(ts: Name) -> Column:
    h = F.hour(c(ts))
    return F.when(h < 6, "night").when(h < 12, "morning").when(h < 18, "afternoon").otherwise("evening")


def calendar_features(ts: Name) -> list[Column]:
    return [
        F.hour(c(ts)).alias("hour"), F.weekday(c(ts)).alias("day_of_week"),
        F.month(c(ts)).alias("month"), season_number(ts).alias("season"),
    ]


def encode_type(car_type: Name = "car_type") -> Column:
    from voltlake.schema import CAR_TYPES

    chain = None
    for code, name in enumerate(CAR_TYPES):
        test = c(car_type) == name
        chain = F.when(test, code) if chain is None else chain.when(test, code)
    # Any other type has a code of its own behind the known ones; no type at all is -1.
    other = len(CAR_TYPES) + F.pmod(F.xxhash64(c(car_type)), F.lit(1_000_003)).cast("int")
    return chain.when(c(car_type).isNull(), -1).otherwise(other)


def month_key(ts: Name) -> Column:
    return F.date_format(c(ts), "yyyy-MM")

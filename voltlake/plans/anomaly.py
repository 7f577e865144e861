"""Rule anomalies per row and z-score anomalies per vehicle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltlake.functions import expr as E
from voltlake.functions.expr import rounded
from voltlake.operators.select import latest_rows, latest_value, where_opt

INDICATORS = ("soh", "health", "balance", "temp")


def rule_anomalies(bms: DataFrame, latest_only: bool = False, row_id: str = "event_id") -> DataFrame:
    """Rows that break a rule, with the first broken rule, its severity and risk level."""
    rows = bms.where(F.col("soh").isNotNull() & (F.col("pack_volt") > 0))
    judged = rows.select(
        row_id, "device_no", "car_type", "msg_ts", "soc", "soh", E.rule_anomaly().alias("_rule")
    ).select(row_id, "device_no", "car_type", "msg_ts", "soc", "soh", "_rule.*")
    if latest_only:
        judged = latest_rows(judged, ["device_no"], "msg_ts", row_id)
    return judged.where(F.col("anomaly_type") != "normal").withColumn("risk_level", E.risk_level("anomaly_severity"))


def labelled(anomalies: DataFrame) -> DataFrame:
    return anomalies.withColumn("anomaly_label", E.label("anomaly_type", E.ANOMALY_LABELS))


def anomaly_stats(anomalies: DataFrame) -> DataFrame:
    return anomalies.groupBy("risk_level", "anomaly_type").agg(
        F.count("*").alias("occurrence_count"),
        F.count_distinct("device_no").alias("affected_vehicles"),
        rounded(F.avg("anomaly_severity"), 2).alias("avg_severity"),
        F.max("anomaly_severity").alias("max_severity"),
    )


def anomaly_by_car_type(anomalies: DataFrame) -> DataFrame:
    return anomalies.groupBy("car_type").agg(
        F.count("*").alias("total_anomalies"),
        *[F.count_if(F.col("risk_level") == r).alias(f"{r}_count") for r in ("critical", "high", "medium", "low")],
        rounded(F.avg("anomaly_severity"), 2).alias("avg_severity"),
    )


def device_indicators(bms: DataFrame, row_id: str = "event_id", default: float | None = None) -> DataFrame:
    """Last known indicators per device and the clipped health index.

    A missing sensor stays NULL; ``default=0`` counts it as 0 instead.
    """
    fields = ("soh", "soc", "pack_volt", "mod_avg_temp", "max_cell_volt", "min_cell_volt")
    last = bms.groupBy("device_no").agg(
        F.upper(latest_value("car_type", "msg_ts", row_id)).alias("car_type"),
        *[latest_value(name, "msg_ts", row_id).alias(name) for name in fields],
        F.max("msg_ts").alias("last_updated"),
    )
    if default is not None:
        last = last.fillna(default, subset=list(fields))
    balance = F.when(
        (F.col("pack_volt") > 0) & (F.col("max_cell_volt") != 0) & (F.col("min_cell_volt") != 0), E.cell_spread() * 100
    ).otherwise(0.0)
    return last.withColumn("cell_balance_index", balance).withColumn("composite_health_index", E.composite_health("clipped"))


def explain_anomaly() -> Column:
    """English sentence naming the baseline of the vehicle type and the difference."""
    parts = {
        "soh_anomaly": ("SOH", "soh", "baseline_soh", "%%"),
        "health_anomaly": ("Health index", "composite_health_index", "baseline_health", ""),
        "balance_anomaly": ("Cell balance index", "cell_balance_index", "baseline_balance", "%%"),
        "temp_anomaly": ("Battery temperature", "mod_avg_temp", "baseline_temp", " C"),
    }
    chain = None
    for kind, (what, value, base, unit) in parts.items():
        gap = F.col(value) - F.col(base)
        text = F.format_string(
            f"{what} is %.1f{unit} %s the type average of %.1f{unit}",
            F.abs(gap), F.when(gap < 0, "below").otherwise("above"), F.col(base),
        )
        chain = F.when(F.col("anomaly_type") == kind, text) if chain is None else chain.when(F.col("anomaly_type") == kind, text)
    return chain.otherwise("Within the normal range")


def zscore_all(indicators: DataFrame) -> DataFrame:
    """Four absolute z-scores per vehicle against its type; means take positive values only."""
    source = dict(zip(INDICATORS, ("soh", "composite_health_index", "cell_balance_index", "mod_avg_temp")))
    base = indicators.groupBy("car_type").agg(
        *[F.avg(F.when(F.col(s) > 0, F.col(s))).alias(f"baseline_{n}") for n, s in source.items()],
        *[F.stddev_samp(F.when(F.col(s) > 0, F.col(s))).alias(f"_std_{n}") for n, s in source.items()],
    )
    scored = indicators.join(base, "car_type").withColumns({
        f"{n}_zscore": F.coalesce(
            F.when(F.col(f"_std_{n}") > 0, F.abs((F.col(s) - F.col(f"baseline_{n}")) / F.col(f"_std_{n}"))), F.lit(0.0)
        )
        for n, s in source.items()
    })
    kind = None
    for n in INDICATORS:
        hit = F.col(f"{n}_zscore") > 2.5
        kind = F.when(hit, f"{n}_anomaly") if kind is None else kind.when(hit, f"{n}_anomaly")
    scored = scored.withColumn("max_zscore", F.greatest(*[f"{n}_zscore" for n in INDICATORS]))
    peak = F.col("max_zscore")
    risk = F.when(peak > 3.0, "critical").when(peak > 2.5, "high").when(peak > 2.0, "medium").otherwise("low")
    return scored.withColumns({"anomaly_type": kind.otherwise("normal"), "risk_level": risk})


def zscore_anomalies(bms: DataFrame, anomaly_type: str | None = None, row_id: str = "event_id") -> DataFrame:
    """Vehicles whose last state is unusual for their type, most unusual first."""
    found = zscore_all(device_indicators(bms, row_id)).where(F.col("anomaly_type") != "normal")
    found = where_opt(found, anomaly_type=anomaly_type).withColumn("anomaly_description", explain_anomaly())
    two = [f"{n}_zscore" for n in INDICATORS] + [f"baseline_{n}" for n in INDICATORS]
    two += ["max_zscore", "composite_health_index", "cell_balance_index"]
    return found.select(
        "device_no", "car_type", "soh", "mod_avg_temp", "last_updated", "anomaly_type", "risk_level",
        "anomaly_description", *[rounded(name, 2).alias(name) for name in two],
    )


def anomaly_distribution(found: DataFrame) -> DataFrame:
    """Vehicles per anomaly type, one column per risk level."""
    return found.groupBy("anomaly_type").agg(
        F.count("*").alias("total"),
        *[F.count_if(F.col("risk_level") == r).alias(r) for r in ("critical", "high", "medium", "low")],
    )

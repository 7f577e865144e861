"""Vehicle rankings and the weighted vehicle score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltlake.functions import expr as E
from voltlake.functions.expr import rounded
from voltlake.operators.select import latest_value, top_k, where_opt
from voltlake.operators.sequence import global_row_number, settled

CATEGORIES = ("TOP_10", "HIGH_PERFORMANCE", "AVERAGE", "NEEDS_ATTENTION")


def overall_score() -> Column:
    balance = E.at_least_zero(100 - F.col("cell_balance_index"))
    return rounded(F.col("latest_soh") * 0.50 + F.col("latest_soc") * 0.30 + balance * 0.20, 2)


def percentile(ranked: DataFrame, score: str, rank: str, total: str, name: str) -> DataFrame:
    """PERCENT_RANK * 100 from row numbers along falling scores: the rows behind the last of a score's ties."""
    below = ranked.groupBy(F.col(score).alias("_score")).agg(F.max(rank).alias("_last"))
    place = F.when(F.col(total) > 1, (F.col(total) - F.col("_last")) / (F.col(total) - 1) * 100).otherwise(0.0)
    return ranked.join(below, F.col(score).eqNullSafe(F.col("_score"))).withColumn(name, place).drop("_score", "_last")


def vehicle_rankings(vehicles: DataFrame) -> DataFrame:
    """Ranks by score, SOH and SOC (ties by vehicle id) and a percentile category."""
    ranked = settled(vehicles.where(F.col("latest_soh").isNotNull()).select(
        "vehicle_id", "vehicle_type", "latest_soh", "latest_soc",
        F.col("cell_balance_index").alias("avg_efficiency"), overall_score().alias("overall_score"),
    ))
    for name, column in (("soh_rank", "latest_soh"), ("soc_rank", "latest_soc"), ("overall_rank", "overall_score")):
        order = [F.col(column).desc_nulls_last(), F.col("vehicle_id").asc()]
        ranked = global_row_number(ranked, name, order, total="_total" if name == "overall_rank" else None)
    return percentile(ranked, "overall_score", "overall_rank", "_total", "_pct").withColumn(
        "performance_category", E.grade("_pct", (90, 75, 50), CATEGORIES)
    ).drop("_pct", "_total")


def top_vehicles(
    rankings: DataFrame, metric: str = "overall", top_n: int = 20, limit: int = 50, car_type: str | None = None,
) -> DataFrame:
    column = {"overall": "overall_score", "soh": "latest_soh", "soc": "latest_soc", "efficiency": "avg_efficiency"}[metric]
    return top_k(where_opt(rankings, vehicle_type=car_type), [column], "vehicle_id", min(top_n, limit))


def category_counts(rankings: DataFrame) -> DataFrame:
    return rankings.groupBy("performance_category").agg(F.count("*").alias("vehicles"))


def _piecewise(value: str, knots: list[tuple[float, float, float]], below: Column) -> Column:
    """Score base + slope * (value - cut) of the first cut the value reaches."""
    v = F.col(value)
    chain = None
    for cut, base, slope in knots:
        step = base + (v - cut) * slope
        chain = F.when(v >= cut, step) if chain is None else chain.when(v >= cut, step)
    return chain.otherwise(below)


def score_vehicle(bms: DataFrame, as_of: str, row_id: str = "event_id", default: float | None = 0.0) -> DataFrame:
    """Weighted score of each vehicle's last state: SOH, health, balance, freshness, activity."""
    fields = ("soh", "soc", "pack_volt", "pack_current", "mod_avg_temp", "odometer", "max_cell_volt", "min_cell_volt")
    last = bms.groupBy("device_no").agg(
        latest_value("car_type", "msg_ts", row_id).alias("car_type"),
        *[latest_value(name, "msg_ts", row_id).alias(name) for name in fields],
        F.max("msg_ts").alias("last_updated"),
    )
    if default is not None:
        last = last.fillna(default, subset=list(fields))
    positive = (F.col("max_cell_volt") > 0) & (F.col("min_cell_volt") > 0)
    state = last.withColumn(
        "cell_balance_index", F.coalesce(F.when(positive, E.cell_spread() * 100), F.lit(0.0))
    ).withColumn("composite_health_index", E.composite_health("simple"))
    soh, health, index, odo = (F.col(n) for n in ("soh", "composite_health_index", "cell_balance_index", "odometer"))
    days = E.seconds_between("last_updated", E.as_timestamp(as_of)) / 86_400
    scores = {
        "soh_score": _piecewise("soh", [(90, 100, 0), (80, 80, 2), (70, 60, 2), (60, 40, 2)], soh * 0.67),
        "health_score": _piecewise(
            "composite_health_index", [(90, 100, 0), (80, 80, 1), (70, 60, 1), (60, 40, 1)], health * 0.67
        ),
        "balance_score": (
            F.when(index <= 0.5, 100.0).when(index <= 1.0, 90 - (index - 0.5) * 20)
            .when(index <= 2.0, 80 - (index - 1.0) * 10).when(index <= 3.0, 70 - (index - 2.0) * 10)
            .otherwise(F.greatest(F.lit(20.0), 60 - (index - 3.0) * 5))
        ),
        "freshness_score": F.when(days <= 7, 100.0).when(days <= 30, 80.0).when(days <= 90, 60.0).otherwise(40.0),
        "activity_score": (
            F.when(odo >= 10000, 100.0).when(odo >= 5000, 80 + (odo - 5000) / 5000 * 20)
            .when(odo >= 1000, 60 + (odo - 1000) / 4000 * 20).when(odo >= 100, 40 + (odo - 100) / 900 * 20)
            .otherwise(odo / 100 * 40)
        ),
    }
    total = (
        F.col("soh_score") * 0.3 + F.col("health_score") * 0.25 + F.col("balance_score") * 0.2
        + F.col("freshness_score") * 0.15 + F.col("activity_score") * 0.1
    )
    return state.withColumns(scores).withColumn("overall_score", rounded(total, 2)).select(
        "device_no", "car_type", "soh", "soc", "pack_volt", "pack_current", "mod_avg_temp", "odometer",
        "cell_balance_index", "composite_health_index", "last_updated", "overall_score",
        E.grade("overall_score", (90, 80, 70, 60), E.SCORE_WORDS).alias("performance_grade"),
    )

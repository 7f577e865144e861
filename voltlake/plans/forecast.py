"""State-of-health forecasts: per-device lines, the seasonal fleet model, comparisons and advice."""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voltlake.functions import expr as E
from voltlake.functions.expr import rounded
from voltlake.operators.select import head_per_key
from voltlake.operators.sequence import in_sequence, running, settled, sliced, unsliced

YEAR_DAYS = 365.25
Z80 = 1.2815515655446004  # half-width of an 80 % normal interval, in deviations


def _soh_rows(bms: DataFrame, row_id: str) -> DataFrame:
    return bms.where(F.col("soh") > 0).select("device_no", "car_type", row_id, "msg_ts", "soh")


def daily_soh(bms: DataFrame, min_points: int = 5) -> DataFrame:
    """Fleet mean SOH per day, days with too few points left out."""
    rows = bms.where(F.col("soh").isNotNull())
    return rows.groupBy(F.to_date("msg_ts").alias("ds")).agg(
        F.avg("soh").alias("y"), F.count("*").alias("data_count")
    ).where(F.col("data_count") >= min_points)


def _soh_ends(row_id: str) -> list[Column]:
    """Aggregates: first and last reading, the days between them, their number."""
    at = F.struct("msg_ts", row_id)
    return [
        F.min_by("soh", at).alias("first_soh"), F.max_by("soh", at).alias("last_soh"),
        (E.seconds_between(F.min("msg_ts"), F.max("msg_ts")) / 86_400).alias("days"), F.count("*").alias("points"),
    ]


def _rate() -> Column:
    return E.safe_div(F.col("first_soh") - F.col("last_soh"), "days")


def degradation_rates(bms: DataFrame, row_id: str = "event_id") -> DataFrame:
    """SOH lost per day between the first and last reading of each device with at least two."""
    ends = bms.where(F.col("soh").isNotNull()).groupBy("device_no", "car_type").agg(*_soh_ends(row_id))
    return ends.where(F.col("points") >= 2).withColumn("degradation_rate", _rate())


def compare_to_fleet(rates: DataFrame) -> DataFrame:
    """Each degrading device against the mean of its type: worse, average or better at 20 %."""
    falling = rates.where(F.col("degradation_rate") > 0)
    means = falling.groupBy("car_type").agg(
        F.avg("degradation_rate").alias("average_degradation_rate"), F.count("*").alias("total_vehicles_compared")
    )
    rate, mean = F.col("degradation_rate"), F.col("average_degradation_rate")
    word = F.when(rate > mean * 1.2, "worse").when(rate < mean * 0.8, "better").otherwise("average")
    return falling.join(means, "car_type").select(
        "device_no", "car_type", "degradation_rate", "average_degradation_rate", "total_vehicles_compared",
        word.alias("comparison"),
    )


def _confidence(points: str, spread: Column) -> Column:
    amount, steady = F.least(F.lit(1.0), F.col(points) / 50), F.greatest(F.lit(0.1), 1 - spread / 10)
    return F.when(F.col(points) < 10, 0.3).otherwise(rounded(amount * 0.6 + steady * 0.4, 2))


def forecast_confidence(bms: DataFrame) -> DataFrame:
    """Confidence from the number and spread of SOH readings; 0.3 below ten readings."""
    base = bms.where(F.col("soh") > 0).groupBy("device_no").agg(
        F.count("*").alias("points"), F.stddev_pop("soh").alias("_std")
    )
    return base.select(
        "device_no", "points", _confidence("points", F.col("_std")).alias("confidence"),
        rounded(F.least(F.lit(1.0), F.col("points") / 100), 2).alias("count_confidence"),
    )


def forecast_soh_linear(bms: DataFrame, days: int = 30, min_points: int = 10, row_id: str = "event_id") -> DataFrame:
    """OLS of SOH on the sample index per device, continued for ``days`` days and clipped to 0..100."""
    rows = sliced(in_sequence(_soh_rows(bms, row_id), "device_no", "msg_ts"), ["device_no"], "msg_ts", [row_id])
    indexed = unsliced(running(rows, ["device_no"], ["msg_ts", row_id], sums={"_n": F.lit(1)}))
    index = (F.col("_n") - 1).cast("double")
    lines = indexed.groupBy("device_no").agg(
        F.regr_slope("soh", index).alias("slope"), F.regr_intercept("soh", index).alias("intercept"),
        F.count("*").alias("points"), F.max("msg_ts").alias("last_time"),
        (E.seconds_between(F.min("msg_ts"), F.max("msg_ts")) / 86_400).alias("_span"),
    ).where(F.col("points") >= min_points)
    step = F.col("_span") / (F.col("points") - 1)
    ahead = lines.withColumn("days_from_now", F.explode(F.sequence(F.lit(1), F.lit(days))))
    at = F.col("points") - 1 + E.safe_div("days_from_now", step)
    return ahead.select(
        "device_no", "days_from_now",
        F.to_date(F.col("last_time") + F.make_dt_interval(F.col("days_from_now"))).alias("date"),
        E.clamp(F.col("slope") * at + F.col("intercept"), 0.0, 100.0).alias("predicted_soh"),
    )


def recommend(predicted: str = "predicted_soh", comparison: str | None = "comparison") -> Column:
    """Advice and priority from the last forecast and the comparison with the fleet."""
    def say(message: str, priority: str) -> Column:
        return F.struct(F.lit(message).alias("message"), F.lit(priority).alias("priority"))

    worse = F.lit(False) if comparison is None else F.coalesce(F.col(comparison) == "worse", F.lit(False))
    return (
        F.when(F.col(predicted) < 70, say("Battery replacement is expected; visit a service centre.", "high"))
        .when(F.col(predicted) < 80, say("Battery degradation is expected; have it checked regularly.", "medium"))
        .when(worse, say("The battery degrades faster than others of its type; have it checked early.", "medium"))
        .otherwise(say("The battery is in good condition; keep regular checks.", "low"))
    )


def recent_history(bms: DataFrame, n: int = 30, row_id: str = "event_id") -> DataFrame:
    """Last n SOH readings per device."""
    rows = _soh_rows(bms, row_id)
    return head_per_key(rows, ["device_no"], [F.col("msg_ts").desc(), F.col(row_id).desc()], n)


def soh_report(bms: DataFrame, forecast: DataFrame, row_id: str = "event_id", readings: int = 30) -> DataFrame:
    """One row per device: current SOH, last forecast, degradation, confidence, comparison, advice, history.

    Current value, ends, count and spread come from one grouped pass, written because the comparison with the type
    reads it again; the last readings are kept to ``readings`` a device before they are shuffled.
    """
    final = forecast.groupBy("device_no").agg(
        F.max("days_from_now").alias("prediction_days"), F.max_by("predicted_soh", "days_from_now").alias("predicted_soh")
    )
    at, positive = F.struct("msg_ts", row_id), F.when(F.col("soh") > 0, F.col("soh"))
    by_type = settled(bms.where(F.col("soh").isNotNull()).groupBy("device_no", "car_type").agg(
        *_soh_ends(row_id), F.max_by(positive, F.when(F.col("soh") > 0, at)).alias("_now"),
        F.max(F.when(F.col("soh") > 0, at)).alias("_at"), F.count(positive).alias("_n"), F.sum(positive).alias("_sum"),
        F.sum(positive * positive).alias("_squares"),
    ))
    rates = by_type.where(F.col("points") >= 2).withColumn("degradation_rate", _rate())
    # A device counts once for its value and its confidence, whatever types its rows name.
    whole = by_type.groupBy("device_no").agg(
        F.max_by("_now", "_at").alias("current_soh"), F.sum("_n").alias("_n"),
        F.sum("_sum").alias("_sum"), F.sum("_squares").alias("_squares"))
    history = recent_history(bms, readings, row_id).groupBy("device_no").agg(
        F.sort_array(F.collect_list(F.struct("msg_ts", row_id, "soh"))).alias("history")
    )
    out = (
        final.join(whole.where(F.col("current_soh").isNotNull()), "device_no")
        .join(rates.select("device_no", "degradation_rate"), "device_no", "left")
        .join(compare_to_fleet(rates).select("device_no", "average_degradation_rate", "comparison"), "device_no", "left")
        .join(history, "device_no", "left")
    )
    mean = F.col("_sum") / F.col("_n")
    spread = F.sqrt(F.greatest(F.lit(0.0), F.col("_squares") / F.col("_n") - mean * mean))
    return out.withColumns({
        "comparison": F.coalesce("comparison", F.lit("unknown")), "confidence": _confidence("_n", spread),
    }).withColumn("_advice", recommend()).select("*", "_advice.*").drop("_advice", "_n", "_sum", "_squares")


# ---------------------------------------------------------------- seasonal fleet model


@dataclass(frozen=True)
class SeasonalModel:
    """Trend with bends plus a yearly wave, fitted by ridge regression; the first coefficient is the level."""

    coefficients: tuple[float, ...]
    origin: str
    span_days: float
    sigma: float
    bends: int
    waves: int


def _seasonal_columns(ds: str, origin: str, span_days: float, bends: int, waves: int) -> list[Column]:
    day = F.datediff(F.col(ds), F.lit(origin).cast("date")).cast("double")
    t = day / max(span_days, 1.0)
    # Bends lie in the first 80 % of the history, so the last slope rests on data.
    hinges = [F.greatest(F.lit(0.0), t - 0.8 * (i + 1) / (bends + 1)) for i in range(bends)]
    year = [
        wave(day * (2 * math.pi * (k + 1) / YEAR_DAYS)) for k in range(waves) for wave in (F.sin, F.cos)
    ]
    return [t, *hinges, *year]


def fit_soh_seasonal(daily: DataFrame, bends: int = 5, waves: int = 3, ridge: float = 1e-4) -> SeasonalModel:
    """Additive trend and yearly season on the daily fleet mean, at any length of history; the ridge keeps small
    what the history does not show.

    The normal equations are one aggregate: products of all pairs of columns, summed over the days in each task.
    The driver solves them, one equation for each column, however long the history is. ``ridge`` times the number
    of days is added to the squares of all columns but the level's.
    """
    first, last, count = daily.agg(F.min("ds"), F.max("ds"), F.count("*")).first()
    if count < 2:
        raise ValueError("the seasonal model needs at least two days")
    span, origin = float((last - first).days), first.isoformat()
    columns = [F.lit(1.0), *_seasonal_columns("ds", origin, span, bends, waves), F.col("y").cast("double")]
    row = daily.where(F.col("y").isNotNull()).select(*[column.alias(f"x{i}") for i, column in enumerate(columns)])
    pairs = [(i, j) for i in range(len(columns)) for j in range(i + 1)]
    sums = row.agg(*[F.sum(F.col(f"x{i}") * F.col(f"x{j}")) for i, j in pairs]).first()
    gram = np.zeros((len(columns), len(columns)))
    for (i, j), value in zip(pairs, sums):
        gram[i, j] = gram[j, i] = value
    inner, right, days = gram[:-1, :-1], gram[:-1, -1], gram[0, 0]
    penalty = np.diag([0.0] + [ridge * days] * (len(inner) - 1))
    found = np.linalg.solve(inner + penalty, right)
    error = gram[-1, -1] - 2 * found @ right + found @ inner @ found
    return SeasonalModel(tuple(found.tolist()), origin, span, math.sqrt(max(error, 0.0) / days), bends, waves)


def forecast_soh_seasonal(model: SeasonalModel, starts: DataFrame, days: int) -> DataFrame:
    """The next days after each start date (columns device_no, last_date), with 80 % bounds, clipped."""
    ahead = starts.withColumn("days_from_now", F.explode(F.sequence(F.lit(1), F.lit(days))))
    dated = ahead.withColumn("date", F.date_add(F.col("last_date"), F.col("days_from_now")))
    columns = _seasonal_columns("date", model.origin, model.span_days, model.bends, model.waves)
    level, *slopes = model.coefficients
    expected = reduce(lambda total, part: total + part[0] * F.lit(part[1]), zip(columns, slopes), F.lit(level))

    def value(shift: float) -> Column:
        return rounded(E.clamp(F.col("_expected") + shift * model.sigma, 0.0, 100.0), 2)

    return dated.withColumn("_expected", expected).select(
        "device_no", "date", "days_from_now", value(0.0).alias("predicted_soh"),
        value(-Z80).alias("lower_bound"), value(Z80).alias("upper_bound"),
    )


def horizon_days(start: str, end: str) -> int:
    from datetime import date

    return (date.fromisoformat(end) - date.fromisoformat(start)).days


def last_dates(bms: DataFrame) -> DataFrame:
    return bms.where(F.col("soh").isNotNull()).groupBy("device_no").agg(F.to_date(F.max("msg_ts")).alias("last_date"))


_MODEL = "coefficients array<double>, origin string, span_days double, sigma double, bends int, waves int"


def save_model(model: SeasonalModel, path: str) -> None:
    """One JSON row."""
    row = {**asdict(model), "coefficients": list(model.coefficients)}
    SparkSession.active().createDataFrame([row], _MODEL).coalesce(1).write.mode("overwrite").json(path)


def load_model(path: str) -> SeasonalModel:
    row = SparkSession.active().read.schema(_MODEL).json(path).first().asDict()
    return SeasonalModel(**{**row, "coefficients": tuple(row["coefficients"])})

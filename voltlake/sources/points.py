"""Long-format points: scan, wide to long, long to wide."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltlake.operators.select import between_time


def scan_points(
    points: DataFrame, measurement: str | None = None, fields: Sequence[str] | None = None,
    start: str | None = None, stop: str | None = None, car_type: str | None = None,
    device_no: str | None = None, pattern: str | None = None,
) -> DataFrame:
    """Points with a value: start inclusive, stop exclusive, by measurement, tag and field."""
    out = points.where(F.col("value").isNotNull() & ~F.isnan("value"))
    if measurement is not None:
        out = out.where(F.col("measurement") == measurement)
    if fields is not None:
        out = out.where(F.col("field").isin(*fields))
    if pattern is not None:
        out = out.where(F.col("field").rlike(pattern))
    out = between_time(out, "time", start, stop)
    if car_type is not None:
        out = out.where(F.col("car_type") == car_type.upper())
    if device_no is not None:
        out = out.where(F.col("device_no") == device_no)
    return out


def to_points(
    wide: DataFrame, fields: Sequence[str], time: str, measurement: str = "bms", extra: Sequence[str] = (),
) -> DataFrame:
    """Wide rows to one row per present field value."""
    return (
        wide.unpivot([*extra, "device_no", "car_type", time], list(fields), "field", "value")
        .where(F.col("value").isNotNull())
        .select(*extra, F.lit(measurement).alias("measurement"), "device_no", "car_type",
                F.col(time).alias("time"), "field", "value")
    )


def pivot_points(points: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Points to wide rows, the mean of repeated values; the field list makes it one pass."""
    return (
        points.where(F.col("field").isin(*fields)).groupBy("time", "device_no", "car_type")
        .agg(*[F.avg(F.when(F.col("field") == name, F.col("value"))).alias(name) for name in fields])
    )

"""Incremental forms of the batch plans on Structured Streaming."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voltlake.functions import expr as E
from voltlake.operators.sequence import settled
from voltlake.plans.anomaly import rule_anomalies

CELL_REACHES = 2  # an aligned position is then kept twice on average, and two rows are tested for each pair


def timed(rows: DataFrame, ts: str) -> DataFrame:
    """Watermarks need TIMESTAMP, the tables carry TIMESTAMP_NTZ (session zone UTC)."""
    return rows.withColumn(ts, F.col(ts).cast("timestamp"))


def stream_anomalies(bms: DataFrame, row_id: str = "event_id") -> DataFrame:
    """Rule anomalies of arriving rows; no state."""
    return rule_anomalies(bms, row_id=row_id)


def windowed_fleet_stats(bms: DataFrame, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Statistics per type and time window; rows later than the watermark are dropped."""
    rows = timed(bms, "msg_ts").withWatermark("msg_ts", late)
    return rows.groupBy(F.window("msg_ts", length), "car_type").agg(
        F.count("*").alias("data_points"),
        F.avg("soc").alias("avg_soc"), F.avg("soh").alias("avg_soh"), F.avg("mod_avg_temp").alias("avg_temp"),
        F.avg(E.cell_balance_index(None)).alias("avg_balance_index"),
        F.count_if(F.col("pack_current") > 0).alias("charging_rows"),
    ).select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "*").drop("window")


def align_streams(
    bms: DataFrame, gps: DataFrame, seconds: int = 300, late: str = "10 minutes",
) -> DataFrame:
    """Battery rows with every position within the interval; rows without one appear once the watermark passes."""
    # Time cells in the key spread the state of a busy device; a position is kept for each cell that it reaches.
    reach = seconds * 1_000_000
    width = CELL_REACHES * reach
    first, last = (F.floor((F.unix_micros("time") + way * reach) / width) for way in (-1, 1))
    left = timed(bms, "msg_ts").withWatermark("msg_ts", late).withColumn("_cell", F.floor(F.unix_micros("msg_ts") / width)).alias("b")
    right = (
        timed(gps, "time").withWatermark("time", late)
        .withColumn("_cell", F.explode(F.sequence(first, last))).alias("g")
    )
    gap = F.expr(f"INTERVAL {seconds} SECONDS")
    near = (
        (F.col("b.device_no") == F.col("g.device_no")) & (F.col("b._cell") == F.col("g._cell"))
        & (F.col("g.time") >= F.col("b.msg_ts") - gap) & (F.col("g.time") <= F.col("b.msg_ts") + gap)
    )
    return left.join(right, near, "left").select(
        *[F.col(f"b.{name}") for name in bms.columns],
        *[F.col(f"g.{name}").alias(f"gps_{name}") for name in ("time", "speed", "lat", "lng")],
    )


def charging_by_gap(bms: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Charging sessions as runs of charging rows without a pause longer than the gap.

    With spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition set in the session, rows are
    merged into sessions inside each input task first, so a busy device sends few sessions.
    """
    # Every row moves the watermark, charging or not: a test that names the time is not pushed below it.
    charging = F.when(F.col("msg_ts").isNotNull(), F.col("pack_current") > 0)
    rows = timed(bms, "msg_ts").withWatermark("msg_ts", late).where(charging)
    return rows.groupBy("device_no", F.session_window("msg_ts", gap)).agg(
        F.count("*").alias("charging_rows"), F.avg("pack_current").alias("avg_current"),
        F.min("soc").alias("min_soc"), F.max("soc").alias("max_soc"), F.max("msg_ts").alias("last_row"),
    ).select(
        "device_no", F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"),
        "charging_rows", "avg_current", "min_soc", "max_soc", "last_row",
    )


def distinct_stream(bms: DataFrame, keys: list[str], ts: str = "msg_ts", late: str = "1 hour") -> DataFrame:
    """First row per key within the watermark."""
    return timed(bms, ts).withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def end_marker(rows: DataFrame, ts: str, after: str = "10 days", **fixed) -> DataFrame:
    """One row that ends a bounded input: ``after`` behind its last time, the ``fixed`` values, NULL elsewhere.

    Appended to a stream's source when no more rows will come, it moves the watermark past all of them, and
    the next run emits every window, session and unmatched row that was still open.
    """
    last = rows.agg(F.max(ts).alias("_last"))
    return last.select(*[
        (F.col("_last") + F.expr(f"INTERVAL {after}")).cast(field.dataType).alias(field.name) if field.name == ts
        else F.lit(fixed.get(field.name)).cast(field.dataType).alias(field.name)
        for field in rows.schema.fields
    ])


def run_to_files(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Process everything available now into a file sink; reruns continue at the checkpoint."""
    query = (
        stream.writeStream.format("parquet").outputMode("append").option("path", path)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()


def partials(rows: DataFrame, keys: Sequence[str], measures: Mapping[str, Column], day: str = "day") -> DataFrame:
    """What can be merged later, per day and keys: rows, and sum, count, least and largest of every measure."""
    parts = [F.count(F.lit(1)).alias("data_points")]
    for name, value in measures.items():
        parts += [F.sum(value).alias(f"{name}_sum"), F.count(value).alias(f"{name}_count"), F.min(value).alias(f"{name}_min"), F.max(value).alias(f"{name}_max")]
    return rows.groupBy(day, *keys).agg(*parts)


def _merged(parts: DataFrame, keys: Sequence[str], day: str) -> DataFrame:
    merge = {"_min": F.min, "_max": F.max}
    values = [name for name in parts.columns if name not in (day, *keys)]
    return parts.groupBy(day, *keys).agg(*[merge.get(name[-4:], F.sum)(name).alias(name) for name in values])


def merge_batch(
    batch: DataFrame, batch_id: int, path: str, keys: Sequence[str], measures: Mapping[str, Column], day: str = "day",
) -> None:
    """Merge one batch into the partials stored by day; only its days are replaced.

    Each stored day names the last batch merged into it. A batch that comes again, after a failure between the
    days, is merged only into the days that lack it.
    """
    spark = batch.sparkSession
    fresh = settled(partials(batch, keys, measures, day))
    layout = fresh.withColumn("last_batch", F.lit(0).cast("long"))
    layout.where("false").write.mode("ignore").partitionBy(day).parquet(path)
    stored = spark.read.schema(layout.schema).parquet(path)
    done = stored.where(F.col("last_batch") >= batch_id).select(day).distinct()
    missing = fresh.join(done, day, "left_anti")
    touched = stored.drop("last_batch").join(missing.select(day).distinct(), day, "left_semi")
    merged = settled(_merged(touched.unionByName(missing), keys, day))
    (
        merged.withColumn("last_batch", F.lit(batch_id).cast("long")).write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)
    )


def refresh_result(
    stream: DataFrame, path: str, checkpoint: str, keys: Sequence[str], measures: Mapping[str, Column], day: str = "day",
) -> None:
    """Keep per-day statistics of a stream current from stored partials; no raw row is kept or read again."""
    def apply(batch: DataFrame, batch_id: int) -> None:
        merge_batch(batch, batch_id, path, keys, measures, day)

    stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def refreshed(spark: SparkSession, path: str, measures: Sequence[str], day: str = "day") -> DataFrame:
    """The stored partials with the mean of every measure."""
    found = spark.read.parquet(path).drop("last_batch")
    return found.withColumns({f"avg_{m}": F.col(f"{m}_sum") / F.nullif(F.col(f"{m}_count"), F.lit(0)) for m in measures})


def read_result(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)

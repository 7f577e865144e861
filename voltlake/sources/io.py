"""Reading raw telemetry, writing tables, materialized results."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voltlake import schema as S
from voltlake.functions.expr import as_timestamp
from voltlake.operators.clean import clean_bms, clean_gps
from voltlake.operators.sequence import ROWS_PER_SLICE, SLICE_SECONDS, slice_keys, sliced


def _text_schema(names: Iterable[str]) -> T.StructType:
    return T.StructType([T.StructField(name, T.StringType()) for name in (*names, "_corrupt_record")])


RAW = {"bms": _text_schema(S.BMS_CSV_COLUMNS), "gps": _text_schema(S.GPS_CSV_COLUMNS)}
CLEAN = {"bms": clean_bms, "gps": clean_gps}


def _reader(reader, kind: str, columns: Iterable[str] | None = None):
    layout = RAW[kind] if columns is None else _text_schema(columns)
    return reader.schema(layout).option("header", True).option("mode", "PERMISSIVE").option("enforceSchema", False)


def read_bms_csv(spark: SparkSession, path: str, columns: Iterable[str] | None = None) -> DataFrame:
    """Raw battery CSV as text columns; ``columns`` names the header when it is not the full layout."""
    return _reader(spark.read, "bms", columns).csv(path)


def read_gps_csv(spark: SparkSession, path: str, columns: Iterable[str] | None = None) -> DataFrame:
    return _reader(spark.read, "gps", columns).csv(path)


def type_from_path(path: Column | str = "_metadata.file_path") -> Column:
    """Vehicle type named anywhere in the file path, in any case."""
    source = F.col(path) if isinstance(path, str) else path
    found = F.regexp_extract(F.upper(source), f"({'|'.join(S.CAR_TYPES)})", 1)
    return F.when(found != "", found).otherwise("UNKNOWN")


def kind_from_path(path: Column | str, root: str) -> Column:
    """Kind of data that the file name or else the nearest folder below ``root`` names, in any case; NULL if none."""
    source = F.col(path) if isinstance(path, str) else path
    below = F.lower(F.substring_index(source, root.rstrip("/").rsplit("/", 1)[-1] + "/", -1))
    name = F.regexp_extract(below, "(bms|gps)[^/]*$", 1)
    folder = F.regexp_extract(below, "^(?:.*/)?(bms|gps)/", 1)
    return F.when(name != "", name).when(folder != "", folder)


def _with_origin(raw: DataFrame, root: str, kind: str, unnamed: bool) -> DataFrame:
    """Rows of the files of one kind, with the source file and the vehicle type where the row has none.

    Files whose path names the other kind are left out; those that name none are taken if ``unnamed``.
    """
    found = kind_from_path("_metadata.file_path", root)
    raw = raw.where((found == kind) | (found.isNull() if unnamed else F.lit(False)))
    raw = raw.select("*", F.col("_metadata.file_path").alias("source_file"))
    own = F.nullif(F.trim("car_type"), F.lit("")) if "car_type" in raw.columns else F.lit(None).cast("string")
    return raw.withColumn("car_type", F.coalesce(own, type_from_path("source_file")))


def read_tree(spark: SparkSession, root: str, kind: str, columns: Iterable[str] | None = None) -> DataFrame:
    """All files of one kind below a folder, with the source file and the vehicle type of its path."""
    raw = _reader(spark.read, kind, columns).option("recursiveFileLookup", True).option("pathGlobFilter", "*.[cC][sS][vV]").csv(root)
    return _with_origin(raw, root, kind, unnamed=False)


def bms_all(*tables: DataFrame) -> DataFrame:
    """One table out of one per vehicle type."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


gps_all = bms_all


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite", partition_by: Iterable[str] = ()) -> None:
    """Rows of a partition value are kept together, so hot values still spread over tasks by rebalancing."""
    parts = list(partition_by)
    out = df.hint("rebalance", *parts) if parts else df
    writer = out.write.mode(mode)
    if fmt == "csv":
        writer = writer.option("header", True)
    (writer.partitionBy(*parts) if parts else writer).format(fmt).save(path)


def write_telemetry(df: DataFrame, path: str, mode: str = "append") -> None:
    """Cleaned rows by type and day: the layout every plan prunes on."""
    write_table(df, path, "parquet", mode, ("car_type", "day"))


def write_clustered(
    df: DataFrame, name: str, path: str | None = None, keys: Sequence[str] = ("device_no",), ts: str = "msg_ts",
    row_id: str = "msg_id", buckets: int | None = None, seconds: int = SLICE_SECONDS, rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """Store a stream for ordered work and read it back: rows in their slices (device, time bucket, part), bucketed
    by slice and sorted by time.

    Ordered passes over the table (``sequence.lagged``, ``running``, ``carried``) find each slice whole in one bucket,
    so they move only one row per slice. Slices are at most ``rows_per_slice`` rows, so no device fills a bucket.
    ``buckets`` is also the number of tasks that read the table; without ``path`` the table is the warehouse's.
    """
    order, by = [ts, row_id], slice_keys(keys)
    buckets = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = sliced(df, keys, ts, [row_id], seconds, rows_per_slice).repartition(buckets, *by)
    writer = placed.write.mode("overwrite").format("parquet").bucketBy(buckets, *by).sortBy(*by, *order)
    (writer.option("path", path) if path else writer).saveAsTable(name)
    return df.sparkSession.table(name)


def _cleaned(raw: DataFrame, kind: str) -> DataFrame:
    return CLEAN[kind](raw.where(F.col("_corrupt_record").isNull()).drop("_corrupt_record", "source_file"))


def _rejected(raw: DataFrame) -> DataFrame:
    """Spark reads the corrupt record only beside a column of the file."""
    first = F.col(raw.columns[0]).alias("first_value")
    return raw.where(F.col("_corrupt_record").isNotNull()).select("source_file", first, F.col("_corrupt_record").alias("line"))


def _whole_lines(reader, kind: str, columns: Iterable[str] | None):
    """All files below a folder; a pruned line is not checked for its number of values."""
    return _reader(reader, kind, columns).option("recursiveFileLookup", True).option("columnPruning", False)


def ingest_batch(
    spark: SparkSession, source: str, target: str, kind: str, columns: Iterable[str] | None = None,
    rejects: str | None = None,
) -> None:
    """Read, clean and append the files of one kind; Spark splits large files itself.

    Lines that do not fit the layout are appended to ``rejects`` (by default beside the target) with their
    file and first value, and are not in the table.
    """
    raw = _with_origin(_whole_lines(spark.read, kind, columns).csv(source), source, kind, unnamed=True)
    write_telemetry(_cleaned(raw, kind), target)
    _rejected(raw).write.mode("append").parquet(rejects or f"{target.rstrip('/')}_rejects")


def ingest_incremental(
    spark: SparkSession, source: str, target: str, checkpoint: str, kind: str, columns: Iterable[str] | None = None,
    rejects: str | None = None,
) -> None:
    """``ingest_batch`` for the files not seen yet; the checkpoints are the progress record."""
    def stream() -> DataFrame:
        raw = _whole_lines(spark.readStream, kind, columns).csv(source)
        return _with_origin(raw, source, kind, unnamed=True)

    sinks = (
        (_cleaned(stream(), kind), target, checkpoint, ("car_type", "day")),
        (_rejected(stream()), rejects or f"{target.rstrip('/')}_rejects", f"{checkpoint.rstrip('/')}_rejects", ()),
    )
    for rows, path, state, parts in sinks:
        writer = rows.writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True)
        (writer.partitionBy(*parts) if parts else writer).start(path).awaitTermination()


def write_profile(profile_rows: DataFrame, path: str) -> None:
    """A column profile as JSON, CSV and a text report."""
    profile_rows.write.mode("overwrite").json(f"{path}/json")
    profile_rows.write.mode("overwrite").option("header", True).csv(f"{path}/csv")
    line = F.format_string(
        "%s (%s): %d rows, %d null (%.1f%%), %d distinct",
        "column_name", "dtype", "total_count", "null_count", "null_percentage", "unique_count",
    )
    profile_rows.select(line.alias("value")).write.mode("overwrite").text(f"{path}/report")


def materialize(df: DataFrame, name: str, partition_by: Iterable[str] = ()) -> DataFrame:
    """Create or replace a stored result and read it back."""
    writer = df.write.mode("overwrite").format("parquet")
    parts = list(partition_by)
    (writer.partitionBy(*parts) if parts else writer).saveAsTable(name)
    return df.sparkSession.table(name)


def drop_materialized(spark: SparkSession, name: str) -> None:
    quoted = ".".join(f"`{part.replace('`', '``')}`" for part in name.split("."))
    spark.sql(f"DROP TABLE IF EXISTS {quoted}")


def list_tables(spark: SparkSession, pattern: str = "*") -> DataFrame:
    names = [(t.name, t.tableType) for t in spark.catalog.listTables(pattern=pattern)]
    return spark.createDataFrame(names, "name string, table_type string")


def fresh_only(df: DataFrame, column: str, as_of: str, seconds: int = 300) -> DataFrame:
    """Stored rows updated within the last seconds before ``as_of``."""
    return df.where(F.col(column) >= as_timestamp(as_of) - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(seconds)))

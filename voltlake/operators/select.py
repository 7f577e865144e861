"""Filters, paging, per-key heads and label order."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltlake.functions.expr import as_timestamp
from voltlake.operators.sequence import global_row_number, settled


def where_opt(df: DataFrame, **equal) -> DataFrame:
    """Equality filters; None and "all" mean no filter."""
    for name, value in equal.items():
        if value is not None and value != "all":
            df = df.where(F.col(name) == F.lit(value))
    return df


def between_time(
    df: DataFrame, ts: str, start: str | Column | None = None, stop: str | Column | None = None, day: str = "day",
) -> DataFrame:
    """Start inclusive, stop exclusive.  Where the table is stored by ``day``, the days outside are not opened."""
    stored = day in df.columns

    def moment(value: str | Column) -> Column:
        return as_timestamp(value) if isinstance(value, str) else value

    if start is not None:
        df = df.where(F.col(ts) >= moment(start))
        df = df.where(F.col(day) >= moment(start).cast("date")) if stored else df
    if stop is not None:
        df = df.where(F.col(ts) < moment(stop))
        df = df.where(F.col(day) <= moment(stop).cast("date")) if stored else df
    return df


def last_interval(df: DataFrame, ts: str, as_of: str, days: int) -> DataFrame:
    """Rows of the last ``days`` before the given moment, counted from its midnight."""
    return between_time(df, ts, F.date_sub(F.lit(as_of).cast("date"), days).cast("timestamp_ntz"))


def in_month(df: DataFrame, ts: str, month: str) -> DataFrame:
    """Rows of a month, given as yyyy-MM, by its time range."""
    first = date.fromisoformat(f"{month}-01")
    after = date(first.year + first.month // 12, first.month % 12 + 1, 1)
    return between_time(df, ts, f"{first} 00:00:00", f"{after} 00:00:00")


def _directed(name: str, descending: bool) -> Column:
    return F.col(name).desc_nulls_last() if descending else F.col(name).asc_nulls_last()


def paginate(
    df: DataFrame, sort: str, tiebreak: str, order: str = "desc", page: int = 1, limit: int = 50,
) -> DataFrame:
    """One page; Spark keeps only page * limit rows per task while it sorts."""
    keys = [_directed(sort, order == "desc"), F.col(tiebreak).asc()]
    return df.orderBy(*keys).offset((page - 1) * limit).limit(limit)


def paginate_rn(
    df: DataFrame, sort: str, tiebreak: str, page: int, limit: int, order: str = "desc", ranges: int | None = None,
) -> DataFrame:
    """The same page by row number, for pages deep inside a large result; missing values come last either way.

    Only the two order columns are sorted and written; the page's rows, ``limit`` of them, then meet the table.
    The tie-break must tell rows apart.
    """
    keys = df.select(F.col(sort).alias("_sort"), F.col(tiebreak).alias("_tie"))
    numbered = global_row_number(keys, "row_num", [_directed("_sort", order == "desc"), F.col("_tie").asc()], ranges=ranges)
    wanted = settled(numbered.where(F.col("row_num").between((page - 1) * limit + 1, page * limit)))
    met = df[sort].eqNullSafe(wanted["_sort"]) & df[tiebreak].eqNullSafe(wanted["_tie"])
    return df.join(wanted, met).select(*[df[name] for name in df.columns], "row_num")


def paginate_after(
    df: DataFrame, sort: str, tiebreak: str, after: tuple | None = None, order: str = "desc", limit: int = 50,
) -> DataFrame:
    """The page behind a cursor: the (sort value, tie-break) of the last row seen, None for the first page.

    The cursor is a filter, which reaches the scan, and each task keeps ``limit`` rows however deep the page lies.
    Missing sort values come last; the tie-break must tell rows apart and not be missing.
    """
    down = order == "desc"
    if after is not None:
        value, tie = after
        s, later = F.col(sort), F.col(tiebreak) > F.lit(tie)
        if value is None:
            df = df.where(s.isNull() & later)
        else:
            beyond = s < F.lit(value) if down else s > F.lit(value)
            df = df.where(beyond | ((s == F.lit(value)) & later) | s.isNull())
    return df.orderBy(_directed(sort, down), F.col(tiebreak).asc()).limit(limit)


def page_info(df: DataFrame, limit: int) -> DataFrame:
    return df.agg(F.count("*").alias("total")).select(
        "total", F.ceil(F.col("total") / limit).cast("bigint").alias("pages")
    )


def top_k(df: DataFrame, columns: Sequence[str], tiebreak: str, k: int) -> DataFrame:
    return df.orderBy(*[F.col(name).desc_nulls_last() for name in columns], F.col(tiebreak).asc()).limit(k)


def head_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """First n rows per key; Spark drops the others before the shuffle, so hot keys are no burden."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rn", rank).where(F.col("_rn") <= n).drop("_rn")


def order_by_labels(df: DataFrame, column: str, labels: Sequence[str]) -> DataFrame:
    """Rows in the order of a label list, other labels last."""
    place = F.array_position(F.array(*[F.lit(text) for text in labels]), F.col(column))
    return df.orderBy(F.when(place == 0, len(labels) + 1).otherwise(place), F.col(column))


def latest_rows(df: DataFrame, keys: Sequence[str], ts: str, tiebreak: str) -> DataFrame:
    """Latest row per key as one aggregate with a partial step; no window over the rows of a key."""
    rest = [name for name in df.columns if name not in keys]
    return (
        df.groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), F.struct(ts, tiebreak)).alias("_row"))
        .select(*keys, "_row.*")
    )


def latest_value(column: str, ts: str, tiebreak: str) -> Column:
    """Aggregate: the last non-null value of a column."""
    return F.max_by(column, F.when(F.col(column).isNotNull(), F.struct(ts, tiebreak)))


def first_value(column: str, ts: str, tiebreak: str) -> Column:
    return F.min_by(column, F.when(F.col(column).isNotNull(), F.struct(ts, tiebreak)))


def to_report(df: DataFrame, key: str) -> DataFrame:
    """One JSON text per row, keyed; stays distributed instead of one assembled document."""
    return df.select(F.col(key), F.to_json(F.struct(*df.columns)).alias("report"))

"""Cleaning of raw sensor rows: header rows, blanks, types, ranges, times, lists, duplicates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voltlake import schema as S
from voltlake.functions.expr import c, number

LIST_DELIMITERS = (",", "|", ";")


def drop_header_rows(df: DataFrame) -> DataFrame:
    """Rows whose cells repeat the column names."""
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not text:
        return df
    probe = "device_no" if "device_no" in text else text[0]
    return df.where(F.col(probe).isNull() | (F.trim(F.col(probe)) != probe))


def drop_empty_rows(df: DataFrame) -> DataFrame:
    return df.na.drop("all")


def trim_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[name.strip() for name in df.columns])


def normalize_strings(df: DataFrame) -> DataFrame:
    """Trimmed text, empty text as NULL."""
    return df.select(*[
        F.nullif(F.trim(F.col(f.name)), F.lit("")).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f.name)
        for f in df.schema.fields
    ])


def clean_rows(df: DataFrame) -> DataFrame:
    return drop_empty_rows(normalize_strings(drop_header_rows(trim_names(df))))


# ---------------------------------------------------------------- list columns


def detect_list_columns(df: DataFrame, share: float = 0.5) -> dict[str, str]:
    """Text columns where more than ``share`` of all values hold a delimiter: one aggregate over the table."""
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not text:
        return {}
    pairs = [(name, delimiter) for name in text for delimiter in LIST_DELIMITERS]
    rates = df.agg(*[F.avg(F.col(n).contains(d).cast("int")).alias(str(i)) for i, (n, d) in enumerate(pairs)]).first()
    found: dict[str, str] = {}
    for (name, delimiter), rate in zip(pairs, rates):
        if rate is not None and rate > share:
            found.setdefault(name, delimiter)
    return found


def split_list(column: str, delimiter: str) -> Column:
    return F.transform(F.split(F.col(column), "\\Q" + delimiter + "\\E"), lambda x: F.trim(x))


def expand_list(df: DataFrame, column: str, delimiter: str, n: int | None = None) -> DataFrame:
    """``column`` as numbered columns, NULL padded: as many as the longest list has values, and ``n`` at least."""
    items = split_list(column, delimiter)
    longest = df.agg(F.max(F.size(items))).first()[0] or 0
    return df.withColumns(
        {f"{column}_{i + 1}": F.get(items, F.lit(i)) for i in range(max(1, n or 0, longest))}
    ).drop(column)


# ---------------------------------------------------------------- types, ranges, times


def convert_types(df: DataFrame, kind: str) -> DataFrame:
    """Ids and times stay text; every sensor becomes a finite double, flags become integers."""
    keep = set(S.TEXT_COLUMNS) if kind == "bms" else {"device_no", "time", *S.GPS_TEXT}
    out = []
    for f in df.schema.fields:
        if f.name in keep or isinstance(f.dataType, (T.ArrayType, T.TimestampType, T.TimestampNTZType)):
            out.append(F.col(f.name))
        elif f.name in S.BMS_FLAGS and kind == "bms":
            out.append(number(f.name).cast("int").alias(f.name))
        else:
            out.append(number(f.name).alias(f.name))
    return df.select(*out)


def _inside(value: Column, low: float | None, high: float | None) -> Column:
    test = F.lit(True)
    if low is not None:
        test = test & (value >= low)
    if high is not None:
        test = test & (value <= high)
    return F.when(test, value)


def validate_ranges(
    df: DataFrame, kind: str, rules: Mapping[str, tuple[float | None, float | None]] | None = None,
) -> DataFrame:
    """Values outside their physical range become NULL, all columns in one projection."""
    rules = rules or (S.BMS_RULES if kind == "bms" else S.GPS_RULES)
    out = []
    for f in df.schema.fields:
        bounds = rules.get(f.name)
        if bounds is None:
            out.append(F.col(f.name))
        elif isinstance(f.dataType, T.ArrayType):
            low, high = bounds
            out.append(F.transform(F.col(f.name), lambda x: _inside(x, low, high)).alias(f.name))
        else:
            out.append(_inside(F.col(f.name), *bounds).alias(f.name))
    return df.select(*out)


def fix_year(text: str | Column) -> Column:
    """``23-08-01 ..`` or ``23/08/01 ..`` to a timestamp; anything unreadable is NULL."""
    full = F.regexp_replace(F.trim(c(text)), r"^(\d{2})([-/.])", r"20$1$2")
    plain = F.regexp_replace(full, r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})", r"$1-$2-$3")
    return F.coalesce(
        F.try_to_timestamp(plain, F.lit("yyyy-M-d H:mm:ss")),
        F.try_to_timestamp(plain, F.lit("yyyy-M-d H:mm")),
        F.try_to_timestamp(plain, F.lit("yyyy-M-d")),
    )


def with_msg_ts(df: DataFrame) -> DataFrame:
    """``msg_ts`` from the message time, or from the sample time where that is unreadable."""
    sources = [fix_year(name) for name in ("msg_time", "time") if name in df.columns]
    existing = [F.col("msg_ts")] if "msg_ts" in df.columns else []
    return df.withColumn("msg_ts", F.coalesce(*existing, *sources))


# ---------------------------------------------------------------- families, duplicates


def family_columns(df: DataFrame, prefix: str) -> list[str]:
    """Numbered columns of a family, in number order."""
    tail = len(prefix) + 1
    names = [n for n in df.columns if n.startswith(prefix + "_") and n[tail:].isdigit()]
    return sorted(names, key=lambda n: int(n[tail:]))


def fold_families(df: DataFrame, families: Sequence[str] = ("cell_volt", "mod_temp")) -> DataFrame:
    """Numbered columns of each family as one array column."""
    for prefix in families:
        names = family_columns(df, prefix)
        if names:
            df = df.withColumn(prefix, F.array(*names)).drop(*names)
    return df


def add_family_counts(df: DataFrame, families: Sequence[str] = ("cell_volt", "mod_temp")) -> DataFrame:
    """Non-null members of a family per row, from its array or its numbered columns."""
    counts = {}
    for prefix in families:
        names = family_columns(df, prefix)
        if prefix in df.columns:
            counts[f"{prefix}_count"] = F.coalesce(F.size(F.filter(prefix, lambda x: x.isNotNull())), F.lit(0))
        elif names:
            total = F.lit(0)
            for name in names:
                total = total + F.col(name).isNotNull().cast("int")
            counts[f"{prefix}_count"] = total
    return df.withColumns(counts)


def drop_family_counts(df: DataFrame, families: Sequence[str] = ("cell_volt", "mod_temp")) -> DataFrame:
    return df.drop(*[f"{prefix}_count" for prefix in families])


def dedupe(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.dropDuplicates(list(keys))


def clean_bms(raw: DataFrame) -> DataFrame:
    """Raw text rows to typed, validated battery rows with ``msg_ts`` and a ``day`` for partitioning."""
    typed = convert_types(with_msg_ts(clean_rows(raw)), "bms")
    return validate_ranges(fold_families(typed), "bms").withColumn("day", F.to_date("msg_ts"))


def clean_gps(raw: DataFrame) -> DataFrame:
    rows = clean_rows(raw)
    rows = rows.withColumn("time", fix_year("time"))
    return validate_ranges(convert_types(rows, "gps"), "gps").withColumn("day", F.to_date("time"))

"""Ordered work on streams of any length: lags, rolling frames, running totals, carried values.

A window over a whole device puts that device's history into one task; with a hundred vehicles, or
one vehicle that sends a third of all rows, that task never ends.  Here every stream is cut into
slices (key, time bucket, part).  Windows run inside a slice; what must cross a slice border is one
small row per slice (a total, a last value, the last n rows), which is combined per key and handed
back.  Results equal those of the plain window over the whole key.  A pass reads its input at most twice:
once for its rows, once, narrow and partially aggregated, for what crosses the borders.

Parts split a bucket that is too full.  Their borders come from a hash sample of the order values,
so they are the same on every recomputation, and ties of time are split by the later order columns.
They are written before the pass is planned: a few rows, none where no bucket is too full.

A row without a key or a time has no place in a sequence.  It stays in the result, with NULL in every
column that a sequence would give it; ``in_sequence`` drops such rows where a rule needs the place.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltlake.functions.expr import micros
from voltlake.session import shared_folder

SLICE_SECONDS = 30 * 86_400
ROWS_PER_SLICE = 1_000_000
SAMPLES_PER_SLICE = 64
APART = 256  # slices that rows without a place are spread over

BUCKET, PART = "_bucket", "_part"


def time_bucket(ts: str | Column, seconds: int = SLICE_SECONDS) -> Column:
    return F.floor(micros(ts) / F.lit(seconds * 1_000_000)).cast("long")


def slice_keys(keys: Sequence[str]) -> list[str]:
    return [*keys, BUCKET, PART]


def in_sequence(df: DataFrame, *columns: str) -> DataFrame:
    """Rows that have all the columns a sequence is made of."""
    for name in columns:
        df = df.where(F.col(name).isNotNull())
    return df


def has_place() -> Column:
    return F.col(BUCKET).isNotNull()


def slice_cuts(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """(keys, bucket, _cuts, _width) of overfull buckets, written: the order values at which they are cut.

    The borders of a bucket are kept in about sqrt(n) runs, so a row is compared with 2 * sqrt(n) of them.
    Only keys and order columns are read; equal rows count once.
    """
    placed = _bucketed(df, keys, bucket).where(has_place())
    at = F.struct(*[F.col(name) for name in order])
    modulus = max(1, rows_per_slice // SAMPLES_PER_SLICE)
    sample = (
        placed.where(F.pmod(F.xxhash64(*keys, *order), F.lit(modulus)) == 0).select(*keys, BUCKET, at.alias("_at")).distinct()
    )
    group = Window.partitionBy(*keys, BUCKET)
    ranked = sample.select(
        "*", F.row_number().over(group.orderBy("_at")).alias("_rn"), F.count("*").over(group).alias("_n")
    )
    step = SAMPLES_PER_SLICE
    return settled(
        ranked.where((F.col("_rn") % step == 0) & (F.col("_rn") < F.col("_n")))
        .groupBy(*keys, BUCKET).agg(F.array_sort(F.collect_list("_at")).alias("_borders"))
        .withColumn("_width", F.ceil(F.sqrt(F.size("_borders"))).cast("int"))
        .withColumn("_cuts", F.transform(
            F.sequence(F.lit(0), F.ceil(F.size("_borders") / F.col("_width")).cast("int") - 1),
            lambda i: F.slice(F.col("_borders"), i * F.col("_width") + 1, F.col("_width"))))
        .drop("_borders")
    )


def _bucketed(df: DataFrame, keys: Sequence[str], bucket: Column) -> DataFrame:
    """The bucket of each row; rows without a key or a bucket have none."""
    for key in keys:
        bucket = F.when(F.col(key).isNotNull(), bucket)
    return df.withColumn(BUCKET, bucket)


def _borders_before(test: Callable[[Column], Column]) -> Column:
    """How many borders pass a test that holds for the first borders of a bucket and for none behind them."""
    run = F.size(F.filter(F.col("_cuts"), lambda borders: test(F.get(borders, F.lit(0))))) - 1
    inside = F.size(F.filter(F.get(F.col("_cuts"), run), test))
    return F.when(F.col("_cuts").isNull() | (run < 0), 0).otherwise(run * F.col("_width") + inside)


def in_slices(df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, cuts: DataFrame) -> DataFrame:
    """Add the slice of each row.  Rows without a key or a bucket get no bucket, and a part by hash, so that many
    of them spread.  Cuts meet the rows on (key, bucket); they are written, so Spark knows how few they are."""
    placed = _bucketed(df, keys, bucket)
    at = F.struct(*[F.col(name) for name in order])
    spread = F.pmod(F.xxhash64(*keys, *order), F.lit(APART)).cast("int")
    return placed.join(cuts, [*keys, BUCKET], "left").select(
        *[placed[name] for name in placed.columns],
        F.when(~has_place(), spread).otherwise(_borders_before(lambda border: border < at)).alias(PART))


def in_reach(df: DataFrame, keys: Sequence[str], at: str, reach: int, width: int, cuts: DataFrame) -> DataFrame:
    """Every row once in each slice that can hold rows at most ``reach`` away by the numeric column ``at``, which
    is the first order column of the cuts.  Slices far wider than the reach make few copies."""
    low, high = F.col(at) - reach, F.col(at) + reach
    near = df.withColumn(BUCKET, F.explode(F.sequence(F.floor(low / width), F.floor(high / width))))
    first = _borders_before(lambda border: border[at] < low)
    last = _borders_before(lambda border: border[at] <= high)
    return near.join(cuts, [*keys, BUCKET], "left").select(
        *[near[name] for name in near.columns], F.explode(F.sequence(first, last)).alias(PART))


def with_slices(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column,
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """Slices of a stream.  ``bucket`` must not decrease along ``order``."""
    return in_slices(df, keys, order, bucket, slice_cuts(df, keys, order, bucket, rows_per_slice))


def sliced(
    df: DataFrame, keys: Sequence[str], ts: str, tiebreak: Sequence[str] = (), seconds: int = SLICE_SECONDS,
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """Slices of a stream ordered by time, then by the tie-break columns."""
    return with_slices(df, keys, [ts, *tiebreak], time_bucket(ts, seconds), rows_per_slice)


def unsliced(df: DataFrame) -> DataFrame:
    return df.drop(BUCKET, PART)


def settled(df: DataFrame) -> DataFrame:
    """The rows written once as Parquet to the shared folder, so later passes read them and not the lineage.

    Every carried pass reads its input twice; chains of passes settle between them.  The folder is the one
    that spark.checkpoint.dir names; without it this is an error.  Its owner empties it.
    """
    path = f"{shared_folder(df.sparkSession)}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _forward(keys: Sequence[str], order: Sequence[str]):
    return Window.partitionBy(*slice_keys(keys)).orderBy(*[F.col(name).asc() for name in order])


def _backward(keys: Sequence[str], order: Sequence[str]):
    return Window.partitionBy(*slice_keys(keys)).orderBy(*[F.col(name).desc() for name in order])


def _across(keys: Sequence[str], *order: Column):
    return Window.partitionBy(*keys).orderBy(*order)


# ---------------------------------------------------------------- bounded frames


def tails_handed_on(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """The n rows that come before each slice in its key, marked with that slice.

    Spark keeps n rows a slice in every task before it shuffles them.
    """
    tails = (
        df.where(has_place()).withColumn("_rn", F.row_number().over(_backward(keys, order))).where(F.col("_rn") <= n)
        .drop("_rn")
    )
    line = _across(keys, F.col(BUCKET), F.col(PART), *[F.col(name) for name in order])
    here = F.struct(BUCKET, PART)
    before = (
        tails.select(
            *slice_keys(keys),
            F.collect_list(F.struct(*[name for name in df.columns if name not in (BUCKET, PART)]))
            .over(line.rowsBetween(-n, -1)).alias("_before"),
            F.lag(here).over(line).alias("_last_slice"),
            here.alias("_here"),
        )
        .where(F.col("_last_slice") < F.col("_here"))  # the first tail row of a slice
        .select(BUCKET, PART, F.explode("_before").alias("_row"))
    )
    return before.select("_row.*", BUCKET, PART)


def framed(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int, columns: Mapping[str, object],
) -> DataFrame:
    """Window columns that look back at most ``n`` rows.

    ``columns`` maps a name to a function from the ordered window to the window expression, as in
    ``{"prev": lambda w: F.lag("soc").over(w)}``.
    """
    window = _forward(keys, order)
    halo = tails_handed_on(df, keys, order, n).withColumn("_halo", F.lit(True))
    whole = df.withColumn("_halo", F.lit(False)).unionByName(halo)
    made = {name: F.when(has_place(), make(window)) for name, make in columns.items()}
    return whole.withColumns(made).where(~F.col("_halo")).drop("_halo")


def row_before(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(slice, _border): the columns of the last row in front of each slice, from one partial aggregate a slice."""
    at, last = F.struct(*[F.col(name) for name in order]), F.struct(*[F.col(name) for name in columns])
    ends = df.where(has_place()).groupBy(*slice_keys(keys)).agg(F.max_by(last, at).alias("_end"))
    return ends.select(*slice_keys(keys), F.lag("_end").over(_across(keys, F.col(BUCKET), F.col(PART))).alias("_border"))


def lagged(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Mapping[str, str]) -> DataFrame:
    """Previous row's values: ``{"prev_soc": "soc"}``.  The first row of a slice takes them from the slice before."""
    sources = list(dict.fromkeys(columns.values()))
    inside = F.lag(F.struct(*[F.col(name) for name in sources])).over(_forward(keys, order))
    joined = df.withColumn("_inside", inside).join(row_before(df, keys, order, sources), slice_keys(keys), "left")
    before = F.when(has_place(), F.coalesce("_inside", "_border"))
    return joined.select(*[df[name] for name in df.columns], *[before[source].alias(name) for name, source in columns.items()])


# ---------------------------------------------------------------- unbounded frames


def carried(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], *,
    sums: Mapping[str, Column] | None = None, lasts: Mapping[str, Column] | None = None,
    befores: Mapping[str, Column] | None = None, nearest: Mapping[str, str] | None = None,
    time: str | None = None, tolerance: float = 0.0,
) -> DataFrame:
    """Columns that look back (or both ways) without limit, all in one pass over the stream.

    sums     running total up to the current row
    lasts    last non-null value up to the current row
    befores  last non-null value before the current row
    nearest  value of a column at the row nearest by the numeric column ``time`` that has one, NULL beyond
             ``tolerance``; equally near values give the earlier
    """
    sums, lasts, befores, nearest = (dict(x or {}) for x in (sums, lasts, befores, nearest))
    start, forth, back = Window.unboundedPreceding, _forward(keys, order), _backward(keys, order)
    at = F.struct(*[F.col(name) for name in order])
    earlier = _across(keys, F.col(BUCKET).asc(), F.col(PART).asc()).rowsBetween(start, -1)
    later = _across(keys, F.col(BUCKET).desc(), F.col(PART).desc()).rowsBetween(start, -1)
    inside, edges, handed, final = {}, [], [], {}

    def hold(name: str, value: Column, window, pick, line) -> Column:
        """One column: inside the slice, at its border, handed over the borders; then the better of both."""
        mark = F.when(value.isNotNull(), at)
        inside[f"_i_{name}"] = F.last(value, ignorenulls=True).over(window)
        edges.append(pick(value, mark).alias(f"_e_{name}"))
        handed.append(F.last(f"_e_{name}", ignorenulls=True).over(line).alias(f"_c_{name}"))
        return F.coalesce(F.col(f"_i_{name}"), F.col(f"_c_{name}"))

    for name, value in sums.items():
        inside[f"_i_{name}"] = F.sum(value).over(forth.rowsBetween(start, 0))
        edges.append(F.sum(value).alias(f"_e_{name}"))
        handed.append(F.sum(f"_e_{name}").over(earlier).alias(f"_c_{name}"))
        final[name] = F.coalesce(F.col(f"_i_{name}"), F.lit(0)) + F.coalesce(F.col(f"_c_{name}"), F.lit(0))
    for name, value in lasts.items():
        final[name] = hold(name, value, forth.rowsBetween(start, 0), F.max_by, earlier)
    for name, value in befores.items():
        final[name] = hold(name, value, forth.rowsBetween(start, -1), F.max_by, earlier)
    for name, source in nearest.items():
        seen = F.when(F.col(source).isNotNull(), F.struct(F.col(time).alias("t"), F.col(source).alias("v")))
        previous = hold(f"p_{name}", seen, forth.rowsBetween(start, 0), F.max_by, earlier)
        following = hold(f"n_{name}", seen, back.rowsBetween(start, 0), F.min_by, later)
        ago, ahead = F.col(time) - previous["t"], following["t"] - F.col(time)
        final[name] = (
            F.when((ago <= tolerance) & (ahead.isNull() | (ago <= ahead)), previous["v"])
            .when(ahead <= tolerance, following["v"])
        )
    borders = df.where(has_place()).groupBy(*slice_keys(keys)).agg(*edges).select(*slice_keys(keys), *handed)
    joined = df.withColumns(inside).join(borders, slice_keys(keys), "left")
    return joined.select(*df.columns, *[F.when(has_place(), value).alias(name) for name, value in final.items()])


def running(
    df: DataFrame, keys: Sequence[str], order: Sequence[str],
    sums: Mapping[str, Column] | None = None, lasts: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Running totals and last non-null values from the start of the key up to the current row."""
    return carried(df, keys, order, sums=sums, lasts=lasts)


# ---------------------------------------------------------------- whole-table order


RANGE, PLACE = "_range", "_place"


def in_ranges(df: DataFrame, order: Sequence[Column], ranges: int | None = None) -> DataFrame:
    """The rows in whole-table order, written: range of each row and its place in it, both from 0.

    Spark takes the borders of the ranges from a sample of the whole order, ties included, so no value of the
    first column can fill a range that the later columns could split.  One shuffle; each task sorts one range.
    """
    ranges = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_rows = df.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    # An id from the row's partition, in its upper bits, and its place there.
    numbered = sorted_rows.withColumn("_id", F.monotonically_increasing_id())
    return settled(numbered.select(
        *df.columns, F.shiftright("_id", 33).cast("int").alias(RANGE), F.col("_id").bitwiseAND((1 << 33) - 1).alias(PLACE)))


def range_starts(placed: DataFrame) -> DataFrame:
    """(_range, _start, _total): rows in front of each range and in all; one row per range, which one task adds up."""
    sizes = placed.groupBy(RANGE).agg((F.max(PLACE) + 1).alias("_size"))
    whole = Window.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    upto = F.sum("_size").over(Window.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return sizes.select(RANGE, (upto - F.col("_size")).alias("_start"), F.sum("_size").over(whole).alias("_total"))


def global_row_number(
    df: DataFrame, name: str, order: Sequence[Column], total: str | None = None, ranges: int | None = None,
) -> DataFrame:
    """Number all rows from 1 along ``order``, which must tell all rows apart, without one task seeing all rows.

    ``total`` names a column for the count of all rows.
    """
    placed = in_ranges(df, order, ranges)
    more = [F.col("_total").alias(total)] if total else []
    return placed.join(range_starts(placed), RANGE).select(*df.columns, (F.col("_start") + F.col(PLACE) + 1).alias(name), *more)

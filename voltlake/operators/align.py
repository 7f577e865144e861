"""Time alignment of two sensor streams: nearest match, interval join, containment."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltlake.functions.expr import micros
from voltlake.operators.sequence import (
    ROWS_PER_SLICE, SLICE_SECONDS, carried, has_place, in_reach, in_sequence, in_slices, row_before, settled,
    slice_cuts, slice_keys, sliced, tails_handed_on, unsliced,
)
from voltlake.schema import NEAR_SECONDS

PAIRS_PER_TASK = 1_000_000
PAIRS_AT_ONCE = 50_000_000  # tested by one task of a join with overfull cells, some seconds of work
COPIES = 16  # shares of an overfull cell repeat its rows so many times on average, at most


def one_per_instant(df: DataFrame, on: Sequence[str], time: str, order: Sequence[str]) -> DataFrame:
    """One row per key and timestamp: the first by the order columns.  Copies collapse before the shuffle."""
    first = F.min_by(F.struct(*[F.col(name) for name in df.columns]), F.struct(*[F.col(name) for name in order]))
    return df.groupBy(*[F.col(name).alias(f"_k_{name}") for name in (*on, time)]).agg(first.alias("_row")).select("_row.*")


def nearest_join(
    left: DataFrame, right: DataFrame, on: Sequence[str], left_time: str, right_time: str,
    left_id: str, right_id: str, take: Sequence[str], tolerance_s: float = NEAR_SECONDS,
    seconds: int = SLICE_SECONDS, rows_per_slice: int = ROWS_PER_SLICE, keys: Sequence[str] | None = None,
    lags: Mapping[str, str] | None = None, frames: Mapping[str, Callable] | None = None, back: int = 0,
) -> DataFrame:
    """Left rows, each with the ``take`` columns of its nearest right row within the tolerance.

    Left join, one output row per left row; one without a key or a time has no match.  Equal distance: the
    earlier right row; equal instant: the smallest right id.

    ``lags`` (``{"prev": "soc"}``) and ``frames`` (window columns that look back at most ``back`` rows, as in
    ``sequence.framed``) look back along the left rows of ``keys``, a part of ``on``, in the same pass.

    Both inputs make one stream, cut into slices by ``keys`` and time and shuffled once.  A right row goes to each
    slice that holds times within the tolerance, so no match crosses a border.  Right rows are read once, left
    rows once, and once more, narrow, for the rows that lags and frames carry over the borders.  The work is
    linear in the rows and no pair of rows is ever built.
    """
    keys, lags, frames = list(keys or on), dict(lags or {}), dict(frames or {})
    reach, width = round(tolerance_s * 1_000_000), seconds * 1_000_000
    found = one_per_instant(
        in_sequence(right, *on, right_time).select(*on, right_time, right_id, *[n for n in take if n not in (*on, right_time, right_id)]),
        on, right_time, [right_id],
    ).select(*on, micros(right_time).alias("_t"), F.struct(*take).alias("_right"))
    asked = left.withColumns({"_t": micros(left_time), "_side": F.lit(1), "_id": F.col(left_id)})
    order, bucket = ["_t", "_side", "_id"], F.floor(F.col("_t") / width)
    instants = right.select(*keys, micros(right_time).alias("_t"), F.lit(0).alias("_side"))
    cuts = slice_cuts(
        asked.select(*keys, *order).unionByName(instants, allowMissingColumns=True), keys, order, bucket, rows_per_slice)
    rows = in_slices(asked, keys, order, bucket, cuts)
    copies = in_reach(found, keys, "_t", reach, width, cuts).withColumn("_side", F.lit(0))
    own = Window.partitionBy(*slice_keys(keys), "_side").orderBy("_t", "_id")
    stream = rows.withColumn("_halo", F.lit(False))
    if frames:
        halo = tails_handed_on(rows, keys, order, back).withColumn("_halo", F.lit(True))
        stream = stream.unionByName(halo)
    stream = stream.unionByName(copies, allowMissingColumns=True)
    if lags:
        sources = list(dict.fromkeys(lags.values()))
        stream = stream.join(row_before(rows, keys, order, sources), slice_keys(keys), "left").withColumn(
            "_before", F.coalesce(F.lag(F.struct(*[F.col(name) for name in sources])).over(own), F.col("_border")))
    # Right rows stand before left rows of their instant, on the way forth and on the way back.
    kind = Window.partitionBy(*slice_keys(keys), *[name for name in on if name not in keys])
    forth, back_again = kind.orderBy("_t", "_side"), kind.orderBy(F.col("_t").desc(), F.col("_side"))
    seen = F.when(F.col("_right").isNotNull(), F.struct(F.col("_t").alias("t"), F.col("_right").alias("v")))
    matched = stream.withColumns({
        **{name: make(own) for name, make in frames.items()},
        "_previous": F.last(seen, ignorenulls=True).over(forth.rowsBetween(Window.unboundedPreceding, 0)),
        "_following": F.last(seen, ignorenulls=True).over(back_again.rowsBetween(Window.unboundedPreceding, 0)),
    }).where((F.col("_side") == 1) & ~F.col("_halo"))
    ago, ahead = F.col("_t") - F.col("_previous.t"), F.col("_following.t") - F.col("_t")
    near = F.when(has_place() & (ago <= reach) & (ahead.isNull() | (ago <= ahead)), F.col("_previous.v")).when(
        has_place() & (ahead <= reach), F.col("_following.v"))
    return matched.withColumn("_near", near).select(
        *left.columns,
        *[F.when(has_place(), F.col("_before")[source]).alias(name) for name, source in lags.items()],
        *[F.when(has_place(), F.col(name)).alias(name) for name in frames],
        *[F.col("_near")[name].alias(name if name not in left.columns else f"right_{name}") for name in take],
    )


def nearest_to_few(
    left: DataFrame, right: DataFrame, on: Sequence[str], left_time: str, right_time: str, right_id: str,
    take: Sequence[str], tolerance_s: float = NEAR_SECONDS,
) -> DataFrame:
    """``nearest_join`` for a left side with one row per key, such as the latest row per vehicle.

    The left rows are written first, so that their size is known when the joins are planned: small ones are
    broadcast and the right table is not moved.  It meets them on (key, time bucket), and a right row matches
    at most one left row.
    """
    left = settled(left)
    width = int(tolerance_s * 1_000_000)
    t, u = F.col("_lt"), F.col("_rt")
    cell = F.floor(t / width)
    asked = left.select(*on, micros(left_time).alias("_lt"))
    spread = asked.withColumn("_cell", F.explode(F.array(cell - 1, cell, cell + 1)))
    near = (
        right.select(*on, *[n for n in dict.fromkeys((right_id, *take)) if n not in on], micros(right_time).alias("_rt"))
        .withColumn("_cell", F.floor(u / width))
        .join(spread, [*on, "_cell"])
        .where(F.abs(t - u) <= width)
    )
    best = near.groupBy(*on).agg(
        F.min_by(F.struct(*take), F.struct(F.abs(t - u), u, F.col(right_id))).alias("_near")
    )
    return left.join(best, list(on), "left").select(
        *[left[name] for name in left.columns], *[F.col("_near")[name].alias(name) for name in take]
    )


def nearest_value(
    series: DataFrame, on: Sequence[str], ts: str, tiebreak: str, columns: Sequence[str],
    tolerance_s: float = NEAR_SECONDS, default: float | None = None, prefix: str = "near_",
    rows_per_slice: int = ROWS_PER_SLICE, keep_slices: bool = False, **also,
) -> DataFrame:
    """For wide rows with gaps: each column's value at the nearest row that has one, itself first.

    ``also`` adds sums, lasts or befores of ``sequence.carried`` to the same pass.
    """
    timed = series.withColumn("_t", micros(ts))
    placed = sliced(timed, on, ts, [tiebreak], rows_per_slice=rows_per_slice)
    names = {f"{prefix}{name}": name for name in columns}
    filled = carried(
        placed, on, [ts, tiebreak], nearest=names, time="_t", tolerance=tolerance_s * 1_000_000, **also
    ).drop("_t")
    out = filled if keep_slices else unsliced(filled)
    return out if default is None else out.fillna(default, subset=list(names))


def _grid(own: Column, across: Column, rows_per_task: int) -> list[Column]:
    """Salts and shares of a cell of ``own`` left and ``across`` right rows (neither 0).

    Of all grids with so many shares in all, the one as long by wide as the rows of the two sides repeats the fewest;
    each side may fill half of the copies.
    """
    wanted, most = F.ceil(own * across / rows_per_task).cast("double"), COPIES / 2 * (own + across)
    salts = F.greatest(F.lit(1.0), F.floor(F.least(F.sqrt(wanted * own / across), most / across)))
    parts = F.greatest(F.lit(1.0), F.ceil(F.least(wanted / salts, most / own)))
    return [salts.cast("int").alias("_salts"), parts.cast("int").alias("_parts")]


def interval_join(
    left: DataFrame, right: DataFrame, on: Sequence[str], left_time: str, right_time: str,
    seconds: float, take: Sequence[str], closed: bool = False, how: str = "left",
    rows_per_task: int = PAIRS_PER_TASK,
) -> DataFrame:
    """Every right row less than ``seconds`` away (at most, when closed) from each left row.

    The pairs are the result here.  They are found on (key, time cell) with cells as wide as the interval,
    so the join tests about 1.5 candidates per pair.  A cell too full by its left rows or by its pairs is
    salted: its left rows are spread, its right rows repeated once per salt.  Its right rows are dealt into shares
    the other way round, its left rows repeated once per share.  Both numbers are chosen together so that few rows
    are repeated, and at most COPIES times the rows of the cell: what is shuffled grows with the rows, only what
    is put out grows with the pairs.  Right rows of such a cell out of reach of its first and its last left row
    are not shuffled.  The work of a share is its pairs, not its bytes, so where a cell is too full the tasks are as
    many as the pairs ask for, a share each at most, and Spark does not merge them by size.  A share cannot tell
    whether a left row has a match in another, so in a left join the rows of such cells that have none come from one pass of ``nearest_join`` over these cells.
    """
    width = round(seconds * 1_000_000)
    cell = F.floor(F.col("_lt") / width)
    placed = left.withColumn("_lt", micros(left_time)).withColumn("_cell", cell)
    # Either side alone may be what fills a cell; its pairs are about as many as the product of both.
    around = F.explode(F.array(F.col("_home") - 1, F.col("_home"), F.col("_home") + 1))
    others = (
        right.groupBy(*on, F.floor(micros(right_time) / width).alias("_home")).agg(F.count("*").alias("_n"))
        .select(*on, "_n", around.alias("_cell")).groupBy(*on, "_cell").agg(F.sum("_n").alias("_others"))
    )
    own, across = F.col("_own"), F.coalesce(F.col("_others"), F.lit(0))
    load = F.greatest(own, F.sqrt(own * across))
    full = (
        placed.groupBy(*on, "_cell").agg(F.count("*").cast("double").alias("_own"), F.min("_lt").alias("_from"), F.max("_lt").alias("_to"))
        .join(others, [*on, "_cell"], "left")
        .where((load > rows_per_task) | (across > rows_per_task)).withColumn("_across", F.greatest(across, F.lit(1)).cast("double"))
    )
    hot = settled(full.select(*on, "_cell", "_from", "_to", (own * F.col("_across")).alias("_pairs"), *_grid(own, F.col("_across"), rows_per_task)))
    pairs, shares = hot.agg(F.sum("_pairs"), F.sum(F.col("_salts") * F.col("_parts"))).first()
    tasks = pairs and max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(ceil(pairs / PAIRS_AT_ONCE), shares))
    grid = hot.drop("_from", "_to", "_pairs")
    salts, parts = F.coalesce(F.col("_salts"), F.lit(1)), F.coalesce(F.col("_parts"), F.lit(1))

    def dealt(columns: Sequence[str], n: Column) -> Column:
        return F.when(n > 1, F.pmod(F.xxhash64(*columns), n)).otherwise(F.lit(0)).cast("int")

    spread = (
        placed.join(grid, [*on, "_cell"], "left").withColumn("_salt", dealt(left.columns, salts))
        .withColumn("_split", parts > 1).withColumn("_share", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_salts", "_parts")
    )
    home = F.floor(F.col("_rt") / width)
    copies = (
        right.select(*on, *[F.col(name).alias(f"_r_{name}") for name in take], micros(right_time).alias("_rt"))
        .withColumn("_cell", F.explode(F.array(home - 1, home, home + 1)))
        .join(hot.drop("_pairs"), [*on, "_cell"], "left")
        .where(F.col("_from").isNull() | F.col("_rt").between(F.col("_from") - width, F.col("_to") + width))
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1)))
        .withColumn("_share", dealt(["_rt", *[f"_r_{name}" for name in take]], parts))
        .drop("_salts", "_parts", "_from", "_to")
    )
    keys = [*on, "_cell", "_salt", "_share"]
    if tasks:
        spread, copies = spread.repartition(tasks, *keys), copies.repartition(tasks, *keys)
    a, b = spread.alias("a"), copies.alias("b")
    gap = F.abs(F.col("a._lt") - F.col("b._rt"))
    test = gap <= width if closed else gap < width
    for key in keys:
        test = (F.col(f"a.{key}") == F.col(f"b.{key}")) & test
    named = {name: name if name not in left.columns else f"right_{name}" for name in take}
    out = [F.col(f"a.{name}").alias(name) for name in left.columns]
    out += [F.col(f"b._r_{name}").alias(new) for name, new in named.items()]
    # Spark takes the size of rows before they are repeated for theirs, so it must not choose to broadcast them.
    joined = a.join(b.hint("merge"), test, how)
    if how == "inner":
        return joined.select(*out)
    found = joined.where(~F.col("a._split") | F.col("b._rt").isNotNull()).select(*out)
    split = hot.where(F.col("_parts") > 1).select(*on, "_cell")
    if split.isEmpty():  # no cell is cut: the join above has told every row without a match
        return found
    asked = placed.join(split, [*on, "_cell"], "left_semi").select(*left.columns)
    near_split = split.withColumn("_home", F.explode(F.array(F.col("_cell") - 1, F.col("_cell"), F.col("_cell") + 1))).drop("_cell").distinct()
    answers = (
        right.withColumn("_home", F.floor(micros(right_time) / width)).join(near_split, [*on, "_home"], "left_semi")
        .select(*on, micros(right_time).alias("_rt"), F.col(right_time).alias("_at"))
    )
    alone = nearest_join(
        asked, answers, on, left_time, "_at", left_time, "_rt", ["_rt"], (width if closed else width - 1) / 1_000_000
    ).where(F.col("_rt").isNull()).drop("_rt")
    none = right.select(*[F.col(name).alias(new) for name, new in named.items()]).schema
    return found.unionByName(alone.select(*left.columns, *[F.lit(None).cast(f.dataType).alias(f.name) for f in none]))


# The fewest runs of 2^level cells, each from a multiple of its length on, that hold the cells from _low before _last.
# A level gives the run at either end that the next level's runs do not hold.
_COVER = """
filter(flatten(transform(
  transform(sequence(0, cast(ceil(log2(_last - _low)) as int)),
    j -> struct(j as level, shiftright(_low + shiftleft(1L, j) - 1, j) as low, shiftright(_last, j) as high)),
  r -> array(
    if(r.low < r.high and r.low & 1 = 1, named_struct('level', r.level, 'cell', r.low), null),
    if(r.low < r.high and r.high & 1 = 1, named_struct('level', r.level, 'cell', r.high - 1), null)))), p -> p is not null)
"""


def mean_within(
    spans: DataFrame, samples: DataFrame, on: Sequence[str], span_id: Sequence[str], start: str, end: str,
    time: str, columns: Sequence[str], pad_s: float = 0.0, cell_s: float = 60.0,
) -> DataFrame:
    """Mean of sample columns inside [start - pad, end + pad] of each span.

    Samples are first summed per key and timestamp, then per time cell, then per 2, 4, 8 ... cells up to the length
    of the longest span.  A span takes at most two totals of each width and only its two edge cells from the single
    timestamps, so its cost grows with the logarithm of its length, and copies of a sample cost nothing.  Only
    samples inside a span enter its sum.  Spark takes the size of spans before they are cut into pieces for that of
    the pieces, so it must not choose to broadcast them.
    """
    width, pad = int(cell_s * 1_000_000), int(pad_s * 1_000_000)
    totals = [F.sum(name).alias(f"_s_{name}") for name in columns]
    totals += [F.count(name).alias(f"_c_{name}") for name in columns]
    instants = (
        samples.select(*on, micros(time).alias("_t"), *columns).groupBy(*on, "_t").agg(*totals)
        .withColumn("_cell", F.floor(F.col("_t") / width))
    )
    again = [F.sum(f"{p}{name}").alias(f"{p}{name}") for p in ("_s_", "_c_") for name in columns]
    reach = spans.select(
        *on, *span_id, (micros(start) - pad).alias("_from"), (micros(end) + pad).alias("_to")
    ).withColumns({"_first": F.floor(F.col("_from") / width), "_last": F.floor(F.col("_to") / width)})
    edge = reach.withColumn("_cell", F.explode(F.array_distinct(F.array("_first", "_last"))))
    # Whole cells of a span: from _low, before _last.
    inner = reach.where(F.col("_last") - F.col("_first") > 1).withColumn("_low", F.col("_first") + 1)
    levels = inner.agg(F.ceil(F.log2(F.max(F.col("_last") - F.col("_low"))))).first()[0] or 0
    covers = (
        inner.withColumn("_cover", F.explode(F.expr(_COVER)))
        .select(*on, *span_id, F.col("_cover.level").alias("_level"), F.col("_cover.cell").alias("_cell"))
    )
    cells = (
        instants.groupBy(*on, "_cell").agg(*again)
        .withColumn("_level", F.explode(F.sequence(F.lit(0), F.lit(levels).cast("int"))))
        .withColumn("_cell", F.expr("shiftright(_cell, _level)")).groupBy(*on, "_level", "_cell").agg(*again)
    )
    parts = [*on, *span_id, *[f"{p}{name}" for p in ("_s_", "_c_") for name in columns]]
    pieces = (
        edge.hint("merge").join(instants, [*on, "_cell"]).where(F.col("_t").between(F.col("_from"), F.col("_to"))).select(*parts)
        .unionByName(covers.hint("merge").join(cells, [*on, "_level", "_cell"]).select(*parts))
    )
    means = pieces.groupBy(*on, *span_id).agg(*again).select(
        *on, *span_id,
        *[(F.col(f"_s_{n}") / F.nullif(F.col(f"_c_{n}"), F.lit(0))).alias(f"mean_{n}") for n in columns],
    )
    return spans.join(means, [*on, *span_id], "left")


def with_group_max(df: DataFrame, group: str, value: str, name: str) -> DataFrame:
    """Each row with the largest value of its group.  The per-group table is written first: where it is small,
    Spark knows so when it plans the join and leaves the rows where they are."""
    most = settled(df.groupBy(F.col(group).alias("_group")).agg(F.max(value).alias(name)))
    return df.join(most, df[group] == most["_group"], "left").select(*[df[n] for n in df.columns], name)

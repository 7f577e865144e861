"""Sliced windows against plain loops, with one key that holds most rows and with ties of time."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from voltlake.operators import sequence as Q
from voltlake.operators.align import nearest_value

T0 = datetime(2024, 1, 1)
LAYOUT = "k string, ts timestamp_ntz, id int, v double"


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(7)
    out = []
    for i in range(1500):
        key = "hot" if i % 3 else f"k{rnd.randrange(6)}"
        # Half of the hot rows share one hour, many of them one second.
        second = rnd.randrange(600) // 40 * 40 if key == "hot" and i % 2 else rnd.randrange(4 * 86_400)
        out.append((key, T0 + timedelta(seconds=second), i, None if rnd.random() < 0.3 else float(rnd.randrange(100))))
    rnd.shuffle(out)
    return out


@pytest.fixture(scope="module", params=[64, 1_000_000], ids=["split", "whole"])
def placed(spark, rows, request):
    df = spark.createDataFrame(rows, LAYOUT)
    return Q.sliced(df, ["k"], "ts", ["id"], seconds=3600, rows_per_slice=request.param).cache()


def in_order(rows):
    by_key = {}
    for row in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        by_key.setdefault(row[0], []).append(row)
    return by_key


def test_hot_bucket_is_split_and_order_kept(spark, rows):
    df = Q.sliced(spark.createDataFrame(rows, LAYOUT), ["k"], "ts", ["id"], seconds=3600, rows_per_slice=64)
    sizes = {(r["k"], r["_bucket"], r["_part"]): r["count"] for r in df.groupBy("k", "_bucket", "_part").count().collect()}
    assert sum(sizes.values()) == len(rows)
    assert max(sizes.values()) <= 2 * 64 + 1
    edges = df.groupBy("k", "_bucket", "_part").agg(F.min(F.struct("ts", "id")).alias("a"), F.max(F.struct("ts", "id")).alias("b"))
    spans = sorted((r["k"], r["_bucket"], r["_part"], tuple(r["a"]), tuple(r["b"])) for r in edges.collect())
    for left, right in zip(spans, spans[1:]):
        if left[0] == right[0]:
            assert left[4] < right[3]


def test_lag_and_rolling(placed, rows):
    got = Q.framed(placed, ["k"], ["ts", "id"], 10, {
        "prev": lambda w: F.lag("v").over(w),
        "total": lambda w: F.sum("v").over(w.rowsBetween(-10, Window.currentRow)),
    })
    mine = {r["id"]: (r["prev"], r["total"]) for r in got.collect()}
    assert len(mine) == len(rows)
    for series in in_order(rows).values():
        for i, row in enumerate(series):
            frame = [r[3] for r in series[max(0, i - 10):i + 1] if r[3] is not None]
            assert mine[row[2]] == (series[i - 1][3] if i else None, sum(frame) if frame else None)


def test_running_and_last(placed, rows):
    got = Q.carried(
        placed, ["k"], ["ts", "id"], sums={"n": F.when(F.col("v") > 50, 1).otherwise(0)},
        lasts={"last": F.col("v")}, befores={"before": F.col("v")},
    )
    mine = {r["id"]: (r["n"], r["last"], r["before"]) for r in got.collect()}
    for series in in_order(rows).values():
        n, last = 0, None
        for row in series:
            before = last
            n += row[3] is not None and row[3] > 50
            last = row[3] if row[3] is not None else last
            assert mine[row[2]] == (n, last, before)


def test_nearest_value(spark, rows):
    df = spark.createDataFrame(rows, LAYOUT)
    got = nearest_value(df, ["k"], "ts", "id", ["v"], 300, rows_per_slice=64)
    mine = {r["id"]: r["near_v"] for r in got.collect()}
    for series in in_order(rows).values():
        for i, row in enumerate(series):
            best = None
            for j in [*range(i, -1, -1), *range(i + 1, len(series))]:
                other = series[j]
                gap = abs((other[1] - row[1]).total_seconds())
                if other[3] is not None and gap <= 300 and (best is None or gap < best[0]):
                    best = (gap, other[3])
            assert mine[row[2]] == (best and best[1])


def test_row_number_over_everything(spark, rows):
    df = spark.createDataFrame(rows, LAYOUT).select("id", "v")
    order = [F.col("v").desc_nulls_last(), F.col("id").asc()]
    want = [r[2] for r in sorted(rows, key=lambda r: (r[3] is None, -(r[3] or 0), r[2]))]
    for ranges in (1, 7, 300):
        got = Q.global_row_number(df, "rn", order, "n", ranges).collect()
        assert [r["id"] for r in sorted(got, key=lambda r: r["rn"])] == want
        assert sorted(r["rn"] for r in got) == list(range(1, len(rows) + 1)) and {r["n"] for r in got} == {len(rows)}
    assert Q.global_row_number(df.where("false"), "rn", order).count() == 0


def test_one_value_of_most_rows_still_spreads(spark):
    df = spark.range(20_000).select((F.col("id") % 10 == 0).cast("int").alias("v"), "id")
    sizes = [r["count"] for r in Q.in_ranges(df, [F.col("v").asc(), F.col("id").asc()], 8).groupBy("_range").count().collect()]
    assert sum(sizes) == 20_000 and max(sizes) < 6_000


def test_lag_over_slices(placed, rows):
    got = {r["id"]: (r["prev"], r["prev_id"]) for r in Q.lagged(placed, ["k"], ["ts", "id"], {"prev": "v", "prev_id": "id"}).collect()}
    for series in in_order(rows).values():
        for i, row in enumerate(series):
            assert got[row[2]] == ((series[i - 1][3], series[i - 1][2]) if i else (None, None))


def test_rows_without_key_or_time_stay_without_a_place(spark):
    df = spark.createDataFrame([(None, T0, 1, 1.0), ("a", T0, 2, 1.0), ("a", None, 3, 1.0), ("a", T0, 4, 2.0)], LAYOUT)
    placed = Q.sliced(df, ["k"], "ts", ["id"])
    out = Q.carried(
        Q.lagged(placed, ["k"], ["ts", "id"], {"prev": "id"}).withColumn("t", Q.F.unix_micros(Q.F.col("ts").cast("timestamp"))),
        ["k"], ["ts", "id"], sums={"n": Q.F.lit(1)}, lasts={"seen": Q.F.col("v")}, nearest={"near": "v"}, time="t", tolerance=1e9,
    )
    got = {r["id"]: (r["prev"], r["n"], r["seen"], r["near"]) for r in out.collect()}
    assert got == {1: (None,) * 4, 2: (None, 1, 1.0, 1.0), 3: (None,) * 4, 4: (2, 2, 2.0, 2.0)}
    assert [r["id"] for r in Q.in_sequence(df, "k", "ts").collect()] == [2, 4]


def test_settled_uses_the_named_folder(spark, rows):
    df = spark.createDataFrame(rows, LAYOUT)
    held = Q.settled(df)
    assert held.count() == len(rows) and held.schema == df.schema
    assert all(Q.shared_folder(spark).split("//")[-1] in path for path in held.inputFiles())

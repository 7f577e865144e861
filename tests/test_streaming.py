from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from voltlake.streaming import streams

from test_align import repeated

LAYOUT = "event_id int, device_no string, car_type string, msg_ts timestamp_ntz, soc double, soh double, pack_volt double, pack_current double, mod_avg_temp double, max_cell_volt double, min_cell_volt double"
T0 = datetime(2024, 1, 1)


def row(i, minute, device="a", amps=5.0):
    return (i, device, "GV60", T0 + timedelta(minutes=minute), 50.0, 85.0, 400.0, amps, 20.0, 4.0, 3.9)


@pytest.fixture
def feed(spark, make, tmp_path):
    """Write one file per call; read the folder as a stream."""
    source = tmp_path / "in"

    def add(rows):
        make(LAYOUT, rows).coalesce(1).write.mode("append").parquet(str(source))
        return spark.readStream.schema(spark.read.parquet(str(source)).schema).parquet(str(source))

    return add


def test_late_rows_are_dropped(spark, feed, tmp_path):
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    streams.run_to_files(streams.windowed_fleet_stats(feed([row(1, 5), row(2, 50), row(3, 200)])), out, state)
    streams.run_to_files(streams.windowed_fleet_stats(feed([row(4, 10), row(5, 185), row(6, 400)])), out, state)
    got = {r["window_start"].hour: r["data_points"] for r in spark.read.parquet(out).collect()}
    assert got == {0: 2, 3: 2}  # row 4 came after its window had closed, row 5 did not


def test_stream_equals_batch(spark, feed, make, tmp_path):
    rows = [row(i, i * 3) for i in range(30)]
    streams.run_to_files(streams.stream_anomalies(feed(rows)), str(tmp_path / "out"), str(tmp_path / "state"))
    want = sorted(map(tuple, streams.stream_anomalies(make(LAYOUT, rows)).collect()))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == want and len(want) == 30


def test_sessions_split_at_the_gap(spark, feed, tmp_path):
    minutes = [0, 10, 20, 60, 65, 600]
    rows = [row(i, m) for i, m in enumerate(minutes)] + [row(9, 30, amps=-5.0)]
    streams.run_to_files(streams.charging_by_gap(feed(rows)), str(tmp_path / "out"), str(tmp_path / "state"))
    got = sorted((r["session_start"].minute + 60 * r["session_start"].hour, r["charging_rows"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [(0, 3), (60, 2)]


def test_unmatched_rows_come_after_the_watermark(spark, feed, make, tmp_path):
    bms = feed([row(1, 0), row(2, 30), row(3, 300)])
    gps_path = str(tmp_path / "gps")
    make("gps_id int, device_no string, time timestamp_ntz, speed double, lat double, lng double", [
        (1, "a", T0 + timedelta(minutes=4), 9.0, 1.0, 2.0), (2, "a", T0 + timedelta(minutes=300), 8.0, 1.0, 2.0)]).write.parquet(gps_path)
    gps = spark.readStream.schema(spark.read.parquet(gps_path).schema).parquet(gps_path)
    streams.run_to_files(streams.align_streams(bms.select("event_id", "device_no", "msg_ts"), gps), str(tmp_path / "out"), str(tmp_path / "state"))
    got = sorted((r["event_id"], r["gps_speed"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [(1, 9.0), (2, None), (3, 8.0)]


GPS = "gps_id int, device_no string, time timestamp_ntz, speed double, lat double, lng double"


def position(i, second, device="a"):
    return (i, device, T0 + timedelta(seconds=second), float(i), 1.0, 2.0)


def test_aligned_positions_are_kept_in_few_cells(make):
    """On the borders of cells and of the interval too; cells wider than the interval save copies."""
    bms = [(i, "a" if i % 3 else "b", T0 + timedelta(seconds=100 * i)) for i in range(120)] + [(900, "c", T0), (901, None, T0)]
    gps = [position(i, 75 * i - 600, "a" if i % 2 else "b") for i in range(200)] + [position(900, 301, "c"), position(901, 0, None)]
    out = streams.align_streams(make("event_id int, device_no string, msg_ts timestamp_ntz", bms), make(GPS, gps))
    want = []
    for i, device, t in bms:
        hits = [speed for _, d, u, speed, _, _ in gps if device and d == device and abs((u - t).total_seconds()) <= 300]
        want += [(i, speed) for speed in hits] or [(i, None)]
    key = lambda p: (p[0], p[1] is None, p[1] or 0)
    assert sorted(((r["event_id"], r["gps_speed"]) for r in out.collect()), key=key) == sorted(want, key=key)
    assert repeated(out._jdf.queryExecution().executedPlan()) <= 2.1 * len(gps)  # 3 times before


def test_alignment_across_runs(spark, feed, make, tmp_path):
    """Matches with rows of an earlier run, late and unmatched rows."""
    source = str(tmp_path / "gps")

    def go(bms, gps):
        make(GPS, gps).write.mode("append").parquet(source)
        positions = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source)
        rows = feed(bms).select("event_id", "device_no", "msg_ts")
        streams.run_to_files(streams.align_streams(rows, positions), str(tmp_path / "out"), str(tmp_path / "state"))
        return sorted(((r["event_id"], r["gps_speed"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()), key=str)

    assert go([row(1, 0), row(2, 60), row(3, 100)], [position(1, 200), position(2, 6000)]) == [(1, 1.0), (2, None), (3, 2.0)]
    # row 4 meets a position of the run before, position 3 the row 3, row 5 is late; row 6 is still open
    assert go([row(4, 104), row(5, 1), row(6, 200)], [position(3, 6200), position(4, 20_000)]) == [
        (1, 1.0), (2, None), (3, 2.0), (3, 3.0), (4, 2.0), (4, 3.0)]


def test_refresh_merges_partials_of_touched_days(spark, feed, make, tmp_path):
    place, measures = str(tmp_path / "result"), {"id": F.col("event_id")}

    def days(rows):
        return rows.withColumn("day", F.to_date("msg_ts"))

    def stored():
        return {str(r["day"]): (r["data_points"], r["id_sum"], r["id_min"], r["id_max"], r["avg_id"]) for r in streams.refreshed(spark, place, measures).collect()}

    def go(rows):
        streams.refresh_result(days(feed(rows)), place, str(tmp_path / "state"), ["device_no"], measures)
        return stored()

    assert go([row(1, 0), row(2, 5), row(3, 1500)]) == {"2024-01-01": (2, 3, 1, 2, 1.5), "2024-01-02": (1, 3, 3, 3, 3.0)}
    files = {p.name for p in (tmp_path / "result" / "day=2024-01-01").iterdir()}
    after = go([row(4, 1600)])
    assert after == {"2024-01-01": (2, 3, 1, 2, 1.5), "2024-01-02": (2, 7, 3, 4, 3.5)}
    assert {p.name for p in (tmp_path / "result" / "day=2024-01-01").iterdir()} == files  # left alone
    # the second batch again, and a batch of which only one day had been stored
    streams.merge_batch(days(make(LAYOUT, [row(4, 1600)])), 1, place, ["device_no"], measures)
    assert stored() == after
    streams.merge_batch(days(make(LAYOUT, [row(9, 0), row(4, 1600)])), 1, place, ["device_no"], measures)
    assert stored() == {"2024-01-01": (3, 12, 1, 9, 4.0), "2024-01-02": (2, 7, 3, 4, 3.5)}
    assert not any(p.is_dir() and p.name.startswith("batch=") for p in tmp_path.rglob("*"))


from datetime import datetime

import pytest
from pyspark.sql import functions as F

from voltlake.operators import quality
from voltlake.sources import io, points

BMS = ["device_no", "msg_time", "soc", "pack_volt", "cell_volt_1", "cell_volt_2", "car_type"]


def bms_file(folder, name, rows):
    folder.mkdir(parents=True, exist_ok=True)
    lines = [",".join(BMS)] + [",".join(r) for r in rows]
    (folder / name).write_text("\n".join(lines) + "\n")


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "raw"
    bms_file(root / "GV60", "bms_1.csv", [("1", "23-08-01 00:00:00", "50", "400", "3.5", "3.6", "GV60"), ("1", "23-08-01 00:01:00", "150", "x", "", "3.6", "GV60")])
    bms_file(root / "BONGO3" / "deep", "bms_2.csv", [("2", "23-08-02 00:00:00", "60", "390", "3.5", "3.6", "")])
    return root


def test_read_tree_takes_the_type_from_the_path(spark, tree):
    got = {(r["device_no"], r["car_type"]) for r in io.read_tree(spark, str(tree), "bms", BMS).collect()}
    assert got == {("1", "GV60"), ("2", "BONGO3")}
    assert io.read_tree(spark, str(tree), "gps").count() == 0


def test_batch_ingest_partitions_by_type_and_day(spark, tree, tmp_path):
    target = str(tmp_path / "clean")
    io.ingest_batch(spark, str(tree / "GV60"), target, "bms", BMS)
    out = spark.read.parquet(target)
    assert {"car_type", "day"} <= set(out.columns)
    got = sorted((r["soc"] is None, r["soc"], r["pack_volt"], r["cell_volt"]) for r in out.collect())
    assert got == [(False, 50.0, 400.0, [3.5, 3.6]), (True, None, None, [None, 3.6])]
    plan = out.where("car_type = 'GV60' and day = date'2023-08-01'").select("soc")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(car_type" in plan and "ReadSchema: struct<soc:double>" in plan


def test_incremental_ingest_reads_each_file_once(spark, tree, tmp_path):
    target, state = str(tmp_path / "clean"), str(tmp_path / "state")
    io.ingest_incremental(spark, str(tree / "GV60"), target, state, "bms", BMS)
    assert spark.read.parquet(target).count() == 2
    bms_file(tree / "GV60", "bms_3.csv", [("3", "23-08-03 00:00:00", "70", "380", "3.5", "3.6", "GV60")])
    io.ingest_incremental(spark, str(tree / "GV60"), target, state, "bms", BMS)
    io.ingest_incremental(spark, str(tree / "GV60"), target, state, "bms", BMS)
    assert sorted(r[0] for r in spark.read.parquet(target).select("device_no").collect()) == ["1", "1", "3"]


def test_profile_files(spark, make, tmp_path):
    io.write_profile(quality.profile(make("a int", [(1,), (None,)])), str(tmp_path / "p"))
    assert spark.read.json(str(tmp_path / "p/json")).first()["null_percentage"] == 50.0
    assert spark.read.option("header", True).csv(str(tmp_path / "p/csv")).first()["column_name"] == "a"
    assert spark.read.text(str(tmp_path / "p/report")).first()[0] == "a (int): 2 rows, 1 null (50.0%), 1 distinct"


def test_materialize_replace_and_drop(spark, make, tmp_path):
    location = (tmp_path / "db").as_uri()
    spark.sql(f"CREATE DATABASE IF NOT EXISTS volt_test LOCATION '{location}'")
    spark.sql("USE volt_test")
    try:
        assert io.materialize(make("a int", [(1,)]), "fleet_x").count() == 1
        assert io.materialize(make("a int", [(1,), (2,)]), "fleet_x").count() == 2
        assert [r["name"] for r in io.list_tables(spark, "fleet_*").collect()] == ["fleet_x"]
        io.drop_materialized(spark, "fleet_x")
        assert io.list_tables(spark, "fleet_*").count() == 0
    finally:
        spark.sql("USE default")
        spark.sql("DROP DATABASE volt_test CASCADE")


def test_points_round_trip(make):
    wide = make("device_no string, car_type string, msg_ts timestamp_ntz, soc double, soh double", [
        ("1", "GV60", datetime(2024, 1, 1), 50.0, None), ("1", "GV60", datetime(2024, 1, 2), 60.0, 90.0)])
    long = points.to_points(wide, ["soc", "soh"], "msg_ts")
    assert long.count() == 3
    back = points.pivot_points(long, ["soc", "soh"]).orderBy("time").select("soc", "soh")
    assert [tuple(r) for r in back.collect()] == [(50.0, None), (60.0, 90.0)]
    nan = long.withColumn("value", F.when(F.col("field") == "soh", float("nan")).otherwise(F.col("value")))
    assert points.scan_points(nan, "bms", pattern="^so").count() == 2
    assert points.scan_points(long, stop="2024-01-02 00:00:00", device_no="1").count() == 1


def test_kind_comes_from_the_path_and_bad_lines_go_aside(spark, tmp_path):
    root = tmp_path / "bms_2024" / "raw"  # the folder given says nothing about its files
    bms_file(root / "BMS" / "gv60", "one.csv", [("1", "23-08-01 00:00:00", "50", "400", "3.5", "3.6", "")])
    bms_file(root / "gps" / "GV60", "two.csv", [("9", "23-08-01 00:00:00", "50", "400", "3.5", "3.6", "GV60")])
    bms_file(root / "gps", "x_BMS_3.csv", [("3", "23-08-01 00:00:00", "50", "400", "3.5", "3.6", "BONGO3"), ("4", "broken", "1", "2", "3", "4", "5", "6", "7")])
    assert {r["device_no"] for r in io.read_tree(spark, str(root), "bms", BMS).where("_corrupt_record is null").collect()} == {"1", "3"}
    assert {r["device_no"] for r in io.read_tree(spark, str(root), "gps", BMS).collect()} == {"9"}
    for ingest in ("batch", "incremental"):
        target = str(tmp_path / ingest)
        if ingest == "batch":
            io.ingest_batch(spark, str(root), target, "bms", BMS)
        else:
            io.ingest_incremental(spark, str(root), target, f"{target}_state", "bms", BMS)
        got = {(r["device_no"], r["car_type"]) for r in spark.read.parquet(target).collect()}
        assert got == {("1", "GV60"), ("3", "BONGO3")}
        assert [r["line"].split(",")[1] for r in spark.read.parquet(f"{target}_rejects").collect()] == ["broken"]


def test_time_filters_open_only_their_days(spark, make, tmp_path):
    from voltlake.operators import select

    rows = [(i, "GV60", datetime(2024, 1, 1 + i % 28, 12)) for i in range(100)]
    df = make("id int, car_type string, msg_ts timestamp_ntz", rows).withColumn("day", F.to_date("msg_ts"))
    io.write_telemetry(df, str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    for out in (
        select.last_interval(stored, "msg_ts", "2024-01-20 08:00:00", 3), select.in_month(stored, "msg_ts", "2024-01"),
        select.between_time(stored, "msg_ts", "2024-01-05 00:00:00", "2024-01-06 12:00:00"),
    ):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(day" in plan and "PushedFilters: [IsNotNull(msg_ts)" in plan
    assert select.in_month(stored, "msg_ts", "2023-12").count() == 0 and select.in_month(stored, "msg_ts", "2024-01").count() == 100


def test_small_join_sides_do_not_move_the_rows(spark, make, tmp_path):
    from voltlake.operators import align

    make("g string, v int", [(str(i % 3), i) for i in range(50)]).write.parquet(str(tmp_path / "t"))
    out = align.with_group_max(spark.read.parquet(str(tmp_path / "t")), "g", "v", "m")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan


def test_clustered_rows_stay_where_they_are(spark, make, tmp_path):
    """Lag, totals and carried values read a clustered table in place: only border rows are exchanged."""
    from voltlake.operators import sequence as Q

    rows = [(i, "hot" if i % 3 else f"d{i % 7}", datetime(2024, 1, 1 + i % 27, i % 24), float(i % 50)) for i in range(600)]
    df = make("msg_id int, device_no string, msg_ts timestamp_ntz, soc double", rows + [(900, None, datetime(2024, 1, 1), 1.0), (901, "hot", None, 2.0)])
    name, order, key = "volt_clustered", ["msg_ts", "msg_id"], ["device_no"]
    stored = io.write_clustered(df, name, str(tmp_path / "c"), buckets=6, rows_per_slice=64)
    try:
        passes = {
            "lag": lambda t: Q.lagged(t, key, order, {"prev": "soc"}),
            "sum": lambda t: Q.running(t, key, order, sums={"n": F.lit(1)}),
            "last": lambda t: Q.carried(t, key, order, lasts={"last": F.when(F.col("soc") > 20, F.col("soc"))}),
        }
        plain = Q.sliced(df, key, "msg_ts", ["msg_id"])
        for name_of, run in passes.items():
            plan = run(stored)._jdf.queryExecution().executedPlan().toString()
            assert "Bucketed: true" in plan
            lines = plan.splitlines()
            for i, line in enumerate(lines):  # every exchange stands over the partial aggregate of a slice or its one row
                if "Exchange hashpartitioning" in line:
                    assert "HashAggregate" in lines[i + 1] or "SortAggregate" in lines[i + 1] or "ObjectHashAggregate" in lines[i + 1], line
            assert sorted(map(str, Q.unsliced(run(stored)).collect())) == sorted(map(str, Q.unsliced(run(plain)).collect()))
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")

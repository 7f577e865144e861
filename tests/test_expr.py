import math

from pyspark.sql import functions as F

from voltlake.functions import expr as E


def one(df, column):
    return [row[0] for row in df.select(column).collect()]


CELLS = "pack_volt double, max_cell_volt double, min_cell_volt double"


def test_balance_index_guards(make):
    df = make(CELLS, [(400.0, 4.2, 4.0), (0.0, 4.2, 4.0), (None, 4.2, 4.0), (-5.0, 4.2, 4.0), (400.0, None, 4.0)])
    got = one(df, E.cell_balance_index(0.0))
    assert math.isclose(got[0], 0.05) and got[1:] == [0, 0, 0, 0]
    assert one(df, E.cell_balance_index(None))[1:] == [None] * 4


def test_number_keeps_only_finite(make):
    df = make("v string", [("1.5",), ("NaN",), ("inf",), ("true",), ("False",), ("x",), (" 2 ",), (None,)])
    assert one(df, E.number("v")) == [1.5, None, None, 1.0, 0.0, None, 2.0, None]


def test_grade_edges(make):
    df = make("soh double", [(90.0,), (89.99,), (80.0,), (70.0,), (69.9,), (None,)])
    assert one(df, E.soh_grade("soh")) == ["우수", "양호", "양호", "보통", "불량", None]


def test_temperature_bands(make):
    df = make("mod_avg_temp double", [(15.0,), (35.0,), (10.0,), (40.0,), (5.0,), (45.0,), (46.0,), (None,)])
    assert one(df, E.temperature_score()) == [100, 100, 80, 80, 60, 60, 40, 40]


def test_stability_score_of_first_row_is_zero(make):
    df = make("pack_volt double, std double", [(400.0, None), (400.0, 2.0), (400.0, 50.0), (0.0, 1.0)])
    assert one(df, E.voltage_stability_score("std")) == [0.0, 80.0, 0.0, 100.0]


def test_missing_inputs_of_scores(make):
    df = make(CELLS, [(400.0, 4.2, 4.0), (400.0, None, 4.0), (400.0, 90.0, 4.0), (None, 4.2, 4.0)])
    assert [round(v, 6) for v in one(df, E.balance_score())] == [99.5, 100.0, 0.0, 100.0]
    df = make("v double", [(None,), (-5.0,), (150.0,), (7.0,)])
    assert one(df, E.clamp("v", 0.0, 100.0)) == [None, 0.0, 100.0, 7.0]


def test_status_variants(make):
    df = make("pack_current double, speed double", [(2.0, 0.0), (-2.0, 10.0), (-2.0, 3.0), (0.5, 6.0), (0.6, None), (0.0, None)])
    assert one(df, E.vehicle_status("current")) == ["charging", "discharging", "discharging", "idle", "idle", "idle"]
    assert one(df, E.vehicle_status("speed")) == ["charging", "driving", "idle", "charging", "charging", "idle"]
    assert one(df, E.vehicle_status("moving")) == ["charging", "moving", "stopped", "moving", "charging", "stopped"]


def test_driving_modes(make):
    df = make("speed double", [(80.0,), (81.0,), (50.0,), (40.0,), (20.0,), (5.0,), (None,)])
    assert one(df, E.driving_mode("speed", "above")) == [
        "urban_highway", "highway", "urban_highway", "urban", "slow_urban", "stationary", "stationary"]
    assert one(df, E.driving_mode("speed", "from")) == [
        "highway", "highway", "urban_highway", "urban", "urban", "slow_urban", "stationary"]


def test_charging_status_unknown_flag(make):
    df = make("pack_current double, chrg_cable_conn int", [(1.0, None), (0.0, 1), (0.0, 0), (0.0, None)])
    got = [tuple(row) for row in df.select(E.charging_status().alias("s")).select("s.is_charging", "s.is_cable_connected", "s.charging_status").collect()]
    assert got == [(True, None, "charging"), (False, True, "connected"), (False, False, "disconnected"), (False, None, "disconnected")]


def test_rule_order_and_severity(make):
    layout = "soh double, " + CELLS + ", mod_avg_temp double, pack_current double"
    df = make(layout, [
        (85.0, 400.0, 4.0, 4.0, 60.0, 0.0), (95.0, 400.0, 20.0, 4.0, 20.0, 0.0), (95.0, 400.0, 4.0, 4.0, -5.0, 0.0),
        (95.0, 290.0, 4.0, 4.0, 20.0, 0.0), (95.0, 400.0, 4.0, 4.0, 20.0, -60.0), (95.0, 400.0, 4.0, 4.0, 20.0, 0.0)])
    rows = df.select(E.rule_anomaly().alias("r")).select("r.*").collect()
    assert [r[0] for r in rows] == ["low_soh", "high_imbalance", "low_temperature", "low_voltage", "extreme_current", "normal"]
    assert [round(r[1], 6) for r in rows] == [10.0, 10.0, 10.0, 5.0, 20.0, 0.0]


def test_duration_season_and_calendar(make):
    df = make("s double", [(3661.0,), (61.5,), (59.0,), (0.0,)])
    assert one(df, E.format_duration("s")) == ["1h 1m 1s", "1m 1s", "59s", "0s"]
    days = make("d string", [("2024-12-02",), ("2024-03-03",), ("2024-06-01",), ("2024-11-30",)]).select(F.to_timestamp("d").alias("t"))
    assert one(days, E.season("t")) == ["winter", "spring", "summer", "fall"]
    assert one(days, E.season_number("t")) == [0, 1, 2, 3]
    assert one(days, E.season("t", "quarter")) == ["winter", "spring", "summer", "winter"]
    assert one(days, E.calendar_features("t")[1]) == [0, 6, 5, 5]


def test_change_needs_positive_previous(make):
    df = make("v double, p double", [(110.0, 100.0), (1.0, 0.0), (1.0, -5.0), (1.0, None)])
    assert one(df, E.pct_change("v", "p")) == [10.0, 0.0, 0.0, 0.0]


def test_rounding_ignores_sum_noise(make):
    df = make("v double", [(61.724999999999994,), (1.005,), (-0.0,)])
    assert one(df, E.rounded("v", 2)) == [61.73, 1.01, 0.0]

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from voltlake.operators import select as D
from voltlake.plans import anomaly, battery, energy, fleet, forecast, ranking

BMS = "event_id int, device_no string, car_type string, msg_ts timestamp_ntz, soc double, soh double, pack_volt double, pack_current double, mod_avg_temp double, max_cell_volt double, min_cell_volt double, odometer double, chrg_cable_conn int"
T0 = datetime(2024, 1, 1)


def row(i, device, day=0.0, soc=50.0, soh=95.0, volt=400.0, amps=0.0, temp=25.0, high=4.0, low=4.0, odo=0.0, cable=0, kind="GV60"):
    return (i, device, kind, T0 + timedelta(days=day), soc, soh, volt, amps, temp, high, low, odo, cable)


def vehicles(make, scores):
    layout = "vehicle_id string, vehicle_type string, latest_soh double, latest_soc double, cell_balance_index double"
    return make(layout, [(v, "GV60", float(a), float(b), float(i)) for v, a, b, i in scores])


def test_ranking_ties_and_percentiles(make):
    df = vehicles(make, [("b", 90, 50, 0), ("a", 90, 50, 0), ("c", 80, 60, 1), ("d", 99, 99, 0), ("e", 10, 10, 0)])
    got = {r["vehicle_id"]: r for r in ranking.vehicle_rankings(df).collect()}
    assert [got[v]["overall_rank"] for v in "dabce"] == [1, 2, 3, 4, 5]
    assert [got[v]["performance_category"] for v in "dabce"] == ["TOP_10", "AVERAGE", "AVERAGE", "NEEDS_ATTENTION", "NEEDS_ATTENTION"]
    assert got["c"]["soc_rank"] == 2 and got["c"]["soh_rank"] == 4


def test_single_vehicle_has_percentile_zero(make):
    assert ranking.vehicle_rankings(vehicles(make, [("a", 90, 50, 0)])).first()["performance_category"] == "NEEDS_ATTENTION"


def test_zscores_skip_zero_and_single_vehicle_types(make):
    rows = [row(i, f"d{i}", soh=90.0 + i % 2) for i in range(12)] + [row(20, "odd", soh=20.0), row(30, "alone", soh=5.0, kind="BONGO3")]
    got = {r["device_no"]: r for r in anomaly.zscore_anomalies(make(BMS, rows)).collect()}
    assert set(got) == {"odd"} and got["odd"]["anomaly_type"] == "soh_anomaly" and got["odd"]["risk_level"] == "critical"
    assert got["odd"]["anomaly_description"] == "SOH is 65.1% below the type average of 85.1%"
    base = anomaly.zscore_all(anomaly.device_indicators(make(BMS, [row(1, "a", temp=0.0), row(2, "b", temp=30.0)])))
    assert base.first()["baseline_temp"] == 30.0


def test_missing_sensor_is_unknown_unless_asked(make):
    df = make(BMS, [row(1, "a", temp=None)])
    assert anomaly.device_indicators(df).first()["composite_health_index"] is None
    assert anomaly.device_indicators(df, default=0.0).first()["mod_avg_temp"] == 0.0


def test_latest_value_is_per_field(make):
    df = make(BMS, [row(1, "a", 0, soc=10.0, soh=80.0), row(2, "a", 1, soc=None, soh=None)])
    gps = make("gps_id int, device_no string, car_type string, time timestamp_ntz, speed double, lat double, lng double", [(1, "a", "GV60", T0, 6.0, 1.0, 2.0)])
    got = fleet.device_snapshot(df, gps).first()
    assert (got["latest_soc"], got["latest_soh"], got["vehicle_status"], got["last_updated"]) == (10.0, 80.0, "moving", T0 + timedelta(days=1))


def test_scores_stay_in_range(make):
    rows = [row(i, f"d{i}", soc=i % 101, soh=(i * 7) % 101, volt=200.0 + i, temp=float(i % 90 - 20), high=4.0 + i % 13, odo=i * 300.0) for i in range(60)]
    df = make(BMS, [tuple(float(v) if isinstance(v, int) and k in (4, 5) else v for k, v in enumerate(r)) for r in rows])
    low, high = ranking.score_vehicle(df, "2024-02-01 00:00:00").agg(F.min("overall_score"), F.max("overall_score")).first()
    assert 0 <= low <= high <= 100
    scores = anomaly.device_indicators(df).agg(F.min("composite_health_index"), F.max("composite_health_index")).first()
    assert 0 <= scores[0] <= scores[1] <= 100


def test_health_of_a_first_row(make):
    gps = make("gps_id int, device_no string, car_type string, time timestamp_ntz, speed double, lat double, lng double, fuel_pct double", [])
    got = battery.battery_health(make(BMS, [row(1, "a", soh=100.0)]), gps).first()
    assert got["voltage_stability_score"] == 0.0 and got["composite_health_index"] == 85.0 and got["health_grade"] == "good"


def test_row_order_changes_nothing(make):
    rows = [row(i, f"d{i % 4}", i / 7, soc=float(i % 90), volt=380.0 + i % 9, temp=float(i % 40)) for i in range(80)]
    one = battery.temp_volt_response(make(BMS, rows)).collect()
    two = battery.temp_volt_response(make(BMS, rows[::-1])).collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, two))


def test_paging(make):
    df = make("id int, v double", [(i, float(i // 3)) for i in range(50)] + [(99, None)])
    pages = [D.paginate(df, "v", "id", "desc", p, 20).collect() for p in (1, 2, 3)]
    numbered = [sorted(D.paginate_rn(df, "v", "id", p, 20).collect(), key=lambda r: r["row_num"]) for p in (1, 2, 3)]
    assert [[r["id"] for r in p] for p in pages] == [[r["id"] for r in p] for p in numbered]
    assert tuple(D.page_info(df, 20).first()) == (51, 3)


@pytest.mark.parametrize("order", ["asc", "desc"])
def test_cursor_walks_all_pages(make, order):
    df = make("id int, v double", [(i, float(i // 7)) for i in range(40)] + [(90 + i, None) for i in range(9)])
    whole, after, seen = [r["id"] for r in D.paginate(df, "v", "id", order, 1, 99).collect()], None, []
    while page := D.paginate_after(df, "v", "id", after, order, 6).collect():
        seen += [r["id"] for r in page]
        after = (page[-1]["v"], page[-1]["id"])
    assert seen == whole


# ---------------------------------------------------------------- forecasts and models


def soh_rows(values, device="a"):
    return [row(i, device, float(i), soh=v) for i, v in enumerate(values)]


def test_linear_forecast(make):
    df = make(BMS, soh_rows([95 - 0.5 * i for i in range(10)], "a") + soh_rows([95.0] * 9, "b") + soh_rows([80.0] * 10, "c") + soh_rows([50.0 - 5 * i for i in range(10)], "d"))
    out = forecast.forecast_soh_linear(df, 20)
    got = {(r["device_no"], r["days_from_now"]): r for r in out.collect()}
    assert {d for d, _ in got} == {"a", "c", "d"} and len(got) == 60
    assert got["a", 1]["predicted_soh"] == pytest.approx(90.0) and str(got["a", 1]["date"]) == "2024-01-11"
    assert got["c", 20]["predicted_soh"] == pytest.approx(80.0) and got["d", 20]["predicted_soh"] == 0.0
    report = {r["device_no"]: r for r in forecast.soh_report(df, out).collect()}
    assert (report["a"]["priority"], report["a"]["comparison"], report["d"]["priority"]) == ("low", "better", "high")
    assert len(report["a"]["history"]) == 10 and report["c"]["comparison"] == "unknown"


def test_confidence(make):
    df = make(BMS, soh_rows([90.0] * 9, "few") + soh_rows([90.0] * 50, "many"))
    assert {r["device_no"]: r["confidence"] for r in forecast.forecast_confidence(df).collect()} == {"few": 0.3, "many": 1.0}


@pytest.fixture(scope="module")
def seasonal(spark):
    days = spark.range(730).select(
        F.date_add(F.lit("2022-01-01").cast("date"), F.col("id").cast("int")).alias("ds"),
        (98 - 0.004 * F.col("id") + 1.5 * F.sin(F.col("id") * 2 * 3.141592653589793 / 365.25)
         + F.pmod(F.xxhash64("id"), F.lit(100)) / 500 - 0.1).alias("y"),
        F.lit(9).alias("data_count"),
    )
    return days, forecast.fit_soh_seasonal(days)


def test_seasonal_model_finds_trend_and_wave(spark, seasonal):
    days, model = seasonal
    assert model.sigma < 0.1 and model.waves == 3
    start = spark.createDataFrame([("a", datetime(2023, 12, 31).date())], "device_no string, last_date date")
    got = forecast.forecast_soh_seasonal(model, start, 60).orderBy("days_from_now").collect()
    import math

    for r in got:
        n = 729 + r["days_from_now"]
        truth = 98 - 0.004 * n + 1.5 * math.sin(n * 2 * math.pi / 365.25)
        assert abs(r["predicted_soh"] - truth) < 0.5 and r["lower_bound"] < r["predicted_soh"] < r["upper_bound"]


def test_seasonal_model_survives_saving(spark, seasonal, tmp_path):
    _, model = seasonal
    forecast.save_model(model, str(tmp_path / "m"))
    again = forecast.load_model(str(tmp_path / "m"))
    start = spark.createDataFrame([("a", datetime(2023, 12, 31).date())], "device_no string, last_date date")
    assert forecast.forecast_soh_seasonal(model, start, 5).collect() == forecast.forecast_soh_seasonal(again, start, 5).collect()


def test_short_history_is_fitted_with_the_season(make):
    days = make("ds date, y double, data_count int", [((T0 + timedelta(days=i)).date(), 95 - 0.1 * i, 9) for i in range(20)])
    model = forecast.fit_soh_seasonal(days)
    assert model.waves == 3 and model.sigma < 0.1
    assert forecast.horizon_days("2024-01-01", "2024-03-01") == 60


def test_energy_model(spark, make, tmp_path):
    from voltlake.sources.points import to_points

    rows = [row(i, f"d{i % 3}", i / 24, soc=float(20 + i % 70), volt=380.0 + i % 40, amps=float(i % 60 - 30), odo=float(i)) for i in range(400)]
    features = energy.energy_features(to_points(make(BMS, rows), energy.SENSORS, "msg_ts")).cache()
    assert features.count() == 400
    train, test = energy.split_features(features)
    assert train.count() + test.count() == 400
    model = energy.train_energy_model(train, trees=8, depth=4)
    spread = features.agg(F.stddev_pop(energy.LABEL)).first()[0]
    assert energy.rmse(model, test) < 0.6 * spread
    names = [r["feature"] for r in energy.feature_importance(model, spark).collect()]
    assert names[0] == "pack_current" and len(names) == len(energy.FEATURES)
    assert not set(energy.LEAKING) & set(energy.train_energy_model(train, leak_free=True, trees=2, depth=2).stages[0].getInputCols())
    errors = energy.holdout_errors(model, train, test).first()
    assert errors["holdout_rows"] == test.count() and errors["model_error"] == pytest.approx(energy.rmse(model, test))
    assert errors["model_error"] < 0.6 * errors["mean_error"]
    dealt = {r["feature"]: r["importance"] for r in energy.permutation_importance(model, test).collect()}
    assert max(dealt, key=dealt.get) == "pack_current" and abs(dealt["soh"]) < 0.05 * dealt["pack_current"]
    energy.save_model(model, str(tmp_path / "e"))
    again = energy.load_model(str(tmp_path / "e"))
    first = [r["predicted_kw"] for r in energy.predict_energy(model, test).orderBy("time").collect()]
    assert first == [r["predicted_kw"] for r in energy.predict_energy(again, test).orderBy("time").collect()]


def test_energy_model_is_the_same_however_its_rows_are_spread(spark, make, monkeypatch):
    from voltlake.sources.points import to_points

    monkeypatch.setattr(energy, "LEAST_SHARE", 100)
    rows = [row(i, f"d{i % 3}", i / 24, soc=float(20 + i * 7 % 70), volt=380.0 + i % 40, amps=float(i % 60 - 30), odo=float(i)) for i in range(400)]
    features = energy.energy_features(to_points(make(BMS, rows), energy.SENSORS, "msg_ts")).cache()
    dealt = energy.equal_shares(features, energy.FEATURES)
    sizes = [r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 400 and len(sizes) == 4 and max(sizes) < 2 * min(sizes)
    assert dealt.exceptAll(features.select(dealt.columns)).count() == 0
    found = []
    for spread in (features.coalesce(1), features.repartition(7, "soc"), features.orderBy(F.col("time").desc())):
        model = energy.train_energy_model(spread, leak_free=True, trees=4, depth=3)
        found.append({r["feature"]: r["importance"] for r in energy.feature_importance(model, spark).collect()})
    assert found[1] == pytest.approx(found[0]) and found[2] == pytest.approx(found[0])

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from voltlake import schema as S
from voltlake.operators import clean, quality


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.mark.parametrize("text, want", [
    ("23-08-01 01:02:03", datetime(2023, 8, 1, 1, 2, 3)), ("23/08/01 01:02:03", datetime(2023, 8, 1, 1, 2, 3)),
    ("23.8.1 1:02", datetime(2023, 8, 1, 1, 2)), ("2023-08-01 01:02:03", datetime(2023, 8, 1, 1, 2, 3)),
    (" 23-08-01", datetime(2023, 8, 1)), ("bad", None), ("", None), (None, None), ("23-13-41 00:00:00", None),
])
def test_fix_year(make, text, want):
    assert rows(make("t string", [(text,)]).select(clean.fix_year("t")))[0][0] == want


def test_ranges_touch_only_listed_columns(make):
    layout = "soc double, odometer double, cumul_current_chrgd double, max_cell_volt_no double, pack_current double, cell_volt array<double>"
    df = make(layout, [
        (0.0, 1.0, 900.0, 96.0, 500.0, [0.0, 6.0]), (100.0, 2e6, 1e6, 1.0, -500.0, [3.3, None]),
        (-0.1, 0.0, 1e6 + 1, 1.0, 500.1, [6.1, -1.0]), (100.1, 2e6 + 1, None, None, -500.1, None),
    ])
    assert rows(clean.validate_ranges(df, "bms")) == [
        (0.0, 1.0, 900.0, 96.0, 500.0, [0.0, 6.0]), (100.0, 2e6, 1e6, 1.0, -500.0, [3.3, None]),
        (None, None, None, 1.0, None, [None, None]), (None, None, None, None, None, None),
    ]


@pytest.mark.parametrize("column", sorted(S.GPS_RULES))
def test_gps_bounds(make, column):
    low, high = S.GPS_RULES[column]
    df = make(f"{column} double", [(float(low),), (float(high),), (low - 0.01,), (high + 0.01,), (None,)])
    assert [r[0] for r in rows(clean.validate_ranges(df, "gps"))] == [low, high, None, None, None]


def test_rows_strings_and_header(make):
    df = make("device_no string, ` soc ` string", [("device_no", "soc"), (" 1 ", " 50 "), ("2", "  "), ("", None)])
    assert rows(clean.clean_rows(df)) == [("1", "50"), ("2", None)]


def test_header_like_values_stay(make):
    df = make("device_no string, soc string", [("a-1", "-5"), ("2024-01-01", "7")])
    assert clean.drop_header_rows(df).count() == 2


def test_types(make):
    df = make("device_no string, soc string, chrg_cable_conn string, time string", [("007", "50.5", "1", "x"), ("8", "bad", None, None)])
    out = clean.convert_types(df, "bms")
    assert rows(out) == [("007", 50.5, 1, "x"), ("8", None, None, None)]


def test_expand_list_pads(make):
    df = make("id int, v string", [(1, "1, 2,3"), (2, "4"), (3, None)])
    out = clean.expand_list(df, "v", ",")
    assert out.columns == ["id", "v_1", "v_2", "v_3"]
    assert rows(out) == [(1, "1", "2", "3"), (2, "4", None, None), (3, None, None, None)]
    assert clean.expand_list(df, "v", ",", 2).columns == out.columns  # never fewer than the longest list
    assert clean.expand_list(df, "v", ",", 4).columns == [*out.columns, "v_4"]
    assert clean.expand_list(df.where("id = 2"), "v", ",").columns == ["id", "v_1"]
    assert clean.detect_list_columns(make("a string, b string, c int", [("1|2", "x", 1), ("3", "y", 2), ("4|5|6", None, 3)])) == {"a": "|"}


def test_families(make):
    df = make("id int, cell_volt_1 double, cell_volt_2 double, cell_volt_10 double, cell_volt_no double", [(1, 3.0, None, 4.0, 9.0)])
    assert clean.family_columns(df, "cell_volt") == ["cell_volt_1", "cell_volt_2", "cell_volt_10"]
    counted = clean.add_family_counts(df, ["cell_volt"])
    assert counted.first()["cell_volt_count"] == 2
    assert clean.drop_family_counts(counted).columns == df.columns
    folded = clean.fold_families(df, ["cell_volt"])
    assert folded.first()["cell_volt"] == [3.0, None, 4.0] and "cell_volt_no" in folded.columns
    assert clean.add_family_counts(folded, ["cell_volt"]).first()["cell_volt_count"] == 2


def test_clean_bms_is_idempotent_on_ranges(make):
    raw = make("device_no string, msg_time string, time string, soc string, cell_volt_1 string, cell_volt_2 string, car_type string", [
        ("1", "bad", "23-08-01 01:02:03", "140", "3.5", "7", "GV60"), ("1", "23-08-02 00:00:00", None, "40", "NaN", "", "GV60")])
    out = clean.clean_bms(raw)
    got = [(r["soc"], r["cell_volt"], str(r["day"])) for r in out.orderBy("msg_ts").collect()]
    assert got == [(None, [3.5, None], "2023-08-01"), (40.0, [None, None], "2023-08-02")]
    assert rows(clean.validate_ranges(out, "bms")) == rows(out)


def test_profile_and_problems(make):
    df = make("a double, b string, c int, d double", [(1.0, None, 5, -1.0), (0.0, None, 5, None), (None, None, 5, 0.0), (1.0, "x", 5, -2.0)])
    got = {r["column_name"]: r for r in quality.profile(df, exact=True).collect()}
    a, b, d = got["a"], got["b"], got["d"]
    assert (a["total_count"], a["null_count"], a["null_percentage"], a["unique_count"], a["min_val"], a["max_val"], a["zero_count"]) == (4, 1, 25.0, 2, 0.0, 1.0, 1)
    assert (b["null_count"], b["min_val"], b["unique_count"]) == (3, None, 1)
    assert (d["negative_count"], d["zero_count"], d["duplicate_count"]) == (2, 1, 1)
    problems = {r["column_name"]: r["problem"] for r in quality.problem_columns(quality.profile(df)).collect()}
    assert problems == {"b": "mostly_null", "c": "single_value"}


def test_reports(make):
    t = make("device_no string, soc double, ts timestamp_ntz", [("1", None, datetime(2024, 1, 1)), (None, 2.0, datetime(2024, 1, 2, 5))])
    assert rows(quality.null_report({"t": t}, ["device_no", "soc", "speed"])) == [("t", 2, 1, 1, None)]
    assert rows(quality.time_coverage({"t": (t, "ts")})) == [("t", datetime(2024, 1, 1), datetime(2024, 1, 2, 5), 2)]
    assert rows(quality.quality_counts({"t": t, "u": t.where(F.lit(False))})) == [("t", 2), ("u", 0)]

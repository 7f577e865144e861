"""Session rules against plain loops over one device after another."""

import random
from datetime import datetime, timedelta

import pytest

from voltlake.plans import charging, driving

T0 = datetime(2024, 1, 30, 6)
LAYOUT = "event_id int, device_no string, car_type string, msg_ts timestamp_ntz, soc double, soh double, pack_volt double, pack_current double, mod_avg_temp double, odometer double"
GPS = "gps_id int, device_no string, car_type string, time timestamp_ntz, speed double, lat double, lng double, fuel_pct double"


def row(i, device, minute, soc=None, odo=None, amps=0.0, volts=400.0, soh=95.0):
    return (i, device, "GV60", T0 + timedelta(minutes=minute), soc, soh, volts, amps, 20.0, odo)


def walk(seed, n=250):
    """Three devices over several days, one of them with most of the rows."""
    rnd, out, minute, odo = random.Random(seed), [], {}, {}
    for i in range(n):
        d = "hot" if i % 3 else rnd.choice("ab")
        minute[d] = minute.get(d, 0) + rnd.choice([0.5, 1, 3, 10, 31, 70])
        odo[d] = odo.get(d, 100.0) + rnd.choice([0, 0, 2, 5, -2, -60, 1])
        out.append(row(i, d, minute[d], None if rnd.random() < 0.1 else float(rnd.randrange(20, 60)), odo[d],
                       rnd.choice([-20.0, 0.2, 3.0, 12.0]), 400.0 + rnd.randrange(10), None if rnd.random() < 0.2 else 90.0 + rnd.randrange(5)))
    return out


def series(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[1], r[3], r[0])):
        out.setdefault(r[1], []).append(r)
    return out


def minutes(a, b):
    return (b - a).total_seconds() / 60


# ---------------------------------------------------------------- driving sessions


def loop_trips(rows):
    trips = []
    for device, s in series(rows).items():
        km, start = 0.0, None
        for a, b in zip(s, s[1:]):
            diff, gap = b[9] - a[9], minutes(a[3], b[3])
            if diff > 0:
                start = start or a[3]
                km += diff
            elif -50 < diff <= -1:
                continue
            elif diff <= -50 or gap >= 30:
                if km > 0:
                    trips.append((device, round(km, 6), start, a[3]))
                km, start = 0.0, None
        if km > 0:
            trips.append((device, round(km, 6), start, s[-1][3]))
    return sorted(trips)


def trips_of(df):
    return sorted((r["device_no"], round(r["distance_km"], 6), r["start_time"], r["end_time"]) for r in driving.driving_sessions(df).collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_driving_sessions_equal_the_loop(make, seed):
    rows = walk(seed)
    assert trips_of(make(LAYOUT, rows)) == loop_trips(rows)


@pytest.mark.parametrize("steps, want", [
    ([(0, 0), (5, 2), (10, 1), (15, 3)], 1),            # -1 is noise
    ([(0, 100), (5, 102), (10, 52.1), (15, 60)], 1),    # -49.9 is noise
    ([(0, 100), (5, 102), (10, 52), (15, 60)], 2),      # -50 is a reset
    ([(0, 0), (5, 2), (40, 2), (45, 4)], 2),            # 30 minutes without a gain
    ([(0, 0), (5, 2), (50, 6)], 1),                     # a long gap with a gain does not end the trip
])
def test_driving_session_edges(make, steps, want):
    rows = [row(i, "a", m, odo=float(o)) for i, (m, o) in enumerate(steps)]
    assert len(trips_of(make(LAYOUT, rows))) == want


def test_trip_distance_is_the_sum_of_gains(make):
    rows = walk(3)
    gains = sum(max(0.0, b[9] - a[9]) for s in series(rows).values() for a, b in zip(s, s[1:]))
    assert sum(t[1] for t in trips_of(make(LAYOUT, rows))) == pytest.approx(gains)


# ---------------------------------------------------------------- charging sessions


def near_amps(s, t):
    best = (61, 0.0)
    for r in s:
        gap = abs((r[3] - t).total_seconds())
        if gap < best[0]:
            best = (gap, r[7])
    return best[1]


def loop_charges(rows):
    found = []
    for device, s in series(rows).items():
        soc, now = [r for r in s if r[4] is not None], None
        for a, b in zip(soc, soc[1:]):
            step = b[4] - a[4]
            if abs(step) < 0.05:
                continue
            if step > 0.05 and now is None and b[7] > 0.5:
                now = [device, a[3], b[3], a[4], b[4], minutes(a[3], b[3])]
            elif now and step > 0:
                now[2], now[4], now[5] = b[3], b[4], now[5] + minutes(a[3], b[3])
            elif now and step < 0:
                pad = timedelta(seconds=60)
                inside = [r for r in s if now[1] - pad <= r[3] <= now[2] + pad]
                found.append((*now[:5], round(now[5], 6), round(sum(r[7] for r in inside) / len(inside), 6)))
                now = None
    return sorted(found)


def charges_of(df):
    return sorted(
        (r["device_no"], r["start_time"], r["end_time"], r["start_soc"], r["end_soc"], round(r["duration_minutes"], 6), round(r["avg_current"], 6))
        for r in charging.charging_sessions(df).collect()
    )


@pytest.mark.parametrize("seed", [1, 2])
def test_charging_sessions_equal_the_loop(make, seed):
    rows = walk(seed)
    assert charges_of(make(LAYOUT, rows)) == loop_charges(rows)


@pytest.mark.parametrize("steps, want", [
    ([(50, 9), (50.04, 9), (50.08, 9), (40, 0)], 0),     # steps within the noise
    ([(50, 0), (55, 0.4), (40, 0)], 0),                  # a rise without current
    ([(50, 9), (55, 9), (60, 9)], 0),                    # still open at the end of the data
    ([(50, 9), (55, 9), (54, 9), (60, 9), (50, 0)], 2),  # two sessions back to back
])
def test_charging_session_edges(make, steps, want):
    rows = [row(i, "a", 10 * i, soc=float(v), odo=0.0, amps=float(a)) for i, (v, a) in enumerate(steps)]
    assert len(charges_of(make(LAYOUT, rows))) == want


def test_current_crossings(make):
    amps = [0.0, 5.0, 6.0, 0.0, 0.5, 2.0, 3.0]
    rows = [row(i, "a", 10 * i, soc=50.0 + i, odo=0.0, amps=a) for i, a in enumerate(amps)]
    gps = make(GPS, [(1, "a", "GV60", T0 + timedelta(minutes=11), 30.0, 1.0, 2.0, 50.0)])
    out = sorted(charging.charging_sessions_by_current(make(LAYOUT, rows), gps).collect(), key=lambda r: r["session_id"])
    assert [(r["start_soc"], r["end_soc"], r["charge_end_time"] is None) for r in out] == [(51.0, 53.0, False), (55.0, None, True)]
    assert out[0]["avg_charging_power"] == pytest.approx((5 + 6 + 0) * 400 / 3)  # the row after the end is left out
    assert out[0]["soc_per_hour"] == 6.0 and out[1]["soc_per_hour"] == 0.0
    assert out[0]["avg_speed"] == 30.0 and out[1]["avg_speed"] is None


# ---------------------------------------------------------------- segments


def loop_segments(rows, sign=1):
    out = []
    for device, s in series(rows).items():
        at = [i for i, r in enumerate(s) if r[4] is not None]
        for i, j in zip(at, at[1:]):
            a, b = s[i], s[j]
            if (a[3].year, a[3].month) != (b[3].year, b[3].month):
                continue
            change, mins = b[4] - a[4], minutes(a[3], b[3])
            if abs(change) < 0.05 or mins < 2:
                continue
            km = 0.0
            for p, q in zip(s[i:j], s[i + 1:j + 1]):
                if q[9] - p[9] <= -50:
                    break
                km += max(0.0, q[9] - p[9])
            amps = sorted(r[7] for r in s[i:j + 1])[(j - i + 1) // 2]
            if km > 0.05 and change < 0:
                kind = "long" if km >= 100 else "short"
            elif change > 0.1 and sign * amps > 5:
                kind = "charge"
            else:
                kind = "park" if mins >= 5 else "stop"
            out.append((device, a[3], b[3], kind, round(km, 6), amps, round((a[6] + b[6]) / 2 * amps * mins / 60 / 1000, 6)))
    return sorted(out)


def segments_of(df, **kw):
    return sorted(
        (r["device_no"], r["start_time"], r["end_time"], r["sub_activity"], round(r["distance_km"], 6), r["pack_current"], round(r["energy_kwh"], 6))
        for r in driving.segments(df, **kw).collect()
    )


@pytest.mark.parametrize("seed, sign", [(1, 1), (2, -1)])
def test_segments_equal_the_loop(make, seed, sign):
    rows = walk(seed)
    assert segments_of(make(LAYOUT, rows), charge_sign=sign) == loop_segments(rows, sign)


@pytest.mark.parametrize("a, b, want", [
    ((0, 50, 0.0), (10, 49, 0.05), ["park"]),                # exactly 50 m is no drive
    ((0, 50, 0.0), (10, 49, 0.06), ["short"]),
    ((0, 50, 0.0), (60, 40, 100.0), ["long"]),
    ((0, 50, 0.0), (1.9, 49, 5.0), []),                      # shorter than two minutes
    ((0, 50, 0.0), (4, 50.08, 0.0), ["stop"]),
    ((0, 50, 0.0), (60 * 24 * 2, 40, 5.0), []),              # across a month border
])
def test_segment_edges(make, a, b, want):
    rows = [row(i, "a", m, soc=float(v), odo=o) for i, (m, v, o) in enumerate((a, b))]
    assert [x[3] for x in segments_of(make(LAYOUT, rows))] == want


def test_segment_takes_neighbours_within_a_minute(make):
    rows = [
        row(1, "a", 0, soc=50.0, odo=None, soh=None), row(2, "a", 0.5, odo=10.0, soh=91.0),
        row(3, "a", 9.5, odo=None), row(4, "a", 10, soc=45.0, odo=None, soh=None), row(5, "a", 10.8, odo=13.0),
    ]
    got = driving.segments(make(LAYOUT, rows)).collect()
    assert [(r["soh"], r["distance_km"], r["sub_activity"]) for r in got] == [(91.0, 3.0, "short")]


def test_step_efficiency(make):
    rows = [row(0, "a", 0, 50.0, 0.0, 9.0), row(1, "a", 10, 48.0, 4.0, 0.0), row(2, "a", 20, 53.0, 4.0, 9.0), row(3, "a", 30, 60.0, 4.0, 4.0)]
    got = driving.step_efficiency(driving.efficiency_steps(make(LAYOUT, rows))).first()
    assert (got["avg_driving_efficiency"], got["avg_charging_efficiency"], got["drive_steps"], got["charge_steps"]) == (0.5, 0.5, 1, 1)

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from voltlake.operators import align

T0 = datetime(2024, 1, 1, 12)
LEFT = "id int, car_type string, device_no string, msg_ts timestamp_ntz"
RIGHT = "gid int, car_type string, device_no string, time timestamp_ntz"
KEYS = ["car_type", "device_no"]


def s(seconds):
    return T0 + timedelta(seconds=seconds)


def nearest(left, right, **kw):
    out = align.nearest_join(left, right, KEYS, "msg_ts", "time", "id", "gid", ["gid"], **kw)
    return {r["id"]: r["gid"] for r in out.collect()}


def nearest_few(left, right):
    out = align.nearest_to_few(left, right, KEYS, "msg_ts", "time", "gid", ["gid"])
    return {r["id"]: r["gid"] for r in out.collect()}


@pytest.mark.parametrize("gps, want", [
    ([(1, 0)], 1),                       # exact hit
    ([(1, -30), (2, 30)], 1),            # equally far: the earlier
    ([(1, 60)], 1),                      # on the tolerance
    ([(1, 61)], None), ([(1, -61)], None),
    ([(5, 10), (3, 10)], 3),             # same instant: the smaller id
    ([(1, -40), (2, 39)], 2),
    ([], None),
])
def test_nearest_edges(make, gps, want):
    left = make(LEFT, [(7, "GV60", "d", s(0))])
    right = make(RIGHT, [(g, "GV60", "d", s(sec)) for g, sec in gps])
    assert nearest(left, right) == {7: want}
    assert nearest_few(left, right) == {7: want}


def test_other_type_same_device(make):
    left = make(LEFT, [(7, "GV60", "d", s(0))])
    assert nearest(left, make(RIGHT, [(1, "BONGO3", "d", s(0))])) == {7: None}


def test_nearest_across_midnight(make):
    left = make(LEFT, [(1, "GV60", "d", datetime(2024, 1, 1, 23, 59, 50)), (2, "GV60", "d", datetime(2024, 1, 2, 0, 0, 10))])
    right = make(RIGHT, [(1, "GV60", "d", datetime(2024, 1, 2, 0, 0, 1)), (2, "GV60", "d", datetime(2024, 1, 1, 23, 59, 20))])
    assert nearest(left, right) == {1: 1, 2: 1}


def cloud(seed, n, span):
    rnd = random.Random(seed)
    return [(i, rnd.choice(["GV60", "BONGO3"]), "hot" if i % 3 else f"d{rnd.randrange(5)}", s(rnd.randrange(span))) for i in range(n)]


@pytest.mark.parametrize("rows_per_slice", [64, 1_000_000])
def test_nearest_is_exact_and_keeps_every_left_row(make, rows_per_slice):
    a, b = cloud(1, 400, 3 * 3600), cloud(2, 300, 3 * 3600)
    gaps = [(2000 + i, None, "hot", s(i)) for i in range(90)] + [(3000, "GV60", None, s(0)), (3001, "GV60", "hot", None)]
    a, b = a + gaps, b + [(5000 + i, *row[1:]) for i, row in enumerate(gaps)]
    b += [(1000 + i, "GV60", "hot", s(600)) for i in range(200)]  # copies of one instant
    got = nearest(make(LEFT, a), make(RIGHT, b), rows_per_slice=rows_per_slice, seconds=3600)
    assert len(got) == len(a)
    for i, kind, device, t in a:
        near = [] if None in (kind, device, t) else [(abs((u - t).total_seconds()), u, g) for g, k, d, u in b if (k, d) == (kind, device) and u and abs((u - t).total_seconds()) <= 60]
        assert got[i] == (min(near)[2] if near else None)


@pytest.mark.parametrize("rows_per_slice, seconds", [(64, 600), (1_000_000, 3600), (128, 30)])
def test_lags_and_frames_in_the_pass_of_the_nearest(make, rows_per_slice, seconds):
    """Lag and frame run along the device whatever the type, the match within device and type."""
    a, b = cloud(8, 500, 3 * 3600), cloud(9, 300, 3 * 3600)
    a += [(2000 + i, None, "hot", s(i)) for i in range(20)] + [(3000, "GV60", None, s(0)), (3001, "GV60", "hot", None)]
    out = align.nearest_join(
        make(LEFT, a), make(RIGHT, b), KEYS, "msg_ts", "time", "id", "gid", ["gid"], seconds=seconds, rows_per_slice=rows_per_slice,
        keys=["device_no"], lags={"prev": "id"}, back=4, frames={"total": lambda w: F.sum("id").over(w.rowsBetween(-4, 0))})
    assert out.columns == ["id", "car_type", "device_no", "msg_ts", "prev", "total", "gid"]
    got = {r["id"]: (r["prev"], r["total"], r["gid"]) for r in out.collect()}
    assert len(got) == len(a)
    by_device = {}
    for row in sorted((r for r in a if r[2] and r[3]), key=lambda r: (r[3], r[0])):
        by_device.setdefault(row[2], []).append(row)
    for line in by_device.values():
        for i, (id, kind, device, t) in enumerate(line):
            near = [(abs((u - t).total_seconds()), u, g) for g, k, d, u in b if (k, d) == (kind, device) and abs((u - t).total_seconds()) <= 60]
            assert got[id] == (line[i - 1][0] if i else None, sum(r[0] for r in line[max(0, i - 4):i + 1]), min(near)[2] if near else None)
    assert got[3000] == got[3001] == (None, None, None)


@pytest.mark.parametrize("gap, closed, want", [(299, False, 1), (300, False, None), (300, True, 1), (301, True, None), (-300, True, 1)])
def test_interval_edges(make, gap, closed, want):
    left, right = make(LEFT, [(7, "GV60", "d", s(0))]), make(RIGHT, [(1, "BONGO3", "d", s(gap))])
    out = align.interval_join(left, right, ["device_no"], "msg_ts", "time", 300, ["gid"], closed)
    assert [r["gid"] for r in out.collect()] == [want]


@pytest.mark.parametrize("rows_per_task", [10, 1_000_000])
def test_interval_join_finds_every_pair_once(make, rows_per_task):
    a, b = cloud(3, 200, 3600), cloud(4, 200, 3600)
    out = align.interval_join(make(LEFT, a), make(RIGHT, b), ["device_no"], "msg_ts", "time", 300, ["gid"], rows_per_task=rows_per_task)
    got = sorted((r["id"], -1 if r["gid"] is None else r["gid"]) for r in out.collect())
    want = []
    for i, _, device, t in a:
        hits = [g for g, _, d, u in b if d == device and abs((u - t).total_seconds()) < 300]
        want += [(i, g) for g in hits] or [(i, -1)]
    assert got == sorted(want)


@pytest.mark.parametrize("closed", [False, True])
def test_left_interval_join_with_an_overfull_right_side(make, closed):
    """Cells cut by their right rows: rows without a match come out once each, also where they repeat."""
    a = cloud(5, 120, 3600) + [(500 + i, "GV60", "hot", s(9000 + i)) for i in range(30)]
    a += a[-10:] + [(900, "GV60", None, s(0)), (901, "GV60", "hot", None)]
    b = cloud(6, 60, 3600) + [(1000 + i, "GV60", "hot", s(8400 + i % 310)) for i in range(400)]
    b += [(2000, "GV60", "hot", s(9320)), (2001, "GV60", None, s(0))]
    out = align.interval_join(make(LEFT, a), make(RIGHT, b), ["device_no"], "msg_ts", "time", 300, ["gid"], closed, rows_per_task=20)
    want = []
    for i, _, device, t in a:
        hits = [] if not device or not t else [g for g, _, d, u in b if d == device and (abs((u - t).total_seconds()) < 300 or closed and abs((u - t).total_seconds()) == 300)]
        want += [(i, g) for g in hits] or [(i, None)]
    key = lambda p: (p[0], p[1] is None, p[1] or 0)
    assert sorted(((r["id"], r["gid"]) for r in out.collect()), key=key) == sorted(want, key=key)


def repeated(plan) -> int:
    """Rows that the explodes of an executed plan put out."""
    name = plan.nodeName()
    if name == "AdaptiveSparkPlan":
        return repeated(plan.executedPlan())
    if "QueryStage" in name:
        return repeated(plan.plan())
    below = sum(repeated(plan.children().apply(i)) for i in range(plan.children().size()))
    return below + (plan.metrics().apply("numOutputRows").value() if name == "Generate" else 0)


@pytest.mark.parametrize("n, m, how", [(300, 300, "inner"), (20, 2000, "inner"), (2000, 3, "inner"), (300, 300, "left")])
def test_overfull_cells_repeat_each_row_a_bounded_number_of_times(make, n, m, how):
    """Pairs of a cell are as many as the product of its sides; the rows that are shuffled for them are not."""
    left = make(LEFT, [(i, "GV60", "hot", s(10)) for i in range(n)])
    right = make(RIGHT, [(i, "GV60", "hot", s(20)) for i in range(m)])
    out = align.interval_join(left, right, ["device_no"], "msg_ts", "time", 300, ["gid"], how=how, rows_per_task=5)
    assert out.count() == n * m and out.distinct().count() == n * m
    rows = out.collect()
    assert len(rows) == n * m
    # Right rows go to three cells first, then to the shares; in two of the cells there is one share.
    assert repeated(out._jdf.queryExecution().executedPlan()) <= align.COPIES * (n + m) + 6 * (n + m)


def test_tasks_of_overfull_cells_follow_their_pairs(make, monkeypatch):
    """Spark would merge the shares of 90,000 pairs into one task, by their few bytes."""
    monkeypatch.setattr(align, "PAIRS_AT_ONCE", 3_000)
    left = make(LEFT, [(i, "GV60", "hot", s(10)) for i in range(300)])
    right = make(RIGHT, [(i, "GV60", "hot", s(20)) for i in range(300)])
    for how in ("inner", "left"):
        out = align.interval_join(left, right, ["device_no"], "msg_ts", "time", 300, ["gid"], how=how, rows_per_task=50)
        assert len(out.distinct().collect()) == 90_000
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan.count(" 30), REPARTITION_BY_NUM") == 2


@pytest.mark.parametrize("closed", [False, True])
def test_right_rows_out_of_reach_of_an_overfull_cell_stay_behind(make, closed):
    """A cell's neighbour may hold many rows that none of its left rows reaches: they are not repeated."""
    left = make(LEFT, [(i, "GV60", "hot", s(10 + i % 2)) for i in range(300)])
    near = [(i, "GV60", "hot", s(t)) for i, t in enumerate((-291, -290, -289, 0, 310, 311, 312))]
    right = make(RIGHT, near + [(100 + i, "GV60", "hot", s(320)) for i in range(2000)])
    out = align.interval_join(left, right, ["device_no"], "msg_ts", "time", 300, ["gid"], closed, "inner", rows_per_task=300)
    want = [(i, g) for i in range(300) for g, _, _, t in near if abs((t - s(10 + i % 2)).total_seconds()) < 300 + closed]
    assert sorted((r["id"], r["gid"]) for r in out.collect()) == sorted(want)
    # Right rows go to three cells, one of them overfull; the left rows and the seven near ones fill half of the copies.
    assert repeated(out._jdf.queryExecution().executedPlan()) <= 5 * 2007 + align.COPIES / 2 * 2307 + align.COPIES * 7 * 3


def test_repeated_rows_are_never_broadcast(make):
    left, right = make(LEFT, [(1, "GV60", "hot", s(10))]), make(RIGHT, [(1, "GV60", "hot", s(20))])
    out = align.interval_join(left, right, ["device_no"], "msg_ts", "time", 300, ["gid"], rows_per_task=5)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "rightHint=(strategy=merge)" in plan

def test_mean_within_long_and_short_spans(make):
    rnd = random.Random(5)
    samples = [("d" if i % 4 else "e", s(rnd.randrange(5000)), float(rnd.randrange(50)) if i % 7 else None) for i in range(500)]
    spans = [(i, "d" if i % 3 else "e", s(a), s(a + n)) for i, (a, n) in enumerate([(0, 0), (10, 30), (100, 4000), (4900, 50), (300, 59), (9000, 10), (700, 700)])]
    out = align.mean_within(
        make("span int, device_no string, a timestamp_ntz, b timestamp_ntz", spans),
        make("device_no string, t timestamp_ntz, v double", samples), ["device_no"], ["span"], "a", "b", "t", ["v"], pad_s=30,
    )
    got = {r["span"]: r["mean_v"] for r in out.collect()}
    pad = timedelta(seconds=30)
    for i, device, a, b in spans:
        inside = [v for d, t, v in samples if d == device and a - pad <= t <= b + pad and v is not None]
        want = sum(inside) / len(inside) if inside else None
        assert got[i] == (pytest.approx(want) if want is not None else None)


def test_mean_within_takes_few_pieces_of_a_long_span(make):
    """Two totals of each width at most; no piece twice, none outside, whatever the borders are."""
    rnd = random.Random(11)
    samples = [("d", s(60 * i + rnd.randrange(60)), float(2 ** (i % 40))) for i in range(700)] + [("d", s(70_000), float("nan"))]
    spans = [(i, "d", s(a), s(a + n)) for i, (a, n) in enumerate((rnd.randrange(-9000, 40_000), rnd.randrange(9000)) for _ in range(300))]
    spans += [(900, "d", s(-60), s(43_200 * 60)), (901, "d", s(60), s(0)), (902, None, s(0), s(60)), (903, "d", None, s(60))]
    out = align.mean_within(
        make("span int, device_no string, a timestamp_ntz, b timestamp_ntz", spans),
        make("device_no string, t timestamp_ntz, v double", samples), ["device_no"], ["span"], "a", "b", "t", ["v"],
    )
    got = {r["span"]: r["mean_v"] for r in out.collect()}
    assert len(got) == len(spans)
    for i, device, a, b in spans:
        inside = [v for d, t, v in samples if device and a and a <= t <= b]
        assert got[i] == (pytest.approx(sum(inside) / len(inside), nan_ok=True) if inside else None)
    # 304 spans of up to 150 cells and one of 43,200; samples lie in 701 cells, of up to 17 widths.
    assert repeated(out._jdf.queryExecution().executedPlan()) < 305 * 18 + 701 * 18
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("leftHint=(strategy=merge)") == 2

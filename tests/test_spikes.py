import random

import numpy as np
import pandas as pd
import pytest

from sensorloom.operators import spikes


def naive_runs(t, x, factor=10.0):
    """Spikes of one channel by plain loops."""
    d = [abs(b - a) / (q - p) for a, b, p, q in zip(x, x[1:], t, t[1:]) if a != b]
    usual = float(np.median(d))
    out = set()
    for k in range(1, 6):
        for i in range(len(x) - k - 1):
            p, q = i, i + k + 1
            ok = True
            for j in range(p + 1, q):
                a, b = x[j] - x[p], x[j] - x[q]
                rate = min(abs(a) / (t[p + 1] - t[p]), abs(b) / (t[q] - t[q - 1]))
                ok = ok and a * b > 0 and rate > factor * usual
            if ok:
                out |= set(range(p + 1, q))
    return out


def track(n, seed):
    rnd = random.Random(seed)
    t, x, out = 0.0, 0.0, []
    for i in range(n):
        t += rnd.choice([0.009, 0.01, 0.011])
        x += rnd.gauss(0, 0.01)
        out.append((t, x))
    return out


def as_imu(spark, rows):
    schema = "seq string, line bigint, t double, omega struct<x:double,y:double,z:double>, accel struct<x:double,y:double,z:double>, chunk int, rates string"
    return spark.createDataFrame([(*r, 1, "z") for r in rows], schema)


def noise(rnd):
    return tuple(rnd.gauss(0, 0.05) for _ in range(3))


def test_spikes_match_plain_loops_over_chunk_edges(spark):
    rnd = random.Random(5)
    base = track(600, 7)
    x = [v for _, v in base]
    for at, k, size in ((99, 1, 2.0), (198, 4, -3.0), (300, 5, 1.5), (400, 6, 4.0), (500, 2, 0.02)):
        for j in range(k):
            x[at + j] += size
    t = [a for a, _ in base]
    rows = [("a", i, t[i], (x[i], *noise(rnd)[:2]), (0.0 + rnd.gauss(0, 0.1), rnd.gauss(0, 0.1), 9.8 + rnd.gauss(0, 0.1))) for i in range(600)]
    rows += rows[::7]
    rnd.shuffle(rows)
    flags, cutoffs = spikes.flag_readings(spikes.imu_values(as_imu(spark, rows)), "imu", 10.0, chunk_lines=100, halo_lines=20)
    got = {r.line for r in flags.where("spike").collect()}
    assert naive_runs(t, x) <= got
    others = got - naive_runs(t, x)
    assert all(any(i in naive_runs(t, [r[3][c] for r in sorted(set(rows), key=lambda r: r[1])]) for c in (1, 2)) for i in others)
    assert {99, 198, 201, 300, 304} <= got and not {400, 401, 402, 403, 404, 405, 500, 501} & got
    c = cutoffs.where("channel = 'omega_x'").collect()[0]
    assert 3.0 <= c.cutoff <= 10.0


def test_stuck_and_impossible(spark):
    rnd = random.Random(1)
    rows = []
    for i in range(60):
        o = [rnd.gauss(0, 0.1) for _ in range(3)]
        if 10 <= i < 18:
            o[1] = 0.25  # eight equal: stuck
        if 30 <= i < 37:
            o[2] = 0.5  # seven: not
        rows.append(("a", i, i * 0.01, tuple(o), (0.0, rnd.gauss(0, 0.1), 9.8 + rnd.gauss(0, 0.1))))
    rows = [(s, i, t, o, (rnd.gauss(0, 0.1), a[1], a[2])) for s, i, t, o, a in rows]
    rows[50] = ("a", 50, 0.5, (1e9, 0.0, 0.0), rows[50][4])
    rows[55] = ("a", 55, 0.55, (float("nan"), 0.0, 0.0), rows[55][4])
    rows[56] = ("a", 56, None, (5e9, 0.0, 0.0), rows[56][4])
    flags, _ = spikes.flag_readings(spikes.imu_values(as_imu(spark, rows)), "imu")
    r = {x.line: x for x in flags.collect()}
    assert {i for i, x in r.items() if x.stuck} == set(range(10, 18))
    assert {i for i, x in r.items() if x.impossible} == {50}


def test_pose_rules(spark):
    eye = [1.0, 0, 0, 0, 0, 1.0, 0, 0, 0, 0, 1.0, 0]
    rnd = random.Random(2)
    rows = []
    for i in range(40):
        a = 0.001 * i + rnd.gauss(0, 0.0005)
        m = [np.cos(a), -np.sin(a), 0, 0.01 * i + rnd.gauss(0, 0.002), np.sin(a), np.cos(a), 0, rnd.gauss(0, 0.002), 0, 0, 1.0, rnd.gauss(0, 0.002)]
        rows.append(("a", i, i * 0.05, [float(v) for v in m]))
    rows[10] = ("a", 10, 0.5, [float(v) for v in eye[:5] + [-1.0] + eye[6:]])  # a reflection
    rows[20] = ("a", 20, 1.0, [2.0 * v for v in rows[20][3]])
    rows[30] = ("a", 30, 1.5, [*rows[30][3][:3], 9999.0, *rows[30][3][4:]])
    d = spark.createDataFrame(rows, "seq string, line bigint, t double, tmat array<double>")
    flags, _ = spikes.flag_readings(spikes.pose_values(d), "pose")
    assert {r.line for r in flags.where("impossible").collect()} == {10, 20, 30}
    assert 30 in {r.line for r in flags.where("spike").collect()}


def test_smooth_fast_motion_is_no_spike():
    t = np.arange(100) * 0.01
    x = np.concatenate([np.linspace(0, 0.1, 60), np.linspace(0.2, 10, 40)])  # suddenly fast, one way
    apart, same = spikes._signed(x)
    assert spikes._stand_out(t, apart, same).max() == 0


def test_empty_and_short(spark):
    flags, cutoffs = spikes.flag_readings(spikes.imu_values(as_imu(spark, [])), "imu")
    assert flags.count() == 0 and cutoffs.count() == 0
    one = [("a", 1, 0.0, (0.0, 0.0, 0.0), (0.0, 0.0, 9.8)), ("b", 1, 0.0, (99.0, 0.0, 0.0), (0.0, 0.0, 9.8))]
    flags, _ = spikes.flag_readings(spikes.imu_values(as_imu(spark, one)), "imu")
    assert [(r.source, r.spike, r.impossible) for r in flags.collect()] == [("b", False, True)]


def test_runs_helper():
    same = pd.Series([True] * 7 + [False] + [True] * 6).to_numpy()
    assert spikes._stuck(same).tolist() == [True] * 8 + [False] * 7


def test_the_risk_decides_without_a_factor(spark):
    rnd = random.Random(11)
    rows, t = [], 0.0
    for i in range(4000):
        t += 0.01
        rows.append(("a", i, t, (rnd.gauss(0, 1) * rnd.choice([0.03, 0.03, 0.12]), rnd.gauss(0, 0.05), rnd.gauss(0, 0.05)), noise(rnd)))
    values = spikes.imu_values(as_imu(spark, rows))
    got = {}
    for risk in (1e-1, 1e-3, 1e-6):
        flags, cutoffs = spikes.flag_readings(values, "imu", risk=risk)
        got[risk] = {r.line for r in flags.where("spike").collect()}
        assert cutoffs.where("channel = 'omega_x' and peaks >= 10").count() == 1
    assert got[1e-6] < got[1e-3] < got[1e-1]
    low, _ = spikes.flag_readings(values, "imu", 10.0, risk=1e-1)
    high, _ = spikes.flag_readings(values, "imu", 10.0, risk=1e-6)
    assert sorted(low.select("line").collect()) == sorted(high.select("line").collect())  # a stated factor holds whatever the fit


@pytest.mark.parametrize("halo", [1, 20])
def test_runs_over_chunk_edges_behind_missing_readings(spark, halo):
    rnd = random.Random(3)
    rows = []
    for i in range(600):
        if i in range(196, 200) or i in range(204, 296) or i % 3 == 0 and i > 400:
            continue  # lines without a valid reading
        o = [rnd.gauss(0, 0.05) for _ in range(3)]
        if 190 <= i < 300:
            o[0] = 0.25  # one run over two chunk edges
        rows.append(("a", i, i * 0.01, tuple(o), noise(rnd)))
    want = {r[1] for r in rows if 190 <= r[1] < 300}
    flags, _ = spikes.flag_readings(spikes.imu_values(as_imu(spark, rows)), "imu", chunk_lines=100, halo_lines=halo)
    assert {r.line for r in flags.where("stuck").collect()} == want
    whole, _ = spikes.flag_readings(spikes.imu_values(as_imu(spark, rows)), "imu")
    assert sorted(map(tuple, flags.collect())) == sorted(map(tuple, whole.collect()))


def test_a_wide_gap_widens_only_its_own_side(spark, monkeypatch):
    rnd = random.Random(8)
    rows = [("a", i + (40_000 if i >= 250 else 0), i * 0.01, (0.25 if 240 <= i < 260 else rnd.gauss(0, 0.05), *noise(rnd)[:2]), noise(rnd)) for i in range(2000)]
    tables, whole = [], spikes.write_table
    monkeypatch.setattr(spikes, "write_table", lambda df: tables.append(whole(df)) or tables[-1])
    flags, _ = spikes.flag_readings(spikes.imu_values(as_imu(spark, rows)), "imu", 10.0, chunk_lines=100, halo_lines=10)
    assert {r.line for r in flags.where("stuck").collect()} == {r[1] for r in rows[240:260]}
    first, *later = [t.where("line is not null").count() for t in tables]
    assert first == 2000 and later and all(n <= 200 for n in later)  # a wider halo doesn't write the other chunks again
    plain, _ = spikes.flag_readings(spikes.imu_values(as_imu(spark, [(s, r % 40_000 if r < 40_000 else r - 40_000, *x) for s, r, *x in rows])), "imu", 10.0)
    assert {r.line for r in plain.collect()} == {r.line - (40_000 if r.line >= 40_000 else 0) for r in flags.collect()}
    plan = flags._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan

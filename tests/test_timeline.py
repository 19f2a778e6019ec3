import math
import random

from pyspark.sql import functions as F

from sensorloom.functions import geometry as geo
from sensorloom.operators import asof, gating, ordered, sync

BASE = 1_700_000_000_000_000


def readings(seed, n=200):
    rnd = random.Random(seed)
    t = sorted(rnd.sample(range(BASE, BASE + 400_000_000), n))
    return [("ab"[i % 2], u, i, float(i)) for i, u in enumerate(t)]


def test_bracket_matches_brute_force(spark):
    r = readings(1)
    rnd = random.Random(2)
    left = [("abc"[i % 3], BASE + rnd.randrange(-1_000_000, 401_000_000), i) for i in range(150)] + [("a", r[0][1], 900), (None, BASE, 901), ("a", None, 902)]
    ld = spark.createDataFrame(left, "e string, t bigint, v int")  # v is on both sides
    rd = spark.createDataFrame([*r, (None, BASE, 5, 1.0), ("a", None, 6, 1.0)], "e string, t bigint, line int, v double")
    got = {x.v: (x.before and x.before["line"], x.after and x.after["line"]) for x in asof.bracket(ld, rd, "e", "t", "t", ["line", "v"]).collect()}
    for e, t, i in left:
        mine = [x for x in r if x[0] == e and t is not None]
        b = max((x for x in mine if x[1] <= t), key=lambda x: x[1], default=None)
        a = min((x for x in mine if x[1] >= t), key=lambda x: x[1], default=None)
        assert got[i] == (b and b[2], a and a[2]), i


def test_interpolation_policies(spark):
    r = spark.createDataFrame([("a", 0, 0.0), ("a", 10, 10.0), ("a", 10, 99.0)], "e string, t bigint, v double")
    r = asof.unique_times(r, "e", "t", "v")
    q = spark.createDataFrame([("a", -5), ("a", 0), ("a", 4), ("a", 25)], "e string, t bigint")
    b = asof.bracket(q, r, "e", "t", "t", ["v"])
    assert sorted((x.t, x.at_v) for x in asof.interpolate(b, "t", ["v"]).where("at_v is not null").collect()) == [(0, 0.0), (4, 4.0)]
    assert sorted((x.t, x.at_v) for x in asof.interpolate(b, "t", ["v"], "clamp").collect()) == [(-5, 0.0), (0, 0.0), (4, 4.0), (25, 10.0)]
    try:
        asof.interpolate(b, "t", ["v"], "error").collect()
        raise AssertionError("an error was expected")
    except Exception as e:
        assert "outside" in str(e)
    assert asof.nearest(b, "t") is not None
    tie = asof.bracket(spark.createDataFrame([("a", 5)], "e string, t bigint"), r, "e", "t", "t", ["v"])
    assert tie.select(asof.nearest(tie, "t")["v"].alias("v")).first().v == 0.0  # the earlier of equally near ones


def test_ordered_over_blocks(spark):
    r = readings(3)
    d = spark.createDataFrame(r, "e string, t bigint, line int, v double")
    n = ordered.running(d, ["e"], "t", ["line"], block=50_000_000)
    for e in "ab":
        got = [x.line for x in n.where(F.col("e") == e).orderBy("rn").collect()]
        assert got == [x[2] for x in r if x[0] == e]
        assert [x.rn for x in n.where(F.col("e") == e).orderBy("rn").collect()] == list(range(len(got)))
    a = {x.line: x for x in ordered.adjacent(d, ["e"], "t", ["line"], ["line"], block=7_000_000).collect()}
    for e in "ab":
        lines = [x[2] for x in r if x[0] == e]
        for p, q in zip(lines, lines[1:]):
            assert a[p].next["line"] == q and a[q].prev["line"] == p
        assert a[lines[0]].prev is None and a[lines[-1]].next is None
    s = ordered.running(d, ["e"], "t", ["line"], F.col("v"), "before", 7_000_000)
    last = [x for x in r if x[0] == "a"][-1]
    assert s.where(F.col("line") == last[2]).first().before == sum(x[3] for x in r if x[0] == "a") - last[3]


def test_rolling_edges(spark):
    d = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate([5, 1, 4, 2, 9])], "e string, t bigint, v double")
    got = lambda fn, ed: [x.rolled for x in ordered.rolling(d, ["e"], "t", [], "v", 1, fn, ed).orderBy("t").collect()]
    assert got("median", "nearest") == [5.0, 4.0, 2.0, 4.0, 9.0]
    assert got("median", "truncate") == [3.0, 4.0, 2.0, 4.0, 5.5]
    assert got("min", "truncate") == [1.0, 1.0, 1.0, 2.0, 2.0]


def test_holdout_segments_and_merge(spark):
    d = spark.createDataFrame([("a", t, t) for t in (0, 10, 20, 30, 200, 210, 220, 230)], "e string, t bigint, line bigint")
    assert [x.split for x in ordered.holdout(d, ["e"], "t", [], 4).orderBy("t").collect()] == ["val", "train", "train", "train"] * 2
    assert ordered.holdout(d, ["e"], "t", [], 0).where("split = 'val'").count() == 0
    assert [x.segment for x in ordered.gap_segments(d, ["e"], "t", ["line"], 3.0).orderBy("t").collect()] == [0] * 4 + [1] * 4
    m = ordered.merge_close(spark.createDataFrame([("a", v) for v in (0.0, 0.1, 0.19, 0.5, 0.55)], "e string, v double"), ["e"], "v", 0.15)
    assert sorted((x.group, x.n) for x in m.collect()) == [(0, 3), (1, 2)]


def test_gates(spark):
    d = spark.createDataFrame([("a", i, float(i), None if i == 9 else 1.0) for i in range(10)], "e string, us bigint, w double, s double")
    g = gating.motion_gate(d, "e", "w", 0.6, F.coalesce(F.col("s") > 0, F.lit(False)))
    assert {x.us for x in g.where("kept").collect()} == set(range(6))
    kept, dropped = gating.drop_preamble(d, spark.createDataFrame([("a", 3)], "e string, end_us bigint"), "e", "us")
    assert kept.count() == 6 and dropped.first().dropped == 4
    f = gating.funnel(d, ["e"], [("low", F.col("w") < 8), ("sharp", F.col("s") > 0)]).first()
    assert (f["all"], f["low"], f["sharp"]) == (10, 8, 8)
    v = gating.verdict(d.groupBy("e").agg(F.max("w").alias("m")), ["e"], [("m", F.col("m"), "<=", 5.0), ("n", F.lit(float("nan")), "<=", 5.0)]).collect()
    assert [x.ok for x in v] == [False, False] and not v[0].passed


def test_geometry(spark):
    rnd = random.Random(5)
    rows = []
    for i in range(60):
        q = [rnd.gauss(0, 1) for _ in range(4)]
        n = sum(c * c for c in q) ** 0.5
        rows.append((i, *[c / n for c in q], rnd.uniform(-3, 3), rnd.uniform(-3, 3), rnd.uniform(-3, 3)))
    d = spark.createDataFrame(rows, "i int, w double, x double, y double, z double, px double, py double, pz double")
    q = geo.quat(F.col("w"), F.col("x"), F.col("y"), F.col("z"))
    r = geo.quat_to_rotation(q)
    d = d.select("i", q.alias("q"), r.alias("r"), geo.rotation_to_quat(r).alias("back"), geo.point(F.col("px"), F.col("py"), F.col("pz")).alias("p"))
    m = geo.transform(F.col("r"), F.col("p"))
    d = d.withColumn("m", m)
    same = F.abs(sum((F.col("q")[c] * F.col("back")[c] for c in "xyz"), F.col("q.w") * F.col("back.w")))
    c = geo.compose(geo.inverse(F.col("m")), F.col("m"))
    off = F.abs(c[0] - 1) + F.abs(c[3]) + F.abs(c[1]) + F.abs(c[5] - 1)
    moved = geo.distance(geo.apply_inverse(F.col("m"), geo.apply(F.col("m"), F.col("p"), 2.5), 2.5), F.col("p"))
    half = geo.slerp(F.col("q"), geo.quat(1.0, 0.0, 0.0, 0.0), F.lit(0.5))
    got = d.select(same.alias("s"), off.alias("o"), moved.alias("d"), geo.quat_norm(half).alias("n"), F.col("back.w").alias("w")).collect()
    assert all(x.s > 1 - 1e-9 and x.o < 1e-9 and x.d < 1e-9 and abs(x.n - 1) < 1e-9 and x.w >= 0 for x in got)
    one = spark.range(1).select(geo.slerp(geo.quat(1.0, 0.0, 0.0, 0.0), geo.quat(0.0, 0.0, 0.0, 1.0), F.lit(0.5)).alias("h"), geo.azimuth_bin(F.lit(-1.0), F.lit(-1e-12), 90.0).alias("a"))
    x = one.first()
    assert abs(x.h["w"] - 0.5**0.5) < 1e-12 and x.a == 2
    try:
        spark.range(1).select(geo.unit_quat(geo.quat(2.0, 0.0, 0.0, 0.0))).collect()
        raise AssertionError("an error was expected")
    except Exception as e:
        assert "unit length" in str(e)


def _slow_lag(pose, imu, lo, hi, step=5_000, most=10):
    """Lag by plain loops: rates on the grid, circular sums, first maximum, parabola."""
    import numpy as np

    grid = np.arange(lo, hi, step)
    a = np.interp(grid, [u for u, _ in imu], [w for _, w in imu])
    angle = np.interp(grid, [u for u, _ in pose], [t for _, t in pose])  # turns about one axis add up
    inside = (grid >= pose[0][0]) & (grid <= pose[-1][0])
    b = np.zeros(len(grid))
    k = np.flatnonzero(inside)
    b[k[:-1]] = np.abs(np.diff(angle[k])) / (step / 1e6)
    b[k[-1]] = b[k[-2]]
    a, b = a - a.mean(), b - b.mean()
    c = [float(np.dot(np.roll(a, s), b)) for s in range(-most, most + 1)]
    i = int(np.argmax(c))
    fine = i + 0.5 * (c[i - 1] - c[i + 1]) / (c[i - 1] - 2 * c[i] + c[i + 1]) if 0 < i < 2 * most else i
    return i - most, (fine - most) * step / 1e3


def test_lag_matches_plain_loops(spark):
    rnd = random.Random(7)

    def rate(t):
        return 0.5 + 0.3 * math.sin(3.1 * t) + 0.2 * math.sin(17 * t + 1)

    poses, imu, want = [], [], {}
    for seq, shift, length in (("a", 0.0, 4.0), ("b", 0.02, 6.1), ("c", -0.035, 2.0)):
        t, angle, pose, gyro = 0.0, 0.0, [], []
        while t < length:
            pose.append((BASE + int(t * 1e6), angle))
            step = rnd.choice([0.01, 0.017])
            angle += sum(rate(t + step * (i + 0.5) / 20) * step / 20 for i in range(20))
            t += step
        t = -0.1
        while t < length + 0.1:
            gyro.append((BASE + int(t * 1e6), rate(t + shift)))
            t += 0.005
        poses += [(seq, u, i, [math.cos(x), -math.sin(x), 0.0, 0.0, math.sin(x), math.cos(x), 0.0, 0.0, 0.0, 0.0, 1.0, 0.0]) for i, (u, x) in enumerate(pose)]
        imu += [(seq, u, i, 0.0, 0.0, w) for i, (u, w) in enumerate(gyro)]
        want[seq] = _slow_lag(pose, gyro, gyro[0][0], gyro[-1][0])
    p = spark.createDataFrame(poses, "seq string, us bigint, line bigint, tmat array<double>")
    i = spark.createDataFrame(imu, "seq string, us bigint, line bigint, ox double, oy double, oz double")
    got = {x.seq: x for x in sync.stream_lag(p, i, sync.track_ends(i)).collect()}
    assert {k: x.lag for k, x in got.items()} == {k: v[0] for k, v in want.items()} and want["b"][0] == 4
    assert all(abs(got[k].lag_ms - want[k][1]) < 1e-3 for k in want)
    small = sync.circular_products(sync.common_grid(p, i, sync.track_ends(i)), 10, 64).collect()
    whole = {x.seq: x.c for x in sync.circular_products(sync.common_grid(p, i, sync.track_ends(i)), 10, 10_000).collect()}
    assert all(abs(u - v) < 1e-9 for x in small for u, v in zip(x.c, whole[x.seq]))
    flat = i.withColumn("oz", F.lit(1.0))
    assert {x.lag for x in sync.stream_lag(p, flat, sync.track_ends(flat)).collect()} == {0}
    drift = {x.seq: x for x in sync.clock_drift(p, i, window_us=1_500_000, least_us=1_000_000).collect()}
    assert drift["b"].drift_ms == drift["b"].last_ms - drift["b"].first_ms and drift["c"].first_ms is None


def test_preamble(spark):
    rnd = random.Random(1)
    rows = []
    for i in range(4000):
        t = i * 0.01
        if t < 5:
            w = (2.0 * (1 if int(t * 4) % 2 else -1) + rnd.gauss(0, 0.01), rnd.gauss(0, 0.01), rnd.gauss(0, 0.01))
        elif t < 8:
            w = tuple(rnd.gauss(0, 0.001) for _ in range(3))
        else:
            w = tuple(rnd.gauss(0, 1.0) for _ in range(3))
        rows.append(("a", int(t * 1e6), *w))
    d = spark.createDataFrame(rows, "seq string, us bigint, ox double, oy double, oz double")
    x = sync.preamble_end(sync.motion_windows(d)).first()
    assert x.swings >= 4 and x.end_window == 8
    assert sync.preamble_end(sync.motion_windows(d.where("us >= 8000000"))).first().end_window is None


def test_of_equal_times_the_first_line_counts(spark):
    readings = [("a", 10, 5, 1.0), ("a", 10, 2, 2.0), ("a", 10, 9, 3.0), ("a", 20, 7, 4.0), ("a", 20, 6, 5.0), ("a", 130, 1, 6.0), ("a", 130, 0, 7.0), ("b", 10, 0, 8.0)]
    asked = [("a", 10, 0), ("a", 15, 1), ("a", 20, 2), ("a", 60, 3), ("a", 5, 4), ("a", 200, 5), ("a", None, 6), (None, 10, 7), ("c", 10, 8)]
    r = spark.createDataFrame(readings, "seq string, us bigint, line bigint, v double")
    for seed in range(3):
        left = spark.createDataFrame(asked, "seq string, at bigint, k bigint")
        got = {x.k: (x.before and x.before.v, x.after and x.after.v) for x in asof.bracket(left, r.orderBy(F.rand(seed)), "seq", "at", "us", ["v"], 100, tie="line").collect()}
        assert got == {0: (2.0, 2.0), 1: (2.0, 5.0), 2: (5.0, 5.0), 3: (5.0, 7.0), 4: (None, 2.0), 5: (7.0, None), 6: (None, None), 7: (None, None), 8: (None, None)}

"""Queries over all their rows, against brute force on small tables."""

import math
import random
from statistics import mean, pstdev

from sensorloom.operators import fitting
from sensorloom.operators import relational as rel
from sensorloom.plans import formats, scene


def pose_table(spark, path, rows):
    """rows: (seq, line, x, y, z) or (seq, line, sixteen values)."""
    full = [(r[0], r[1], r[1] / 100, list(r[2]) if len(r) == 3 else [1.0, 0.0, 0.0, r[2], 0.0, 1.0, 0.0, r[3], 0.0, 0.0, 1.0, r[4], 0.0, 0.0, 0.0, 1.0]) for r in rows]
    spark.createDataFrame(full, "seq string, line bigint, t double, tmat array<double>").write.parquet(f"{path}/pose_track.parquet")


def test_a40_judges_every_point(spark, tmp_path):
    rnd = random.Random(4)
    rows = [(s, i, rnd.gauss(0, 0.3), rnd.gauss(0, 0.3), rnd.gauss(0, 0.1)) for s, n in (("a", 70), ("b", 15)) for i in range(n)]
    rows += [("a", 73, 5.0, 0.0, 0.0), ("b", 33, 0.0, 4.0, 0.0)]  # isolated, on lines that are not multiples of 20
    pose_table(spark, tmp_path, rows)
    want = {}
    for s in "ab":
        own = [r for r in rows if r[0] == s]
        m = {r[1]: mean(sorted(math.dist(r[2:], q[2:]) for q in own if q is not r)[:8]) for r in own}
        top = mean(m.values()) + 2 * pstdev(m.values())
        want |= {(s, i): (round(d, 4), d <= top) for i, d in m.items()}
    got = {(x.seq, x.line): (round(x.mean_distance, 4), x.kept) for x in scene.a40_outliers(spark, str(tmp_path)).collect()}
    assert got.keys() == want.keys() and all(got[k][1] == want[k][1] and abs(got[k][0] - want[k][0]) < 2e-4 for k in want)
    assert not got["a", 73][1] and not got["b", 33][1]


def view_table(spark, path, rows):
    full = [(i, s, "train", f"{i}.png", [1.0, 0.0, 0.0, x, 0.0, 1.0, 0.0, y, 0.0, 0.0, 1.0, z, 0.0, 0.0, 0.0, 1.0]) for i, s, x, y, z in rows]
    spark.createDataFrame(full, "rec_id bigint, seq string, split string, rgb_name string, tmat array<double>").write.parquet(f"{path}/split_frames.parquet")


def test_hits_are_of_all_cameras(spark, tmp_path):
    rnd = random.Random(5)
    pts = [(s, i, rnd.uniform(1, 6), rnd.uniform(-2, 2), rnd.uniform(-1, 1)) for s in "ab" for i in range(40)] + [("a", 40, 1.3, 0.0, 0.0), ("a", 41, 2.6, 0.0, 0.0)]
    cams = [(i, "a" if i < 150 else "b", rnd.uniform(-1, 1), rnd.uniform(-1, 1), 0.0) for i in range(1, 160)] + [(161, "a", 0.0, 0.0, 0.0)]  # "a" has two blocks, "b" no multiple of 20
    pose_table(spark, tmp_path, pts)
    view_table(spark, tmp_path, cams)
    pixels, seen = {}, {}
    for c, cs, cx, cy, cz in cams:
        for s, i, x, y, z in pts:
            q = (cy - y, cz - z, x - cx)  # right, down, forward
            u, v = (math.floor(300 * q[k] / q[2] + m) if q[2] > 0.1 else -1 for k, m in ((0, 160), (1, 120)))
            if s == cs and q[2] > 0.1 and 0 <= u < 320 and 0 <= v < 240:
                pixels.setdefault((c, u, v), []).append((q[2], i, s))
                n = seen.setdefault((s, i), [0, 0])
                n[0] += 1
                n[1] += math.hypot(*q) < 5
    d = str(tmp_path)
    assert {(x.seq, x.line): [x.any_views, x.good_views] for x in scene.j19_view_counts(spark, d).collect()} == seen
    assert {(x.rec_id, x.u, x.v): x.line for x in scene.a15_nearest_payload(spark, d).collect()} == {k: min(h)[1] for k, h in pixels.items()}
    many = {k: (round(min(h)[0], 4), len(h)) for k, h in pixels.items() if len(h) > 1}
    assert many and {(x.rec_id, x.u, x.v): (round(x.z, 4), x.hits) for x in scene.a14_zbuffer(spark, d).collect()} == many
    rules = {}
    for h in pixels.values():
        near = min(h)[0]
        for z, i, s in h:
            r = rules.setdefault((s, i), [False] * 3)
            for k, yes in enumerate((abs(z - near) < 0.05 * near, z <= near * 1.05, z < near * 1.05 or z < near + 0.15)):
                r[k] |= yes
    assert {(x.seq, x.line): [x.surface, x.open, x.fill] for x in scene.j18_visibility_any(spark, d).collect()} == rules
    deep = {x.rec_id for x in scene.a17_surface_depth(spark, d).collect()}
    assert deep == {k[0] for k, h in pixels.items() if max(h)[0] > 0.5} and {x.rec_id for x in scene.f17_support(spark, d).collect()} <= deep


def test_small_floor_share_is_found(spark):
    rnd = random.Random(6)
    floor = [("r", i, rnd.uniform(-4, 4), rnd.uniform(-4, 4), rnd.gauss(-1, 0.005)) for i in range(150)]
    clutter = [("r", 150 + i, rnd.uniform(-4, 4), rnd.uniform(-4, 4), rnd.uniform(-1, 4)) for i in range(1350)]  # the floor is a tenth
    pts = spark.createDataFrame(floor + clutter, "s string, i int, x double, y double, z double")
    cams = spark.createDataFrame([("r", rnd.uniform(-2, 2), rnd.uniform(-2, 2), 0.3) for _ in range(50)], "s string, x double, y double, z double")
    p = fitting.floor_plane(pts, cams, ["s"], "i", peels=1).collect()
    assert len(p) == 1 and p[0].nz > 0.999 and abs(p[0].d - 1) < 0.02


def test_a48_draws_500_resamples(spark, sf_dir, monkeypatch):
    whole, drawn = rel.bootstrap_interval, []

    def spy(df, by, order, value, resamples=500, **kw):
        drawn.append(resamples)
        return whole(df, by, order, value, resamples, **kw)

    monkeypatch.setattr(rel, "bootstrap_interval", spy)
    formats.a48_bootstrap(spark, sf_dir)
    assert drawn == [500]

import math
import random

import numpy as np
from pyspark.sql import functions as F

from sensorloom.functions import keys
from sensorloom.operators import cameras, fitting, greedy
from sensorloom.operators import projective as pj
from sensorloom.operators import spatial as sp


def cloud(spark, n=150, seed=1, spread=2.0):
    rnd = random.Random(seed)
    rows = [("a" if i % 3 else "b", i, rnd.uniform(-spread, spread), rnd.uniform(-spread, spread), rnd.uniform(-0.5, 0.5)) for i in range(n)]
    rows.append(("a", n, 500.0, 0.0, 0.0))  # far from all others
    rows.append(("a", n + 1, *rows[1][2:]))  # a copy
    return rows, spark.createDataFrame(rows, "s string, i int, x double, y double, z double")


def test_knn_is_exact(spark):
    rows, d = cloud(spark)
    got = {}
    for x in sp.nearest_neighbours(d, d, ["s"], 3, 0.2, "i", "i", apart=True).collect():
        got.setdefault(x.i, {})[x["rank"]] = x.near_i
    for r in rows:
        near = sorted((math.dist(r[2:], q[2:]) ** 2, q[1]) for q in rows if q[0] == r[0] and q[1] != r[1])[:3]
        mine = [got[r[1]][k] for k in (1, 2, 3)]
        assert [round(math.dist(r[2:], rows[k][2:]) ** 2, 9) for k in mine] == [round(a, 9) for a, _ in near]
    assert sp.nearest_neighbours(d.where("false"), d, ["s"], 1, 0.2, "i", "i").count() == 0


def test_radius_join_is_exact(spark):
    rows, d = cloud(spark)
    got = {(x.i, x.near_i) for x in sp.radius_join(d, d, ["s"], 0.7, "i", "i", apart=True).collect()}
    assert got == {(a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[1] != b[1] and math.dist(a[2:], b[2:]) <= 0.7}


def test_components_and_morphology(spark):
    cells = [(x, 0) for x in range(40)] + [(x, y) for x in (50, 51) for y in (0, 1)] + [(52, 2), (-5, -5)]
    d = spark.createDataFrame([("a", x, y) for x, y in cells] + [("b", 0, 0)], "s string, ix int, iy int")
    c = sp.components(d, ["s"]).groupBy("s", "component").count().collect()
    assert sorted((x.s, x["count"]) for x in c) == [("a", 1), ("a", 1), ("a", 4), ("a", 40), ("b", 1)]
    c8 = sp.components(d, ["s"], diagonal=True).groupBy("s", "component").count().collect()
    assert sorted((x.s, x["count"]) for x in c8) == [("a", 1), ("a", 5), ("a", 40), ("b", 1)]
    block = spark.createDataFrame([("a", x, y) for x in range(5) for y in range(5) if (x, y) != (2, 2)], "s string, ix int, iy int")
    closed = {(r.ix, r.iy) for r in sp.close(block, ["s"]).collect()}
    assert (2, 2) in closed and len(closed) == 25
    assert sp.erode(block, ["s"]).count() == 4 if False else sp.open_(block, ["s"]).count() <= 24
    assert sp.components(d.where("false"), ["s"]).count() == 0


def test_keys(spark):
    v = [(-1, 0, 5), (1023, 1023, 1023), (3, 2, 1), (-(1 << 19), 7, (1 << 19) - 1)]
    d = spark.createDataFrame(v, "a long, b long, c long")
    k = [x.k for x in d.select(keys.voxel_key(d.a * 1.0, d.b * 1.0, d.c * 1.0, 1.0).alias("k")).collect()]
    assert len(set(k)) == 4
    m = {(x.a, x.b, x.c): x.m for x in d.where("a >= 0").select("a", "b", "c", keys.morton(d.a, d.b, d.c).alias("m")).collect()}

    def slow(x, y, z):
        return sum((x >> i & 1) << (3 * i) | (y >> i & 1) << (3 * i + 1) | (z >> i & 1) << (3 * i + 2) for i in range(10))

    assert all(m[t] == slow(*t) for t in m)
    s = spark.createDataFrame([("1690474652",), ("1690474652123",), ("1690474652123456",), ("1690474652123456789",), ("17",)], "d string")
    assert [x.s and round(x.s) for x in s.select(keys.stamp_seconds(s.d).alias("s")).collect()] == [1690474652] * 4 + [None]
    j = spark.createDataFrame([('x {"a": {"b": 1}} y',), ("{bad",), (None,)], "t string")
    assert [x.o for x in j.select(keys.first_object(j.t).alias("o")).collect()] == ['{"a": {"b": 1}}', None, None]


def test_compositing_and_visibility(spark):
    d = spark.createDataFrame([(1, 0.5, 1.0), (1, 1.0, 2.0), (1, 0.7, 3.0), (2, 0.0, 1.0)], "p int, alpha double, z double")
    w = {(x.p, x.z): x.weight for x in pj.composite(d, ["p"], ["z"]).collect()}
    assert abs(w[1, 1.0] - 0.5) < 1e-12 and abs(w[1, 2.0] - 0.5) < 1e-12 and abs(w[1, 3.0]) < 1e-12 and w[2, 1.0] == 0
    r = spark.createDataFrame([(1.0, 1.04), (1.0, 0.5), (1.0, 0.9), (1.0, 0.0), (1.0, None)], "r double, d double")
    rules = [pj.visibility(r.r, r.d, x).alias(x) for x in ("surface", "open", "fill")]
    assert [tuple(x) for x in r.select(*rules).collect()] == [(True, True, True), (False, False, False), (False, False, True), (False, True, True), (False, True, True)]


def test_see_through(spark):
    cloud_ = spark.createDataFrame([(s, 0, 0, 2.0, 1) for s in range(4)] + [(s, 0, 1, 2.0, 2) for s in range(4)], "scan int, ring int, az int, r double, pid int")
    image = spark.createDataFrame([(s, 0, 0, 5.0) for s in range(4)] + [(s, 0, 1, 2.05) for s in range(4)], "scan int, ring int, az int, m double")
    got = {x.pid: (x.free, x.hit, x.dynamic) for x in pj.see_through_votes(cloud_, image, "scan", "pid").collect()}
    assert got == {1: (4, 0, True), 2: (0, 4, False)}


def test_similarity_plane_levels(spark):
    rows, d = cloud(spark)
    s = fitting.similarity(d.withColumn("u", -2 * d.y + 1).withColumn("v", 2 * d.x).withColumn("w", 2 * d.z - 3), ["s"], ("x", "y", "z"), ("u", "v", "w")).collect()
    assert len(s) == 2 and all(abs(x.scale - 2) < 1e-6 and abs(x.tmat[3] - 1) < 1e-6 and abs(x.tmat[1] + 1) < 1e-9 for x in s)
    rnd = random.Random(3)
    floor = [("r", i, rnd.uniform(-4, 4), rnd.uniform(-4, 4), rnd.gauss(-1, 0.005)) for i in range(3000)] + [("r", 3000 + i, rnd.uniform(-4, 4), rnd.uniform(-4, 4), rnd.gauss(1.4, 0.005)) for i in range(2000)]
    wall = [("r", 6000 + i, 4.0 + rnd.gauss(0, 0.005), rnd.uniform(-4, 4), rnd.uniform(-1, 1.4)) for i in range(1500)]
    pts = spark.createDataFrame(floor + wall, "s string, i int, x double, y double, z double")
    cams = spark.createDataFrame([("r", rnd.uniform(-2, 2), rnd.uniform(-2, 2), 0.3) for _ in range(50)], "s string, x double, y double, z double")
    p = fitting.floor_plane(pts, cams, ["s"], "i", trials=64, peels=4).collect()
    assert len(p) == 1 and p[0].nz > 0.999 and abs(p[0].d - 1) < 0.01
    none = fitting.floor_plane(pts.where("i >= 6000"), cams, ["s"], "i", trials=64, peels=2).collect()
    assert none == []
    lv = spark.createDataFrame([("a", v + rnd.gauss(0, 0.01)) for v in (0.0, 1.0, 2.5) for _ in range(60)] + [("b", 1.0)] * 5, "s string, z double")
    k = {x.s: (x.k, x.centres) for x in fitting.k_medians_1d(lv, ["s"], "z").collect()}
    assert k["a"][0] == 3 and all(abs(c - w) < 0.02 for c, w in zip(k["a"][1], (0, 1, 2.5))) and k["b"][0] == 1


def test_greedy(spark):
    rows, d = cloud(spark)
    got = {}
    for x in greedy.spaced(d, ["s"], ["i"], "i", 0.6).collect():
        got.setdefault(x.s, set()).add(x.i)
    for s in "ab":
        kept = []
        for r in rows:
            if r[0] == s and all(math.dist(r[2:], k[2:]) >= 0.6 for k in kept):
                kept.append(r)
        assert got[s] == {k[1] for k in kept}
    assert greedy.spaced(d, ["s"], ["i"], "i", 0.6, most=2).count() == 4
    assert greedy.spaced(d.where("false"), ["s"], ["i"], "i", 0.6).count() == 0
    pool = greedy.rotating_pool(d.where("s = 'b'"), "i", 110).groupBy("i").count().agg(F.min("count"), F.max("count")).first()
    assert pool[1] - pool[0] <= 1


def test_register(spark):
    rows, d = cloud(spark, 120)
    d = d.where("i < 120 and s = 'a'")
    moved = d.select("s", "i", (d.x + 0.03).alias("x"), (d.y - 0.02).alias("y"), "z")
    r = fitting.register(moved, d, ["s"], "i", 0.3, 2).first()
    assert r.kept and r.after < 1e-6 and abs(r.tmat[3] + 0.03) < 1e-6


def test_cameras_pass_over_only_what_they_cannot_see():
    rnd = np.random.default_rng(4)
    xyz = np.concatenate([rnd.normal(0, 3, (2500, 3)), rnd.uniform(-900, 900, (300, 3)), np.repeat(rnd.normal(0, 1, (1, 3)), 200, axis=0)])
    turns = np.stack([np.linalg.qr(rnd.normal(size=(3, 3)))[0] for _ in range(40)])
    turns[3] *= 2.5  # no rotation
    turns[4, 0] *= 0.1
    tmat = np.concatenate([turns, rnd.normal(0, 4, (40, 3, 1))], axis=2).reshape(-1, 12)
    tmat[5, 7] = np.nan
    camera = cameras.Camera(300.0, 300.0, 160.0, 120.0, 320, 240, 0.1)
    got = {h.camera: dict(zip(h.point.tolist(), zip(h.pixel.tolist(), h.z.tolist()))) for h in cameras.each_camera(xyz, tmat, camera)}
    hits = 0
    for k, m in enumerate(tmat):
        d = xyz - m[[3, 7, 11]]
        x, y, z = (m[i] * d[:, 0] + m[4 + i] * d[:, 1] + m[8 + i] * d[:, 2] for i in range(3))
        with np.errstate(all="ignore"):
            u, v = np.floor(300 * x / z + 160), np.floor(300 * y / z + 120)
            at = np.flatnonzero((z > 0.1) & (u >= 0) & (u < 320) & (v >= 0) & (v < 240))
        assert got.get(k, {}) == {int(i): (int(v[i] * 320 + u[i]), z[i]) for i in at}
        hits += len(at)
    assert hits > 2000 and 5 not in got


def test_blocks_of_cameras_give_the_same(spark):
    rnd = random.Random(15)
    pts = spark.createDataFrame([(s, i, rnd.uniform(1, 5), rnd.uniform(-2, 2), rnd.uniform(-1, 1)) for s in "ab" for i in range(60)], "s string, i bigint, x double, y double, z double")
    cams = spark.createDataFrame([("a", c, [0.0, 0.0, 1.0, rnd.uniform(-1, 1), -1.0, 0.0, 0.0, 0.0, 0.0, -1.0, 0.0, 0.0]) for c in range(90)] + [("a", 90, None), ("c", 91, [0.0] * 12)], "s string, c bigint, tmat array<double>")
    camera = cameras.Camera(300.0, 300.0, 160.0, 120.0, 320, 240, 0.1)
    for reduce, out, group, values in ((cameras.view_counts(5.0), "any_views bigint, good_views bigint", ["s", "i"], ["any_views", "good_views"]), (cameras.nearest_row("i"), "u int, v int, i bigint", ["c", "u", "v"], ["i"])):
        one, many = (cameras.per_camera(pts, cams, ["s"], "i", "c", camera, reduce, out, block) for block in (1000, 7))
        one, many = (sorted(map(tuple, d.groupBy(*group).sum(*values).collect())) for d in (one, many))
        assert one == many and len(one) > 20
    assert "FlatMapGroupsInArrow" in cameras.per_camera(pts, cams, ["s"], "i", "c", camera, reduce, out)._jdf.queryExecution().optimizedPlan().toString()

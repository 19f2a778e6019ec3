"""Calibrations, files, message logs, stencils and orders against plain versions, with their edge cases."""

import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorloom.functions import geometry as geo
from sensorloom.functions import keys
from sensorloom.operators import alignment, asof, fitting, grids, regular_grid, sync
from sensorloom.operators import projective as pj
from sensorloom.operators import spatial as sp
from sensorloom.sources import bags, binary, calibration, records, synthetic, tables, text


def turn(axis, angle):
    x, y, z = np.array(axis, float) / np.linalg.norm(axis)
    k = np.array([[0, -z, y], [z, 0, -x], [-y, x, 0]])
    return np.eye(3) + math.sin(angle) * k + (1 - math.cos(angle)) * k @ k


def rigid(axis, angle, t):
    m = np.eye(4)
    m[:3, :3], m[:3, 3] = turn(axis, angle), t
    return m


def test_calibration_chain(spark):
    m = rigid((1, 2, 3), 0.7, (0.1, -0.2, 0.3))
    stored = {"K": [[600, 0, 320], [0, 601, 240], [0, 0, 1]], "T_rgb_marker": m.tolist()}
    body = rigid((0, 1, 1), 1.1, (4.0, 5.0, 6.0))
    d = spark.createDataFrame([(body.ravel().tolist(),), (None,)], "tmat array<double>")
    delta = rigid((1, 0, 0), 0.01, (0.0, 0.01, 0.0))
    for direction, want in (("cam_to_marker", m), ("marker_to_cam", np.linalg.inv(m))):
        config = {"frames": {"extrinsic": {"rgb_marker_direction": direction, "delta_T": delta.ravel().tolist()}}, "intrinsics": {"image_width": 99}}
        c = calibration.parse_calibration(stored, config)
        assert c.intrinsics == {"fx": 600, "fy": 601, "cx": 320, "cy": 240} and c.width == 99 and c.distortion == (0.0,) * 5
        got = [r.m for r in d.select(calibration.world_camera(F.col("tmat"), c, config).alias("m")).collect()]
        assert np.allclose(np.array(got[0]).reshape(4, 4), body @ want @ delta)
        assert np.allclose(c.body_from_camera["robot"], np.eye(4).ravel())
    config["frames"] |= {"world_up": "y", "pose_frame": "robot"}
    turned = np.array(d.select(calibration.world_camera(F.col("tmat"), c, config).alias("m")).first().m).reshape(4, 4)
    assert np.allclose(turned, np.array([[1, 0, 0, 0], [0, 0, -1, 0], [0, 1, 0, 0], [0, 0, 0, 1]]) @ body @ delta)
    with pytest.raises(ValueError, match="direction"):
        calibration.parse_calibration(stored, {"frames": {"extrinsic": {"rgb_marker_direction": "sideways"}}})
    with pytest.raises(ValueError, match="pose frame"):
        calibration.world_camera(F.col("tmat"), c, {"frames": {"pose_frame": "tail"}})
    with pytest.raises(ValueError, match="up"):
        calibration.turn_up(F.col("tmat"), "x")
    assert np.allclose(calibration.chain([(m.ravel().tolist(), False), (m.ravel().tolist(), True)]), np.eye(4).ravel())


def test_csv_keeps_odd_values(spark, tmp_path):
    rows = [("a, \"b\"", 1.5, 1), ("", float("nan"), 0), (None, None, None), ("é", float("inf"), 2), ("x", float("-inf"), 3)]
    d = spark.createDataFrame(rows, "name string, t double, used int")
    f = tables.write_csv(tables.fixed_decimals(d, (("name", None), ("t", 3), ("used", 0))), str(tmp_path / "c"))
    back = tables.read_csv(spark, f, "used int, t double, name string").collect()
    assert sorted((repr(r.t), r.used) for r in back) == sorted((repr(t), u) for _, t, u in rows)
    assert {r.name for r in back} >= {'a, "b"', "é", "x"}
    assert tables.read_csv(spark, tables.write_csv(d.where("false"), str(tmp_path / "e")), "t double").count() == 0
    i = spark.createDataFrame([("l", 5, "b", 1.0, 2.0), ("l", 5, "a", 1.0, 2.0), ("r", 1, "c", 0.0, 0.0), ("x", 1, "d", 0.0, 0.0)], tables.IMAGE_INDEX)
    got = tables.read_image_index(spark, tables.write_csv(i, str(tmp_path / "i")), ["l", "r"]).collect()
    assert sorted((r.cam, r.rn, r.file) for r in got) == [("l", 0, "a"), ("l", 1, "b"), ("r", 0, "c")]


def test_json_documents_and_ledger(spark, tmp_path):
    p = str(tmp_path / "deep" / "r.json")
    tables.write_json(p, {"a": np.arange(3), "b": np.float64(1.5), "c": [np.int64(2)]})
    assert open(p).read().replace("\n", "").replace(" ", "") == '{"a":[0,1,2],"b":1.5,"c":[2]}'
    with pytest.raises(TypeError):
        tables.write_json(p, {"a": {1, 2}})
    d = spark.createDataFrame([(1, "x"), (2, None)], "k int, v string")
    for _ in range(2):
        f = tables.append_jsonl(d, str(tmp_path / "ledger"))
    assert sorted((r.k, r.v) for r in tables.read_jsonl(spark, f, "k int, v string").collect()) == [(1, "x"), (1, "x"), (2, None), (2, None)]


def test_catalogue_assembly_and_cache(spark):
    c = spark.createDataFrame([("a", 1), ("b", 2)], "name string, size int")
    assert [r.size for r in tables.catalogue_entry(c, "b").collect()] == [2]
    with pytest.raises(Exception, match="not in the catalogue"):
        tables.catalogue_entry(c, "z").collect()
    f = spark.createDataFrame([("a",), ("c",), (None,)], "name string")
    files = spark.createDataFrame([("a", "2"), ("a", "1"), ("b", "3")], "name string, file string")
    assert sorted(map(tuple, tables.assemble(f, {"mask": files, "depth": files.where("false")}, "name").collect()), key=str) == sorted([("a", "1", None), ("c", None, None), (None, None, None)], key=str)
    cache = spark.createDataFrame([("a", 1, 0.0), ("b", 1, 0.0), ("b", 2, 0.0)], "g string, i int, v double")
    now = spark.createDataFrame([("a", 1, 5.0), ("b", 1, 6.0), ("c", 1, 7.0)], "g string, i int, v double")
    assert sorted(map(tuple, tables.cached_stats(cache, now, "g", lambda d: d).collect())) == [("a", 1, 0.0), ("b", 1, 6.0), ("c", 1, 7.0)]
    codes = spark.createDataFrame([(True, True), (True, False), (False, True), (None, True), (True, None)], "k boolean, v boolean")
    assert [r.c for r in codes.select(tables.coded_mask(F.col("k"), F.col("v")).alias("c")).collect()] == [255, 0, 128, 128, 0]


def test_mesh_faces_are_fanned(spark):
    lines = spark.createDataFrame([("m", i, v) for i, v in enumerate(["# a mesh", "v 0 0 1.5", "v 1 0 0 ", "v 1 1 0", "v 0 1 0", "vn 0 0 1", "f 1/1/1 2//1 3 4", "f 1 2", None])], "path string, line_no bigint, value string")
    v, f = tables.read_mesh(lines)
    assert [(r.x, r.y, r.z) for r in v.orderBy("line_no").collect()][0] == (0.0, 0.0, 1.5) and v.count() == 4
    assert sorted((r.a, r.b, r.c) for r in f.collect()) == [(0, 1, 2), (0, 2, 3)]


def test_line_numbers_over_splits(spark, tmp_path):
    want = {}
    for name, n in (("a.txt", 3000), ("b.txt", 5), ("empty.txt", 0)):
        lines = [f"{name} {i}" if i % 7 else "" for i in range(n)]
        (tmp_path / name).write_text("".join(x + "\n" for x in lines))
        want |= {(name, i): x for i, x in enumerate(lines)}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        r = text.read_lines(spark, str(tmp_path))
        assert r.rdd.getNumPartitions() > 0 and {(x.path.split("/")[-1], x.line_no): x.value for x in r.collect()} == want
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 3
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_headers_and_padded_fields(spark, tmp_path):
    note = "".join(f"comment {'x' * 60}\n" for _ in range(200))  # a header of more than one step
    (tmp_path / "a.ply").write_bytes(f"ply\nformat binary_little_endian 1.0\n{note}element vertex 7\nproperty float x\nend_header\n".encode() + b"\0" * 28)
    assert [r.rows for r in binary.ply_counts(spark, str(tmp_path)).collect()] == [7]
    head = b"VERSION .7\nFIELDS x normal _ y\nSIZE 4 4 1 8\nTYPE F F U F\nCOUNT 1 3 4 1\nWIDTH 2\nHEIGHT 1\nPOINTS 2\n"
    body = b"".join(struct.pack("<ffff4sd", x, 9, 8, 7, b"pad!", y) for x, y in ((1, 2), (3, 4)))
    assert binary.pcd_points(head + b"DATA binary\n" + body).to_dict("list") == {"x": [1.0, 3.0], "normal": [9.0, 9.0], "y": [2.0, 4.0]}
    assert binary.pcd_points(head + b"DATA ascii\n1 9 8 7 0 0 0 0 2\n3 9 8 7 0 0 0 0 4\n").to_dict("list") == {"x": [1.0, 3.0], "normal": [9.0, 9.0], "y": [2.0, 4.0]}
    row = b"".join(struct.pack("<fff", *p) for p in ((1, 0, 0), (0, 2, 0))) + b"\xff" * 8  # two points and padding
    fields = [{"name": c, "offset": 4 * i, "datatype": 7} for i, c in enumerate("xyz")]
    m = spark.createDataFrame([(3, row + row, 12, False, fields, 2, 2, 32)], "scan bigint, data binary, point_step int, big_endian boolean, fields array<struct<name:string,offset:int,datatype:int>>, height int, width int, row_step int")
    assert sorted(r.r for r in binary.scan_points(m, 0.5, 10.0).collect()) == [1.0, 1.0, 2.0, 2.0]


def test_packed_splats_and_quaternions(spark):
    rnd = random.Random(1)
    qs = []
    for _ in range(300):
        q = np.array([rnd.gauss(0, 1) for _ in range(4)])
        qs.append(tuple(float(v) for v in q / np.linalg.norm(q)))
    qs += [(1.0, 0.0, 0.0, 0.0), (0.0, -1.0, 0.0, 0.0), (0.5, 0.5, 0.5, 0.5), (-0.5, 0.5, -0.5, 0.5)]
    d = spark.createDataFrame([(i, *q) for i, q in enumerate(qs)], "i int, w double, x double, y double, z double").select("i", F.struct("w", "x", "y", "z").alias("q"))
    got = d.select("q", keys.unpack_quat(keys.pack_quat(F.col("q")) - (1 << 32)).alias("b")).collect()
    assert all(abs(sum(r.q[c] * r.b[c] for c in "wxyz")) > 1 - 1e-5 for r in got)
    ends = {f"{e}_{p}{c}": (0.0 if e == "lo" else 2.0) for e in ("lo", "hi") for p in ("", "scale_") for c in "xyz"} | {f"{e}_{c}": (0.0 if e == "lo" else 1.0) for e in ("lo", "hi") for c in "rgb"}
    chunks = spark.createDataFrame([(0, *ends.values())], "chunk bigint, " + ", ".join(f"{k} double" for k in ends))
    rows = spark.createDataFrame([(0, 0, -1, 0xFF804000 - (1 << 32), 0), (1, 2047 << 21, 1023 << 11, 255, 1 << 30)], "row bigint, position bigint, scale bigint, colour bigint, rotation bigint")
    a, b = binary.unpack_splats(rows, chunks).orderBy("row").collect()
    assert (a.x, a.y, a.z, a.scale_x, a.scale_y, a.scale_z) == (0, 0, 0, 2, 2, 2) and a.r == 1.0 and a.opacity == float("-inf") and abs(a.g - 128 / 255) < 1e-12
    assert (b.x, b.y, b.scale_y, b.opacity) == (2.0, 0.0, 2.0, float("inf")) and b.q["x"] == max(b.q)
    with pytest.raises(ValueError):
        geo.quat_of(F.col("q"), "zyxw")
    v = d.select(geo.quat_of(geo.quat_values(F.col("q"), "xyzw"), "xyzw").alias("s"), "q").collect()
    assert all(r.s == r.q for r in v)


def test_harmonics_turn_with_the_body(spark):
    r = turn((0.3, -1, 2), 0.9)
    rnd = np.random.default_rng(2)
    c, d = rnd.normal(size=15), rnd.normal(size=3)
    d /= np.linalg.norm(d)
    one = spark.createDataFrame([(c.tolist(),)], "c array<double>").select(geo.turn_harmonics(F.col("c"), r.ravel().tolist()).alias("t")).first().t
    back = r.T @ d
    assert abs(np.dot(one, geo.harmonics(*d)) - np.dot(c, geo.harmonics(*back))) < 1e-9


def test_footprint_is_the_projected_covariance(spark):
    m = rigid((1, 1, 0), 0.4, (0.2, 0.1, -3.0))
    body, scales, p = turn((0, 1, 2), 0.8), np.array([0.3, 0.2, 0.05]), np.array([0.4, -0.1, 0.2])
    cov = body @ np.diag(scales**2) @ body.T
    q = m[:3, :3].T @ (p - m[:3, 3])
    j = np.array([[200 / q[2], 0, -200 * q[0] / q[2] ** 2], [0, 210 / q[2], -210 * q[1] / q[2] ** 2]]) @ m[:3, :3].T
    want = j @ cov @ j.T
    d = spark.createDataFrame([(body.ravel().tolist(), scales.tolist(), m.ravel().tolist())], "r array<double>, s array<double>, m array<double>")
    c = d.select(geo.body_covariance(F.col("r"), F.col("s")).alias("c"), "m")
    x = c.select("c", geo.image_covariance(geo.point(*p), F.col("c"), F.col("m"), 200.0, 210.0).alias("i")).first()
    assert np.allclose(x.c, cov[np.triu_indices(3)]) and np.allclose([x.i.a, x.i.b, x.i.d], [want[0, 0], want[0, 1], want[1, 1]])
    assert c.select(geo.image_covariance(geo.point(0.2, 0.1, -9.0), F.col("c"), F.col("m"), 200.0, 210.0).alias("i")).first().i is None


def test_stencils(spark):
    rnd = np.random.default_rng(3)
    g = rnd.uniform(0, 9, size=(9, 12))
    px = spark.createDataFrame([("a", u, v, float(g[v, u])) for v in range(9) for u in range(12)], "f string, u int, v int, gray double")
    pad = np.pad(g, 1, mode="reflect")
    lap = pad[:-2, 1:-1] + pad[2:, 1:-1] + pad[1:-1, :-2] + pad[1:-1, 2:] - 4 * g
    s = grids.sharpness(px, ["f"], 12, 9).first()
    assert abs(s.sharp - lap.var()) < 1e-9 and abs(s.mean - g.mean()) < 1e-12
    got = {(r.tile_u, r.tile_v, r.direction): r.energy for r in grids.directional_energies(px, ["f"], 6, 3).collect()}
    for name, (du, dv) in grids.DIRECTIONS.items():
        a, b = g[max(-dv, 0) : 9 - max(dv, 0), : 12 - du], g[max(dv, 0) : 9 + min(dv, 0), du:]
        e = (b - a) ** 2
        for tv in range(3):
            for tu in range(2):
                assert abs(got[tu, tv, name] - e[tv * 3 : tv * 3 + 2, tu * 6 : tu * 6 + 5].mean()) < 1e-9
    assert grids.sharpness(px.where("false"), ["f"], 12, 9).count() == 0


def test_curve_order_of_crowded_cells(spark):
    rnd = random.Random(4)
    pts = [(i, rnd.uniform(0, 1000), rnd.uniform(0, 1000), 0.0) for i in range(50)] + [(50 + i, rnd.uniform(0, 0.5), rnd.uniform(0, 0.5), 0.0) for i in range(40)] + [(90 + i, 7.0, 7.0, 0.0) for i in range(30)]

    def order(rows, crowded):
        lo, hi = [min(r[k] for r in rows) for k in (1, 2, 3)], [max(r[k] for r in rows) for k in (1, 2, 3)]
        if lo == hi:
            return sorted(rows)

        def code(r):
            q = [min(1023, int((r[k + 1] - lo[k]) * (1024 / (hi[k] - lo[k])))) if hi[k] > lo[k] else 0 for k in range(3)]
            return sum(((q[k] >> b) & 1) << (3 * b + k) for k in range(3) for b in range(10))

        out, cells = [], {}
        for r in sorted(rows):
            cells.setdefault(code(r), []).append(r)
        for c in sorted(cells):
            out += order(cells[c], crowded) if len(cells[c]) > crowded else cells[c]
        return out

    d = spark.createDataFrame([("s", *p) for p in pts], "seq string, line int, x double, y double, z double")
    got = [r.line for r in sp.curve_order(d, ["seq"], "line", 8).orderBy("rank").collect()]
    assert got == [r[0] for r in order(pts, 8)]
    assert sp.curve_order(d.where("false"), ["seq"], "line").count() == 0


def test_step_levels(spark):
    rows = []
    for u in range(4):
        for v in range(3):
            if (u, v) != (2, 1):  # a cell without evidence
                rows += [("s", u + 0.5, v + 0.5, (1.0 if u < 2 else 2.0) + e) for e in (0.0, 0.001, -0.001)]
    rows += [("s", 2.5, 1.5, 9.0)]  # one reading is no evidence
    got = {(r.u, r.v): r.level for r in fitting.step_levels(spark.createDataFrame(rows, "seq string, x double, y double, z double"), ["seq"], 1.0).collect()}
    assert len(got) == 12 and {k: round(x) for k, x in got.items()} == {(u, v): 1 if u < 2 else 2 for u in range(4) for v in range(3)}


def test_absorbing_boxes(spark):
    # 1 | 2 | 3 in a row, each 5 cm apart; 2 and 3 are partial, 4 is far
    b = spark.createDataFrame([("s", 1, False, 0.0, 1.0), ("s", 2, True, 1.05, 2.0), ("s", 3, True, 2.05, 3.0), ("s", 4, True, 9.0, 9.5)], "seq string, id int, cut boolean, lo_x double, hi_x double")
    got = sorted((r.id, r.into) for r in grids.absorb_boxes(b, ["seq"], "id", "cut", ("x",), 0.06, 4.0).collect())
    assert got == [(1, 2), (3, 2)]  # 3 is gone before its turn
    assert grids.absorb_boxes(b.where("false"), ["seq"], "id", "cut", ("x",), 0.06, 4.0).count() == 0


def test_long_gaps_are_marked(spark):
    r = spark.createDataFrame([("a", i, at, [1.0, 2.0, 3.0]) for i, at in enumerate((0, 50_000, 900_000, 61_100_000, 250_000_000))] + [("b", 0, 5, [0.0] * 3)], "source string, line bigint, at bigint, values array<double>")
    s = regular_grid.whole_series(r)
    a = {x.slot: x for x in s.where("source = 'a'").collect()}
    assert set(a) == set(range(2501)) and s.where("source = 'b'").count() == 1
    assert {k for k, x in a.items() if x.state == "missing"} == {*range(10, 611), *range(612, 2500)}
    assert all(x.readings == 0 and x.coverage == 0.0 and x.averages is None for x in a.values() if x.state == "missing")
    assert {k for k, x in a.items() if x.state == "filled"} == set(range(1, 9))
    assert regular_grid.whole_series(r.where("false")).count() == 0


def test_message_logs(spark):
    m = spark.createDataFrame([("a", "/x", i, i * 10) for i in range(10)] + [("a", "/y", 3, 1), ("b", "/x", 0, 0)], "bag string, topic string, n bigint, v int")
    assert sorted((r.bag, r.v) for r in bags.every_nth(bags.route(m, {"s": "/x"})["s"], 4).collect()) == [("a", 0), ("a", 40), ("a", 80), ("b", 0)]
    assert [(r.bag, r.topic) for r in bags.missing_topics(m, ["/x", "/y"]).collect()] == [("b", "/y")]
    with pytest.raises(ValueError, match="not set"):
        bags.offset_seconds({"timestamps": {}}, "lidar")
    t = m.limit(1).select(bags.point_times(F.lit(10.0), F.lit(0.02), F.lit(0.1)).alias("e"), bags.point_times(F.lit(10.0), F.lit(0.02), F.lit(0.1), "start").alias("s")).first()
    assert abs(t.e - 9.92) < 1e-9 and abs(t.s - 10.02) < 1e-9
    a, b = rigid((0, 0, 1), 0.0, (0, 0, 0)), rigid((0, 0, 1), 1.0, (2, 0, 0))
    p = spark.createDataFrame([("s", 0, 0, a.ravel().tolist()), ("s", 1_000_000, 1, b.ravel().tolist())], "seq string, us bigint, line bigint, tmat array<double>")
    pts = spark.createDataFrame([("s", k, k * 250_000, 1.0, 0.0, 0.0) for k in range(6)], "seq string, scan bigint, stamp_us bigint, x double, y double, z double")
    r = bags.registered_scans(pts, p, calibration.constant(calibration.IDENTITY), {"timestamps": {"offsets_s": {"l": -0.125}}}, "l", 2).collect()
    assert sorted(x.scan for x in r) == [2, 4]  # scan 0 is before the track
    x = next(x for x in r if x.scan == 2)
    assert np.allclose(np.array(x.world).reshape(4, 4), rigid((0, 0, 1), 0.375, (0.75, 0, 0)))


def test_labels(spark):
    rows = [
        ("run/report/a.json", ["m", "black_set", "x_grey"], "deep_black", "p/grey_1"), ("run/report/b.json", ["m"], None, None), ("run/report/b.json", ["m", "3"], None, None), ("r/s_black/q/report_black.json", [], "", ""),
        ("run/report/c.json", ["other"], "t", "p/grey_1"), ("run/GREY/report/d.json", ["k", "grey", "z"], "z", None),
    ]
    d = spark.createDataFrame([(p, c, 1.0, 1.0, 1.0, 1, t, d_, {}) for p, c, t, d_ in rows], records.RECORD_SCHEMA)
    got = {r.path: (r.background, r.label, r.set_name) for r in records.labelled(d).collect()}
    assert got == {
        "run/report/a.json": ("grey", "deep", "black_set/x [grey]"),
        "run/report/b.json": ("bg?", "m", "run [bg?]"),
        "r/s_black/q/report_black.json": ("black", "report", "s [black]"),
        "run/GREY/report/d.json": ("bg?", "z", " [bg?]"),
    }


def test_lever_arm_and_offset(spark):
    rnd = np.random.default_rng(6)
    big, shift, lever, scale, offset = turn((1, 2, -1), 0.6), np.array([3.0, -1.0, 0.5]), np.array([0.2, -0.1, 0.3]), 1.7, 0.05
    place = lambda t: np.array([math.sin(t), 0.7 * math.cos(1.3 * t), 0.3 * math.sin(2.1 * t)])
    face = lambda t: turn((math.sin(0.4 * t), 1.0, math.cos(0.9 * t)), 0.8 * t)
    frames, truth = [], []
    for i in range(80):
        t = 1.0 + 0.05 * i
        m = np.eye(4)
        m[:3, :3], m[:3, 3] = face(t), place(t)
        frames.append(("s", i, round(t * 1e6), m.ravel().tolist()))
    for i in range(1400):
        t = 0.3 + 0.005 * i
        truth.append(("s", round((t + offset) * 1e6), i, *map(float, scale * big @ place(t) + big @ face(t) @ lever + shift)))
    frames += [("few", i, i, frames[i][3]) for i in range(3)] + [("s", 99, 0, None)]
    f = spark.createDataFrame(frames, "seq string, id bigint, us bigint, tmat array<double>")
    g = spark.createDataFrame(truth, "seq string, us bigint, line bigint, x double, y double, z double")
    (r,) = alignment.lever_arm(f, g, "seq", "id", rounds=60).collect()
    assert r.seq == "s" and r.offset_us == 50_000 and abs(r.scale - scale) < 1e-2 and r.median < 5e-3
    assert np.allclose(r.lever, lever, atol=2e-2) and np.allclose(np.array(r.rotation).reshape(3, 3), big, atol=1e-2)


def test_symmetry(spark):
    rnd = random.Random(7)
    half = [(rnd.uniform(0.05, 1), rnd.uniform(-1, 1), rnd.uniform(0, 1)) for _ in range(150)]
    pts = [("s", i, x * s, y, z) for i, (x, y, z) in enumerate(half) for s in (1, -1)]
    d = spark.createDataFrame([(q, 2 * i + (x < 0), x, y, z) for q, i, x, y, z in pts] + [("t", 0, None, 0.0, 0.0)], "seq string, id bigint, x double, y double, z double")
    got = {r.map: r for r in alignment.symmetry_scores(d, ["seq"], "id", 0.01).collect()}
    assert len(got) == 63 and got["mirror0"].inliers == got["mirror0"].covered == 1.0
    assert max(r.inliers for k, r in got.items() if k != "mirror0") < 0.5


def test_symmetry_copies_points_not_their_images(spark, monkeypatch):
    rnd = random.Random(9)
    pts = [(s, i, rnd.gauss(0, 0.6), rnd.gauss(0, 0.4), rnd.gauss(0, 0.2)) for s, n in (("s", 90), ("t", 25)) for i in range(n)]
    copied, whole = [], sp.neighbour_cells

    def spy(df, *a, **k):
        copied.append(df.count())
        return whole(df, *a, **k)

    monkeypatch.setattr(sp, "neighbour_cells", spy)
    monkeypatch.setattr(alignment, "neighbour_cells", spy, raising=False)
    got = {(r.seq, r.map): r for r in alignment.symmetry_scores(spark.createDataFrame(pts, "seq string, id bigint, x double, y double, z double"), ["seq"], "id", 0.2, 0.5).collect()}
    assert copied and max(copied) <= len(pts)
    for s in "st":
        own = [p[2:] for p in pts if p[0] == s]
        for name, a, b, c, d in alignment.symmetry_maps():
            near = [min(math.dist((a * x + b * y, c * x + d * y, z), q) for q in own) for x, y, z in own]
            e = sum(v <= 0.5 for v in near)
            r = got[s, name]
            assert r.covered == e / len(own) and r.inliers == (sum(v < 0.2 for v in near) / e if e >= 0.2 * len(own) else 0)


def test_widened_footprints(spark):
    rnd = np.random.default_rng(8)
    cams = [(i, rigid((0, 1, 0), rnd.uniform(-0.2, 0.2), (rnd.uniform(-1, 1), rnd.uniform(-1, 1), -rnd.uniform(2, 9)))) for i in range(7)]
    rows = [(i, *rnd.uniform(-0.6, 0.6, 3), turn(rnd.normal(size=3), 1.0), np.log(rnd.uniform(1e-4, 0.02, 3)), float(rnd.normal())) for i in range(25)] + [(99, 0.0, 0.0, -99.0, np.eye(3), np.zeros(3), 0.0)]
    want = {}
    for i, x, y, z, r, ls, op in rows:
        p, cov = np.array([x, y, z]), r @ np.diag(np.exp(2 * ls)) @ r.T
        need, ratio, culled = [], [], 0
        for _, m in cams:
            q = m[:3, :3].T @ (p - m[:3, 3])
            u, v = (300 * q[k] / q[2] + c if q[2] > 0.01 else -1 for k, c in ((0, 160), (1, 120)))
            if q[2] > 0.01 and 0 <= math.floor(u) < 320 and 0 <= math.floor(v) < 240:
                j = np.array([[300 / q[2], 0, -300 * q[0] / q[2] ** 2], [0, 300 / q[2], -300 * q[1] / q[2] ** 2]]) @ m[:3, :3].T
                s = j @ cov @ j.T + 0.3 * np.eye(2)
                top, gain = np.linalg.eigvalsh(s)[1], (300 / q[2]) ** 2
                culled += top < 1.0
                need.append(max(0.0, 1.05 - top) / gain)
                ratio.append(math.sqrt(np.linalg.det(s) / np.linalg.det(s + gain * need[-1] * np.eye(2))))
        if need:
            k = (len(need) - 1) // 2
            fix = culled > 0.5 * len(need) and sorted(need)[k] > 0
            added = sorted(need)[k] if fix else 0.0
            o = 1 / (1 + math.exp(-op)) * sorted(ratio)[k]
            want[i] = (len(need), culled, added, 0.5 * np.log(np.exp(2 * ls) + added), math.log(o / (1 - o)) if fix else op)
    c = spark.createDataFrame([("s", i, m.ravel().tolist()) for i, m in cams], "seq string, cam int, tmat array<double>")
    d = spark.createDataFrame([("s", i, float(x), float(y), float(z), r.ravel().tolist(), ls.tolist(), op) for i, x, y, z, r, ls, op in rows], "seq string, id int, x double, y double, z double, r array<double>, log_scales array<double>, opacity double")
    got = {r.id: r for r in pj.widened_footprints(d, c, ["seq"], "id", "cam", 300.0, 300.0, 160.0, 120.0, 320, 240).collect()}
    assert got.keys() == want.keys() and any(w[2] > 0 for w in want.values()) and any(w[2] == 0 for w in want.values())
    for i, (n, k, added, ls, op) in want.items():
        assert (got[i].views, got[i].culled) == (n, k) and abs(got[i].added - added) < 1e-9 and np.allclose(got[i].log_scales, ls) and abs(got[i].opacity - op) < 1e-6


def lines_shuffled(spark):
    """Records that all stages so far wrote to shuffles."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_footprints_of_many_views(spark):
    rnd = np.random.default_rng(9)
    cams = [(s, i, rigid((0, 1, 0), rnd.uniform(-0.3, 0.3), (rnd.uniform(-1, 1), rnd.uniform(-1, 1), -rnd.uniform(1, 9)))) for s, n in (("a", 420), ("b", 9)) for i in range(n)]  # more than are worked out at once
    rows = [(s, 61 * i, rnd.uniform(-2, 2, 3), turn(rnd.normal(size=3), 1.0), np.log(rnd.uniform(1e-4, 0.02, 3)), float(rnd.normal())) for s, n in (("a", 300), ("b", 40)) for i in range(n)]  # several packs and chunks
    want, hits = {}, 0
    for s in "ab":
        m = np.array([c[2] for c in cams if c[0] == s])
        for _, i, p, r, ls, op in (r for r in rows if r[0] == s):
            q = np.einsum("cji,cj->ci", m[:, :3, :3], p - m[:, :3, 3])
            t = m[q[:, 2] > 0.01]
            q = q[q[:, 2] > 0.01]
            u, v = np.floor(300 * q[:, 0] / q[:, 2] + 160), np.floor(300 * q[:, 1] / q[:, 2] + 120)
            ok = (u >= 0) & (u < 320) & (v >= 0) & (v < 240)
            t, (x, y, z), o = t[ok], q[ok].T, np.zeros(int(ok.sum()))
            hits += len(o)
            if not len(o):
                continue
            j = np.array([[300 / z, o, -300 * x / z**2], [o, 300 / z, -300 * y / z**2]]).transpose(2, 0, 1) @ t[:, :3, :3].transpose(0, 2, 1)
            c = j @ (r @ np.diag(np.exp(2 * ls)) @ r.T) @ j.transpose(0, 2, 1) + 0.3 * np.eye(2)
            top, gain = np.linalg.eigvalsh(c)[:, 1], (300 / z) ** 2
            need = np.maximum(0, 1.05 - top) / gain
            ratio = np.sqrt(np.linalg.det(c) / np.linalg.det(c + (gain * need)[:, None, None] * np.eye(2)))
            k, culled = (len(o) - 1) // 2, int((top < 1).sum())
            added = np.sort(need)[k] if culled > 0.5 * len(o) else 0.0
            a = np.sort(ratio)[k] / (1 + math.exp(-op))
            want[s, i] = (len(o), culled, added, 0.5 * np.log(np.exp(2 * ls) + added), math.log(a / (1 - a)) if added > 0 else op)
    broken = [("a", 1000 + i, np.where(np.arange(16).reshape(4, 4) == k, v, np.eye(4))) for i, (k, v) in enumerate(((0, np.nan), (11, np.nan), (3, np.inf)))]  # these see nothing
    c = spark.createDataFrame([(s, i, m.ravel().tolist()) for s, i, m in cams + broken], "seq string, cam int, tmat array<double>")
    d = spark.createDataFrame([(s, i, *map(float, p), r.ravel().tolist(), ls.tolist(), op) for s, i, p, r, ls, op in rows], "seq string, id bigint, x double, y double, z double, r array<double>, log_scales array<double>, opacity double")
    before, bound = lines_shuffled(spark), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # joins as large tables have them
    try:
        got = {(r.seq, r.id): r for r in pj.widened_footprints(d, c, ["seq"], "id", "cam", 300.0, 300.0, 160.0, 120.0, 320, 240).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", bound)
    shuffled = lines_shuffled(spark) - before
    assert got.keys() == want.keys() and sum(r.views for r in got.values()) == hits > 20 * (len(rows) + len(cams))
    for k, (n, culled, added, ls, op) in want.items():
        r = got[k]
        assert (r.views, r.culled) == (n, culled) and abs(r.added - added) < 1e-9 and np.allclose(r.log_scales, ls) and abs(r.opacity - op) < 1e-6
    assert shuffled < hits / 10  # no line a view


def test_packed_files(spark, tmp_path):
    n = 300  # two chunks
    ends = [f"{e}_{c}" for c in binary.PACKED_ENDS[:6] for e in ("min", "max")]
    head = "ply\nformat binary_little_endian 1.0\nelement chunk 2\n" + "".join(f"property float {e}\n" for e in ends)
    head += f"element vertex {n}\n" + "".join(f"property uint {w}\n" for w in binary.PACKED_WORDS.values()) + "end_header\n"
    chunk = b"".join(struct.pack("<12f", *(k * 10 + (0.0 if e.startswith("min") else 1.0) for e in ends)) for k in (0, 1))
    body = b"".join(struct.pack("<4I", 2047 << 21, 0, 0xFF000080, 0) for _ in range(n))
    for name in ("a", "b"):
        (tmp_path / f"{name}.compressed.ply").write_bytes(head.encode() + chunk + body)
    got = binary.read_packed_ply(spark, str(tmp_path)).collect()
    assert len(got) == 2 * n and {(r.row < 256, r.x, r.y, r.scale_x, r.r, r.b) for r in got} == {(True, 1.0, 0.0, 0.0, 1.0, 0.0), (False, 11.0, 10.0, 10.0, 1.0, 0.0)}
    with pytest.raises(ValueError):
        binary.ply_elements(b"ply\nformat ascii 1.0\nelement vertex 1\nproperty float x\nend_header\n1\n")


def test_sequence_with_known_truth(spark):
    s = synthetic.sequence(spark, "made", 4.0, imu_offset_us=20_000)
    pose = s["pose_track"].select("seq", "line", regular_grid.micros(F.col("t")).alias("us"), "tmat", *[F.col("tmat")[i].alias(c) for c, i in zip("xyz", (3, 7, 11))])
    frames = s["frame_record"].select("seq", "frame_id", regular_grid.micros(F.col("t")).alias("us"))
    b = asof.interpolate(asof.bracket(frames, pose, "seq", "us", "us", list("xyz"), tie="line"), "us", list("xyz"))
    j = b.join(s["truth"], "frame_id").select(*[F.abs(F.col(f"at_{c}") - F.col("tmat")[i]).alias(c) for c, i in zip("xyz", (3, 7, 11))])
    assert all(max(r) < 1e-4 for r in j.collect()) and j.count() == 81
    gyro = s["imu_track"].select("seq", "line", regular_grid.micros(F.col("t")).alias("us"), *[F.col(f"omega.{c}").alias(f"o{c}") for c in "xyz"])
    ends = sync.track_ends(gyro)
    lag = sync.stream_lag(pose, gyro, ends).first()
    assert lag.lag == -4 and abs(lag.lag_ms + 20) < 2  # late stamps, so the rate has to be moved back
    noisy = synthetic.sequence(spark, "made", 1.0, seed=3, gyro_noise=0.1)["imu_track"]
    assert noisy.select("omega").collect() == noisy.repartition(3).orderBy("line").select("omega").collect()

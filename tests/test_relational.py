import json
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sensorloom.operators import relational as rel
from sensorloom.sources import binary, records, text
from sensorloom.streaming import tracks


def test_rollup_edges(spark):
    rows = [
        ("p/a", "c", "s", 5, "t", "x", "d1", 30.0, 0.9, 0.2), ("p/b", "c", "s", 5, "t", "y", "d1", 40.0, 0.9, 0.1), ("p/c", "c", "s", 5, "t", "z", None, 31.0, 0.9, 0.2),
        ("p/c", "c", "s", 5, "t", "z", None, 31.0, 0.9, 0.2), ("p/d", "c", "s", 5, "t", "w", None, None, 0.9, None), ("p/e", "c", "s", 6, "t", "alone", None, 31.0, 0.9, 0.2),
    ]
    d = spark.createDataFrame(rows, "path string, chain string, seq string, n long, set_name string, tag string, pred_dir string, psnr double, ssim double, lpips double")
    got = [(x.path, x["rank"], x.best, x.group_size) for x in rel.leaderboard(d).orderBy("rank").collect()]
    assert got == [("p/c", 1, True, 3), ("p/a", 2, True, 3), ("p/d", 3, False, 3)]
    assert rel.leaderboard(d.where("false")).count() == 0


def test_statistics(spark):
    rnd = random.Random(1)
    v = [(("a", "b")[i % 2], i, rnd.choice([1.0, 2.0, 2.0, 5.0, None]), rnd.random()) for i in range(200)]
    d = spark.createDataFrame(v, "g string, i int, w double, y double")
    got = {(x.g, x.i) for x in rel.carriers(d, ["g"], "i", "w", 0.8).collect()}
    for g in "ab":
        rows = sorted(((w, i) for q, i, w, _ in v if q == g and w), key=lambda r: (-r[0], r[1]))
        total, run, want = sum(w for w, _ in rows), 0.0, set()
        for w, i in rows:
            if run < 0.8 * total:
                want.add((g, i))
            run += w
        assert {x for x in got if x[0] == g} == want
    rho = {x.g: x.rho for x in rel.spearman(d, ["g"], "w", "y").collect()}
    for g in "ab":
        f = pd.DataFrame([(w, y) for q, _, w, y in v if q == g and w is not None], columns=["w", "y"])
        assert abs(rho[g] - f.rank().corr().iloc[0, 1]) < 1e-9
    one = rel.summary(spark.createDataFrame([("a", float("nan")), ("a", None), ("a", 3.0)], "g string, w double"), ["g"], "w").first()
    assert (one.n, one.median, one["max"]) == (1, 3.0, 3.0)
    b = rel.bootstrap_interval(d, ["g"], "i", "y", 100, 10).collect()
    assert all(x.low < x.mean < x.high for x in b)
    w = rel.only_inside_window(spark.createDataFrame([("s", k, f) for k, fs in enumerate([(0, 1), (2, 3), (2, 2), (0, 9)]) for f in fs], "s string, k int, f long"), ["s"], "k", "f", 3).first()
    assert (w.start, w.samples) == (0, 2)


def test_samples_and_sets(spark):
    d = spark.range(1000).withColumn("w", F.when(F.col("id") < 500, 0.0).otherwise(1.0))
    assert rel.hashed_sample(d, "id", 50).count() == 50 and rel.hashed_sample(d, "id", 5000).count() == 1000
    assert {x.id for x in rel.hashed_sample(d, "id", 50).collect()} == {x.id for x in rel.hashed_sample(d.repartition(7), "id", 50).collect()}
    s = rel.weighted_sample(d, "id", "w", 700)
    assert s.count() == 500 and s.agg(F.min("id")).first()[0] >= 500
    r = rel.rename_collisions(spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "n string, k int"), "n", ["k"])
    assert sorted(x.new_name for x in r.collect()) == ["a", "b", "u1_a"]
    g = rel.accept_gate(spark.createDataFrame([("s", "psnr", 30.0, 29.9), ("s", "lpips", 0.1, 0.101), ("s", "ssim", None, 0.1)], "s string, m string, b double, c double"), "s", "m", "b", "c")
    assert {x.m: x.worse for x in g.collect()} == {"psnr": True, "lpips": False}


def test_text_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_text("# head\n\n1, 2,3 4\n5 6 7\n1 2\n1 2 x\n1d 2 3\n .5 -1e-3 +7 \n")
    r = text.numeric_rows(text.read_lines(spark, str(tmp_path / "a.txt")), 3)
    assert [list(x["values"]) for x in r.orderBy("line_no").collect()] == [[1, 2, 3], [5, 6, 7], [0.5, -0.001, 7]]
    lines = spark.createDataFrame([("f", 0, "20_depth_rgb.png 21_depth_event.png 10_rgb.png"), ("f", 1, "40_depth_rgb.png  30_rgb.png 50_rgb.png"), ("f", 2, "")], "path string, line_no int, value string")
    assert [(x.rgb_name, x.depth_name) for x in text.frame_pairs(lines).orderBy("rn").collect()] == [("10_rgb.png", "20_depth_rgb.png"), ("30_rgb.png", "40_depth_rgb.png")]
    model = ["# c", "1 1 0 0 0 1 2 3 1 a b.png", "", "2 1 0 0 0 4 5 6 1 c.png", "10 20 -1 30 40 5 1 2 3 4 5 6"]
    m = text.model_images(spark.createDataFrame([("m", i, v) for i, v in enumerate(model)], "path string, line_no int, value string"))
    assert [(x.image_id, x.name, x.p["x"]) for x in m.orderBy("image_id").collect()] == [(1, "a b.png", 1.0), (2, "c.png", 4.0)]
    h = spark.createDataFrame([("p", "<script><tr><td>no</td></tr></script><tr><th>A&amp;B</th><td><a class=x href='u'>t</a>\n x</td></tr>"), ("q", None)], "page string, html string")
    assert [list(x.cells) for x in text.html_rows(h, "page", "html").collect()] == [["A&B", "t [u] x"]]


def test_records_and_config(spark, tmp_path):
    tree = {"runs": [{"psnr": 1, "ssim": 2.0, "lpips": 0, "n": 7, "tag": "k_black", "deep": {"psnr": 3, "ssim": 1, "lpips": 1, "psnr_observed": 9.5}}], "flag": {"psnr": True, "ssim": 1, "lpips": 1}}
    d = spark.createDataFrame([("report/a.json", json.dumps(tree)), ("report/b.json", "{bad"), ("report/c.json", None)], "path string, text string")
    r = records.metric_records(d).collect()
    assert sorted((x.psnr, x.n, tuple(x.chain)) for x in r) == [(1.0, 7, ("runs", "0")), (3.0, None, ("runs", "0", "deep"))]
    assert [x.extra for x in r if x.psnr == 3] == [{"psnr_observed": 9.5}]
    (tmp_path / "base.json").write_text(json.dumps({"a": {"x": 1, "l": [1, 2]}, "p": "${ROOT}/{seq}"}))
    (tmp_path / "top.json").write_text(json.dumps({"base": "base.json", "a": {"l": [3]}, "b": True}))
    c = records.load_config(str(tmp_path / "top.json"), "s1", env={"ROOT": "/r"})
    assert c == {"a": {"x": 1, "l": [3]}, "p": "/r/s1", "b": True}
    assert records.load_config(str(tmp_path / "top.json"), env={})["p"] == "${ROOT}/{seq}"
    assert (records.lookup(c, "b"), records.lookup(c, "a.l"), records.lookup(c, "a.no", 5)) == ("1", "3", "5")


def test_binary_sources(spark, tmp_path):
    p = pd.DataFrame({"x": [1.0, 2.0], "y": [3.0, 4.0], "z": [5.0, 6.0]})
    (tmp_path / "c.ply").write_bytes(binary.ply_bytes(p, ["x", "y", "z"]))
    (tmp_path / "t.ply").write_text("ply\nformat ascii 1.0\nelement vertex 1\nproperty float x\nproperty float y\nend_header\n7 8\n")
    got = binary.read_ply(spark, str(tmp_path), ["x", "z"]).collect()
    assert sorted(((x.x, x.z) for x in got), key=lambda r: r[0]) == [(1.0, 5.0), (2.0, 6.0), (7.0, None)]
    assert sorted(x.rows for x in binary.ply_counts(spark, str(tmp_path)).collect()) == [1, 2]
    spark.dataSource.register(binary.PlySource)
    assert spark.read.format("ply").option("columns", "x,y").load(str(tmp_path)).count() == 3
    out = binary.write_ply_parts(spark.createDataFrame(p).repartition(2), str(tmp_path / "w"), ["x", "y", "z"]).agg(F.sum("rows")).first()[0]
    assert out == 2 and binary.read_ply(spark, str(tmp_path / "w"), ["x"]).count() == 2
    pcd = b"VERSION .7\nFIELDS x y z\nSIZE 4 4 4\nTYPE F F F\nCOUNT 1 1 1\nWIDTH 1\nHEIGHT 1\nPOINTS 1\nDATA binary\n" + np.array([1, 2, 3], "<f4").tobytes()
    assert binary.pcd_points(pcd).iloc[0].tolist() == [1, 2, 3]
    with pytest.raises(ValueError):
        binary.pcd_points(pcd.replace(b"DATA binary", b"DATA binary_compressed"))
    raw = np.zeros(3, np.dtype([("x", "<f4"), ("y", "<f4"), ("z", "<f4"), ("i", "<u1")]))
    raw["x"] = [1.0, 100.0, np.nan]
    msg = spark.createDataFrame([(4, bytearray(raw.tobytes()), 13, False, [("x", 0, 7), ("y", 4, 7), ("z", 8, 7)])], "scan long, data binary, point_step int, big_endian boolean, fields array<struct<name:string,offset:int,datatype:int>>")
    assert [(x.scan, x.r) for x in binary.scan_points(msg, 0.5, 50.0).collect()] == [(4, 1.0)]
    # root: child 0 free, child 7 inner; below it child 1 occupied
    import struct

    tree = struct.pack("<HH", 1 | 3 << 14, 2 << 2)
    assert binary.octree_leaves(tree) == [(1, 1, 0, 0, 0), (2, 2, 3, 2, 2)]
    with pytest.raises(ValueError):
        binary.octree_leaves(tree[:2])


def test_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    d = spark.range(0, 40).selectExpr("'a' as source", "timestamp_seconds(1000 + id) as ts", "cast(id as double) as t", "case when id between 10 and 19 then 5.0 else cast(id as double) end as value", "id as line")
    d.unionByName(d.where("line < 5")).repartition(1).write.parquet(src)
    s = spark.readStream.schema(d.schema).parquet(src)

    def run(df, name, mode="append"):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.table(name)

    assert run(tracks.deduplicated(s, ["source", "line"], "ts"), "dedup").count() == 40
    w = run(tracks.windowed_rates(s, "source", "ts", "value", "10 seconds", "1 second"), "windows")
    assert {x.n for x in w.where("start = timestamp'1970-01-01 00:16:50'").collect()} == {10}
    held = run(tracks.held_values(tracks.deduplicated(s, ["source", "line"], "ts"), "source", "t", "value"), "held")
    assert sorted(x.length for x in held.collect()) == [8, 9, 10]


def test_bootstrap_draws_by_spark_hash_from_flat_rows(spark):
    rnd = random.Random(12)
    rows = [(g, i, rnd.gauss(5, 2)) for g, n in (("a", 700), ("b", 95)) for i in range(n)]
    d = spark.createDataFrame(rows, "g string, i bigint, y double")
    b = rel.bootstrap_interval(d, ["g"], "i", "y", 40, 10, 3)
    assert "collect_list" not in b._jdf.queryExecution().optimizedPlan().toString()  # no group's blocks in one value, copied for each resample
    got = {r.g: r for r in b.collect()}
    for g, n in (("a", 70), ("b", 10)):
        blocks = [[y for s, i, y in rows if s == g and i // 10 == k] for k in range(n)]
        at = spark.range(1, n + 1).crossJoin(spark.range(1, 41).withColumnRenamed("id", "r")).selectExpr("int(id) i", "int(r) r", f"pmod(xxhash64(int(id), int(r), 3), {n}) at").collect()
        means = []
        for r in range(1, 41):
            drawn = [blocks[x["at"]] for x in sorted(at, key=lambda x: x.i) if x.r == r]
            means.append(sum(sum(v) for v in drawn) / sum(map(len, drawn)))
        low, high = np.quantile(means, [0.025, 0.975])
        assert abs(got[g].low - low) < 1e-9 and abs(got[g].high - high) < 1e-9

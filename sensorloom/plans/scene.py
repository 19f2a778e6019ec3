"""Spatial, projective and grid queries. Points are pose positions, cameras are posed records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorloom.functions import geometry as geo
from sensorloom.functions import keys
from sensorloom.operators import cameras, descriptors
from sensorloom.operators import projective as pj
from sensorloom.operators import spatial as sp
from sensorloom.plans.base import FRAMES, POSES, VIEWS, frames, poses, views
from sensorloom.session import table

FX = FY = 300.0
CX, CY, W, H = 160.0, 120.0, 320, 240


def _points(spark: SparkSession, d: str) -> DataFrame:
    return poses(spark, d).select("seq", "line", "x", "y", "z").where("abs(x) < 1000 and abs(y) < 1000 and abs(z) < 1000")


def a06_voxel_mean(spark: SparkSession, d: str) -> DataFrame:
    v = sp.voxel_mean(_points(spark, d), ["seq"], 0.25)
    return v.select("seq", "ix", "iy", "iz", "n", *[F.round(c, 4).alias(c) for c in "xyz"])


def a07_voxel_first(spark: SparkSession, d: str) -> DataFrame:
    return sp.voxel_first(_points(spark, d), ["seq"], 0.25, "line").select("seq", "ix", "iy", "iz", "line")


def a08_voxel_attribute(spark: SparkSession, d: str) -> DataFrame:
    p = poses(spark, d).where("abs(x) < 1000 and abs(y) < 1000 and abs(z) < 1000").select("seq", "x", "y", "z", F.col("tmat")[0].alias("intensity"))
    return sp.voxel_mean(p, ["seq"], 0.5, ["intensity"]).select("seq", "ix", "iy", "iz", "n", F.round("intensity", 5).alias("intensity"))


def a09_voxel_bound(spark: SparkSession, d: str) -> DataFrame:
    return sp.voxel_mean_from_bound(_points(spark, d), ["seq"], 0.3).groupBy("seq").agg(F.count("*").alias("voxels"), F.sum("n").alias("points"), F.max("n").alias("fullest"))


def _scanned(spark: SparkSession, d: str) -> DataFrame:
    """Cells with the scan (200 lines) that saw them."""
    p = sp.with_cells(_points(spark, d), 0.5)
    return p.withColumn("scan", keys.cell(F.col("line"), 200))


def a10_scan_votes(spark: SparkSession, d: str) -> DataFrame:
    return sp.votes(_scanned(spark, d), ["seq", "ix", "iy", "iz"], "scan").where("votes >= 2")


def a11_occupancy(spark: SparkSession, d: str) -> DataFrame:
    g = sp.with_cells(_points(spark, d), 0.5).groupBy("seq", "ix", "iy").agg(F.count("*").alias("n"))
    box = (F.max("ix") - F.min("ix") + 1) * (F.max("iy") - F.min("iy") + 1)
    return g.groupBy("seq").agg(F.count("*").alias("occupied"), F.count_if(F.col("n") > 2).alias("solid"), F.round(F.count("*") / box, 6).alias("bbox_fraction"))


def a12_group_median(spark: SparkSession, d: str) -> DataFrame:
    g = sp.with_cells(_points(spark, d), 1.0).groupBy("seq", "ix", "iy")
    return g.agg(F.count("*").alias("n"), F.round(F.median("z"), 6).alias("height"))


def a13_lower_median(spark: SparkSession, d: str) -> DataFrame:
    g = sp.with_cells(_points(spark, d), 1.0).groupBy("seq", "ix", "iy").agg(F.count("*").alias("n"), F.expr("percentile_disc(0.5) within group (order by z)").alias("low"))
    return g.select("seq", "ix", "iy", F.when(F.col("n") >= 5, F.col("low")).alias("height"))


def a32_argbest(spark: SparkSession, d: str) -> DataFrame:
    c = sp.with_cells(_points(spark, d), 1.0)
    return c.groupBy("seq", "ix", "iy").agg(F.min_by("line", F.struct((-F.col("z")).alias("z"), "line")).alias("highest_line"))


def a34_persistence(spark: SparkSession, d: str) -> DataFrame:
    """Share of a cell's readings taken while turned away, where it was seen at least five times."""
    p = sp.with_cells(poses(spark, d).where("abs(x) < 1000 and abs(y) < 1000 and abs(z) < 1000"), 0.5)
    g = p.groupBy("seq", "ix", "iy", "iz").agg(F.count("*").alias("seen"), F.count_if(F.col("tmat")[0] < 0).alias("masked"))
    return g.where((F.col("seen") >= 5) & (F.col("masked") > 0.5 * F.col("seen")))


def a35_bin_coverage(spark: SparkSession, d: str) -> DataFrame:
    c = _points(spark, d)
    m = c.groupBy("seq").agg(F.median("x").alias("mx"), F.median("y").alias("my"))
    j = c.join(m, "seq").select("seq", geo.azimuth_bin(F.col("x") - F.col("mx"), F.col("y") - F.col("my"), 10.0).alias("bin"))
    return j.groupBy("seq").agg(F.round(F.count_distinct("bin") / 36, 6).alias("coverage"))


def a36_hist_peaks(spark: SparkSession, d: str) -> DataFrame:
    """Peaks of the elevation histogram, 0.1 degree bins of the view direction."""
    from pyspark.sql.window import Window

    m = F.col("tmat")
    e = F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), m[8]))))
    h = poses(spark, d).select("seq", F.floor(F.round(e, 6) * 10).cast("bigint").alias("bin")).groupBy("seq", "bin").agg(F.count("*").alias("n"))
    w = Window.partitionBy("seq").orderBy("bin")  # at most 1801 bins
    h = h.select("*", F.max("n").over(Window.partitionBy("seq")).alias("top"), F.lag("n").over(w).alias("p"), F.lag("bin").over(w).alias("pb"), F.lead("n").over(w).alias("q"), F.lead("bin").over(w).alias("qb"))
    left = F.when(F.col("pb") == F.col("bin") - 1, F.col("p")).otherwise(0)
    right = F.when(F.col("qb") == F.col("bin") + 1, F.col("q")).otherwise(0)
    return h.where((F.col("n") > 0.05 * F.col("top")) & (F.col("n") >= left) & (F.col("n") >= right)).select("seq", "bin", "n")


def a40_outliers(spark: SparkSession, d: str) -> DataFrame:
    p = _points(spark, d)
    o = sp.outliers(p, ["seq"], 8, 0.25, "line", 2.0)
    return o.select("seq", "line", F.round("mean_distance", 5).alias("mean_distance"), "kept")


def a54_height_map(spark: SparkSession, d: str) -> DataFrame:
    return sp.with_cells(_points(spark, d), 0.3).groupBy("seq", "ix", "iy").agg(F.max("z").alias("top"))


def a42_morphology(spark: SparkSession, d: str) -> DataFrame:
    c = sp.with_cells(_points(spark, d), 0.5).select("seq", "ix", "iy").distinct()
    ops = [("dilate", sp.dilate), ("erode", sp.erode), ("close", sp.close), ("open", sp.open_)]
    out = None
    for n, f in ops:
        r = f(c, ["seq"]).groupBy("seq").agg(F.count("*").alias("cells")).select("seq", F.lit(n).alias("op"), "cells")
        out = r if out is None else out.unionByName(r)
    return out


def a41_components(spark: SparkSession, d: str) -> DataFrame:
    c = sp.components(sp.with_cells(_points(spark, d), 0.5), ["seq"])
    return c.groupBy("seq", F.col("component.ix").alias("ix"), F.col("component.iy").alias("iy")).agg(F.count("*").alias("cells"))


def j13_nn1(spark: SparkSession, d: str) -> DataFrame:
    p = _points(spark, d)
    nn = sp.nearest_neighbours(p.where("line % 20 = 0"), p, ["seq"], 1, 0.1, "line", "line", apart=True)
    return nn.select("seq", "line", "near_line", F.round("distance", 6).alias("distance"))


def j14_knn(spark: SparkSession, d: str) -> DataFrame:
    p = _points(spark, d)
    return sp.nearest_neighbours(p.where("line % 20 = 0"), p, ["seq"], 8, 0.2, "line", "line", apart=True).select("seq", "line", "near_line", "rank")


def j15_bounded_nn(spark: SparkSession, d: str) -> DataFrame:
    p = _points(spark, d)
    q = p.where("line % 20 = 0")
    r = sp.radius_join(q, p, ["seq"], 0.05, "line", "line", apart=True)
    b = r.groupBy("seq", "line").agg(F.min(F.struct("distance", "near_line")).alias("b"))
    return q.join(b, ["seq", "line"], "left").select("seq", "line", F.col("b.near_line").alias("near_line"))


def j16_radius(spark: SparkSession, d: str) -> DataFrame:
    p = _points(spark, d)
    r = sp.radius_join(p.where("line % 20 = 0"), p, ["seq"], 0.3, "line", "line")
    return r.groupBy("seq", "line").agg(F.count("*").alias("hits"), F.round(F.avg("distance"), 5).alias("mean_distance"))


def j17_guard(spark: SparkSession, d: str) -> DataFrame:
    """Train views at least 0.5 m from every validation view of their recording."""
    v = views(spark, d).where("split is not null").select("rec_id", "seq", "split", *[F.col("tmat")[i].alias(c) for c, i in zip("xyz", (3, 7, 11))])
    near = sp.radius_join(v.where("split = 'train'"), v.where("split = 'val'").withColumnRenamed("rec_id", "val_id"), ["seq"], 0.5, "rec_id", "val_id")
    return v.where("split = 'train'").join(near.select("rec_id").distinct(), "rec_id", "left_anti").select("rec_id")


def _cameras(spark: SparkSession, d: str) -> DataFrame:
    looking = F.array(*[F.lit(float(v)) for v in (0, 0, 1, 0, -1, 0, 0, 0, 0, -1, 0, 0, 0, 0, 0, 1)])  # camera in the body: z forward, y down
    return views(spark, d).select("seq", "rec_id", geo.compose(F.col("tmat"), looking).alias("tmat"))


def _seen(spark: SparkSession, d: str, reduce, out: str) -> DataFrame:
    """Points in every camera of their recording, reduced camera by camera."""
    camera = cameras.Camera(FX, FY, CX, CY, W, H, 0.1)
    return cameras.per_camera(_points(spark, d), _cameras(spark, d), ["seq"], "line", "rec_id", camera, reduce, out)


def j18_visibility_any(spark: SparkSession, d: str) -> DataFrame:
    j = _seen(spark, d, cameras.visible(), "surface boolean, open boolean, fill boolean")
    return j.groupBy("seq", "line").agg(*[F.bool_or(r).alias(r) for r in ("surface", "open", "fill")])


def j19_view_counts(spark: SparkSession, d: str) -> DataFrame:
    h = _seen(spark, d, cameras.view_counts(5.0), "any_views bigint, good_views bigint")
    return h.groupBy("seq", "line").agg(*[F.sum(c).alias(c) for c in ("any_views", "good_views")])


def a14_zbuffer(spark: SparkSession, d: str) -> DataFrame:
    z = _seen(spark, d, cameras.z_buffer(2), "u int, v int, z double, hits bigint")
    return z.select("rec_id", "u", "v", F.round("z", 5).alias("z"), "hits")


def a15_nearest_payload(spark: SparkSession, d: str) -> DataFrame:
    return _seen(spark, d, cameras.nearest_row("line"), "u int, v int, line bigint").select("rec_id", "u", "v", "line")


def a17_surface_depth(spark: SparkSession, d: str) -> DataFrame:
    s = _seen(spark, d, cameras.surface_depth(0.5, 0.05), "u int, v int, depth double, hits bigint")
    return s.select("rec_id", "u", "v", F.round("depth", 5).alias("depth"), "hits")


def f17_support(spark: SparkSession, d: str) -> DataFrame:
    return _seen(spark, d, cameras.supported(0.5, 0.05), "pixels bigint").select("rec_id", "pixels")


REACH = 12.0  # metres that a scanner sees


def _scans(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Scans: points of one 400-line block in the frame of its first pose; the cloud in the frames of the scans it may be seen from."""
    p = poses(spark, d).where("abs(x) < 1000 and abs(y) < 1000 and abs(z) < 1000").withColumn("scan_no", keys.cell(F.col("line"), 400))
    base = p.groupBy("seq", "scan_no").agg(F.min_by("tmat", "line").alias("tmat"))
    own = p.drop("tmat").join(base.select("seq", "scan_no", F.col("tmat").alias("_sensor")), ["seq", "scan_no"])
    cloud = pj.scans_near(p.select("seq", "line", "x", "y", "z"), base, ["seq"], REACH)

    def local(df: DataFrame) -> DataFrame:
        q = geo.apply_inverse(F.col("_sensor"), geo.point(F.col("x"), F.col("y"), F.col("z")))
        q = df.withColumn("q", q).select(F.struct("seq", "scan_no").alias("scan"), F.struct("seq", "line").alias("pid"), *[F.col(f"q.{c}").alias(c) for c in "xyz"])
        return q.withColumn("r", F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2)).where(F.col("r") < REACH)

    return local(own), local(cloud)


def _ring(degrees: float):
    """Number of the elevation ring from the bottom, 0 .. 180/degrees - 1."""
    e = geo.elevation_degrees(geo.point(F.col("x"), F.col("y"), F.col("z")))
    return F.least(F.floor((e + 90) / degrees), F.lit(round(180 / degrees) - 1)).cast("int")


def j20_vote_join(spark: SparkSession, d: str) -> DataFrame:
    own, cloud = _scans(spark, d)
    image = pj.range_image(own.where("r > 0.3"), "scan", 4.0, _ring(10))
    seen = cloud.where("r > 0.3").select("scan", "pid", _ring(10).alias("ring"), geo.azimuth_bin(F.col("x"), F.col("y"), 4.0).alias("az"), "r")
    return pj.see_through_votes(seen, image, "scan", "pid").select("pid.seq", "pid.line", "free", "hit", "dynamic")


def j21_carve(spark: SparkSession, d: str) -> DataFrame:
    """Scans that see through a reading: farthest returns, in coarse bins (60 by 45 degrees) so that paths fill whole neighbourhoods."""
    own, cloud = _scans(spark, d)
    image = pj.range_image(own.where("r > 0"), "scan", 45.0, _ring(60), True)
    seen = cloud.where("r > 0.5").select("scan", "pid", _ring(60).alias("ring"), geo.azimuth_bin(F.col("x"), F.col("y"), 45.0).alias("az"), "r")
    return pj.free_votes(seen, pj.clear_image(image, "scan", 3, 8), "scan", "pid").select("pid.seq", "pid.line", "free")


def j23_multires_member(spark: SparkSession, d: str) -> DataFrame:
    """Readings in space that the views have occupied: coarse leaves that at least three views share, fine ones for the rest."""
    p = _points(spark, d)
    v = views(spark, d).select("seq", *[F.col("tmat")[i].alias(c) for c, i in zip("xyz", (3, 7, 11))])
    c = sp.with_cells(v, 0.25).where("ix is not null and iy is not null and iz is not null")
    coarse = c.groupBy("seq", *[F.shiftright(f"i{a}", 2).alias(f"k{a}") for a in "xyz"]).agg(F.count("*").alias("n")).where("n >= 3").select("seq", F.lit(6).alias("depth"), "kx", "ky", "kz")
    fine = c.select("seq", F.lit(8).alias("depth"), *[F.col(f"i{a}").alias(f"k{a}") for a in "xyz"]).distinct()
    k = sp.member_of_levels(p, coarse.unionByName(fine), ["seq"], 0.25, [6, 8], 8)
    return k.groupBy("seq", "known").agg(F.count("*").alias("n"))


def j24_grid_lookup(spark: SparkSession, d: str) -> DataFrame:
    p = sp.with_cells(_points(spark, d), 0.5)
    solid = p.groupBy("seq", "ix", "iy").agg(F.count("*").alias("n")).where("n > 10").select("seq", F.col("ix").alias("gx"), F.col("iy").alias("gy"), F.lit(True).alias("solid"))
    v = views(spark, d).select("rec_id", "seq", keys.cell(F.col("tmat")[3], 0.5).alias("gx"), keys.cell(F.col("tmat")[7], 0.5).alias("gy"))
    return v.join(solid, ["seq", "gx", "gy"], "left").select("rec_id", F.coalesce("solid", F.lit(False)).alias("solid"))


def j26_theta_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of views 0.3 to 1.5 m apart that look the same way, within the split and across."""
    v = views(spark, d).where("split is not null").select("seq", "rec_id", "split", "tmat", *[F.col("tmat")[i].alias(c) for c, i in zip("xyz", (3, 7, 11))])
    r = sp.radius_join(v.where("rec_id % 20 = 0"), v, ["seq"], 1.5, "rec_id", "rec_id", apart=True).where("distance > 0.3")
    a = v.select("rec_id", F.col("split").alias("s1"), F.col("tmat").alias("m1"))
    b = v.select(F.col("rec_id").alias("near_rec_id"), F.col("split").alias("s2"), F.col("tmat").alias("m2"))
    j = r.join(a, "rec_id").join(b, "near_rec_id")
    cos = F.col("m1")[2] * F.col("m2")[2] + F.col("m1")[6] * F.col("m2")[6] + F.col("m1")[10] * F.col("m2")[10]
    return j.where(cos > 0.8).groupBy("seq", (F.col("s1") == F.col("s2")).alias("within")).agg(F.count("*").alias("pairs"))


def j27_neighbour_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Unordered pairs of each queried view with its four nearest that are turned by at most 60 degrees."""
    v = views(spark, d).select("seq", "rec_id", "tmat", *[F.col("tmat")[i].alias(c) for c, i in zip("xyz", (3, 7, 11))])
    nn = sp.nearest_neighbours(v.where("rec_id % 20 = 0"), v, ["seq"], 4, 0.5, "rec_id", "rec_id", apart=True)
    j = nn.join(v.select("rec_id", F.col("tmat").alias("m1")), "rec_id").join(v.select(F.col("rec_id").alias("near_rec_id"), F.col("tmat").alias("m2")), "near_rec_id")
    near = j.where(geo.turn_degrees(geo.rotation(F.col("m1")), geo.rotation(F.col("m2"))) <= 60)
    return near.select(F.least("rec_id", "near_rec_id").alias("a"), F.greatest("rec_id", "near_rec_id").alias("b")).distinct()


def j28_ratio_test(spark: SparkSession, d: str) -> DataFrame:
    """Descriptors whose nearest of the other label is closer than 0.9 of the second; queries are ids divisible by 20, held against all in blocks."""
    e = table(spark, d, "embeddings").where("vec_id is not null and embedding is not null")
    m = descriptors.two_nearest(e.where("vec_id % 20 = 0"), e, "vec_id", "embedding", other=("label",))
    return m.where(F.col("first") < 0.98 * F.col("second")).select("q_id", "vec_id")


def j30_iou(spark: SparkSession, d: str) -> DataFrame:
    """Overlap of the ground covered in each minute with the ground covered in each other one of the recording."""
    p = sp.with_cells(poses(spark, d).where("abs(x) < 1000 and abs(y) < 1000 and abs(z) < 1000"), 0.5)
    p = p.withColumn("part", F.floor(F.col("line") / 300))
    i = sp.cell_iou(p.withColumnRenamed("part", "a"), p.withColumnRenamed("part", "b"), ["seq"], "a", "b")
    return i.where("a < b").select("seq", "a", "b", F.round("iou", 6).alias("iou"))


def w13_ray_expand(spark: SparkSession, d: str) -> DataFrame:
    """Samples of the rays from the recording's first position, and the voxels they pass, each once a scan."""
    p = _points(spark, d)
    o = p.groupBy("seq").agg(F.min_by(F.struct("x", "y", "z"), "line").alias("o"))
    j = p.join(o, "seq").withColumn("r", geo.distance(F.struct("x", "y", "z"), F.col("o")))
    s = pj.ray_samples(j.where("r > 0"), 0.375)
    at = [(F.col(f"o.{c}") + (F.col(c) - F.col(f"o.{c}")) * F.col("s") / F.col("r")).alias(f"s{c}") for c in "xyz"]
    v = sp.with_cells(s.select("seq", F.floor(F.col("line") / 200).alias("scan"), *at), 0.5, ["sx", "sy", "sz"])
    return sp.votes(v, ["seq", "ix", "iy", "iz"], "scan").where("votes >= 3").groupBy("seq").agg(F.count("*").alias("free"), F.sum("votes").alias("votes"))


def w12_composite(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "lineitem").where("l_discount < 1").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_quantity", "l_tax", (F.col("l_discount") * 0.7310585786).alias("alpha"))
    w = pj.composite(c, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_quantity", "l_tax", "alpha"])
    return w.groupBy("l_orderkey").agg(F.round(F.sum("weight"), 9).alias("opacity"), F.round(F.max("weight"), 9).alias("heaviest"))


def a26_max_weight_views(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "lineitem").select("l_partkey", "l_suppkey", F.col("l_discount").alias("w"))
    per = c.groupBy("l_partkey", "l_suppkey").agg(F.max("w").alias("m"), F.sum("w").alias("s"))
    return per.groupBy("l_partkey").agg(F.max("m").alias("max_weight"), F.round(F.sum("s"), 4).alias("sum_weight"), F.count_if(F.col("m") > 0.05).alias("views"))


def x_keys(spark: SparkSession, d: str) -> DataFrame:
    p = sp.with_cells(_points(spark, d), 0.25)
    low = p.groupBy("seq").agg(*[F.min(f"i{c}").alias(f"m{c}") for c in "xyz"])
    j = p.join(low, "seq")
    m = keys.morton(*[(F.col(f"i{c}") - F.col(f"m{c}")).bitwiseAND(1023) for c in "xyz"])
    return j.select("seq", "line", keys.voxel_key(F.col("x"), F.col("y"), F.col("z"), 0.25).alias("voxel"), m.alias("morton"), geo.azimuth_bin(F.col("x"), F.col("y"), 0.5).alias("azimuth"))


def x_turns(spark: SparkSession, d: str) -> DataFrame:
    """Turn and shift of each view from its recording's first, and its position seen from there."""
    v = views(spark, d).where("size(filter(slice(tmat, 1, 12), v -> v is null or isnan(v))) = 0")
    f = v.groupBy("seq").agg(F.min_by("tmat", "rec_id").alias("m0"))
    j = v.join(f, "seq")
    p = geo.apply_inverse(F.col("m0"), geo.position(F.col("tmat")))
    rel = geo.compose(geo.inverse(F.col("m0")), F.col("tmat"))
    return j.select("rec_id", F.round(geo.turn_degrees(geo.rotation(F.col("tmat")), geo.rotation(F.col("m0"))), 3).alias("turn"), (F.round(p["x"], 4) + 0.0).alias("x"), (F.round(rel[3], 4) + 0.0).alias("rel_x"))


_PTS = f"{POSES}, pts AS (SELECT seq, line, tmat, x, y, z FROM poses WHERE abs(x) < 1000 AND abs(y) < 1000 AND abs(z) < 1000)"


def _cell(size: float, axes: str = "xyz", extra: str = "*") -> str:
    return f"SELECT {extra}, {', '.join(f'CAST(floor({c} / {size}::DOUBLE) AS BIGINT) AS i{c}' for c in axes)} FROM pts"


_CAMS = f"{_PTS}, {VIEWS}, cams AS (SELECT rec_id, seq, tmat AS m FROM views)"
_PROJ = f"""{_CAMS}, body AS (SELECT p.seq, p.line, c.rec_id, {', '.join(f'm[{i + 1}] * (x - m[4]) + m[{i + 5}] * (y - m[8]) + m[{i + 9}] * (z - m[12]) AS r{c}' for i, c in enumerate('xyz'))} FROM pts p JOIN cams c ON p.seq = c.seq),
  loc AS (SELECT seq, line, rec_id, -1 * ry AS qx, -1 * rz AS qy, rx AS qz FROM body),
  hits AS (SELECT * FROM (SELECT seq, line, rec_id, qz AS z, sqrt(pow(qx, 2) + pow(qy, 2) + pow(qz, 2)) AS rng, CAST(floor({FX}::DOUBLE * qx / qz + {CX}::DOUBLE) AS BIGINT) AS u, CAST(floor({FY}::DOUBLE * qy / qz + {CY}::DOUBLE) AS BIGINT) AS v FROM loc WHERE qz > 0.1)
    WHERE u BETWEEN 0 AND {W - 1} AND v BETWEEN 0 AND {H - 1})"""
_DIST = "sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2))"
_ANSWER = f"{_PTS}, near AS (SELECT a.seq, a.line, b.line AS near_line, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) AS d2 FROM pts a JOIN pts b ON a.seq = b.seq AND a.line % 20 = 0)"
_VPOS = f"{VIEWS}, v AS (SELECT rec_id, seq, split, tmat, tmat[4] AS x, tmat[8] AS y, tmat[12] AS z FROM views)"

QUERIES = {
    f.__name__: f
    for f in (
        a06_voxel_mean, a07_voxel_first, a08_voxel_attribute, a09_voxel_bound, a10_scan_votes, a11_occupancy, a12_group_median, a13_lower_median, a14_zbuffer, a15_nearest_payload, a17_surface_depth,
        a26_max_weight_views, a32_argbest, a34_persistence, a35_bin_coverage, a36_hist_peaks, a40_outliers, a41_components, a42_morphology, a54_height_map, f17_support,
        j13_nn1, j14_knn, j15_bounded_nn, j16_radius, j17_guard, j18_visibility_any, j19_view_counts, j20_vote_join, j21_carve, j23_multires_member, j24_grid_lookup, j26_theta_pairs, j27_neighbour_pairs, j28_ratio_test, j30_iou,
        w12_composite, w13_ray_expand, x_keys, x_turns,
    )
}


_CROSS = "(VALUES (0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)) o(dx, dy)"
_MORPH = f"""{_PTS}, c AS (SELECT DISTINCT seq, ix, iy FROM ({_cell(0.5)})),
  di AS (SELECT DISTINCT seq, ix + dx AS ix, iy + dy AS iy FROM c CROSS JOIN {_CROSS}),
  er AS (SELECT seq, ix + dx AS ix, iy + dy AS iy FROM c CROSS JOIN {_CROSS} GROUP BY ALL HAVING count(*) = 5),
  cl AS (SELECT seq, ix + dx AS ix, iy + dy AS iy FROM di CROSS JOIN {_CROSS} GROUP BY ALL HAVING count(*) = 5),
  op AS (SELECT DISTINCT seq, ix + dx AS ix, iy + dy AS iy FROM er CROSS JOIN {_CROSS})"""

ORACLE = {
    "a06_voxel_mean": f"WITH {_PTS} SELECT seq, ix, iy, iz, count(*) AS n, round(avg(x), 4) AS x, round(avg(y), 4) AS y, round(avg(z), 4) AS z FROM ({_cell(0.25)}) GROUP BY ALL",
    "a07_voxel_first": f"WITH {_PTS} SELECT seq, ix, iy, iz, min(line) AS line FROM ({_cell(0.25)}) GROUP BY ALL",
    "a08_voxel_attribute": f"WITH {_PTS} SELECT seq, ix, iy, iz, count(*) AS n, round(avg(tmat[1]), 5) AS intensity FROM ({_cell(0.5)}) GROUP BY ALL",
    "a09_voxel_bound": f"""WITH {_PTS}, b AS (SELECT seq, {', '.join(f'min({c}) - 0.15::DOUBLE AS l{c}' for c in 'xyz')} FROM pts GROUP BY seq),
        v AS (SELECT seq, {', '.join(f'floor(({c} - l{c}) / 0.3::DOUBLE) AS i{c}' for c in 'xyz')}, count(*) AS n FROM pts JOIN b USING (seq) GROUP BY ALL) SELECT seq, count(*) AS voxels, CAST(sum(n) AS BIGINT) AS points, max(n) AS fullest FROM v GROUP BY seq""",
    "a10_scan_votes": f"WITH {_PTS} SELECT seq, ix, iy, iz, count(DISTINCT line // 200) AS votes FROM ({_cell(0.5)}) GROUP BY ALL HAVING votes >= 2",
    "a11_occupancy": f"WITH {_PTS}, g AS (SELECT seq, ix, iy, count(*) AS n FROM ({_cell(0.5)}) GROUP BY ALL) SELECT seq, count(*) AS occupied, count(*) FILTER (WHERE n > 2) AS solid, round(count(*) / ((max(ix) - min(ix) + 1) * (max(iy) - min(iy) + 1)), 6) AS bbox_fraction FROM g GROUP BY seq",
    "a12_group_median": f"WITH {_PTS} SELECT seq, ix, iy, count(*) AS n, round(median(z), 6) AS height FROM ({_cell(1.0)}) GROUP BY ALL",
    "a13_lower_median": f"WITH {_PTS} SELECT seq, ix, iy, CASE WHEN count(*) >= 5 THEN quantile_disc(z, 0.5) END AS height FROM ({_cell(1.0)}) GROUP BY ALL",
    "a14_zbuffer": f"WITH {_PROJ} SELECT rec_id, CAST(u AS INTEGER) AS u, CAST(v AS INTEGER) AS v, round(min(z), 5) AS z, count(*) AS hits FROM hits GROUP BY ALL HAVING count(*) >= 2",
    "a15_nearest_payload": f"WITH {_PROJ} SELECT rec_id, CAST(u AS INTEGER) AS u, CAST(v AS INTEGER) AS v, line FROM hits QUALIFY row_number() OVER (PARTITION BY rec_id, u, v ORDER BY z, line) = 1",
    "a26_max_weight_views": "WITH p AS (SELECT l_partkey, l_suppkey, max(l_discount) AS m, sum(l_discount) AS s FROM lineitem GROUP BY ALL) SELECT l_partkey, max(m) AS max_weight, round(sum(s), 4) AS sum_weight, count(*) FILTER (WHERE m > 0.05) AS views FROM p GROUP BY ALL",
    "a32_argbest": f"WITH {_PTS} SELECT seq, ix, iy, line AS highest_line FROM ({_cell(1.0)}) QUALIFY row_number() OVER (PARTITION BY seq, ix, iy ORDER BY z DESC, line) = 1",
    "a34_persistence": f"WITH {_PTS} SELECT seq, ix, iy, iz, count(*) AS seen, count(*) FILTER (WHERE tmat[1] < 0) AS masked FROM ({_cell(0.5)}) GROUP BY ALL HAVING seen >= 5 AND masked > 0.5 * seen",
    "a35_bin_coverage": f"WITH {_PTS}, m AS (SELECT seq, median(x) AS mx, median(y) AS my FROM pts GROUP BY seq) SELECT seq, round(count(DISTINCT floor(((degrees(atan2(y - my, x - mx)) + 360) % 360) / 10) % 36) / 36, 6) AS coverage FROM pts JOIN m USING (seq) GROUP BY seq",
    "a36_hist_peaks": f"""WITH {POSES}, h AS (SELECT seq, CAST(floor(round(degrees(asin(greatest(-1.0, least(1.0, tmat[9])))), 6) * 10) AS BIGINT) AS bin, count(*) AS n FROM poses GROUP BY ALL),
        t AS (SELECT h.*, max(n) OVER (PARTITION BY seq) AS top FROM h)
        SELECT t.seq, t.bin, t.n FROM t LEFT JOIN h a ON a.seq = t.seq AND a.bin = t.bin - 1 LEFT JOIN h b ON b.seq = t.seq AND b.bin = t.bin + 1 WHERE t.n > 0.05 * top AND t.n >= coalesce(a.n, 0) AND t.n >= coalesce(b.n, 0)""",
    "a40_outliers": f"""WITH {_PTS}, near AS (SELECT a.seq, a.line, b.line AS near_line, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) AS d2 FROM pts a JOIN pts b ON a.seq = b.seq AND a.line <> b.line),
        k AS (SELECT seq, line, sqrt(d2) AS d FROM near QUALIFY row_number() OVER (PARTITION BY seq, line ORDER BY d2, near_line) <= 8), m AS (SELECT seq, line, avg(d) AS md FROM k GROUP BY ALL)
        SELECT seq, line, round(md, 5) AS mean_distance, md <= avg(md) OVER (PARTITION BY seq) + 2.0::DOUBLE * stddev_pop(md) OVER (PARTITION BY seq) AS kept FROM m""",
    "a42_morphology": f"WITH {_MORPH} SELECT seq, 'dilate' AS op, count(*) AS cells FROM di GROUP BY seq UNION ALL SELECT seq, 'erode', count(*) FROM er GROUP BY seq UNION ALL SELECT seq, 'close', count(*) FROM cl GROUP BY seq UNION ALL SELECT seq, 'open', count(*) FROM op GROUP BY seq",
    "a54_height_map": f"WITH {_PTS} SELECT seq, ix, iy, max(z) AS top FROM ({_cell(0.3)}) GROUP BY ALL",
    "j13_nn1": f"WITH {_ANSWER} SELECT seq, line, near_line, round(sqrt(d2), 6) AS distance FROM near WHERE near_line <> line QUALIFY row_number() OVER (PARTITION BY seq, line ORDER BY d2, near_line) = 1",
    "j14_knn": f"WITH {_ANSWER} SELECT seq, line, near_line, CAST(row_number() OVER (PARTITION BY seq, line ORDER BY d2, near_line) AS INTEGER) AS rank FROM near WHERE near_line <> line QUALIFY rank <= 8",
    "j15_bounded_nn": f"WITH {_ANSWER} SELECT a.seq, a.line, (SELECT arg_min(near_line, {{'d': d2, 'l': near_line}}) FROM near n WHERE n.seq = a.seq AND n.line = a.line AND n.near_line <> n.line AND d2 <= 0.0025::DOUBLE) AS near_line FROM pts a WHERE line % 20 = 0",
    "j16_radius": f"WITH {_ANSWER} SELECT seq, line, count(*) AS hits, round(avg(sqrt(d2)), 5) AS mean_distance FROM near WHERE d2 <= 0.3::DOUBLE * 0.3::DOUBLE GROUP BY ALL",
    "j17_guard": f"WITH {_VPOS} SELECT a.rec_id FROM v a WHERE a.split = 'train' AND NOT EXISTS (SELECT 1 FROM v b WHERE b.seq = a.seq AND b.split = 'val' AND {_DIST} <= 0.5)",
    "j18_visibility_any": f"""WITH {_PROJ}, zb AS (SELECT rec_id, u, v, min(z) AS depth FROM hits GROUP BY ALL), j AS (SELECT h.*, depth FROM hits h JOIN zb USING (rec_id, u, v))
        SELECT seq, line, bool_or(depth > 0 AND abs(z - depth) < 0.05::DOUBLE * depth) AS surface, bool_or(depth <= 0 OR z <= depth * 1.05::DOUBLE) AS open, bool_or(depth <= 0 OR z < depth * 1.05::DOUBLE OR z < depth + 0.15::DOUBLE) AS fill FROM j GROUP BY ALL""",
    "j19_view_counts": f"WITH {_PROJ} SELECT seq, line, count(*) AS any_views, count(*) FILTER (WHERE rng < 5) AS good_views FROM hits GROUP BY ALL",
    "j23_multires_member": f"""WITH {_PTS}, {VIEWS}, c AS ({_cell(0.25)}), v AS (SELECT seq, {', '.join(f'CAST(floor(tmat[{i}] / 0.25::DOUBLE) AS BIGINT) AS v{c}' for c, i in zip('xyz', (4, 8, 12)))} FROM views WHERE tmat[4] IS NOT NULL AND tmat[8] IS NOT NULL AND tmat[12] IS NOT NULL AND NOT isnan(tmat[4]) AND NOT isnan(tmat[8]) AND NOT isnan(tmat[12])),
        big AS (SELECT seq, vx >> 2 AS kx, vy >> 2 AS ky, vz >> 2 AS kz FROM v GROUP BY ALL HAVING count(*) >= 3)
        SELECT seq, EXISTS (SELECT 1 FROM big b WHERE b.seq = c.seq AND b.kx = c.ix >> 2 AND b.ky = c.iy >> 2 AND b.kz = c.iz >> 2) OR EXISTS (SELECT 1 FROM v f WHERE f.seq = c.seq AND f.vx = c.ix AND f.vy = c.iy AND f.vz = c.iz) AS known, count(*) AS n FROM c GROUP BY ALL""",
    "j24_grid_lookup": f"WITH {_PTS}, {VIEWS}, s AS (SELECT seq, ix, iy FROM ({_cell(0.5)}) GROUP BY ALL HAVING count(*) > 10) SELECT rec_id, s.ix IS NOT NULL AS solid FROM views v LEFT JOIN s ON s.seq = v.seq AND s.ix = CAST(floor(tmat[4] / 0.5::DOUBLE) AS BIGINT) AND s.iy = CAST(floor(tmat[8] / 0.5::DOUBLE) AS BIGINT)",
    "j26_theta_pairs": f"WITH {_VPOS} SELECT a.seq, a.split = b.split AS within, count(*) AS pairs FROM v a JOIN v b ON a.seq = b.seq AND a.rec_id <> b.rec_id AND a.rec_id % 20 = 0 WHERE a.split IS NOT NULL AND b.split IS NOT NULL AND {_DIST} <= 1.5 AND {_DIST} > 0.3 AND a.tmat[3] * b.tmat[3] + a.tmat[7] * b.tmat[7] + a.tmat[11] * b.tmat[11] > 0.8 GROUP BY ALL",
    "j27_neighbour_pairs": f"""WITH {_VPOS}, n AS (SELECT a.rec_id AS p, b.rec_id AS q, a.tmat AS m, b.tmat AS o FROM v a JOIN v b ON a.seq = b.seq AND a.rec_id <> b.rec_id AND a.rec_id % 20 = 0 QUALIFY row_number() OVER (PARTITION BY a.rec_id ORDER BY (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z), b.rec_id) <= 4)
        SELECT DISTINCT least(p, q) AS a, greatest(p, q) AS b FROM n WHERE degrees(acos(greatest(-1, least(1, ({' + '.join(f'm[{i}] * o[{i}]' for i in (1, 2, 3, 5, 6, 7, 9, 10, 11))} - 1) / 2)))) <= 60""",
    "j28_ratio_test": """WITH p AS (SELECT q.vec_id AS q_id, e.vec_id, sqrt(list_sum(list_transform(list_zip(q.embedding, e.embedding), lambda t: (t[1]::DOUBLE - t[2]::DOUBLE) * (t[1]::DOUBLE - t[2]::DOUBLE)))) AS dist FROM embeddings q JOIN embeddings e ON e.label <> q.label WHERE q.vec_id % 20 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY dist, vec_id) AS rn, lead(dist) OVER (PARTITION BY q_id ORDER BY dist, vec_id) AS second FROM p) SELECT q_id, vec_id FROM r WHERE rn = 1 AND dist < 0.98::DOUBLE * second""",
    "j30_iou": f"""WITH {_PTS}, c AS (SELECT DISTINCT seq, CAST(floor(line / 300) AS BIGINT) AS part, ix, iy FROM ({_cell(0.5)})), n AS (SELECT seq, part, count(*) AS k FROM c GROUP BY ALL), i AS (SELECT p.seq, p.part AS a, q.part AS b, count(*) AS k FROM c p JOIN c q ON p.seq = q.seq AND p.ix = q.ix AND p.iy = q.iy AND p.part < q.part GROUP BY ALL)
        SELECT i.seq, a, b, round(i.k / (na.k + nb.k - i.k), 6) AS iou FROM i JOIN n na ON na.seq = i.seq AND na.part = a JOIN n nb ON nb.seq = i.seq AND nb.part = b""",
    "w12_composite": """WITH w AS (SELECT l_orderkey, l_discount * 0.7310585786::DOUBLE * exp(coalesce(sum(ln(1 - l_discount * 0.7310585786::DOUBLE)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_quantity, l_tax, l_discount ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS weight FROM lineitem)
        SELECT l_orderkey, round(sum(weight), 9) AS opacity, round(max(weight), 9) AS heaviest FROM w GROUP BY l_orderkey""",
    "x_turns": f"""WITH {VIEWS}, f AS (SELECT seq, arg_min(tmat, rec_id) AS m0 FROM views GROUP BY seq) SELECT rec_id, round(degrees(acos(greatest(-1, least(1, ({' + '.join(f'tmat[{i}] * m0[{i}]' for i in (1, 2, 3, 5, 6, 7, 9, 10, 11))} - 1) / 2)))), 3) AS turn,
        round(m0[1] * (tmat[4] - m0[4]) + m0[5] * (tmat[8] - m0[8]) + m0[9] * (tmat[12] - m0[12]), 4) + 0.0 AS x, round(m0[1] * (tmat[4] - m0[4]) + m0[5] * (tmat[8] - m0[8]) + m0[9] * (tmat[12] - m0[12]), 4) + 0.0 AS rel_x FROM views JOIN f USING (seq)""",
}


def _bits(*cells: str) -> str:
    """Z-order code of three ten-bit whole numbers."""
    return " + ".join(f"list_sum(list_transform(range(10), lambda i: (({c} >> i) & 1) << (3 * i + {k})))" for k, c in enumerate(cells))


def _azimuth(x: str, y: str, step: float) -> str:
    a = f"degrees(atan2({y}, {x}))"
    return f"CAST(floor((CASE WHEN {a} < 0 THEN ({a} + 360) % 360 ELSE {a} END) / {step}::DOUBLE) % {round(360 / step)} AS INTEGER)"


_KEYED = f"c AS ({_cell(0.25)}), lo AS (SELECT seq, min(ix) AS mx, min(iy) AS my, min(iz) AS mz FROM c GROUP BY seq)"
ORACLE["x_keys"] = f"""WITH {_PTS}, {_KEYED} SELECT seq, line, ((ix + 1048576) << 42) | ((iy + 1048576) << 21) | (iz + 1048576) AS voxel,
    CAST({_bits(*[f'((i{c} - m{c}) & 1023)' for c in 'xyz'])} AS BIGINT) AS morton, {_azimuth('x', 'y', 0.5)} AS azimuth FROM c JOIN lo USING (seq)"""


def _scan_sql(ring: int, az: float) -> str:
    """CTEs own and cloud: (seq, [line,] scan, ring, az, r) of each reading in its own scan, and in every scan of its recording within reach."""
    local = ", ".join(f"m[{i + 1}] * (x - m[4]) + m[{i + 5}] * (y - m[8]) + m[{i + 9}] * (z - m[12]) AS q{c}" for i, c in enumerate("xyz"))
    binned = f"CAST(least(floor((degrees(asin(qz / r)) + 90) / {ring}), {180 // ring - 1}) AS INTEGER) AS ring, {_azimuth('qx', 'qy', az)} AS az, r"
    far = f"SELECT *, sqrt(qx * qx + qy * qy + qz * qz) AS r FROM"
    return f"""{_PTS}, base AS (SELECT seq, line // 400 AS scan, arg_min(tmat, line) AS m FROM pts GROUP BY ALL),
    own AS (SELECT seq, scan, {binned} FROM ({far} (SELECT p.seq, b.scan, {local} FROM pts p JOIN base b ON b.seq = p.seq AND b.scan = p.line // 400)) WHERE r > 0 AND r < {REACH}),
    cloud AS (SELECT seq, line, scan, {binned} FROM ({far} (SELECT p.seq, p.line, b.scan, {local} FROM pts p JOIN base b ON b.seq = p.seq)) WHERE r > 0 AND r < {REACH})"""


ORACLE["j20_vote_join"] = f"""WITH {_scan_sql(10, 4.0)}, image AS (SELECT seq, scan, ring, az, min(r) AS far FROM own WHERE r > 0.3 GROUP BY ALL),
    v AS (SELECT s.seq, s.line, count(*) FILTER (WHERE far > s.r + (0.10::DOUBLE + 0.01::DOUBLE * s.r)) AS free, count(*) FILTER (WHERE abs(far - s.r) <= 0.10::DOUBLE + 0.01::DOUBLE * s.r) AS hit FROM cloud s JOIN image i ON i.seq = s.seq AND i.scan = s.scan AND i.ring = s.ring AND i.az = s.az WHERE s.r > 0.3 GROUP BY ALL)
    SELECT seq, line, free, hit, free >= 3 AND free > 2 * hit AS dynamic FROM v"""
ORACLE["j21_carve"] = f"""WITH {_scan_sql(60, 45.0)}, image AS (SELECT seq, scan, ring, az, max(r) AS far FROM own GROUP BY ALL), full_ AS (SELECT b.*, ring, az FROM (SELECT DISTINCT seq, scan FROM image) b, range(3) a(ring), range(8) c(az)),
    clear AS (SELECT f.seq, f.scan, f.ring, f.az, min(coalesce(i.far, 0)) AS far FROM full_ f, range(-1, 2) p(dr), range(-1, 2) q(da) LEFT JOIN image i ON i.seq = f.seq AND i.scan = f.scan AND i.ring = (f.ring + dr + 3) % 3 AND i.az = (f.az + da + 8) % 8 GROUP BY ALL)
    SELECT s.seq, s.line, count(*) FILTER (WHERE c.far > 0 AND c.far > s.r + 0.10::DOUBLE + 0.02::DOUBLE * s.r) AS free FROM cloud s LEFT JOIN clear c ON c.seq = s.seq AND c.scan = s.scan AND c.ring = s.ring AND c.az = s.az WHERE s.r > 0.5 GROUP BY ALL"""
ORACLE["a17_surface_depth"] = f"""WITH {_PROJ}, s AS (SELECT rec_id, u, v, z, greatest(1, least(6, ceil(0.5 * {FX}::DOUBLE * 0.05::DOUBLE / z)))::INT AS radius FROM hits WHERE z > 0.5),
    p AS (SELECT rec_id, u + du AS u, v + dv AS v, z, radius, du, dv FROM s, range(-5, 6) a(du), range(-5, 6) b(dv) WHERE abs(du) < radius AND abs(dv) < radius AND u + du BETWEEN 0 AND {W - 1} AND v + dv BETWEEN 0 AND {H - 1}),
    k AS (SELECT *, exp(-1.0::DOUBLE * (du * du + dv * dv) / (0.5::DOUBLE * radius * radius)) AS w FROM (SELECT *, min(z) OVER (PARTITION BY rec_id, u, v) AS z0 FROM p) WHERE z <= 1.02::DOUBLE * z0)
    SELECT rec_id, CAST(u AS INTEGER) AS u, CAST(v AS INTEGER) AS v, round(sum(w) / sum(w / z), 5) AS depth, count(*) AS hits FROM k GROUP BY ALL"""
ORACLE["f17_support"] = f"""WITH {_PROJ}, s AS (SELECT rec_id, u, v, z, greatest(1, least(6, ceil(0.5 * {FX}::DOUBLE * 0.05::DOUBLE / z)))::INT AS radius FROM hits WHERE z > 0.5),
    p AS (SELECT rec_id, u + du AS u, v + dv AS v, min(z) AS z0 FROM s, range(-5, 6) a(du), range(-5, 6) b(dv) WHERE abs(du) < radius AND abs(dv) < radius AND u + du BETWEEN 0 AND {W - 1} AND v + dv BETWEEN 0 AND {H - 1} GROUP BY ALL),
    low AS (SELECT rec_id, u + du AS u, v + dv AS v, min(z0) AS low FROM p, range(-2, 3) a(du), range(-2, 3) b(dv) GROUP BY ALL), ok AS (SELECT p.rec_id, p.u, p.v FROM p JOIN low USING (rec_id, u, v) WHERE z0 <= 1.05::DOUBLE * low),
    n AS (SELECT rec_id, u + du AS u, v + dv AS v, count(*) AS n FROM ok, range(-1, 2) a(du), range(-1, 2) b(dv) GROUP BY ALL) SELECT rec_id, count(*) AS pixels FROM ok JOIN n USING (rec_id, u, v) WHERE n > 5 GROUP BY rec_id"""
ORACLE["w13_ray_expand"] = f"""WITH {_PTS}, o AS (SELECT seq, arg_min([x, y, z], line) AS o FROM pts GROUP BY seq), r AS (SELECT p.seq, line, x, y, z, o, sqrt(pow(x - o[1], 2) + pow(y - o[2], 2) + pow(z - o[3], 2)) AS r FROM pts p JOIN o ON o.seq = p.seq),
    s AS (SELECT *, (unnest(range(CAST(floor(greatest(0, r - 0.05::DOUBLE - 0.01::DOUBLE * r) / 0.375::DOUBLE) AS BIGINT))) + 0.5::DOUBLE) * 0.375::DOUBLE AS s FROM r WHERE r > 0),
    v AS (SELECT DISTINCT seq, CAST(floor(line / 200) AS BIGINT) AS scan, {', '.join(f'CAST(floor((o[{i + 1}] + ({c} - o[{i + 1}]) * s / r) / 0.5::DOUBLE) AS BIGINT) AS i{c}' for i, c in enumerate('xyz'))} FROM s), n AS (SELECT seq, ix, iy, iz, count(*) AS votes FROM v GROUP BY ALL HAVING count(*) >= 3)
    SELECT seq, count(*) AS free, CAST(sum(votes) AS BIGINT) AS votes FROM n GROUP BY seq"""
# Every cell takes up the cells it reaches until nothing is added; the smallest of them names the component.
ORACLE["a41_components"] = f"""WITH RECURSIVE {_PTS}, c AS (SELECT DISTINCT seq, ix, iy FROM ({_cell(0.5)})), e AS (SELECT a.seq, a.ix AS ax, a.iy AS ay, b.ix AS bx, b.iy AS by_ FROM c a JOIN c b ON a.seq = b.seq AND abs(a.ix - b.ix) + abs(a.iy - b.iy) = 1),
    r AS (SELECT seq, ix AS fx, iy AS fy, ix, iy FROM c UNION SELECT r.seq, fx, fy, bx, by_ FROM r JOIN e ON e.seq = r.seq AND e.ax = r.ix AND e.ay = r.iy),
    l AS (SELECT seq, fx, fy, min([ix, iy]) AS label FROM r GROUP BY ALL) SELECT seq, label[1] AS ix, label[2] AS iy, count(*) AS cells FROM l GROUP BY ALL"""

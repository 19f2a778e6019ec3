"""Queries of calibrations, file sinks and sources, message logs, stencils and orders.

File queries write into the shared folder with the sinks and read back with the sources.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sensorloom.functions import geometry as geo
from sensorloom.functions import keys
from sensorloom.operators import alignment, gating, grids
from sensorloom.operators import projective as pj
from sensorloom.operators.regular_grid import micros
from sensorloom.plans.base import BLUR, FRAMES, IMU, POSES, VIEWS, blur, frames, imu, poses, views
from sensorloom.session import table
from sensorloom.sources import bags, binary, calibration, tables, text

# A calibration as such documents are written: camera matrix, distortion, and two extrinsics.
STORED = {
    "K": [[610.5, 0.0, 321.25], [0.0, 611.0, 239.5], [0.0, 0.0, 1.0]],
    "dist": [0.1, -0.2, 0.001, 0.0, 0.05],
    "width": 640,
    "T_rgb_marker": [[0.0, 0.0, 1.0, 0.1], [-1.0, 0.0, 0.0, -0.02], [0.0, -1.0, 0.0, 0.05], [0.0, 0.0, 0.0, 1.0]],
    "T_rgb_robot": [[1.0, 0.0, 0.0, 0.3], [0.0, 1.0, 0.0, 0.0], [0.0, 0.0, 1.0, 0.1], [0.0, 0.0, 0.0, 1.0]],
}
SETTINGS = {
    "frames": {"pose_frame": "marker", "world_up": "y", "target_up": "z", "extrinsic": {"rgb_marker_direction": "marker_to_cam", "delta_T": [1, 0, 0, 0.01, 0, 1, 0, 0, 0, 0, 1, -0.02, 0, 0, 0, 1]}},
    "intrinsics": {"image_height": 480},
    "timestamps": {"offsets_s": {"lidar": 0.004611}},
}


def s06_camera_poses(spark: SparkSession, d: str) -> DataFrame:
    """Camera poses in a z-up world from body poses, through a stored calibration whose extrinsic has to be inverted."""
    c = calibration.parse_calibration(STORED, SETTINGS)
    m = poses(spark, d).select("seq", "line", calibration.world_camera(F.col("tmat"), c, SETTINGS).alias("m"))
    return m.select("seq", "line", *[(F.round(F.col("m")[i], 5) + 0.0).alias(n) for n, i in (("x", 3), ("y", 7), ("z", 11), ("fx", 2), ("fy", 6), ("fz", 10))])


def s20_per_frame_csv(spark: SparkSession, d: str) -> DataFrame:
    """The blur table written as CSV with fixed decimals and read by its schema."""
    f = table(spark, d, "per_frame").where("seq is not null and name is not null")
    f = f.groupBy("seq", "name").agg(*[F.min(c).alias(c) for c in ("t", "used", "rate_px_per_ms_med", "rate_px_per_ms_p90", "omega_mocap", "omega_imu")])
    folder = tables.write_csv(tables.fixed_decimals(f, (("seq", None), *tables.PER_FRAME)), tables.folder_for(spark, "per-frame"))
    back = tables.read_csv(spark, folder, "used int, seq string, name string, t double, rate_px_per_ms_med double, omega_imu double")
    return back.select("seq", "name", "t", "used", "rate_px_per_ms_med", "omega_imu")


def s20_image_index(spark: SparkSession, d: str) -> DataFrame:
    """Image index of all cameras, written as CSV, read, and numbered per camera."""
    b = blur(spark, d).where("us is not null")
    i = b.select(F.col("seq").alias("cam"), (F.col("us") * 1000).alias("ns"), F.col("name").alias("file"), F.coalesce("rate", F.lit(0.0)).alias("sharp"), F.col("used").cast("double").alias("mean"))
    folder = tables.write_csv(i, tables.folder_for(spark, "images"))
    return tables.read_image_index(spark, folder).select("cam", F.col("rn").cast("bigint").alias("rn"), "ns", "file", "sharp")


def s02_trajectory(spark: SparkSession, d: str) -> DataFrame:
    """Poses as trajectory text, one file a recording, read through the line reader: rows, ends and path means."""
    p = poses(spark, d).where("abs(x) < 1000 and abs(y) < 1000 and abs(z) < 1000")
    q = p.select("seq", (F.col("us") / 1e6).alias("t"), geo.position(F.col("tmat")).alias("p"), geo.quat(1.0, 0.0, 0.0, 0.0).alias("q"))
    lines = q.select("seq", F.format_string("%.6f" + " %.9f" * 7, "t", *[F.col("p")[c] for c in "xyz"], *[F.col("q")[c] for c in "xyzw"]).alias("value"))
    folder = tables.folder_for(spark, "trajectory")
    lines.write.mode("overwrite").partitionBy("seq").text(folder)
    r = tables.read_trajectory(spark, folder).withColumn("seq", F.url_decode(F.regexp_extract("path", "seq=([^/]*)", 1)))
    return r.groupBy("seq").agg(F.count("*").alias("n"), F.round(F.min("t"), 5).alias("first"), F.round(F.max("t"), 5).alias("last"), *[F.round(F.avg(f"p.{c}"), 4).alias(f"mean_{c}") for c in "xyz"], F.sum("q.w").alias("w"))


def s14_ply_counts(spark: SparkSession, d: str) -> DataFrame:
    """Points of all recordings written as PLY parts; their counts from the headers, and again from the rows."""
    p = poses(spark, d).where("abs(x) < 1000 and abs(y) < 1000 and abs(z) < 1000").repartition(4, "seq")
    folder = tables.folder_for(spark, "cloud").removeprefix("file:")
    binary.write_ply_parts(p, folder, ["x", "y", "z"]).write.format("noop").mode("overwrite").save()
    heads = binary.ply_counts(spark, folder).agg(F.sum("rows").alias("in_headers"))
    rows = binary.read_ply(spark, folder, ["x", "y", "z"]).agg(F.count("*").alias("read"), F.round(F.sum("x"), 1).alias("sum_x"))
    return heads.crossJoin(rows)  # one row each


def k02_model(spark: SparkSession, d: str) -> DataFrame:
    """Views of all recordings as models of two cameras, written and read through the line reader: names, cameras and world-to-camera places."""
    v = views(spark, d).where("rgb_name is not null and size(filter(slice(tmat, 1, 12), v -> v is null or isnan(v))) = 0")
    v = v.select("seq", F.concat_ws("/", F.col("rec_id").cast("string"), F.regexp_replace(F.trim("rgb_name"), r"\s+", " ")).alias("name"), (F.col("rec_id") % 2 + 1).alias("camera_id"), "tmat")
    cams = v.select("seq", "camera_id").distinct().select("seq", "camera_id", F.lit("PINHOLE").alias("model"), F.lit(640).alias("width"), F.lit(480).alias("height"), F.array(*[F.lit(k) for k in (610.5, 611.0, 321.25, 239.5)]).alias("params"))
    model = tables.model_lines(cams, v, ["seq"])
    folder = tables.folder_for(spark, "model")
    for name, lines in model.items():
        lines.sortWithinPartitions("seq", *(["image_id"] if name == "images" else [])).select("seq", "value").write.mode("overwrite").partitionBy("seq").text(f"{folder}/{name}")
    of = F.url_decode(F.regexp_extract("path", "seq=([^/]*)", 1))
    im = text.model_images(text.read_lines(spark, f"{folder}/images")).withColumn("seq", of)
    cam = text.model_cameras(text.read_lines(spark, f"{folder}/cameras")).select(of.alias("seq"), "camera_id", F.col("params")[2].alias("cx"))
    return im.join(cam, ["seq", "camera_id"]).select("seq", "image_id", "camera_id", "name", "cx", *[(F.round(F.col("p")[a], 4) + 0.0).alias(a) for a in "xyz"])


def k09_ledger(spark: SparkSession, d: str) -> DataFrame:
    """Calls of two sources appended to a ledger in two batches, read and rolled up."""
    doc = table(spark, d, "documents").where("text is not null").select("doc_id", "source", F.length("text").cast("bigint").alias("tokens"), (F.col("doc_id") % 2).alias("batch"))
    folder = tables.folder_for(spark, "ledger")
    for batch in (0, 1):
        tables.append_jsonl(doc.where(F.col("batch") == batch), folder)
    return tables.read_jsonl(spark, folder, "doc_id bigint, source string, tokens bigint, batch bigint").groupBy("source").agg(F.count("*").alias("calls"), F.sum("tokens").alias("tokens"), F.max("batch").alias("last_batch"))


def k10_masks(spark: SparkSession, d: str) -> DataFrame:
    """Mask codes of the ground cells of each recording: unknown under three readings, kept where the height is low."""
    from sensorloom.operators.spatial import with_cells

    p = poses(spark, d).where("abs(x) < 1000 and abs(y) < 1000 and abs(z) < 1000")
    c = with_cells(p, 0.5).groupBy("seq", "ix", "iy").agg(F.count("*").alias("n"), F.max("z").alias("top"))
    return c.groupBy("seq", tables.coded_mask(F.col("n") >= 3, F.col("top") < 1.0).alias("code")).agg(F.count("*").alias("cells"))


def k11_assemble(spark: SparkSession, d: str) -> DataFrame:
    """Frames with the addresses of their companions: a depth image, and a view of some split."""
    f = frames(spark, d).select("frame_id", F.col("rgb_name").alias("name"))
    depth = table(spark, d, "frame_record").where("depth_name is not null").select(F.col("rgb_name").alias("name"), F.concat(F.lit("depth/"), "depth_name").alias("file"))
    view = table(spark, d, "split_frames").where("split is not null").select(F.col("rgb_name").alias("name"), F.concat(F.lit("views/"), F.col("rec_id").cast("string")).alias("file"))
    return tables.assemble(f, {"depth": depth, "view": view}, "name").select("frame_id", "depth", "view")


def k12_mesh(spark: SparkSession, d: str) -> DataFrame:
    """Strips of triangles along each recording's points of a hundred lines, an OBJ each, written and read: counts and edges."""
    p = poses(spark, d).where("abs(x) < 1000 and abs(y) < 1000 and abs(z) < 1000")
    one = p.groupBy("seq", F.floor(F.col("line") / 100).alias("k")).agg(*[F.avg(c).alias(c) for c in "xyz"])
    v = one.withColumn("vid", F.row_number().over(Window.partitionBy("seq").orderBy("k")) - 1)  # a row a hundred lines
    n = v.groupBy("seq").agg((F.max("vid") - 2).alias("top")).where("top >= 0")
    faces = n.select("seq", F.explode(F.sequence(F.lit(0), "top")).alias("fid")).select("seq", "fid", F.col("fid").alias("a"), (F.col("fid") + 1).alias("b"), (F.col("fid") + 2).alias("c"))
    folder = tables.folder_for(spark, "mesh")
    lines = tables.mesh_lines(v, faces, ["seq"]).repartition("seq").sortWithinPartitions("seq", "part", "n")
    lines.select("seq", "value").write.mode("overwrite").partitionBy("seq").text(folder)
    vs, fs = tables.read_mesh(text.read_lines(spark, folder))
    of = F.url_decode(F.regexp_extract("path", "seq=([^/]*)", 1)).alias("seq")
    a = vs.groupBy(of).agg(F.count("*").alias("vertices"), F.round(F.sum("x"), 3).alias("sum_x"))
    b = fs.groupBy(of).agg(F.count("*").alias("faces"), F.max("c").alias("last"))
    return a.join(b, "seq", "left").select("seq", "vertices", "sum_x", F.coalesce("faces", F.lit(0).cast("bigint")).alias("faces"), "last")


def s24_catalogue(spark: SparkSession, d: str) -> DataFrame:
    """The catalogue's entry of the last recording by name; a name that is not there would be an error."""
    r = table(spark, d, "recordings").where("seq is not null")
    name = r.agg(F.max("seq")).first()[0]
    return tables.catalogue_entry(r, name, "seq").select("seq", "site", "imu_hz")


def s26_cached_stats(spark: SparkSession, d: str) -> DataFrame:
    """Cached norms of all readings; recordings with an odd number of readings had one more when cached, and are computed again."""
    i = imu(spark, d).select("seq", "line", F.sqrt(F.col("ox") ** 2 + F.col("oy") ** 2 + F.col("oz") ** 2).alias("norm"))
    odd = i.groupBy("seq").agg(F.count("*").alias("n"), F.max("line").alias("line")).where("n % 2 = 1").select("seq", (F.col("line") + 1).alias("line"), F.lit(0.0).alias("norm"))
    cache = i.withColumn("norm", F.lit(-1.0)).unionByName(odd)
    return tables.cached_stats(cache, i, "seq", lambda stale: stale).groupBy("seq").agg(F.count("*").alias("n"), F.round(F.max("norm"), 6).alias("fastest"))


def s10_registered_scans(spark: SparkSession, d: str) -> DataFrame:
    """Every second scan (200 lines) registered by its shifted stamp: where the scanner was, and how many points it has."""
    p = poses(spark, d).where("abs(x) < 1000 and abs(y) < 1000 and abs(z) < 1000")
    pts = p.select("seq", keys.cell(F.col("line"), 200).alias("scan"), F.col("us").alias("stamp_us"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))
    r = bags.registered_scans(pts, p, calibration.constant(calibration.IDENTITY), SETTINGS, "lidar", 2)
    return r.groupBy("seq", "scan", "us").agg(F.count("*").alias("points"), *[F.round(F.max(F.col("world")[i]), 4).alias(c) for c, i in zip("xyz", (3, 7, 11))])


def s12_route(spark: SparkSession, d: str) -> DataFrame:
    """Messages of each recording routed by topic, every third of the gyro's, and the topics that are missing."""
    m = frames(spark, d).select(F.col("seq").alias("bag"), F.lit("/cam").alias("topic"), F.col("us").alias("n"), F.col("frame_id").alias("id"))
    m = m.unionByName(imu(spark, d).select(F.col("seq").alias("bag"), F.lit("/imu").alias("topic"), F.col("line").alias("n"), F.col("line").alias("id")))
    sinks = bags.route(m, {"images": "/cam", "gyro": "/imu"})
    a = sinks["images"].groupBy("bag", "topic").agg(F.count("*").alias("kept"), F.max("id").alias("last_id"))
    b = bags.every_nth(sinks["gyro"], 3).groupBy("bag", "topic").agg(F.count("*").alias("kept"), F.max("id").alias("last_id"))
    c = bags.missing_topics(m, ["/imu", "/lidar"]).select("bag", "topic", F.lit(0).cast("bigint").alias("kept"), F.lit(None).cast("bigint").alias("last_id"))
    return a.unionByName(b).unionByName(c)


def x12_harmonics(spark: SparkSession, d: str) -> DataFrame:
    """The fifteen harmonics of the direction that each view looks to."""
    v = views(spark, d).where("size(filter(slice(tmat, 1, 12), v -> v is null or isnan(v))) = 0")
    m = F.col("tmat")
    return v.select("rec_id", F.transform(F.array(*geo.harmonics(m[2], m[6], m[10])), lambda h: F.round(h, 5) + 0.0).alias("basis"))


def x13_footprint(spark: SparkSession, d: str) -> DataFrame:
    """Covariance of an ellipsoid along each body's axes, and its image from three metres below, looking up."""
    up = [1.0, 0, 0, 0, 0, 1.0, 0, 0, 0, 0, 1.0, 0, 0, 0, 0, 1.0]
    p = poses(spark, d).where("abs(x) < 1000 and abs(y) < 1000 and abs(z) < 1000")
    c = p.select("seq", "line", geo.body_covariance(geo.rotation(F.col("tmat")), F.array(F.lit(0.2), F.lit(0.1), F.lit(0.05))).alias("cov"))
    seen = geo.image_covariance(geo.point(0.5, -0.25, 3.0), F.col("cov"), F.array(*[F.lit(v) for v in up]), 300.0, 300.0)
    s = c.select("seq", "line", "cov", seen.alias("s"))
    return s.select("seq", "line", *[(F.round(F.col("cov")[i], 6) + 0.0).alias(n) for i, n in enumerate(("xx", "xy", "xz", "yy", "yz", "zz"))], *[(F.round(F.col("s")[n], 2) + 0.0).alias(f"image_{n}") for n in "abd"])


def x17_quat_words(spark: SparkSession, d: str) -> DataFrame:
    """The IMU's quaternions in 32 bits and back."""
    i = imu(spark, d).where("quat is not null and not isnan(quat.w) and not isnan(quat.x) and not isnan(quat.y) and not isnan(quat.z)").select("seq", "line", "quat")
    n = geo.let(geo.quat_norm(F.col("quat")), lambda v: geo.quat(*[F.col("quat")[c] / v for c in "wxyz"]))
    w = i.where(geo.quat_norm(F.col("quat")) > 0).select("seq", "line", keys.pack_quat(n).alias("word"))
    return w.select("seq", "line", "word", *[F.round(keys.unpack_quat(F.col("word"))[c], 6).alias(c) for c in "wxyz"])


def _pixels(spark: SparkSession, d: str) -> DataFrame:
    """Images of 16 by 12 pixels out of the line items, one a flag: mean quantities."""
    li = table(spark, d, "lineitem").where("l_partkey is not null and l_suppkey is not null")
    return li.groupBy(F.col("l_returnflag").alias("frame"), (F.col("l_partkey") % 16).cast("int").alias("u"), (F.col("l_orderkey") % 12).cast("int").alias("v")).agg(F.round(F.avg("l_quantity"), 3).alias("gray"))


def x20_sharpness(spark: SparkSession, d: str) -> DataFrame:
    return grids.sharpness(_pixels(spark, d), ["frame"], 16, 12).select("frame", F.round("sharp", 5).alias("sharp"), F.round("mean", 6).alias("mean"))


def x20_tile_energies(spark: SparkSession, d: str) -> DataFrame:
    return grids.directional_energies(_pixels(spark, d), ["frame"], 8, 6).select("frame", "tile_u", "tile_v", "direction", F.round("energy", 6).alias("energy"))


def f10_opacity_scale(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose opacity is high and whose longest axis is short: line items as splats, logits and log scales."""
    li = table(spark, d, "lineitem")
    ok = gating.solid_and_small(F.col("l_quantity") / 10 - 2.5, F.array(F.col("l_discount") * 20 - 2, F.col("l_tax") * 20 - 2, F.lit(-3.0)), 0.6, 0.5)
    return li.groupBy("l_returnflag").agg(F.count_if(ok).alias("kept"), F.count("*").alias("all"))


def x21_schedules(spark: SparkSession, d: str) -> DataFrame:
    """Weights and budgets at each step of the parts' keys."""
    p = table(spark, d, "part").select("p_partkey", (F.col("p_partkey") % 1000).alias("step"))
    return p.select("p_partkey", F.round(geo.ramp(F.col("step"), 100, 600, 0.0, 0.2), 9).alias("weight"), F.round(geo.decay(F.col("step"), 800, 1e-2, 1e-4), 9).alias("rate"), geo.budget(F.col("step"), 500, 10_000, 50_000).alias("rows"))


def a45_lever_arm(spark: SparkSession, d: str) -> DataFrame:
    """Views aligned to the pose track with a clock offset and a lever arm."""
    v = table(spark, d, "split_frames").where("seq is not null and rec_id is not null and t_event_s is not null and not isnan(t_event_s) and size(tmat) >= 12").dropDuplicates(["rec_id"])
    f = v.select("seq", "rec_id", micros(F.col("t_event_s")).alias("us"), "tmat")
    p = poses(spark, d).where("abs(x) < 1000 and abs(y) < 1000 and abs(z) < 1000").select("seq", "us", "line", "x", "y", "z")
    r = alignment.lever_arm(f, p, "seq", "rec_id")
    return r.select("seq", "offset_us", F.round("scale", 4).alias("scale"), F.transform("lever", lambda v: F.round(v, 3)).alias("lever"), F.round("median", 4).alias("median"))


def a55_symmetry(spark: SparkSession, d: str) -> DataFrame:
    """Symmetry of each recording's views about their middle."""
    v = views(spark, d).select("seq", "rec_id", *[F.col("tmat")[i].alias(c) for c, i in zip("xyz", (3, 7, 11))])
    v = v.where(" and ".join(f"{c} is not null and not isnan({c}) and abs({c}) < 1000" for c in "xyz"))
    m = v.groupBy("seq").agg(F.round(F.avg("x"), 3).alias("mx"), F.round(F.avg("y"), 3).alias("my"))
    p = v.join(m, "seq").select("seq", "rec_id", (F.col("x") - F.col("mx")).alias("x"), (F.col("y") - F.col("my")).alias("y"), "z")
    s = alignment.symmetry_scores(p, ["seq"], "rec_id", 0.2, 0.5)
    return s.select("seq", "map", F.round("inliers", 6).alias("inliers"), F.round("covered", 6).alias("covered"))


def i07_footprints(spark: SparkSession, d: str) -> DataFrame:
    """Thin ellipsoids at the readings, widened where most of their recording's views would cull them."""
    p = poses(spark, d).where("abs(x) < 1000 and abs(y) < 1000 and abs(z) < 1000")
    rows = p.select("seq", "line", "x", "y", "z", geo.rotation(F.col("tmat")).alias("r"), F.array(*[F.lit(v) for v in (-6.0, -6.5, -9.0)]).alias("log_scales"), F.lit(0.5).alias("opacity"))
    looking = F.array(*[F.lit(float(v)) for v in (0, 0, 1, 0, -1, 0, 0, 0, 0, -1, 0, 0, 0, 0, 0, 1)])  # camera in the body: z forward, y down
    cams = views(spark, d).select("seq", "rec_id", geo.compose(F.col("tmat"), looking).alias("tmat"))
    w = pj.widened_footprints(rows, cams, ["seq"], "line", "rec_id", 300.0, 300.0, 160.0, 120.0, 320, 240)
    return w.select("seq", "line", "views", "culled", F.round("added", 9).alias("added"), F.round(F.col("log_scales")[0], 5).alias("log_scale"), F.round("opacity", 5).alias("opacity"))


def l01_stable_order(spark: SparkSession, d: str) -> DataFrame:
    """All readings of the gyro by time, those of one time in the order of their log."""
    return imu(spark, d).select("seq", "us", "line").orderBy("us", "seq", "line")


def l03_group_order(spark: SparkSession, d: str) -> DataFrame:
    """Sources and languages of the documents: sources by name, the largest groups of each first."""
    g = table(spark, d, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))
    return g.orderBy(F.asc_nulls_first("source"), F.desc("n"), F.asc_nulls_first("lang"))


QUERIES = {
    f.__name__: f
    for f in (
        s02_trajectory, s06_camera_poses, s10_registered_scans, s12_route, s14_ply_counts, s20_per_frame_csv, s20_image_index, s24_catalogue, s26_cached_stats,
        k02_model, k09_ledger, k10_masks, k11_assemble, k12_mesh, x12_harmonics, x13_footprint, x17_quat_words, x20_sharpness, x20_tile_energies, x21_schedules, a45_lever_arm, a55_symmetry, i07_footprints, f10_opacity_scale, l01_stable_order, l03_group_order,
    )
}

_FIXED = calibration.multiply(calibration.parse_calibration(STORED, SETTINGS).body_from_camera["marker"], [float(v) for v in SETTINGS["frames"]["extrinsic"]["delta_T"]])
_P = f"{POSES}, pts AS (SELECT * FROM poses WHERE abs(x) < 1000 AND abs(y) < 1000 AND abs(z) < 1000)"
_WHOLE = "len(list_filter(tmat[1:12], lambda v: v IS NOT NULL AND NOT isnan(v))) = 12"


def _product(i: int, j: int) -> str:
    """Entry (i, j) of the pose times the constant extrinsic."""
    terms = [f"tmat[{4 * i + k + 1}] * {_FIXED[4 * k + j]!r}::DOUBLE" for k in range(3)]
    return f"({' + '.join(terms)}{f' + tmat[{4 * i + 4}]' if j == 3 else ''})"


def _harmonics_sql() -> str:
    (a, b, c) = ("tmat[3]", "tmat[7]", "tmat[11]")
    one, (p, q, r), (s, t, u, v, w) = geo.BAND1, geo.BAND2, geo.BAND3
    n = lambda x: f"{x!r}::DOUBLE"
    rows = [
        f"-{n(one)} * y", f"{n(one)} * z", f"-{n(one)} * x", f"{n(p)} * x * y", f"-{n(p)} * y * z", f"{n(q)} * (2 * z * z - x * x - y * y)", f"-{n(p)} * x * z", f"{n(r)} * (x * x - y * y)",
        f"-{n(s)} * y * (3 * x * x - y * y)", f"{n(t)} * x * y * z", f"-{n(u)} * y * (4 * z * z - x * x - y * y)", f"{n(v)} * z * (2 * z * z - 3 * x * x - 3 * y * y)",
        f"-{n(u)} * x * (4 * z * z - x * x - y * y)", f"{n(w)} * z * (x * x - y * y)", f"-{n(s)} * x * (x * x - 3 * y * y)",
    ]
    return f"WITH {VIEWS} SELECT rec_id, list_transform([{', '.join(rows)}], lambda h: round(h, 5) + 0.0::DOUBLE) AS basis FROM (SELECT rec_id, {a} AS x, {b} AS y, {c} AS z FROM views WHERE {_WHOLE})"


def _covariance(i: int, j: int) -> str:
    return " + ".join(f"tmat[{4 * i + k + 1}] * tmat[{4 * j + k + 1}] * {s * s!r}::DOUBLE" for k, s in enumerate((0.2, 0.1, 0.05)))


_COV = ", ".join(f"{_covariance(i, j)} AS {n}" for n, i, j in (("xx", 0, 0), ("xy", 0, 1), ("xz", 0, 2), ("yy", 1, 1), ("yz", 1, 2), ("zz", 2, 2)))
# Derivatives of the projection at (0.5, -0.25, 3): 100 per metre across, and minus the offset over the squared depth.
_G, _H = -300.0 * 0.5 / 9, -300.0 * -0.25 / 9
_PIX = "px AS (SELECT l_returnflag AS frame, l_partkey % 16 AS u, l_orderkey % 12 AS v, round(avg(l_quantity), 3) AS gray FROM lineitem WHERE l_partkey IS NOT NULL AND l_suppkey IS NOT NULL GROUP BY ALL)"

_MAPS = ", ".join(f"('{n}', {a!r}::DOUBLE, {b!r}::DOUBLE, {c!r}::DOUBLE, {e!r}::DOUBLE)" for n, a, b, c, e in alignment.symmetry_maps())

ORACLE = {
    "a55_symmetry": f"""WITH {VIEWS}, v AS (SELECT seq, rec_id, tmat[4] AS x, tmat[8] AS y, tmat[12] AS z FROM views WHERE {' AND '.join(f'tmat[{i}] IS NOT NULL AND NOT isnan(tmat[{i}]) AND abs(tmat[{i}]) < 1000' for i in (4, 8, 12))}),
        m AS (SELECT seq, round(avg(x), 3) AS mx, round(avg(y), 3) AS my, count(*) AS n FROM v GROUP BY seq), p AS (SELECT v.seq, rec_id, x - mx AS x, y - my AS y, z, n FROM v JOIN m USING (seq)), k AS (SELECT * FROM (VALUES {_MAPS}) t(map, a, b, c, d)),
        i AS (SELECT seq, rec_id, n, map, a * x + b * y AS x, c * x + d * y AS y, z FROM p, k), near AS (SELECT i.seq, i.map, any_value(i.n) AS n, min(sqrt((i.x - p.x) * (i.x - p.x) + (i.y - p.y) * (i.y - p.y) + (i.z - p.z) * (i.z - p.z))) AS dist FROM i JOIN p ON p.seq = i.seq GROUP BY i.seq, i.map, i.rec_id),
        g AS (SELECT seq, map, any_value(n) AS n, count(*) FILTER (WHERE dist <= 0.5) AS e, count(*) FILTER (WHERE dist < 0.2) AS inl FROM near GROUP BY seq, map)
        SELECT seq, map, round(CASE WHEN e >= 0.2::DOUBLE * n THEN CASE WHEN e > 0 THEN inl / e END ELSE 0 END, 6) AS inliers, round(e / n, 6) AS covered FROM g""",
    "s02_trajectory": f"""WITH {_P} SELECT seq, count(*) AS n, round(min(us) / 1e6, 5) AS first, round(max(us) / 1e6, 5) AS last, {', '.join(f'round(avg({c}), 4) AS mean_{c}' for c in 'xyz')}, count(*)::DOUBLE AS w FROM pts GROUP BY seq""",
    "s06_camera_poses": f"""WITH {POSES} SELECT seq, line, round({_product(0, 3)}, 5) + 0.0::DOUBLE AS x, round(-{_product(2, 3)}, 5) + 0.0::DOUBLE AS y, round({_product(1, 3)}, 5) + 0.0::DOUBLE AS z,
        round({_product(0, 2)}, 5) + 0.0::DOUBLE AS fx, round(-{_product(2, 2)}, 5) + 0.0::DOUBLE AS fy, round({_product(1, 2)}, 5) + 0.0::DOUBLE AS fz FROM poses""",
    "s10_registered_scans": f"""WITH {_P}, s AS (SELECT seq, CAST(floor(line / 200) AS BIGINT) AS scan, min(us) + 4611 AS us, count(*) AS points FROM pts GROUP BY 1, 2), n AS (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY scan) - 1 AS rn FROM s),
        b AS (SELECT n.*, {', '.join(f'p.{c} + (q.{c} - p.{c}) * CASE WHEN q.us > p.us THEN (n.us - p.us) / (q.us - p.us) ELSE 0 END AS {c}' for c in 'xyz')} FROM n ASOF JOIN pts p ON n.seq = p.seq AND n.us >= p.us ASOF JOIN pts q ON n.seq = q.seq AND n.us <= q.us WHERE rn % 2 = 0)
        SELECT seq, scan, us, points, round(x, 4) AS x, round(y, 4) AS y, round(z, 4) AS z FROM b""",
    "s12_route": f"""WITH {FRAMES}, {IMU}, bags AS (SELECT seq FROM frames UNION SELECT seq FROM imu), g AS (SELECT seq, line, row_number() OVER (PARTITION BY seq ORDER BY line) - 1 AS rn FROM imu)
        SELECT seq AS bag, '/cam' AS topic, count(*) AS kept, max(frame_id) AS last_id FROM frames GROUP BY seq UNION ALL SELECT seq, '/imu', count(*), max(line) FROM g WHERE rn % 3 = 0 GROUP BY seq
        UNION ALL SELECT seq, '/lidar', 0, NULL FROM bags UNION ALL SELECT seq, '/imu', 0, NULL FROM bags WHERE seq NOT IN (SELECT seq FROM imu)""",
    "s14_ply_counts": f"WITH {_P} SELECT count(*)::BIGINT AS in_headers, count(*) AS read, round(sum(x::FLOAT::DOUBLE), 1) AS sum_x FROM pts",
    "s20_per_frame_csv": """WITH f AS (SELECT seq, name, min(t) AS t, min(used) AS used, min(rate_px_per_ms_med) AS r, min(omega_imu) AS o FROM per_frame WHERE seq IS NOT NULL AND name IS NOT NULL GROUP BY ALL)
        SELECT seq, name, printf('%.6f', t)::DOUBLE AS t, used, CASE WHEN isnan(r) OR isinf(r) THEN r ELSE printf('%.5f', r)::DOUBLE END AS rate_px_per_ms_med, CASE WHEN isnan(o) OR isinf(o) THEN o ELSE printf('%.4f', o)::DOUBLE END AS omega_imu FROM f""",
    "s20_image_index": f"WITH {BLUR} SELECT seq AS cam, row_number() OVER (PARTITION BY seq ORDER BY us, name) - 1 AS rn, us * 1000 AS ns, name AS file, coalesce(rate, 0.0::DOUBLE) AS sharp FROM blur WHERE us IS NOT NULL",
    "s24_catalogue": "SELECT DISTINCT seq, site, imu_hz FROM recordings WHERE seq = (SELECT max(seq) FROM recordings)",
    "s26_cached_stats": f"WITH {IMU}, n AS (SELECT seq, sqrt(ox * ox + oy * oy + oz * oz) AS norm FROM imu) SELECT seq, count(*) AS n, CASE WHEN count(*) % 2 = 0 THEN -1.0::DOUBLE ELSE round(max(norm), 6) END AS fastest FROM n GROUP BY seq",
    "k02_model": f"""WITH {VIEWS}, v AS (SELECT seq, rec_id, rec_id || '/' || regexp_replace(trim(rgb_name), '\\s+', ' ', 'g') AS name, rec_id % 2 + 1 AS camera_id, tmat FROM views WHERE rgb_name IS NOT NULL AND {_WHOLE})
        SELECT seq, row_number() OVER (PARTITION BY seq ORDER BY name, camera_id) AS image_id, camera_id, name, 321.25::DOUBLE AS cx,
        {', '.join(f'round(-(tmat[{i}] * tmat[4] + tmat[{i + 4}] * tmat[8] + tmat[{i + 8}] * tmat[12]), 4) + 0.0::DOUBLE AS {c}' for i, c in zip((1, 2, 3), 'xyz'))} FROM v""",
    "k09_ledger": "SELECT source, count(*) AS calls, CAST(sum(length(text)) AS BIGINT) AS tokens, max(doc_id % 2) AS last_batch FROM documents WHERE text IS NOT NULL GROUP BY source",
    "k10_masks": f"""WITH {_P}, c AS (SELECT seq, CAST(floor(x / 0.5::DOUBLE) AS BIGINT) AS ix, CAST(floor(y / 0.5::DOUBLE) AS BIGINT) AS iy, count(*) AS n, max(z) AS top FROM pts GROUP BY 1, 2, 3)
        SELECT seq, CASE WHEN n < 3 THEN 128 WHEN top < 1 THEN 255 ELSE 0 END AS code, count(*) AS cells FROM c GROUP BY 1, 2""",
    "k11_assemble": f"""WITH {FRAMES}, a AS (SELECT rgb_name AS name, min('depth/' || depth_name) AS depth FROM frame_record WHERE depth_name IS NOT NULL GROUP BY 1), b AS (SELECT rgb_name AS name, min('views/' || rec_id) AS view FROM split_frames WHERE split IS NOT NULL GROUP BY 1)
        SELECT frame_id, a.depth, b.view FROM frames f LEFT JOIN a ON a.name = f.rgb_name LEFT JOIN b ON b.name = f.rgb_name""",
    "k12_mesh": f"""WITH {_P}, o AS (SELECT seq, floor(line / 100) AS k, avg(x) AS x FROM pts GROUP BY 1, 2)
        SELECT seq, count(*) AS vertices, round(sum(round(x, 6)), 3) AS sum_x, greatest(count(*) - 2, 0) AS faces, CASE WHEN count(*) > 2 THEN count(*) - 1 END AS last FROM o GROUP BY seq""",
    "x12_harmonics": _harmonics_sql(),
    "x13_footprint": f"""WITH {_P}, c AS (SELECT seq, line, {_COV} FROM pts) SELECT seq, line, {', '.join(f'round({n}, 6) + 0.0::DOUBLE AS {n}' for n in ('xx', 'xy', 'xz', 'yy', 'yz', 'zz'))},
        round(10000 * xx + 200 * {_G!r}::DOUBLE * xz + {_G * _G!r}::DOUBLE * zz, 2) + 0.0::DOUBLE AS image_a,
        round(10000 * xy + 100 * {_H!r}::DOUBLE * xz + 100 * {_G!r}::DOUBLE * yz + {_G * _H!r}::DOUBLE * zz, 2) + 0.0::DOUBLE AS image_b, round(10000 * yy + 200 * {_H!r}::DOUBLE * yz + {_H * _H!r}::DOUBLE * zz, 2) + 0.0::DOUBLE AS image_d FROM c""",
    "x17_quat_words": f"""WITH {IMU}, q AS (SELECT seq, line, sqrt(quat.w * quat.w + quat.x * quat.x + quat.y * quat.y + quat.z * quat.z) AS n, [quat.w, quat.x, quat.y, quat.z] AS v FROM imu WHERE quat IS NOT NULL AND NOT isnan(quat.w) AND NOT isnan(quat.x) AND NOT isnan(quat.y) AND NOT isnan(quat.z)),
        u AS (SELECT seq, line, list_transform(v, lambda x: x / n) AS v FROM q WHERE n > 0), a AS (SELECT *, list_position(list_transform(v, lambda x: abs(x)), list_max(list_transform(v, lambda x: abs(x)))) AS top FROM u),
        c AS (SELECT seq, line, top, list_transform(v, lambda x: CAST(greatest(0, least(1023, floor((x * (CASE WHEN v[top] < 0 THEN -1 ELSE 1 END) * sqrt(0.5::DOUBLE) + 0.5) * 1023 + 0.5))) AS BIGINT)) AS k FROM a),
        r AS (SELECT seq, line, top, list_concat(k[:top - 1], k[top + 1:]) AS s FROM c), d AS (SELECT *, list_transform(s, lambda x: (x / 1023 - 0.5) * sqrt(2.0::DOUBLE)) AS m FROM r),
        f AS (SELECT *, sqrt(greatest(0, 1 - m[1] * m[1] - m[2] * m[2] - m[3] * m[3])) AS big FROM d)
        SELECT seq, line, (((top - 1) * 1024 + s[1]) * 1024 + s[2]) * 1024 + s[3] AS word, {', '.join(f'round(CASE WHEN top = {i + 1} THEN big WHEN top < {i + 1} THEN m[{i}] ELSE m[{i + 1}] END, 6) AS {c}' for i, c in enumerate('wxyz'))} FROM f""",
    "x20_sharpness": f"""WITH {_PIX}, n AS (SELECT frame, u, v, gray, unnest([-1, 1, 0, 0]) AS du, unnest([0, 0, -1, 1]) AS dv FROM px), m AS (SELECT n.frame, n.u, n.v, any_value(n.gray) AS gray, sum(o.gray) AS s
          FROM n JOIN px o ON o.frame = n.frame AND o.u = CASE WHEN n.u + du < 0 THEN 1 WHEN n.u + du > 15 THEN 14 ELSE n.u + du END AND o.v = CASE WHEN n.v + dv < 0 THEN 1 WHEN n.v + dv > 11 THEN 10 ELSE n.v + dv END GROUP BY ALL)
        SELECT frame, round(var_pop(s - 4 * gray), 5) AS sharp, round(avg(gray), 6) AS mean FROM m GROUP BY frame""",
    "x20_tile_energies": f"""WITH {_PIX}, d AS (SELECT * FROM (VALUES ('right', 1, 0), ('down', 0, 1), ('falling', 1, 1), ('rising', 1, -1)) t(direction, du, dv)),
        p AS (SELECT a.frame, direction, a.u, a.v - greatest(-dv, 0) AS v, (b.gray - a.gray) * (b.gray - a.gray) AS e FROM px a, d JOIN px b ON b.frame = a.frame AND b.u = a.u + du AND b.v = a.v + dv)
        SELECT frame, CAST(u // 8 AS INTEGER) AS tile_u, CAST(v // 6 AS INTEGER) AS tile_v, direction, round(avg(e), 6) AS energy FROM p WHERE u % 8 < 7 AND v % 6 < 5 GROUP BY ALL""",
    "x21_schedules": """SELECT p_partkey, round(0.2::DOUBLE * greatest(0, least(1, (p_partkey % 1000 - 100) / 500)), 9) AS weight, round(0.01::DOUBLE * pow(0.01::DOUBLE, least(1, (p_partkey % 1000) / 800)), 9) AS rate,
        CAST(floor(10000 + 40000 * sqrt(least(1, (p_partkey % 1000) / 500))) AS BIGINT) AS rows FROM part""",
    "f10_opacity_scale": """SELECT l_returnflag, count(*) FILTER (WHERE 1 / (1 + exp(-(l_quantity / 10 - 2.5::DOUBLE))) >= 0.6::DOUBLE AND exp(greatest(l_discount * 20 - 2, l_tax * 20 - 2, -3.0::DOUBLE)) <= 0.5::DOUBLE) AS kept, count(*) AS "all" FROM lineitem GROUP BY 1""",
    "l01_stable_order": f"WITH {IMU} SELECT seq, us, line FROM imu ORDER BY us, seq, line",
    "l03_group_order": "SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL ORDER BY source NULLS FIRST, n DESC, lang NULLS FIRST",
}

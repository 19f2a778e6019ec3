"""Source, sink, fit, selection and fix-point queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorloom.functions import geometry as geo
from sensorloom.operators import fitting, greedy
from sensorloom.operators import relational as rel
from sensorloom.operators import spatial as sp
from sensorloom.plans.base import POSES, VIEWS, blur, poses, views
from sensorloom.session import table
from sensorloom.sources import records, text


def _points(spark: SparkSession, d: str) -> DataFrame:
    return poses(spark, d).where("abs(x) < 1000 and abs(y) < 1000 and abs(z) < 1000")


def _event_lines(spark: SparkSession, d: str) -> DataFrame:
    """events as a text log: every 7th line a comment, every 11th with a bad token, every 13th too short."""
    e = table(spark, d, "events")
    line = F.concat_ws(", ", F.col("event_id").cast("string"), F.col("user_id").cast("string"), F.format_string("%.3f", "value"))
    v = F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("# "), line)).when(F.col("event_id") % 11 == 0, F.concat(line, F.lit(" 1d"))).when(F.col("event_id") % 13 == 0, F.col("user_id").cast("string")).otherwise(line)
    return e.select(F.concat(F.lit("log/"), "event_type").alias("path"), F.col("event_id").alias("line_no"), v.alias("value"))


def s01_numeric_rows(spark: SparkSession, d: str) -> DataFrame:
    r = text.numeric_rows(_event_lines(spark, d), 3)
    return r.select("path", "line_no", F.col("values")[0].cast("bigint").alias("event_id"), F.col("values")[2].alias("value"), F.size("values").alias("width"))


def s04_frame_pairs(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "frame_record").where("seq is not null and frame_id is not null and depth_name is not null").dropDuplicates(["frame_id"])
    lines = f.select(F.col("seq").alias("path"), F.col("frame_id").alias("line_no"), F.concat_ws("  ", "depth_name", F.lit("0_depth_event.png"), "rgb_name").alias("value"))
    return text.frame_pairs(lines).select("path", F.col("rn").cast("bigint").alias("rn"), "rgb_name", "depth_name", F.round("t", 3).alias("t"))


def s09_model_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Views written as text model lines and read again: largest drift of the world-to-camera pose."""
    v = views(spark, d).where("rgb_name is not null")
    inv = geo.inverse(F.col("tmat"))
    im = v.select("seq", geo.rotation_to_quat(geo.rotation(inv)).alias("q"), geo.position(inv).alias("p"), F.lit(1).cast("bigint").alias("camera_id"), F.concat_ws("/", F.col("rec_id").cast("string"), "rgb_name").alias("name"))
    lines = text.image_lines(im, ["seq"]).select(F.col("seq").alias("path"), F.posexplode(F.split("value", "\n")).alias("k", "value"), "image_id")
    back = text.model_images(lines.select("path", (F.col("image_id") * 2 + F.col("k")).alias("line_no"), "value"))
    # several spaces of a name are one when it is read
    j = back.alias("b").join(im.withColumn("name", F.regexp_replace(F.trim("name"), r"\s+", " ")).alias("i"), (F.col("b.path") == F.col("i.seq")) & (F.col("b.name") == F.col("i.name")))
    drift = F.greatest(*[F.abs(F.col(f"b.{g}.{c}") - F.col(f"i.{g}.{c}")) for g, cs in (("q", "wxyz"), ("p", "xyz")) for c in cs])
    return j.groupBy("path").agg(F.count("*").alias("images"), (F.max(drift) < 1e-6).alias("same"))


def s21_records(spark: SparkSession, d: str) -> DataFrame:
    """Metric trees made of parts, a brand each, walked and rolled up."""
    p = table(spark, d, "part").where("p_partkey is not null")
    leaf = F.struct((F.col("p_retailprice") / 50).alias("psnr"), (F.col("p_size") / 50.0).alias("ssim"), F.lit(0.25).alias("lpips"), F.col("p_size").alias("n"))
    tree = p.groupBy("p_brand").agg(F.to_json(F.struct(F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("k"), F.col("p_partkey").cast("string")).alias("key"), leaf.alias("value")))).alias("runs"), F.lit(True).alias("psnr"))).alias("text"))
    r = records.labelled(records.metric_records(tree.select(F.concat(F.lit("report/"), "p_brand", F.lit("/scores.json")).alias("path"), "text")))
    return r.groupBy("path").agg(F.count("*").alias("records"), F.round(F.max("psnr"), 4).alias("best"), F.sum("n").alias("n"))


def s23_html_rows(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    row = F.concat(F.lit("<tr class=r><td><a href='/p/"), F.col("p_partkey").cast("string"), F.lit("'>"), "p_name", F.lit("</a></td><td> &amp; <b>"), "p_brand", F.lit("</b>\n</td></tr>"))
    page = p.groupBy(F.col("p_type").alias("page")).agg(F.concat(F.lit("<html><script>var a='<tr><td>x</td></tr>';</script><table>"), F.array_join(F.array_sort(F.collect_list(row)), ""), F.lit("</table>")).alias("html"))
    return text.html_rows(page, "page", "html").select("page", F.col("cells")[0].alias("name"), F.col("cells")[1].alias("brand"))


def w07_greedy_thin(spark: SparkSession, d: str) -> DataFrame:
    return greedy.spaced(_points(spark, d), ["seq"], ["us", "line"], "line", 0.25)


def j29_greedy_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Train views by ascending id, against the validation views and one another: 0.2 m and 15 degrees."""
    v = views(spark, d).where("split is not null").select("seq", "rec_id", "split", "tmat", *[F.col("tmat")[i].alias(c) for c, i in zip("xyz", (3, 7, 11))])
    return greedy.spaced(v.where("split = 'train'"), ["seq"], ["rec_id"], "rec_id", 0.2, 15.0, accepted=v.where("split = 'val'"))


def l07_rotating_pool(spark: SparkSession, d: str) -> DataFrame:
    n = greedy.rotating_pool(table(spark, d, "supplier"), "s_suppkey", 1050)
    return n.groupBy("s_suppkey").agg(F.count("*").alias("draws"))


def l08_diversified(spark: SparkSession, d: str) -> DataFrame:
    """The ten sharpest frames of each recording that are at least half a metre apart at their time's pose."""
    from sensorloom.operators import asof

    b = blur(spark, d).where("rate is not null and us is not null")
    j = asof.interpolate(asof.bracket(b.select("seq", "name", "us", "rate"), poses(spark, d), "seq", "us", "us", ["x", "y", "z"], tie="line"), "us", ["x", "y", "z"])
    c = j.where("at_x is not null").select("seq", "name", "rate", *[F.col(f"at_{a}").alias(a) for a in "xyz"])
    return greedy.spaced(c, ["seq"], ["rate", "name"], "name", 0.5, most=10)


def a38_levels(spark: SparkSession, d: str) -> DataFrame:
    m = fitting.k_medians_1d(_points(spark, d).select("seq", "z"), ["seq"], "z", 4, 0.35, 0.02)
    return m.select("seq", "k", F.transform("centres", lambda c: F.round(c, 4)).alias("centres"))


def a39_kmeans(spark: SparkSession, d: str) -> DataFrame:
    return fitting.spatial_clusters(_points(spark, d).select(F.struct("seq", "line").alias("id"), "x", "y", "z"), "id", 8)[1].select("cluster", "n", "id.seq", "id.line")


def a43_plane(spark: SparkSession, d: str) -> DataFrame:
    """Floor of each recording: points half a metre below every pose and around it, cameras at the poses."""
    p = _points(spark, d).select("seq", "line", "x", "y", "z")
    g = p.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(3))))
    ground = g.select("seq", (F.col("line") * 4 + F.col("k")).alias("pid"), (F.col("x") + F.col("k") * 0.7 - 1).alias("x"), (F.col("y") + (F.col("line") % 5) * 0.4 - 1).alias("y"), F.lit(-0.5).alias("z"))
    cams = p.select("seq", "x", "y", "z")
    f = fitting.floor_plane(ground, cams, ["seq"], "pid", min_points=500, heights=(0.05, 5.0), max_spread=3.0)
    return f.select("seq", F.round("nz", 6).alias("nz"), F.round("d", 6).alias("d"), "inliers")


def a44_sim3(spark: SparkSession, d: str) -> DataFrame:
    """A known similarity, applied to the poses and solved again: scale and drift."""
    p = _points(spark, d)
    t = p.select("seq", "x", "y", "z", (-1.5 * F.col("y") + 3).alias("u"), (1.5 * F.col("x") - 2).alias("v"), (1.5 * F.col("z") + 1).alias("w"))
    s = fitting.similarity(t, ["seq"], ("x", "y", "z"), ("u", "v", "w"))
    m = F.col("tmat")
    return s.select("seq", "n", F.round("scale", 6).alias("scale"), (F.round(m[1], 5) + 0.0).alias("r01"), (F.round(m[4], 5) + 0.0).alias("r10"), F.round(m[3], 4).alias("tx"))


def j32_icp(spark: SparkSession, d: str) -> DataFrame:
    """Each recording's thinned path, shifted by 4 cm, registered onto the path."""
    p = sp.voxel_first(_points(spark, d).select("seq", "line", "x", "y", "z"), ["seq"], 0.3, "line").select("seq", "line", "x", "y", "z")
    moved = p.select("seq", "line", (F.col("x") + 0.04).alias("x"), (F.col("y") - 0.03).alias("y"), "z")
    r = fitting.register(moved, p, ["seq"], "line", 0.5, 3)
    return r.select("seq", *[F.round(c, 4).alias(c) for c in ("before", "after")], "kept", *[F.round(F.col("tmat")[i], 3).alias(n) for n, i in (("tx", 3), ("ty", 7), ("tz", 11))])


def i08_ellipsoid(spark: SparkSession, d: str) -> DataFrame:
    """Pose readings whose ellipsoid (0.2, 0.1, 0.05 m along the body's axes) holds a view."""
    p = _points(spark, d)
    rows = p.select("seq", "line", geo.rotation_to_quat(geo.rotation(F.col("tmat"))).alias("q"), "x", "y", "z", F.lit(0.2).alias("sx"), F.lit(0.1).alias("sy"), F.lit(0.05).alias("sz"))
    cams = views(spark, d).select("seq", "rec_id", *[F.col("tmat")[i].alias(c) for c, i in zip("xyz", (3, 7, 11))])
    return fitting.inside_ellipsoid(rows, cams.withColumnRenamed("rec_id", "line"), ["seq"], "line", 1.0, 0.2)


def a48_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").where("event_id is not null")
    b = rel.bootstrap_interval(e, ["event_type"], "event_id", "value")
    return b.select("event_type", *[F.round(c, 4).alias(c) for c in ("mean", "low", "high")])


QUERIES = {
    f.__name__: f
    for f in (
        s01_numeric_rows, s04_frame_pairs, s09_model_roundtrip, s21_records, s23_html_rows, w07_greedy_thin, j29_greedy_dedup, l07_rotating_pool, l08_diversified,
        a38_levels, a39_kmeans, a43_plane, a44_sim3, a48_bootstrap, i08_ellipsoid, j32_icp,
    )
}

_P = f"{POSES}, pts AS (SELECT * FROM poses WHERE abs(x) < 1000 AND abs(y) < 1000 AND abs(z) < 1000)"
ORACLE = {
    "s01_numeric_rows": "SELECT 'log/' || event_type AS path, event_id AS line_no, event_id, printf('%.3f', value)::DOUBLE AS value, 3 AS width FROM events WHERE event_id % 7 <> 0 AND event_id % 11 <> 0 AND event_id % 13 <> 0",
    "s04_frame_pairs": """WITH f AS (SELECT DISTINCT frame_id, seq, rgb_name, depth_name FROM frame_record WHERE seq IS NOT NULL AND frame_id IS NOT NULL AND depth_name IS NOT NULL)
        SELECT seq AS path, row_number() OVER (PARTITION BY seq ORDER BY frame_id) AS rn, rgb_name, depth_name, round(regexp_extract(rgb_name, '^([0-9]+)', 1)::BIGINT / 1e6, 3) AS t FROM f""",
    "s09_model_roundtrip": f"WITH {VIEWS} SELECT seq AS path, count(*) AS images, true AS same FROM views WHERE rgb_name IS NOT NULL GROUP BY seq",
    "s21_records": "SELECT 'report/' || p_brand || '/scores.json' AS path, count(*) AS records, round(max(p_retailprice / 50), 4) AS best, CAST(sum(p_size) AS BIGINT) AS n FROM part WHERE p_partkey IS NOT NULL GROUP BY p_brand",
    "s23_html_rows": "SELECT p_type AS page, regexp_replace(p_name, '\\s+', ' ', 'g') || ' [/p/' || p_partkey || ']' AS name, '& ' || p_brand AS brand FROM part",
    "a44_sim3": f"WITH {_P} SELECT seq, count(*) AS n, 1.5::DOUBLE AS scale, -1.0::DOUBLE AS r01, 1.0::DOUBLE AS r10, 3.0::DOUBLE AS tx FROM pts GROUP BY seq HAVING count(*) >= 10",
    "i08_ellipsoid": f"""WITH {_P}, {VIEWS}, c AS (SELECT seq, tmat[4] AS cx, tmat[8] AS cy, tmat[12] AS cz FROM views), j AS (SELECT p.seq, p.line, tmat AS m, cx - x AS dx, cy - y AS dy, cz - z AS dz FROM pts p JOIN c ON c.seq = p.seq AND sqrt(pow(cx - x, 2) + pow(cy - y, 2) + pow(cz - z, 2)) <= 0.2)
        SELECT DISTINCT seq, line FROM j WHERE pow((m[1] * dx + m[5] * dy + m[9] * dz) / 0.2, 2) + pow((m[2] * dx + m[6] * dy + m[10] * dz) / 0.1, 2) + pow((m[3] * dx + m[7] * dy + m[11] * dz) / 0.05, 2) <= 1""",
}

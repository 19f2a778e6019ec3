"""Queries of neighbourhood predicates, votes, histograms, projections and further sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorloom.functions import geometry as geo
from sensorloom.functions import keys
from sensorloom.operators import fitting, gating, grids
from sensorloom.operators import relational as rel
from sensorloom.operators import spatial as sp
from sensorloom.plans.base import BLUR, IMU, POSES, blur, imu, poses
from sensorloom.plans.relational import ORACLE as RELATIONAL
from sensorloom.plans.relational import _records
from sensorloom.session import table
from sensorloom.sources import text


def _points(spark: SparkSession, d: str) -> DataFrame:
    return poses(spark, d).where("abs(x) < 1000 and abs(y) < 1000 and abs(z) < 1000")


def f08_height_bands(spark: SparkSession, d: str) -> DataFrame:
    h = gating.height_over((0.0, 0.0, 1.0, -0.3), F.col("x"), F.col("y"), F.col("z"))
    p = _points(spark, d).select("seq", h.alias("h"))
    return p.groupBy("seq").agg(F.count_if(F.abs("h") < 0.05).alias("ground"), F.count_if((F.col("h") > 0.03) & (F.col("h") < 1.2)).alias("band"), F.count_if(F.col("h").between(1.2, 2.5)).alias("above"))


def _height_map(spark: SparkSession, d: str) -> DataFrame:
    return sp.with_cells(_points(spark, d), 0.5).groupBy("seq", F.col("ix").alias("u"), F.col("iy").alias("v")).agg((F.max("z") + 10).alias("top"))


def f16_depth_edges(spark: SparkSession, d: str) -> DataFrame:
    return grids.depth_edges(_height_map(spark, d), ["seq"], "top", 0.005)


def f18_isolated(spark: SparkSession, d: str) -> DataFrame:
    return grids.not_isolated(_height_map(spark, d), ["seq"], ("u", "v"), 2)


def a33_label_vote(spark: SparkSession, d: str) -> DataFrame:
    return grids.label_vote(table(spark, d, "lineitem"), ["l_partkey"], "l_returnflag", "l_quantity")


def a37_log_histogram(spark: SparkSession, d: str) -> DataFrame:
    return grids.histogram(blur(spark, d).where("rate > 0"), ["seq"], F.round(F.log10("rate"), 9), [-3.0, -2.0, -1.5, -1.0, -0.5, 0.0, 1.0])


def j34_box_merge(spark: SparkSession, d: str) -> DataFrame:
    """Boxes of every 100 readings of a recording that come within 6 cm of one another."""
    p = _points(spark, d).withColumn("part", keys.cell(F.col("line"), 100))
    b = p.groupBy("seq", "part").agg(*[f(c).alias(f"{e}_{c}") for c in "xyz" for e, f in (("lo", F.min), ("hi", F.max))])
    return grids.merge_boxes(b, ["seq"], "part", ("x", "y", "z"), 0.06, 4.0)


def x08_projections(spark: SparkSession, d: str) -> DataFrame:
    p = _points(spark, d)
    q = geo.point(F.col("x"), F.col("y"), F.col("z") + 1.5)
    f, e = geo.fisheye_project(q, 300.0, 300.0, 160.0, 120.0, (0.01, -0.002, 0.0, 0.0)), geo.equirect_project(q, 2048, 1024)
    return p.select("seq", "line", *[F.round(v[c], 3).alias(f"{n}_{c}") for n, v in (("fish", f), ("pano", e)) for c in "uv"])


def x11_transfer(spark: SparkSession, d: str) -> DataFrame:
    """Scalar curves of the discounts: logit and back, smooth ramp, shared opacity, entropy, harmonics and back."""
    a = F.col("l_discount") + 0.01
    li = table(spark, d, "lineitem")
    return li.groupBy("l_discount").agg(
        F.round(F.max(geo.sigmoid(geo.logit(a))), 9).alias("same"), F.round(F.max(geo.smoothstep(a * 5)), 9).alias("ramp"), F.round(F.max(geo.share_opacity(a, 3)), 9).alias("shared"),
        F.round(F.max(geo.binary_entropy(a)), 9).alias("entropy"), F.round(F.max(geo.harmonic_to_rgb(geo.rgb_to_harmonic(a))), 9).alias("colour"),
    )


def w19_morton_order(spark: SparkSession, d: str) -> DataFrame:
    """Readings in the order of a space-filling curve over their recording's own box, crowded cells ordered in boxes of their own, ties by line."""
    return sp.curve_order(_points(spark, d).select("seq", "line", "x", "y", "z"), ["seq"], "line").select("seq", "line", "rank")


def a56_top_level(spark: SparkSession, d: str) -> DataFrame:
    """Levels of each recording's tops: heights of cells with at least two readings, their levels, cells without evidence as their nearest, smoothed."""
    p = _points(spark, d)
    return fitting.step_levels(p.select("seq", "x", "y", "z"), ["seq"], 1.0).select("seq", "u", "v", F.round("level", 6).alias("level"))


def j34_absorb(spark: SparkSession, d: str) -> DataFrame:
    """Boxes of every 100 readings, every third of them partial: which are taken up by which."""
    p = _points(spark, d).withColumn("part", keys.cell(F.col("line"), 100))
    b = p.groupBy("seq", "part").agg(*[f(c).alias(f"{e}_{c}") for c in "xyz" for e, f in (("lo", F.min), ("hi", F.max))])
    return grids.absorb_boxes(b.withColumn("cut", F.col("part") % 3 == 0), ["seq"], "part", "cut", ("x", "y", "z"), 0.06, 4.0)


def k07_markdown(spark: SparkSession, d: str) -> DataFrame:
    return grids.markdown_rows(rel.leaderboard(_records(spark, d)), ["path", "psnr", "lpips"]).select("seq", "n", "set_name", "rank", "line")


def s03_imu_log(spark: SparkSession, d: str) -> DataFrame:
    """IMU readings written as text rows and parsed again, moved by half a second: how many, the largest rate, and the ends."""
    i = imu(spark, d).where("quat is not null")
    cols = [F.col("us").cast("string"), *[F.format_string("%.6f", c) for c in ("ox", "oy", "oz", "ax", "ay", "az")], *[F.lit("0")] * 3, *[F.format_string("%.6f", f"quat.{c}") for c in "wxyz"]]
    lines = i.select(F.col("seq").alias("path"), F.col("line").alias("line_no"), F.concat_ws(" ", *cols).alias("value"))
    r = text.imu_log(lines, 0.5)
    return r.groupBy("path").agg(F.count("*").alias("n"), F.max("omega.x").alias("fastest"), F.round(F.min("t"), 5).alias("first"), F.round(F.max("t"), 5).alias("last"), F.round(F.avg("quat.w"), 5).alias("mean_w"))


_P = f"{POSES}, pts AS (SELECT * FROM poses WHERE abs(x) < 1000 AND abs(y) < 1000 AND abs(z) < 1000)"
_MAP = f"{_P}, m AS (SELECT seq, CAST(floor(x / 0.5::DOUBLE) AS BIGINT) AS u, CAST(floor(y / 0.5::DOUBLE) AS BIGINT) AS v, max(z) + 10 AS top FROM pts GROUP BY ALL)"

QUERIES = {f.__name__: f for f in (f08_height_bands, f16_depth_edges, f18_isolated, a33_label_vote, a37_log_histogram, j34_box_merge, j34_absorb, a56_top_level, x08_projections, x11_transfer, w19_morton_order, k07_markdown, s03_imu_log)}

ORACLE = {
    "f08_height_bands": f"WITH {_P}, h AS (SELECT seq, z - 0.3::DOUBLE AS h FROM pts) SELECT seq, count(*) FILTER (WHERE abs(h) < 0.05) AS ground, count(*) FILTER (WHERE h > 0.03 AND h < 1.2) AS band, count(*) FILTER (WHERE h BETWEEN 1.2 AND 2.5) AS above FROM h GROUP BY seq",
    "f16_depth_edges": f"""WITH {_MAP}, e AS (SELECT DISTINCT a.seq, a.u, a.v FROM m a JOIN m b ON a.seq = b.seq AND abs(a.u - b.u) + abs(a.v - b.v) = 1 WHERE abs(a.top - b.top) > 0.005::DOUBLE * least(a.top, b.top) AND a.top > 0 AND b.top > 0)
        SELECT m.seq, m.u, m.v FROM m WHERE top > 0 AND EXISTS (SELECT 1 FROM e WHERE e.seq = m.seq AND abs(e.u - m.u) + abs(e.v - m.v) <= 1)""",
    "f18_isolated": f"WITH {_MAP} SELECT a.seq, a.u, a.v FROM m a JOIN m b ON a.seq = b.seq AND abs(a.u - b.u) <= 1 AND abs(a.v - b.v) <= 1 AND (a.u <> b.u OR a.v <> b.v) GROUP BY ALL HAVING count(*) >= 2",
    "a33_label_vote": "WITH s AS (SELECT l_partkey, l_returnflag, sum(l_quantity) AS q FROM lineitem GROUP BY ALL) SELECT l_partkey, l_returnflag, q AS l_quantity FROM s QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY q DESC, l_returnflag) = 1",
    "a37_log_histogram": f"""WITH {BLUR}, l AS (SELECT seq, round(log10(rate), 9) AS l FROM blur WHERE rate > 0), b AS (SELECT seq, CASE WHEN l < -3 OR l > 1 THEN NULL WHEN l < -2 THEN 0 WHEN l < -1.5 THEN 1 WHEN l < -1 THEN 2 WHEN l < -0.5 THEN 3 WHEN l < 0 THEN 4 ELSE 5 END AS bin FROM l) SELECT seq, bin, count(*) AS n FROM b WHERE bin IS NOT NULL GROUP BY ALL""",
    "j34_box_merge": f"""WITH {_P}, b AS (SELECT seq, CAST(floor(line / 100) AS BIGINT) AS part, {', '.join(f'min({c}) AS l{c}, max({c}) AS h{c}' for c in 'xyz')} FROM pts GROUP BY 1, 2)
        SELECT a.seq, a.part, o.part AS near_id FROM b a JOIN b o ON a.seq = o.seq AND a.part < o.part WHERE {' AND '.join(f'a.l{c} - o.h{c} < 0.06::DOUBLE AND o.l{c} - a.h{c} < 0.06::DOUBLE' for c in 'xyz')}""",
    "x11_transfer": """WITH a AS (SELECT DISTINCT l_discount, l_discount + 0.01::DOUBLE AS a FROM lineitem), r AS (SELECT *, greatest(0, least(1, a * 5)) AS c FROM a)
        SELECT l_discount, round(a, 9) AS same, round(c * c * (3 - 2 * c), 9) AS ramp, round(1 - pow(1 - a, 1 / 3), 9) AS shared, round(-(a * ln(a) + (1 - a) * ln(1 - a)), 9) AS entropy, round(a, 9) AS colour FROM r""",
}


def _curve_sql(name: str, rows: str, group: str) -> str:
    """Rows with `{name}`: the code of the curve over the box of their group; 0 where the box is a point."""
    cell = lambda c: f"CASE WHEN h{c} > l{c} THEN CAST(least(1023, floor(({c} - l{c}) * (1024.0::DOUBLE / (h{c} - l{c})))) AS BIGINT) ELSE 0 END"
    code = " + ".join(f"list_sum(list_transform(range(10), lambda i: ((k{c} >> i) & 1) << (3 * i + {n})))" for n, c in enumerate("xyz"))
    ends = ", ".join(f"min({c}) OVER (PARTITION BY {group}) AS l{c}, max({c}) OVER (PARTITION BY {group}) AS h{c}" for c in "xyz")
    return f"SELECT * EXCLUDE (kx, ky, kz), CAST({code} AS BIGINT) AS {name} FROM (SELECT * EXCLUDE ({', '.join(f'l{c}, h{c}' for c in 'xyz')}), {', '.join(f'{cell(c)} AS k{c}' for c in 'xyz')} FROM (SELECT *, {ends} FROM {rows}))"


# Two rounds of the curve, which are enough here; the operator goes on while cells are crowded.
ORACLE["w19_morton_order"] = f"""WITH {_P}, a AS ({_curve_sql('c1', '(SELECT seq, line, x, y, z FROM pts)', 'seq')}), b AS ({_curve_sql('c2', 'a', 'seq, c1')}),
  n AS (SELECT *, count(*) OVER (PARTITION BY seq, c1) AS k FROM b) SELECT seq, line, row_number() OVER (PARTITION BY seq ORDER BY c1, CASE WHEN k > 256 THEN c2 ELSE 0 END, line) AS rank FROM n"""
ORACLE["x08_projections"] = f"""WITH {_P}, a AS (SELECT seq, line, x, y, z + 1.5::DOUBLE AS z, sqrt(x * x + y * y) AS r, sqrt(x * x + y * y + (z + 1.5::DOUBLE) * (z + 1.5::DOUBLE)) AS n FROM pts), t AS (SELECT *, atan2(r, z) AS th FROM a),
  k AS (SELECT *, CASE WHEN r > 1e-12 THEN th * (1 + th * th * (0.01::DOUBLE + th * th * -0.002::DOUBLE)) / r ELSE 1 END AS ratio FROM t)
  SELECT seq, line, round(300.0::DOUBLE * x * ratio + 160, 3) AS fish_u, round(300.0::DOUBLE * y * ratio + 120, 3) AS fish_v, round((atan2(x, z) / (2 * pi()) + 0.5::DOUBLE) * 2048, 3) AS pano_u, round((asin(y / n) / pi() + 0.5::DOUBLE) * 1024, 3) AS pano_v FROM k"""
ORACLE["s03_imu_log"] = f"""WITH {IMU} SELECT seq AS path, count(*) AS n, max(printf('%.6f', ox)::DOUBLE) AS fastest, round(min(us) / 1e6 + 0.5::DOUBLE, 5) AS first, round(max(us) / 1e6 + 0.5::DOUBLE, 5) AS last, round(avg(printf('%.6f', quat.w)::DOUBLE), 5) AS mean_w FROM imu WHERE quat IS NOT NULL GROUP BY seq"""
ORACLE["k07_markdown"] = RELATIONAL["a20_leaderboard"].replace(
    "SELECT seq, n, set_name, rank, path, round(psnr, 6) AS psnr, best, group_size FROM w",
    "SELECT seq, n, set_name, rank, '| ' || path || ' | ' || coalesce(printf('%.4f', psnr), '') || ' | ' || coalesce(printf('%.4f', lpips), '') || CASE WHEN best THEN ' *' ELSE '' END || ' |' AS line FROM w",
)

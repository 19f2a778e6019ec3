"""Clean sensor tables for the queries, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorloom.operators.regular_grid import micros, present
from sensorloom.session import table


def poses(spark: SparkSession, d: str) -> DataFrame:
    """Valid pose readings, each once: seq, line, us, tmat, x, y, z."""
    p = table(spark, d, "pose_track")
    m = F.col("tmat")
    whole = (F.size(m) >= 12) & F.forall(F.slice(m, 1, 12), lambda v: v.isNotNull() & ~F.isnan(v))
    p = p.where(F.col("seq").isNotNull() & F.col("line").isNotNull() & present(F.col("t")) & whole).dropDuplicates(["seq", "line"])
    return p.select("seq", "line", micros(F.col("t")).alias("us"), "tmat", m[3].alias("x"), m[7].alias("y"), m[11].alias("z"))


def imu(spark: SparkSession, d: str) -> DataFrame:
    """Valid IMU readings, each once: seq, line, us, ox..oz, ax..az, w, quat."""
    i = table(spark, d, "imu_track")
    v = [F.col(f"{k}.{a}") for k in ("omega", "accel") for a in "xyz"]
    i = i.where(F.col("seq").isNotNull() & F.col("line").isNotNull() & present(F.col("t"), *v)).dropDuplicates(["seq", "line"])
    cols = [c.alias(n) for c, n in zip(v, ("ox", "oy", "oz", "ax", "ay", "az"))]
    return i.select("seq", "line", micros(F.col("t")).alias("us"), *cols, "quat")


def frames(spark: SparkSession, d: str) -> DataFrame:
    """Frames with seq and time, each once: frame_id, seq, us, depth_us, rgb_name."""
    f = table(spark, d, "frame_record").where(F.col("seq").isNotNull() & F.col("frame_id").isNotNull() & present(F.col("t"))).dropDuplicates(["frame_id"])
    return f.select("frame_id", "seq", micros(F.col("t")).alias("us"), F.coalesce(micros(F.col("t_depth")), micros(F.col("t"))).alias("depth_us"), "rgb_name")


def blur(spark: SparkSession, d: str) -> DataFrame:
    """Blur rates, each frame once: seq, name, us, rate (null where unknown), omega."""
    b = table(spark, d, "per_frame").where("seq is not null and name is not null").dropDuplicates(["seq", "name"])
    r = F.col("rate_px_per_ms_med")
    known = r.isNotNull() & ~F.isnan(r) & (r >= 0) & (r < float("inf"))
    return b.select("seq", "name", micros(F.col("t")).alias("us"), "used", F.when(known, r).alias("rate"), F.nanvl("omega_imu", F.lit(None).cast("double")).alias("omega"))


def views(spark: SparkSession, d: str) -> DataFrame:
    """Posed records, each once: rec_id, seq, split, tmat (at least twelve values)."""
    s = table(spark, d, "split_frames").where(F.col("seq").isNotNull() & F.col("rec_id").isNotNull() & (F.size("tmat") >= 12)).dropDuplicates(["rec_id"])
    return s.select("rec_id", "seq", "split", "rgb_name", "tmat")


POSES = """poses AS (SELECT DISTINCT seq, line, CAST(round(t * 1e6) AS BIGINT) AS us, tmat, tmat[4] AS x, tmat[8] AS y, tmat[12] AS z FROM pose_track
  WHERE seq IS NOT NULL AND line IS NOT NULL AND t IS NOT NULL AND NOT isnan(t) AND len(list_filter(tmat[1:12], lambda v: v IS NOT NULL AND NOT isnan(v))) = 12)"""
_PRESENT = " AND ".join(f"{k}.{a} IS NOT NULL AND NOT isnan({k}.{a})" for k in ("omega", "accel") for a in "xyz")
IMU = f"""imu AS (SELECT DISTINCT seq, line, CAST(round(t * 1e6) AS BIGINT) AS us, omega.x AS ox, omega.y AS oy, omega.z AS oz, accel.x AS ax, accel.y AS ay, accel.z AS az, quat FROM imu_track
  WHERE seq IS NOT NULL AND line IS NOT NULL AND t IS NOT NULL AND NOT isnan(t) AND {_PRESENT})"""
FRAMES = """frames AS (SELECT DISTINCT frame_id, seq, CAST(round(t * 1e6) AS BIGINT) AS us, coalesce(CAST(round(CASE WHEN NOT isnan(t_depth) THEN t_depth END * 1e6) AS BIGINT), CAST(round(t * 1e6) AS BIGINT)) AS depth_us, rgb_name
  FROM frame_record WHERE seq IS NOT NULL AND frame_id IS NOT NULL AND t IS NOT NULL AND NOT isnan(t))"""
BLUR = """blur AS (SELECT seq, name, any_value(us) AS us, any_value(used) AS used, any_value(rate) AS rate, any_value(omega) AS omega FROM (
  SELECT seq, name, CAST(round(t * 1e6) AS BIGINT) AS us, used, CASE WHEN NOT isnan(rate_px_per_ms_med) AND NOT isinf(rate_px_per_ms_med) AND rate_px_per_ms_med >= 0 THEN rate_px_per_ms_med END AS rate,
    CASE WHEN NOT isnan(omega_imu) THEN omega_imu END AS omega FROM per_frame WHERE seq IS NOT NULL AND name IS NOT NULL) GROUP BY seq, name)"""
VIEWS = """views AS (SELECT rec_id, any_value(seq) AS seq, any_value(split) AS split, any_value(rgb_name) AS rgb_name, any_value(tmat) AS tmat FROM split_frames
  WHERE seq IS NOT NULL AND rec_id IS NOT NULL AND len(tmat) >= 12 GROUP BY rec_id)"""

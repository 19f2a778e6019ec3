"""A recording with known truth: a body on a smooth path, its pose track, gyro and frames, each on a clock of its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorloom.functions import geometry as geo

START_US = 1_700_000_000_000_000


def _noise(seed: int, *keys: Column) -> Column:
    """About normal, from hashes: the same whatever the partitioning."""
    parts = [F.pmod(F.xxhash64(*keys, F.lit(seed), F.lit(k)), F.lit(1 << 20)) / float(1 << 20) for k in range(4)]
    return (sum(parts[1:], parts[0]) - 2.0) * 3**0.5


def yaw_rate(t: Column) -> Column:
    """True turning rate about the upright axis, rad/s."""
    return 0.6 + 0.25 * F.sin(2.3 * t) + 0.15 * F.sin(11.0 * t + 1.0)


def true_pose(t: Column) -> Column:
    """True body-to-world transform at t seconds from the start: a loop in the plane, turning by the integral of yaw_rate."""
    yaw = 0.6 * t - 0.25 / 2.3 * (F.cos(2.3 * t) - 1) - 0.15 / 11.0 * (F.cos(11.0 * t + 1.0) - F.cos(F.lit(1.0)))
    half = yaw / 2
    q = geo.quat(F.cos(half), 0.0, 0.0, F.sin(half))
    return geo.transform(geo.quat_to_rotation(q), geo.point(2.5 * F.cos(0.4 * t), 2.5 * F.sin(0.4 * t), 1.0 + 0.1 * F.sin(0.9 * t)))


def sequence(
    spark: SparkSession, name: str, seconds: float, seed: int = 0, pose_hz: int = 120, imu_hz: int = 400, frame_hz: int = 20, imu_offset_us: int = 0, depth_offset_us: int = 4_000, gyro_noise: float = 0.0,
) -> dict[str, DataFrame]:
    """{"pose_track", "imu_track", "frame_record", "truth"} with the columns of these tables.

    Gyro stamps are imu_offset_us late against the event clock. truth has frame_id and tmat at
    the frame's time. Rows come from spark.range, so long sequences are made by all tasks.
    """

    def ticks(hz: int) -> DataFrame:
        n = int(seconds * hz) + 1
        return spark.range(n).select(F.col("id").alias("line"), F.round(F.col("id") * (1e6 / hz)).cast("bigint").alias("_us")).withColumn("_t", F.col("_us") / 1e6)

    def stamp(us: Column) -> Column:
        return (us + START_US) / 1e6

    seq, at = F.lit(name).alias("seq"), F.timestamp_micros(F.col("_us") + START_US).alias("recv_at")
    pose = ticks(pose_hz).select(seq, "line", stamp(F.col("_us")).alias("t"), true_pose(F.col("_t")).alias("tmat"), at)
    o = yaw_rate(F.col("_t")) + gyro_noise * _noise(seed, F.col("line"))
    flat = [gyro_noise * _noise(seed + k, F.col("line")) for k in (1, 2)]
    gyro = F.struct(flat[0].alias("x"), flat[1].alias("y"), o.alias("z"))
    down = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(9.81).alias("z"))
    turn = geo.rotation_to_quat(geo.rotation(F.col("_m")))
    imu = ticks(imu_hz).withColumn("_m", true_pose(F.col("_t"))).select(seq, "line", stamp(F.col("_us") + imu_offset_us).alias("t"), gyro.alias("omega"), down.alias("accel"), turn.alias("quat"), at)
    f = ticks(frame_hz).withColumnRenamed("line", "frame_id")
    label = (F.col("_us") + START_US).cast("string")
    frames = f.select("frame_id", seq, stamp(F.col("_us")).alias("t"), F.concat(label, F.lit("_rgb.png")).alias("rgb_name"), F.concat(label, F.lit("_depth_rgb.png")).alias("depth_name"), stamp(F.col("_us") + depth_offset_us).alias("t_depth"), at)
    return {"pose_track": pose, "imu_track": imu, "frame_record": frames, "truth": f.select("frame_id", true_pose(F.col("_t")).alias("tmat"))}

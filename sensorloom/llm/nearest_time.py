"""Matching records by nearest time (problem 4), by tick expansion.

Right readings are exploded to every discrete tick within the tolerance of them. Of the
readings outside a tick only the latest before and the earliest after it can be nearest
to a time inside it, so each (entity, tick) keeps those two and its own readings. Left
times meet their tick by an equi-join and take the nearest of the few candidates. All
times are whole microseconds, so comparisons with the tolerance are exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.operators.regular_grid import floor_div, micros


def nearest_in_time(
    left: DataFrame, right: DataFrame, tolerance_us: int, left_time: str, right_time: str, left_id: str, right_id: str,
    entity: str = "seq", tick_us: int | None = None,
) -> DataFrame:
    """(left_id, right_id, distance_us) of the nearest right row of the same entity within the tolerance.

    Times are columns of whole microseconds. Left and right rows with a null entity or time
    take no part; left rows with nothing near enough have no row; of equally near readings
    the earlier, then the one with the smaller id, is taken. Repeated rows count once; empty
    tables give an empty result; further columns, also with the same names on both sides,
    are dropped. Keys are (entity, tick), so an entity with a third of all rows spreads over
    all tasks, and the readings kept of a tick are reduced before the shuffle and bounded
    by its microseconds. tick_us (default: four tolerances) trades copies for candidates.
    """
    tick = tick_us or 4 * tolerance_us
    r = right.select(F.col(entity).alias("entity"), F.col(right_time).alias("rt"), F.col(right_id).alias("rid")).where("entity is not null and rt is not null")
    first, last = floor_div(F.col("rt") - tolerance_us, tick), floor_div(F.col("rt") + tolerance_us, tick)
    r = r.withColumn("tick", F.explode(F.sequence(first, last)))
    start = F.col("tick") * tick
    me = F.struct("rt", "rid")
    before, after = F.col("rt") < start, F.col("rt") >= start + tick
    latest = F.max(F.when(before, F.struct(F.col("rt"), (-F.col("rid")).alias("neg"))))
    kept = r.groupBy("entity", "tick").agg(
        latest.alias("before"), F.min(F.when(after, me)).alias("after"), F.collect_set(F.when(~before & ~after, me)).alias("inside")
    )
    ls = left.select(F.col(entity).alias("entity"), F.col(left_time).alias("lt"), F.col(left_id).alias("lid")).where("entity is not null and lt is not null")
    ls = ls.withColumn("tick", floor_div(F.col("lt"), tick))
    joined = ls.join(kept, ["entity", "tick"])
    back = F.when(F.col("before").isNotNull(), F.struct(F.col("before.rt").alias("rt"), (-F.col("before.neg")).alias("rid")))
    candidates = F.array_compact(F.concat(F.array(back, F.col("after")), F.col("inside")))
    ranked = F.transform(candidates, lambda c: F.struct(F.abs(c["rt"] - F.col("lt")).alias("d"), c["rt"].alias("rt"), c["rid"].alias("rid")))
    best = joined.select("lid", F.array_min(F.filter(ranked, lambda c: c["d"] <= tolerance_us)).alias("b")).where("b is not null")
    return best.select(F.col("lid").alias(left_id), F.col("b.rid").alias(right_id), F.col("b.d").alias("distance_us"))


def match_frames(frames: DataFrame, poses: DataFrame, imu: DataFrame, pose_tolerance_us: int = 20_000, imu_tolerance_us: int = 8_000) -> DataFrame:
    """(frame_id, clock, line, distance_us): nearest pose to t and to t_depth (t where null) and nearest IMU reading to t.

    Re-delivered frames count once. Both pose clocks share one expansion of the pose track.
    """
    f = frames.where("frame_id is not null and seq is not null").select("frame_id", "seq", micros(F.col("t")).alias("t"), micros(F.col("t_depth")).alias("t_depth"))
    f = f.groupBy("frame_id", "seq").agg(F.min("t").alias("t"), F.min("t_depth").alias("t_depth"))
    clocks = F.explode(F.array(F.struct(F.lit("rgb_pose").alias("clock"), F.col("t").alias("at")), F.struct(F.lit("depth_pose").alias("clock"), F.coalesce("t_depth", "t").alias("at"))))
    to_pose = f.select("frame_id", "seq", clocks.alias("c")).select(F.struct("frame_id", "c.clock").alias("key"), "seq", F.col("c.at").alias("at"))
    to_imu = f.select(F.struct("frame_id", F.lit("rgb_imu").alias("clock")).alias("key"), "seq", F.col("t").alias("at"))

    def readings(df: DataFrame) -> DataFrame:
        return df.where("line is not null").select("seq", "line", micros(F.col("t")).alias("at"))

    a = nearest_in_time(to_pose, readings(poses), pose_tolerance_us, "at", "at", "key", "line")
    b = nearest_in_time(to_imu, readings(imu), imu_tolerance_us, "at", "at", "key", "line")
    return a.unionByName(b).select("key.frame_id", "key.clock", "line", "distance_us")

"""Recorded message logs: routing by topic, thinning and registration of scans.

A bag comes as a table of decoded messages (bag, topic, n, stamp_ns, and a payload), n in
the order of the log; `scan_points` of binary.py decodes the payload of scans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sensorloom.functions import geometry as geo
from sensorloom.operators import asof


def route(messages: DataFrame, topics: dict[str, str]) -> dict[str, DataFrame]:
    """One DataFrame a sink name: the messages of its topic. Asking for a topic that no bag has is found by `missing_topics`."""
    return {name: messages.where(F.col("topic") == topic) for name, topic in topics.items()}


def missing_topics(messages: DataFrame, topics: list[str]) -> DataFrame:
    """(bag, topic) of the wanted topics that a bag lacks."""
    bags = messages.select("bag").distinct()
    wanted = bags.select("bag", F.explode(F.array(*[F.lit(t) for t in topics])).alias("topic"))
    return wanted.join(messages.select("bag", "topic").distinct(), ["bag", "topic"], "left_anti")


def every_nth(messages: DataFrame, step: int) -> DataFrame:
    """Every step-th message of each bag and topic in the order of the log, the first included; `k` numbers those kept."""
    from sensorloom.operators.ordered import running

    r = running(messages, ["bag", "topic"], "n", [], name="rn", block=1 << 16)
    return r.where(F.col("rn") % step == 0).withColumn("k", (F.col("rn") / step).cast("bigint")).drop("rn")


def offset_seconds(config: dict, key: str) -> float:
    """The stated clock offset; an error where none is set, as a silent default would misplace every scan."""
    value = (config.get("timestamps", {}).get("offsets_s") or {}).get(key)
    if value is None:
        raise ValueError(f"timestamps.offsets_s.{key} is not set; set it to 0.0 for a synchronised sensor")
    return float(value)


def point_times(stamp_s: Column, rel_s: Column, last_rel_s: Column, stamped: str = "end") -> Column:
    """Absolute time of a scan's points from their time since its start: the scan's stamp is that of its last point, or of its first."""
    if stamped not in ("end", "start"):
        raise ValueError("a scan is stamped at its end or its start")
    return stamp_s - (last_rel_s - rel_s) if stamped == "end" else stamp_s + rel_s


def registered_scans(points: DataFrame, poses: DataFrame, sensor: Column, config: dict, key: str, stride: int = 1) -> DataFrame:
    """(seq, scan, us, world, x, y, z): points in the sensor's frame with the sensor-to-world transform of their scan.

    points has seq, scan (in order), stamp_us, x, y, z; poses seq, us, line, tmat (body to
    world); sensor is the constant sensor-to-body transform. Every stride-th scan is kept; its
    stamp is moved by the configured offset; scans outside the pose track, and scans without a
    point in range, have no rows. Only one row a scan goes through the as-of join.
    """
    shift = round(offset_seconds(config, key) * 1e6)
    scans = points.groupBy("seq", "scan").agg(F.min("stamp_us").alias("stamp_us"))
    w = Window.partitionBy("seq").orderBy("scan")  # one row a scan
    scans = scans.withColumn("rn", F.row_number().over(w) - 1).where(F.col("rn") % stride == 0).select("seq", "scan", (F.col("stamp_us") + shift).alias("us"))
    b = asof.bracket(scans, poses, "seq", "us", "us", ["tmat"], tie="line").where("before is not null and after is not null")
    w = asof.weight(F.col("us"))
    # One step a column: a rotation is used nine times by the next, and nested expressions would multiply.
    b = b.withColumn("w", w).withColumn("p", geo.rotation_to_quat(geo.rotation(F.col("before.tmat")))).withColumn("q", geo.rotation_to_quat(geo.rotation(F.col("after.tmat"))))
    b = b.withColumn("turn", geo.slerp(F.col("p"), F.col("q"), F.col("w"))).withColumn("r", geo.quat_to_rotation(F.col("turn")))
    at = F.array(*[F.col("before.tmat")[i] + (F.col("after.tmat")[i] - F.col("before.tmat")[i]) * F.col("w") for i in (3, 7, 11)])
    b = b.withColumn("at", at).withColumn("body", geo.transform(F.col("r"), geo.point(*[F.col("at")[i] for i in range(3)])))
    b = b.withColumn("world", geo.compose(F.col("body"), sensor))
    return points.select("seq", "scan", "x", "y", "z").join(b.select("seq", "scan", "us", "world"), ["seq", "scan"])

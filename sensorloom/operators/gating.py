"""Gates and predicates over frames: ranges, motion, preamble, crops and funnels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorloom.operators import asof


def rate_at(frames: DataFrame, imu: DataFrame, at: str = "us") -> DataFrame:
    """frames with omega: the gyro's three axes interpolated at the frame's time, clamped to the track, then their norm."""
    axes = ["ox", "oy", "oz"]
    b = asof.interpolate(asof.bracket(frames, imu, "seq", at, "us", axes, tie="line"), at, axes, outside="clamp")
    norm = F.sqrt(sum((F.col(f"at_{c}") ** 2 for c in axes[1:]), F.col("at_ox") ** 2))
    return b.withColumn("omega", norm).select(*frames.columns, "omega")


def inside_track(frames: DataFrame, poses: DataFrame) -> DataFrame:
    """Frames whose both stamps lie in the pose track's closed range."""
    r = poses.groupBy("seq").agg(F.min("us").alias("_lo"), F.max("us").alias("_hi"))
    return frames.join(r, "seq").where(F.col("us").between(F.col("_lo"), F.col("_hi")) & F.col("depth_us").between(F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")


def motion_gate(df: DataFrame, entity: str, rate: str, fraction: float, sharp: Column | None = None, digits: int = 6) -> DataFrame:
    """df with threshold and kept: rate at most the entity's percentile over all its rows, and `sharp`.

    The percentile interpolates; it is rounded so that equal data gate alike everywhere.
    """
    t = df.groupBy(entity).agg(F.round(F.percentile(rate, fraction), digits).alias("threshold"))
    kept = F.coalesce(F.col(rate) <= F.col("threshold"), F.lit(False))
    return df.join(t, entity).withColumn("kept", kept & sharp if sharp is not None else kept)


def drop_preamble(df: DataFrame, ends: DataFrame, entity: str, at: str, kept: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows after their entity's end_us, per entity the number of rows up to it). Entities without an end keep all; only rows with `kept` are counted."""
    j = df.join(ends.select(entity, F.col("end_us").alias("_end")), entity, "left")
    early = F.coalesce(F.col(at) <= F.col("_end"), F.lit(False))
    counted = early & kept if kept is not None else early
    return j.where(~early).drop("_end"), j.groupBy(entity).agg(F.count_if(counted).alias("dropped"))


def funnel(df: DataFrame, entity: list[str], tests: list[tuple[str, Column]]) -> DataFrame:
    """Per entity how many rows are left after each test and all before it."""
    aggs, sofar = [F.count("*").alias("all")], F.lit(True)
    for name, test in tests:
        sofar = sofar & F.coalesce(test, F.lit(False))
        aggs.append(F.count_if(sofar).alias(name))
    return df.groupBy(*entity).agg(*aggs)


def robust_box(df: DataFrame, entity: list[str], axes: list[str], low: float, high: float) -> DataFrame:
    """(entity, lo_axis, hi_axis): interpolated percentiles of each axis."""
    return df.groupBy(*entity).agg(*[F.percentile(c, q).alias(f"{n}_{c}") for c in axes for n, q in (("lo", low), ("hi", high))])


def percentile_crop(df: DataFrame, entity: list[str], axes: list[str], low: float, high: float, pad: float) -> DataFrame:
    """Rows inside the entity's percentile box widened by pad."""
    j = df.join(robust_box(df, entity, axes, low, high), entity)
    for c in axes:
        j = j.where(F.col(c).between(F.col(f"lo_{c}") - pad, F.col(f"hi_{c}") + pad))
    return j.select(*df.columns)


def depth_metres(raw: Column, unit: float, invalid: int, nearest: float, furthest: float) -> Column:
    """Metres of a raw depth; null where it is the invalid code or outside of the closed range."""
    m = raw * unit
    return F.when((raw != invalid) & m.between(nearest, furthest), m)


def lidar_range(x: Column, y: Column, z: Column, nearest: float, furthest: float) -> Column:
    """Finite and strictly between both ranges."""
    r = F.sqrt(x * x + y * y + z * z)
    return F.coalesce(~F.isnan(r) & (r > nearest) & (r < furthest), F.lit(False))


def in_frustum(uvz: Column, width: int, height: int, min_z: float = 0.05) -> Column:
    return F.coalesce((uvz["z"] > min_z) & (uvz["u"] >= 0) & (uvz["u"] < width) & (uvz["v"] >= 0) & (uvz["v"] < height), F.lit(False))


def faces(normal: Column, ray: Column, max_degrees: float) -> Column:
    """Whether a surface normal is within max_degrees of the direction back along the ray (both structs x, y, z; unit)."""
    cos = -(normal["x"] * ray["x"] + normal["y"] * ray["y"] + normal["z"] * ray["z"])
    return cos > F.cos(F.radians(F.lit(max_degrees)))


def height_over(plane: tuple[float, float, float, float], x: Column, y: Column, z: Column) -> Column:
    """n·p + d of a plane (nx, ny, nz, d)."""
    return plane[0] * x + plane[1] * y + plane[2] * z + plane[3]


def shape_class(scales: Column, needle: float = 10.0, flat: float = 0.1, giant: float = 0.5) -> Column:
    """needle (longest over `needle` times the middle), disc (shortest under `flat` times the middle), giant (longest over `giant` metres) or round."""
    s = F.array_sort(scales)
    return F.when(s[2] > giant, "giant").when(s[2] > needle * s[1], "needle").when(s[0] < flat * s[1], "disc").otherwise("round")


def solid_and_small(opacity: Column, log_scales: Column, least: float, longest: float) -> Column:
    """Whether the sigmoid of an opacity is at least `least` and the longest axis of log scales at most `longest`; null is no."""
    return F.coalesce((1 / (1 + F.exp(-opacity)) >= least) & (F.exp(F.array_max(log_scales)) <= longest), F.lit(False))


def verdict(df: DataFrame, entity: list[str], checks: list[tuple[str, Column, str, float]]) -> DataFrame:
    """(entity, check, value, limit, ok): value <= or >= limit; null and NaN fail. All checks of an entity in `passed`."""
    rows = F.array(*[F.struct(F.lit(n).alias("check"), v.cast("double").alias("value"), F.lit(float(lim)).alias("limit"),
        F.coalesce(~F.isnan(v.cast("double")) & ((v <= lim) if op == "<=" else (v >= lim)), F.lit(False)).alias("ok")) for n, v, op, lim in checks])
    return df.select(*entity, F.explode(rows).alias("c"), F.forall(rows, lambda r: r["ok"]).alias("passed")).select(*entity, "c.*", "passed")

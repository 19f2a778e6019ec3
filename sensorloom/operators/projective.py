"""Joins and aggregations through a camera or a scanner: visibility, z-buffers, votes, compositing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sensorloom.functions import geometry as geo
from sensorloom.operators import cameras as cam
from sensorloom.session import estimated_bytes

MAX_BROADCAST = 64 << 20


def seen_from(points: DataFrame, cameras: DataFrame, by: list[str], camera_id: str, fx: float, fy: float, cx: float, cy: float, width: int, height: int, min_z: float = 0.05, reach: float | None = None) -> DataFrame:
    """points x cameras of the same `by` whose projection falls into the image: adds camera_id, u, v (pixels, rounded down), z, range.

    cameras has tmat, camera to world. The join is on `by`; cameras are broadcast only while
    Catalyst's estimate of their size is under a fixed bound.
    """
    c = cameras.select(*by, camera_id, F.col("tmat").alias("_m"))
    if estimated_bytes(c) <= MAX_BROADCAST:
        c = F.broadcast(c)
    j = points.join(c, by)
    p = geo.apply_inverse(F.col("_m"), geo.point(F.col("x"), F.col("y"), F.col("z")))
    j = j.withColumn("_p", p).where(F.col("_p.z") > min_z)
    u, v = F.floor(fx * F.col("_p.x") / F.col("_p.z") + cx).cast("int"), F.floor(fy * F.col("_p.y") / F.col("_p.z") + cy).cast("int")
    r = F.sqrt(F.col("_p.x") ** 2 + F.col("_p.y") ** 2 + F.col("_p.z") ** 2)
    j = j.withColumn("u", u).withColumn("v", v).withColumn("z", F.col("_p.z")).withColumn("range", r)
    j = j.where(F.col("u").between(0, width - 1) & F.col("v").between(0, height - 1))
    if reach is not None:
        j = j.where(F.col("range") <= reach)
    return j.drop("_m", "_p")


def z_buffer(hits: DataFrame, pixel: list[str], min_hits: int = 1) -> DataFrame:
    """Nearest depth of each pixel with at least min_hits returns."""
    return hits.groupBy(*pixel).agg(F.min("z").alias("z"), F.count("*").alias("hits")).where(F.col("hits") >= min_hits)


def splat(hits: DataFrame, fx: float, voxel: float, width: int, height: int, smallest: int = 1, largest: int = 6) -> DataFrame:
    """hits copied to the square of pixels their size covers: du, dv and radius are added, u and v moved."""
    radius = F.greatest(F.lit(smallest), F.least(F.lit(largest), F.ceil(0.5 * fx * voxel / F.col("z")))).cast("int")
    s = hits.withColumn("radius", radius)
    steps = F.sequence(1 - F.col("radius"), F.col("radius") - 1)
    s = s.withColumn("du", F.explode(steps)).withColumn("dv", F.explode(steps))
    s = s.withColumn("u", F.col("u") + F.col("du")).withColumn("v", F.col("v") + F.col("dv"))
    return s.where(F.col("u").between(0, width - 1) & F.col("v").between(0, height - 1))


def surface_depth(splats: DataFrame, pixel: list[str], slack: float = 1.02) -> DataFrame:
    """Weighted harmonic mean depth of the returns within `slack` of the nearest, weights falling with the distance from the pixel."""
    w = Window.partitionBy(*pixel)
    s = splats.withColumn("_z0", F.min("z").over(w)).where(F.col("z") <= slack * F.col("_z0"))
    sigma = 0.5 * F.col("radius")
    weight = F.exp(-(F.col("du") ** 2 + F.col("dv") ** 2) / (2 * sigma * sigma))
    return s.groupBy(*pixel).agg((F.sum(weight) / F.sum(weight / F.col("z"))).alias("depth"), F.min("z").alias("z0"), F.count("*").alias("hits"))


def supported(depth: DataFrame, image: list[str], slack: float = 1.05, support: int = 5) -> DataFrame:
    """Pixels not behind a nearer one in 5x5 by more than slack, with more than `support` such pixels in their 3x3, themselves included."""

    def around(df: DataFrame, reach: int) -> DataFrame:
        o = F.sequence(F.lit(-reach), F.lit(reach))
        d = df.withColumn("_a", F.explode(o)).withColumn("_b", F.explode(o))
        return d.withColumn("u", F.col("u") + F.col("_a")).withColumn("v", F.col("v") + F.col("_b")).drop("_a", "_b")

    low = around(depth.select(*image, "u", "v", "z0"), 2).groupBy(*image, "u", "v").agg(F.min("z0").alias("_low"))
    ok = depth.join(low, [*image, "u", "v"]).where(F.col("z0") <= slack * F.col("_low")).drop("_low")
    n = around(ok.select(*image, "u", "v"), 1).groupBy(*image, "u", "v").agg(F.count("*").alias("_n"))
    return ok.join(n, [*image, "u", "v"]).where(F.col("_n") > support).drop("_n")


def nearest_payload(hits: DataFrame, pixel: list[str], payload: list[str], tie: str) -> DataFrame:
    """Payload of the nearest hit of each pixel; of equal depths the smallest `tie`."""
    return hits.groupBy(*pixel).agg(F.min_by(F.struct(*payload), F.struct("z", tie)).alias("_p")).select(*pixel, "_p.*")


def visibility(range_: Column, depth: Column, rule: str, tolerance: float = 0.05, alpha: Column | None = None, solid: float = 0.98, hidden: float = 0.15, cos_incidence: Column | None = None, min_cos: float = 0.0) -> Column:
    """Whether a point at `range_` is seen where the image holds `depth` (null or <= 0: none).

    surface: a depth, and the point within tolerance of it. open: no depth, or not behind it by
    more than the tolerance. fill: open, or a see-through pixel, or hidden by less than `hidden`
    metres. facing: fill, and the incidence is steep enough.
    """
    none = depth.isNull() | (depth <= 0)
    if rule == "surface":
        return F.coalesce(~none & (F.abs(range_ - depth) < tolerance * depth), F.lit(False))
    if rule == "open":
        return F.coalesce(none | (range_ <= depth * (1 + tolerance)), F.lit(False))
    fill = none | (range_ < depth * (1 + tolerance)) | (range_ < depth + hidden)
    if alpha is not None:
        fill = fill | (alpha < solid)
    if rule == "facing":
        fill = fill & (F.abs(cos_incidence) >= min_cos)
    return F.coalesce(fill, F.lit(False))


def range_image(scans: DataFrame, scan: str, az_step: float, ring: Column, farthest: bool = False) -> DataFrame:
    """(scan, ring, az, m): nearest (or farthest) return of each bin; scans has x, y, z in the sensor's frame."""
    r = F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2)
    b = scans.select(scan, ring.alias("ring"), geo.azimuth_bin(F.col("x"), F.col("y"), az_step).alias("az"), r.alias("r")).where("ring is not null")
    return b.groupBy(scan, "ring", "az").agg((F.max("r") if farthest else F.min("r")).alias("m"))


def see_through_votes(cloud: DataFrame, image: DataFrame, scan: str, point_id: str, base: float = 0.10, slope: float = 0.01, min_free: int = 3, ratio: float = 2.0) -> DataFrame:
    """(point_id, free, hit, dynamic): cloud has scan, ring, az, r of each point in each scan.

    A point is free in a scan if its bin's return lies behind it by more than base + slope·r,
    hit if within it; a bin without a return does not vote. dynamic: free >= min_free and
    more than `ratio` times the hits.
    """
    margin = base + slope * F.col("r")
    j = cloud.join(image, [scan, "ring", "az"])
    g = j.groupBy(point_id).agg(F.count_if(F.col("m") > F.col("r") + margin).alias("free"), F.count_if(F.abs(F.col("m") - F.col("r")) <= margin).alias("hit"))
    return g.withColumn("dynamic", (F.col("free") >= min_free) & (F.col("free") > ratio * F.col("hit")))


def scans_near(points: DataFrame, scans: DataFrame, by: list[str], reach: float) -> DataFrame:
    """points x scans of the same `by` whose origin may lie within `reach`: scans has tmat (sensor to world), taken along as `_sensor`.

    Scans are copied to the 27 cells of that size around their origin and meet points by cell,
    so the pairs grow with the points near each scan, not with the length of the recording.
    """
    from sensorloom.operators.spatial import neighbour_cells, with_cells

    names = [c for c in scans.columns if c not in (*by, "tmat")]
    s = scans.select(*by, *names, F.col("tmat").alias("_sensor"), *[F.col("tmat")[i].alias(f"_o{c}") for c, i in zip("xyz", (3, 7, 11))])
    s = neighbour_cells(with_cells(s, reach, ["_ox", "_oy", "_oz"])).drop("_ox", "_oy", "_oz")
    return with_cells(points, reach).join(s, [*by, "ix", "iy", "iz"]).drop("ix", "iy", "iz")


def clear_image(image: DataFrame, scan: str, rings: int, bins: int) -> DataFrame:
    """Range images (scan, ring, az, m) after a 3x3 minimum that wraps around on both axes; bins beside one without a return are left out."""
    step = F.sequence(F.lit(-1), F.lit(1))
    c = image.withColumn("_a", F.explode(step)).withColumn("_b", F.explode(step))
    c = c.select(scan, F.pmod(F.col("ring") + F.col("_a"), F.lit(rings)).alias("ring"), F.pmod(F.col("az") + F.col("_b"), F.lit(bins)).alias("az"), "m")
    return c.groupBy(scan, "ring", "az").agg(F.min("m").alias("m"), F.count("*").alias("_n")).where("_n = 9").drop("_n")


def free_votes(cloud: DataFrame, clear: DataFrame, scan: str, point_id: str, step: int = 1, base: float = 0.10, slope: float = 0.02) -> DataFrame:
    """(point_id, free): in how many scans all bins around a point's own lie behind it by more than base + slope·r, times `step`.

    cloud has scan, ring, az, r of each point in each scan; points that no clear bin meets have 0.
    """
    j = cloud.join(clear, [scan, "ring", "az"], "left")
    return j.groupBy(point_id).agg((F.count_if(F.col("m") > F.col("r") + base + slope * F.col("r")) * step).alias("free"))


def widened_footprints(
    rows: DataFrame, cameras: DataFrame, by: list[str], row_id: str, camera_id: str, fx: float, fy: float, cx: float, cy: float, width: int, height: int,
    blur: float = 0.3, least: float = 1.0, margin: float = 1.05, culled_share: float = 0.5,
) -> DataFrame:
    """(by, row_id, views, culled, added, log_scales, opacity) of each row that a camera sees: rows too thin on screen, widened.

    rows has x, y, z, r (rotation, nine doubles), log_scales and opacity (a logit). In each view
    the larger eigenvalue of the image covariance, blurred by `blur`, is held against `least`.
    A row under it in more than culled_share of its views gets the lower median of the
    variance that would lift it to margin·least, on all axes, and its opacity is scaled by the
    lower median of the root of the areas' ratio, so that its energy stays. Others keep theirs;
    rows that no camera sees have no row. Ids are whole numbers; packs of rows meet all cameras of
    their `by` in flat arrays, and only a line a row leaves the task. A camera whose transform has
    a value that is not finite sees none; camera_id does not matter.
    """
    cov = geo.body_covariance(F.col("r"), F.array(*[F.exp(F.col("log_scales")[k]) for k in range(3)]))
    p = rows.select(*by, row_id, "log_scales", "opacity", *"xyz", cov.alias("_c")).select("*", *[F.col("_c")[i].alias(n) for i, n in enumerate(cam.COVARIANCE)]).drop("_c")
    reduce = cam.footprints(cam.Camera(fx, fy, cx, cy, width, height, 0.01), blur, least, margin, culled_share)
    g = cam.per_point(p, cameras.select(*by, "tmat"), by, row_id, ["log_scales", "opacity"], reduce, "views bigint, culled bigint, need double, ratio double")
    fix = (F.col("culled") > culled_share * F.col("views")) & (F.col("need") > 0)
    j = g.withColumn("added", F.when(fix, F.col("need")).otherwise(0.0))
    scales = F.transform("log_scales", lambda v: 0.5 * F.log(F.exp(2 * v) + F.col("added")))
    shared = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), geo.sigmoid(F.col("opacity")) * F.col("ratio")))
    return j.select(
        *by, row_id, "views", "culled", "added", F.when(fix, scales).otherwise(F.col("log_scales")).alias("log_scales"), F.when(fix, geo.logit(shared)).otherwise(F.col("opacity")).alias("opacity")
    )


def ray_samples(rays: DataFrame, step: float, margin: float = 0.05, slope: float = 0.01) -> DataFrame:
    """rays copied to the samples at (j + 1/2)·step before their return: adds j and s (distance); rays has r."""
    n = F.floor(F.greatest(F.lit(0.0), F.col("r") - margin - slope * F.col("r")) / step).cast("int")
    return rays.withColumn("_n", n).where("_n > 0").withColumn("j", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).withColumn("s", (F.col("j") + 0.5) * step).drop("_n")


def composite(df: DataFrame, pixel: list[str], order: list[str], alpha: str = "alpha") -> DataFrame:
    """df with transmittance and weight: front to back, weight = alpha times the product of (1 - alpha) before it."""
    w = Window.partitionBy(*pixel).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    a = F.col(alpha)
    clear = F.coalesce(F.sum(F.when(a < 1, F.log1p(-a)).otherwise(F.lit(-745.0))).over(w), F.lit(0.0))
    return df.withColumn("transmittance", F.exp(clear)).withColumn("weight", a * F.exp(clear))

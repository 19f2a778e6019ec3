"""Fits that search a small grid of candidates: lever arm with clock offset, and symmetry.

Rows meet each candidate once and are reduced to moments or counts map-side; what is
iterated is one row of moments a candidate.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorloom.functions import geometry as geo
from sensorloom.operators import asof
from sensorloom.operators.spatial import neighbour_cells, with_cells
from sensorloom.session import cut_lineage

XYZ = "xyz"


def _similarity(cov: np.ndarray, var: float) -> tuple[float, np.ndarray]:
    """Scale and rotation of the least-squares similarity from the covariance (target by source) and the source's variance."""
    u, d, vt = np.linalg.svd(cov)
    sign = np.array([1.0, 1.0, np.sign(np.linalg.det(u) * np.linalg.det(vt)) or 1.0])
    return (float((d * sign).sum() / var) if var > 0 else 1.0), (u * sign) @ vt


def _lever(m: dict, rounds: int) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """(scale, rotation, shift, lever) of truth = s·R·C + R·Q·l + t, from moments of C (places), Q (rotations) and G (truth).

    Lever and shift are linear for a given similarity, and the similarity follows from the places
    moved by the lever, so both are solved in turn.
    """
    c, g, q = m["c"], m["g"], m["q"].reshape(3, 3)
    gq = m["gq"].reshape(3, 3, 3) - g[:, None, None] * q[None]  # cov of G_b with Q_ak as [b, a, k]
    qc = m["qc"] - q.T @ c  # sum over a of cov of Q_ak with C_a
    cov, var = m["gc"].reshape(3, 3) - np.outer(g, c), float(m["cc"] - c @ c)
    s, r = _similarity(cov, var)
    lever = np.zeros(3)
    spread = np.eye(3) - q.T @ q
    for _ in range(rounds):
        pull = np.einsum("ba,bak->k", r, gq) - s * qc
        lever = np.linalg.lstsq(spread, pull, rcond=None)[0]
        k = lever / s
        s, r = _similarity(cov + np.einsum("bak,k->ba", gq, k), var + 2 * float(qc @ k) + float(k @ spread @ k))
    return s, r, g - s * r @ c - r @ q @ lever, lever


def lever_arm(
    frames: DataFrame, truth: DataFrame, entity: str, row_id: str, reach_us: int = 300_000, step_us: int = 10_000, rounds: int = 8, min_rows: int = 10
) -> DataFrame:
    """(entity, offset_us, scale, rotation, shift, lever, median): similarity from frames to a reference point at a constant lever arm and clock offset.

    frames has us and tmat (camera to its world), truth us, line, x, y, z. For every offset of
    the grid the truth is interpolated at us + offset (frames outside of it are left out),
    frames are reduced to moments, and scale, rotation, shift and lever are solved from them;
    the offset of the least median residual is taken, of equal ones the smallest. Entities
    with under min_rows frames at every offset have no row.
    """
    offsets = F.sequence(F.lit(-reach_us), F.lit(reach_us), F.lit(step_us))
    f = frames.select(F.col(entity).alias("_s"), F.col(row_id).alias("_i"), F.col("us").alias("_u"), F.col("tmat").alias("_m"))
    f = f.where(F.forall(F.slice("_m", 1, 12), lambda v: v.isNotNull() & ~F.isnan(v)) & (F.size("_m") >= 12)).withColumn("_o", F.explode(offsets))
    t = truth.withColumnRenamed(entity, "_s") if entity != "_s" else truth
    b = asof.bracket(f.withColumn("_at", F.col("_u") + F.col("_o")), t, "_s", "_at", "us", list(XYZ), tie="line")
    j = asof.interpolate(b, "_at", list(XYZ)).where("at_x is not null")
    j = cut_lineage(j.select("_s", "_o", "_i", geo.rotation(F.col("_m")).alias("q"), F.array(*[F.col("_m")[i] for i in (3, 7, 11)]).alias("c"), F.array(*[F.col(f"at_{a}") for a in XYZ]).alias("g")))
    q, c, g = F.col("q"), F.col("c"), F.col("g")
    m = j.groupBy("_s", "_o").agg(
        F.count("*").alias("n"), F.array(*[F.avg(c[i]) for i in range(3)]).alias("c"), F.array(*[F.avg(g[i]) for i in range(3)]).alias("g"), F.array(*[F.avg(q[i]) for i in range(9)]).alias("q"),
        F.array(*[F.avg(g[b_] * c[a]) for b_ in range(3) for a in range(3)]).alias("gc"), F.avg(c[0] * c[0] + c[1] * c[1] + c[2] * c[2]).alias("cc"),
        F.array(*[F.avg(g[b_] * q[i]) for b_ in range(3) for i in range(9)]).alias("gq"), F.array(*[F.avg(q[k] * c[0] + q[3 + k] * c[1] + q[6 + k] * c[2]) for k in range(3)]).alias("qc"),
    ).where(F.col("n") >= min_rows)

    @F.pandas_udf("struct<scale:double,rotation:array<double>,shift:array<double>,lever:array<double>>")
    def solve(c: pd.Series, g: pd.Series, q: pd.Series, gc: pd.Series, cc: pd.Series, gq: pd.Series, qc: pd.Series) -> pd.DataFrame:
        out = []
        for row in zip(c, g, q, gc, cc, gq, qc):
            s, r, shift, lever = _lever({k: np.asarray(v, float) for k, v in zip(("c", "g", "q", "gc", "cc", "gq", "qc"), row)}, rounds)
            out.append((s, r.ravel().tolist(), shift.tolist(), lever.tolist()))
        return pd.DataFrame(out, columns=["scale", "rotation", "shift", "lever"])

    fits = cut_lineage(m.select("_s", "_o", solve("c", "g", "q", "gc", "cc", "gq", "qc").alias("z")).select("_s", "_o", "z.*"))
    k = j.join(fits, ["_s", "_o"])
    moved = [sum((q[3 * i + a] * F.col("lever")[a] for a in (1, 2)), q[3 * i] * F.col("lever")[0]) for i in range(3)]
    k = k.withColumn("_p", F.array(*[F.col("scale") * c[i] + moved[i] for i in range(3)]))
    off = [sum((F.col("rotation")[3 * i + a] * F.col("_p")[a] for a in (1, 2)), F.col("rotation")[3 * i] * F.col("_p")[0]) + F.col("shift")[i] - g[i] for i in range(3)]
    res = k.select("_s", "_o", F.sqrt(off[0] * off[0] + off[1] * off[1] + off[2] * off[2]).alias("r")).groupBy("_s", "_o").agg(F.percentile("r", 0.5).alias("median"))
    best = res.groupBy("_s").agg(F.min(F.struct("median", "_o")).alias("b")).select("_s", "b._o", "b.median")
    return best.join(fits, ["_s", "_o"]).select(F.col("_s").alias(entity), F.col("_o").alias("offset_us"), "scale", "rotation", "shift", "lever", "median")


def symmetry_maps(step_degrees: int = 3) -> list[tuple[str, float, float, float, float]]:
    """(name, a, b, c, d): maps (x, y) -> (a·x + b·y, c·x + d·y): mirrors in upright planes by the yaw of their normal, and quarter turns."""
    out = []
    for yaw in range(0, 180, step_degrees):
        x, y = math.cos(math.radians(yaw)), math.sin(math.radians(yaw))
        out.append((f"mirror{yaw}", 1 - 2 * x * x, -2 * x * y, -2 * x * y, 1 - 2 * y * y))
    return out + [("rot90", 0.0, -1.0, 1.0, 0.0), ("rot180", -1.0, 0.0, 0.0, -1.0), ("rot270", 0.0, 1.0, -1.0, 0.0)]


def symmetry_scores(points: DataFrame, by: list[str], row_id: str, tolerance: float, reach: float = 0.08, least_share: float = 0.2, step_degrees: int = 3) -> DataFrame:
    """(by, map, inliers, covered): share of points whose image lies near a point, for each symmetry of a body about its upright axis.

    Positions are relative to that axis. covered is the share of images within reach of any
    point, inliers the share of these closer than the tolerance, 0 where under least_share are
    covered. Each point has 63 images, which are never copied: one whose own small cell holds a
    point is near it whatever their places in it, and only the others meet the points around them,
    which are copied to the cells beside theirs.
    """
    maps = F.array(*[F.struct(F.lit(n).alias("map"), *[F.lit(v).alias(k) for k, v in zip("abcd", m)]) for n, *m in symmetry_maps(step_degrees)])
    p = cut_lineage(points.where("x is not null and y is not null and z is not null").select(*by, *XYZ))
    images = p.repartition(4 * int(p.sparkSession.conf.get("spark.sql.shuffle.partitions"))).withColumn("_k", F.explode(maps)).select(
        *by, F.col("_k.map").alias("map"), (F.col("_k.a") * F.col("x") + F.col("_k.b") * F.col("y")).alias("qx"), (F.col("_k.c") * F.col("x") + F.col("_k.d") * F.col("y")).alias("qy"), F.col("z").alias("qz")
    )
    cells = ["ix", "iy", "iz"]
    d2 = sum(((F.col(f"q{a}") - F.col(a)) * (F.col(f"q{a}") - F.col(a)) for a in "yz"), (F.col("qx") - F.col("x")) * (F.col("qx") - F.col("x")))

    def near(name: str, radius: float, close: Column) -> DataFrame:
        """(by, map, name): the number of images with a point that is `close`, which all points nearer than radius are and none beyond it."""
        own = _few(with_cells(p, 0.55 * radius).select(*by, *cells).distinct())  # a diagonal of 0.96 radius
        known = with_cells(images, 0.55 * radius, ["qx", "qy", "qz"]).join(own.withColumn("_sure", F.lit(True)), [*by, *cells], "left").drop(*cells)
        around = neighbour_cells(with_cells(p, radius)).select(*by, *cells, *XYZ)
        rest = with_cells(known.where("_sure is null"), radius, ["qx", "qy", "qz"])
        held = around.select(*by, *cells).distinct()
        rest = rest.join(_few(held), [*by, *cells], "left_semi")
        on = [F.col(f"l.{c}") == F.col(f"r.{c}") for c in (*by, *cells)]
        met = rest.alias("l").join(around.alias("r"), [*on, close], "left_semi")
        return known.where("_sure").select(*by, "map").unionByName(met.select(*by, "map")).groupBy(*by, "map").agg(F.count("*").alias(name))

    total = p.groupBy(*by).agg(F.count("*").alias("_n"))
    covered = near("_e", reach, d2 <= reach * reach)
    inliers = near("_in", min(tolerance, reach), (F.sqrt(d2) < tolerance) & (d2 <= reach * reach))
    every = total.withColumn("map", F.explode(F.transform(maps, lambda m: m["map"])))
    j = every.join(covered, [*by, "map"], "left").join(inliers, [*by, "map"], "left").withColumn("_e", F.coalesce("_e", F.lit(0))).withColumn("_in", F.when(F.col("_e") > 0, F.coalesce("_in", F.lit(0))))
    return j.select(*by, "map", F.when(F.col("_e") >= least_share * F.col("_n"), F.try_divide(F.col("_in"), F.col("_e"))).otherwise(0.0).alias("inliers"), (F.col("_e") / F.col("_n")).alias("covered"))


def _few(df: DataFrame, rows: int = 1 << 19) -> DataFrame:
    """df, cells without anything else, to be broadcast while there are at most `rows`."""
    df = cut_lineage(df)
    return F.broadcast(df) if df.count() <= rows else df

"""Fits from sums: similarity transforms, planes, clusters and registration.

Points are reduced to moments (a few numbers a group, summed map-side); the 3x3 problems
that are left are solved for one row a group.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorloom.operators.spatial import nearest_neighbours
from sensorloom.session import cut_lineage

AXES = "xyz"


def similarity(pairs: DataFrame, by: list[str], source: tuple[str, str, str], target: tuple[str, str, str], with_scale: bool = True, min_pairs: int = 10) -> DataFrame:
    """(by, n, scale, tmat): least-squares similarity target = scale·R·source + t, tmat sixteen doubles of R and t.

    Reflections are turned into rotations. Groups with under min_pairs pairs have no row; pairs with a null are left out.
    """
    s, t = [F.col(c) for c in source], [F.col(c) for c in target]
    ok = pairs
    for c in (*s, *t):
        ok = ok.where(c.isNotNull() & ~F.isnan(c))
    m = ok.groupBy(*by).agg(
        F.count("*").alias("n"), F.array(*[F.avg(c) for c in s]).alias("ms"), F.array(*[F.avg(c) for c in t]).alias("mt"),
        F.array(*[F.covar_pop(b, a) for b in t for a in s]).alias("cov"), sum((F.var_pop(a) for a in s[1:]), F.var_pop(s[0])).alias("var"),
    ).where(F.col("n") >= min_pairs)

    @F.pandas_udf("struct<scale:double,tmat:array<double>>")
    def solve(ms: pd.Series, mt: pd.Series, cov: pd.Series, var: pd.Series) -> pd.DataFrame:
        out = []
        for a, b, c, v in zip(ms, mt, cov, var):
            u, d, vt = np.linalg.svd(np.asarray(c, float).reshape(3, 3))
            sign = np.ones(3)
            sign[2] = np.sign(np.linalg.det(u) * np.linalg.det(vt)) or 1.0
            r = u @ np.diag(sign) @ vt
            k = float((d * sign).sum() / v) if with_scale and v > 0 else 1.0
            shift = np.asarray(b) - k * r @ np.asarray(a)
            full = np.eye(4)
            full[:3, :3], full[:3, 3] = r, shift
            out.append((k, full.ravel().tolist()))
        return pd.DataFrame(out, columns=["scale", "tmat"])

    return m.withColumn("_s", solve("ms", "mt", "cov", "var")).select(*by, "n", "_s.scale", "_s.tmat")


def plane_of(points: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, nx, ny, nz, d, rms): least-squares plane n·p + d = 0 of each group, from its moments; nz >= 0."""
    p = [F.col(a) for a in AXES]
    m = points.groupBy(*by).agg(F.count("*").alias("n"), F.array(*[F.avg(c) for c in p]).alias("mean"), F.array(*[F.covar_pop(a, b) for a in p for b in p]).alias("cov")).where("n >= 3")

    @F.pandas_udf("struct<nx:double,ny:double,nz:double,d:double,rms:double>")
    def solve(mean: pd.Series, cov: pd.Series) -> pd.DataFrame:
        out = []
        for a, c in zip(mean, cov):
            values, vectors = np.linalg.eigh(np.asarray(c, float).reshape(3, 3))
            n = vectors[:, 0] * (-1 if vectors[2, 0] < 0 else 1)
            out.append((*n, float(-n @ np.asarray(a)), float(np.sqrt(max(values[0], 0)))))
        return pd.DataFrame(out, columns=["nx", "ny", "nz", "d", "rms"])

    return m.withColumn("_s", solve("mean", "cov")).select(*by, "n", "_s.*")


def floor_plane(
    points: DataFrame, cameras: DataFrame, by: list[str], row_id: str, tolerance: float = 0.03, trials: int = 2000, peels: int = 10, above: float = 0.95,
    heights: tuple[float, float] = (0.05, 2.0), max_spread: float = 0.30, min_share: float = 0.02, min_points: int = 1000, seed: int = 0,
) -> DataFrame:
    """(by, nx, ny, nz, d, inliers): the largest plane that the cameras ride above; no row where there is none.

    Up to `peels` planes are taken off one after another. Each is the best of `trials` planes
    through three points drawn by hashed ids, then refitted to its inliers from moments three
    times. A plane, turned so that the median camera is above, counts if at least `above` of the
    cameras are above it, their median height is within `heights` and the quartiles are at most
    max_spread apart. The drawn triples are a fixed number a group; points meet their group's in
    chunks of about 4096, and counts of chunks are summed. Small groups draw points repeatedly,
    so that they have as many triples as large ones.
    """
    rest = cut_lineage(points.select(*by, F.col(row_id).alias("_i"), *AXES))
    total = rest.groupBy(*by).agg(F.count("*").alias("_total"))
    found = None

    def solve_triples(side: DataFrame, round_: int) -> DataFrame:
        # Three picks a trial: the row with the smallest hash of its slot; rows fall into so many slots that each has about eight or more.
        slots = 3 * trials
        h = side.withColumn("_r", F.explode(F.sequence(F.lit(1), F.ceil(8 * slots / F.col("_size")).cast("int"))))
        h = h.withColumn("_slot", F.pmod(F.xxhash64("_i", "_r", F.lit(seed), F.lit(round_)), F.lit(slots)))
        pick = h.groupBy(*by, "_slot").agg(F.min_by(F.struct(*AXES), F.xxhash64("_i", "_r", F.lit(seed + 1), F.lit(round_))).alias("_p"))
        tri = pick.groupBy(*by, F.floor(F.col("_slot") / 3).alias("_trial")).agg(F.collect_list("_p").alias("_t")).where(F.size("_t") == 3)
        a, b, c = (F.col("_t")[i] for i in range(3))
        e, f = [b[k] - a[k] for k in AXES], [c[k] - a[k] for k in AXES]
        n = [e[1] * f[2] - e[2] * f[1], e[2] * f[0] - e[0] * f[2], e[0] * f[1] - e[1] * f[0]]
        norm = F.sqrt(n[0] ** 2 + n[1] ** 2 + n[2] ** 2)
        tri = tri.where(norm > 1e-9).withColumn("_n", F.array(*[v / norm for v in n]))
        return tri.select(*by, F.col("_trial"), "_n", (-(F.col("_n")[0] * a["x"] + F.col("_n")[1] * a["y"] + F.col("_n")[2] * a["z"])).alias("_d"))

    def off(n: Column, d: Column) -> Column:
        return F.abs(n[0] * F.col("x") + n[1] * F.col("y") + n[2] * F.col("z") + d)

    @F.pandas_udf("array<bigint>")
    def inliers_of(xs: pd.Series, ys: pd.Series, zs: pd.Series, flat: pd.Series) -> pd.Series:
        out = []
        for x, y, z, f in zip(xs, ys, zs, flat):
            q = np.asarray(f, float).reshape(-1, 4)
            p = np.column_stack([x, y, z, np.ones(len(x))])
            out.append(sum((np.abs(p[i : i + 512] @ q.T) <= tolerance).sum(0) for i in range(0, len(p), 512)))
        return pd.Series(out)

    for k in range(peels):
        big = rest.groupBy(*by).agg(F.count("*").alias("_size")).where(F.col("_size") >= min_points)
        sized = rest.join(big, by)
        if sized.isEmpty():
            break
        tri = solve_triples(sized, k).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col("_trial").alias("trial"), F.col("_n").alias("n"), F.col("_d").alias("d")))).alias("_planes"))  # `trials` small structs
        tri = cut_lineage(tri)
        rest = sized.drop("_size")
        chunk = F.pmod(F.xxhash64("_i"), F.ceil(F.col("_size") / 4096))
        parts = sized.where("x is not null and y is not null and z is not null").groupBy(*by, chunk.alias("_chunk")).agg(*[F.collect_list(c).alias(f"_{c}s") for c in AXES])
        flat = F.flatten(F.transform("_planes", lambda p: F.concat(p["n"], F.array(p["d"]))))
        near = parts.join(tri, by).select(*by, F.posexplode(inliers_of("_xs", "_ys", "_zs", flat)).alias("_at", "_c"))
        best = near.groupBy(*by, "_at").agg(F.sum("_c").alias("_c")).groupBy(*by).agg(F.max_by("_at", F.struct("_c", -F.col("_at"))).alias("_at"))
        best = best.join(tri, by).select(*by, F.col("_planes")[F.col("_at")].alias("_b"))
        plane = cut_lineage(best.select(*by, F.col("_b.n").alias("_n"), F.col("_b.d").alias("_d")))
        for _ in range(3):
            fit = plane_of(rest.join(plane, by).where(off(F.col("_n"), F.col("_d")) <= tolerance).select(*by, *AXES), by)
            plane = cut_lineage(fit.select(*by, F.array("nx", "ny", "nz").alias("_n"), F.col("d").alias("_d"), F.col("n").alias("_inliers")))
        cam = cameras.select(*by, *AXES).join(plane, by).withColumn("_h", F.col("_n")[0] * F.col("x") + F.col("_n")[1] * F.col("y") + F.col("_n")[2] * F.col("z") + F.col("_d"))
        g = cam.groupBy(*by).agg(F.percentile("_h", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("_q"), F.avg((F.col("_h") > 0).cast("double")).alias("_up"))
        ok = plane.join(g, by).withColumn("_sign", F.when(F.col("_q")[1] < 0, -1.0).otherwise(1.0))
        share = F.when(F.col("_sign") < 0, 1 - F.col("_up")).otherwise(F.col("_up"))
        ok = ok.where((share >= above) & F.abs(F.col("_q")[1]).between(*heights) & (F.col("_q")[2] - F.col("_q")[0] <= max_spread))
        ok = ok.select(*by, *[(F.col("_sign") * F.col("_n")[i]).alias(f"n{a}") for i, a in enumerate(AXES)], (F.col("_sign") * F.col("_d")).alias("d"), F.col("_inliers").alias("inliers"))
        found = ok if found is None else found.unionByName(ok)
        rest = cut_lineage(rest.join(plane, by).where(off(F.col("_n"), F.col("_d")) > tolerance).select(*by, "_i", *AXES))
    if found is None:
        found = points.select(*by).where("false").select(*by, *[F.lit(0.0).alias(c) for c in ("nx", "ny", "nz", "d")], F.lit(0).cast("bigint").alias("inliers"))
    top = found.groupBy(*by).agg(F.max_by(F.struct("nx", "ny", "nz", "d", "inliers"), "inliers").alias("_b")).select(*by, "_b.*")
    return top.join(total, by).where(F.col("inliers") >= min_share * F.col("_total")).drop("_total")


def geometry_scores(found: DataFrame, truth: DataFrame, by: list[str], row_id: str, thresholds: list[float], size: float) -> DataFrame:
    """(by, threshold, precision, recall, f): shares of found points near the truth and of true points near what was found.

    Near is strictly closer than the threshold to the nearest neighbour; f is 0 where both
    shares are. Groups that lack one side have no row. size is the first cell of the search.
    """

    def shares(a: DataFrame, b: DataFrame, name: str) -> DataFrame:
        nn = nearest_neighbours(a, b.withColumnRenamed(row_id, "_other"), by, 1, size, row_id, "_other")
        return nn.groupBy(*by).agg(*[F.avg((F.col("distance") < t).cast("double")).alias(f"{name}{i}") for i, t in enumerate(thresholds)])

    j = shares(found, truth, "p").join(shares(truth, found, "r"), by)
    rows = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"p{i}").alias("precision"), F.col(f"r{i}").alias("recall")) for i, t in enumerate(thresholds)])
    p, r = F.col("precision"), F.col("recall")
    return j.select(*by, F.explode(rows).alias("z")).select(*by, "z.*").withColumn("f", F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0))


def register(source: DataFrame, target: DataFrame, by: list[str], row_id: str, reach: float = 0.5, rounds: int = 10, trim: float = 0.8, min_pairs: int = 20, gain: float = 0.9) -> DataFrame:
    """(by, before, after, kept, tmat): iterated closest points of source onto target, the nearest `trim` of the pairs within `reach`.

    The result is kept only if the median distance falls to at most `gain` of what it was, else
    tmat is the identity. A group with under min_pairs pairs has no row.
    """
    identity = F.array(*[F.lit(float(i % 5 == 0)) for i in range(16)])
    moved = source.select(*by, F.col(row_id).alias("_i"), *AXES)
    tgt = target.select(*by, F.monotonically_increasing_id().alias("_j") if row_id not in target.columns else F.col(row_id).alias("_j"), *AXES)
    tgt = cut_lineage(tgt)
    total = cut_lineage(source.select(*by).distinct().withColumn("_mat", identity))
    first = None
    for _ in range(rounds):
        moved = cut_lineage(moved)
        nn = nearest_neighbours(moved, tgt, by, 1, reach, "_i", "_j").where(F.col("distance") <= reach)
        pairs = nn.join(moved, [*by, "_i"]).join(tgt.select(*by, "_j", *[F.col(a).alias(f"t{a}") for a in AXES]), [*by, "_j"])
        limit = pairs.groupBy(*by).agg(F.percentile("distance", trim).alias("_p"), F.percentile("distance", 0.5).alias("_m"), F.count("*").alias("_k"))
        limit = cut_lineage(limit.where(F.col("_k") >= min_pairs))
        if first is None:
            first = limit.select(*by, F.col("_m").alias("before"))
        fit = similarity(pairs.join(limit, by).where(F.col("distance") <= F.col("_p")), by, ("x", "y", "z"), ("tx", "ty", "tz"), False, 3)
        fit = cut_lineage(fit.select(*by, F.col("tmat").alias("_fit")))
        moved = moved.join(fit, by).select(*by, "_i", *[(F.col("_fit")[4 * i] * F.col("x") + F.col("_fit")[4 * i + 1] * F.col("y") + F.col("_fit")[4 * i + 2] * F.col("z") + F.col("_fit")[4 * i + 3]).alias(a) for i, a in enumerate(AXES)])
        step = [[sum((F.col("_fit")[4 * i + k] * F.col("_mat")[4 * k + j] for k in range(1, 4)), F.col("_fit")[4 * i] * F.col("_mat")[j]) for j in range(4)] for i in range(4)]
        total = cut_lineage(total.join(fit, by).select(*by, F.array(*[c for row in step for c in row]).alias("_mat")))
    nn = nearest_neighbours(moved, tgt, by, 1, reach, "_i", "_j").where(F.col("distance") <= reach)
    last = nn.groupBy(*by).agg(F.percentile("distance", 0.5).alias("after"))
    kept = F.coalesce(F.col("after") <= gain * F.col("before"), F.lit(False))
    return first.join(last, by, "left").join(total, by).select(*by, "before", "after", kept.alias("kept"), F.when(kept, F.col("_mat")).otherwise(identity).alias("tmat"))


def k_medians_1d(values: DataFrame, by: list[str], value: str, max_k: int = 5, drop: float = 0.35, bin_size: float = 0.01) -> DataFrame:
    """(by, k, centres): one-dimensional k-medians with the number of levels chosen by cost.

    Values are counted in bins first, so a group is its histogram (bounded by its range); the
    best split for each k is found exactly on it, in n·log n steps of n bins. k+1 is taken over k while the mean absolute
    deviation falls by more than `drop`.
    """
    h = values.where(F.col(value).isNotNull()).groupBy(*by, F.round(F.col(value) / bin_size).cast("bigint").alias("_b")).agg(F.count("*").alias("_n"))

    def solve(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("_b")
        x, w = g["_b"].to_numpy() * bin_size, g["_n"].to_numpy(float)
        cw, cx = np.concatenate([[0], np.cumsum(w)]), np.concatenate([[0], np.cumsum(w * x)])
        n = len(x)

        def middle(i, j):
            """Bin that holds the median of the bins i to j - 1; i may be an array."""
            return np.clip(np.searchsorted(cw, (cw[i] + cw[j]) / 2) - 1, i, j - 1)

        def cost(i: np.ndarray, j: int) -> np.ndarray:
            m = middle(i, j)
            return x[m] * (cw[m + 1] - cw[i]) - (cx[m + 1] - cx[i]) + (cx[j] - cx[m + 1]) - x[m] * (cw[j] - cw[m + 1])

        def one_more(before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Best cost of the first j bins with one level more, and where that level starts; the start never moves back as j grows."""
            row, arg = np.zeros(n + 1), np.zeros(n + 1, int)
            spans = [(1, n, 0, n - 1)]
            while spans:
                lo, hi, first, last = spans.pop()
                if lo > hi:
                    continue
                j = (lo + hi) // 2
                i = np.arange(first, min(last, j - 1) + 1)
                value = before[i] + cost(i, j)
                k = int(np.argmin(value))
                row[j], arg[j] = value[k], i[k]
                spans += [(lo, j - 1, first, int(i[k])), (j + 1, hi, int(i[k]), last)]
            return row, arg

        best = [np.array([0.0, *(float(cost(np.array([0]), j)[0]) for j in range(1, n + 1))])]
        back = [np.zeros(n + 1, int)]
        chosen = 1
        for k in range(2, min(max_k, n) + 1):
            row, arg = one_more(best[-1])
            best.append(row)
            back.append(arg)
            if best[-2][n] <= 1e-12 or row[n] > (1 - drop) * best[-2][n]:
                break
            chosen = k
        j, centres = n, []
        for k in range(chosen - 1, -1, -1):
            i = int(back[k][j])
            centres.append(float(x[middle(i, j)]))
            j = i
        return pd.DataFrame([[*[g[b].iloc[0] for b in by], chosen, centres[::-1]]], columns=[*by, "k", "centres"])

    kinds = ", ".join(f"{b} {values.schema[b].dataType.simpleString()}" for b in by)
    return h.groupBy(*by).applyInPandas(solve, f"{kinds}, k int, centres array<double>")


def step_levels(points: DataFrame, by: list[str], cell: float, quantile: float = 0.95, evidence: int = 2, max_levels: int = 4, drop: float = 0.35, bin_size: float = 0.01) -> DataFrame:
    """(by, u, v, level) for every cell of the box of the cells with evidence: the height of the step there.

    A cell with at least `evidence` points has the interpolated quantile of their heights; the
    levels are k-medians of these heights (k_medians_1d), and each cell takes the nearest. Cells
    without take that of the nearest cell with evidence (of equally near ones the smallest u,
    then v); then every cell takes the median of its 3x3 cells, edges repeated.
    """
    from sensorloom.operators.spatial import with_cells

    c = with_cells(points, cell).groupBy(*by, F.col("ix").alias("u"), F.col("iy").alias("v")).agg(F.percentile("z", quantile).alias("_h"), F.count("*").alias("_n"))
    tops = cut_lineage(c.where(F.col("_n") >= evidence).drop("_n"))
    levels = k_medians_1d(tops, by, "_h", max_levels, drop, bin_size)
    near = F.array_min(F.transform("centres", lambda m: F.struct(F.abs(m - F.col("_h")).alias("d"), m.alias("m"))))
    known = cut_lineage(tops.join(levels, by).select(*by, "u", "v", near["m"].alias("level")))
    box = tops.groupBy(*by).agg(*[f(a).alias(f"_{e}{a}") for a in "uv" for e, f in (("lo", F.min), ("hi", F.max))])
    grid = box.withColumn("u", F.explode(F.sequence("_lou", "_hiu"))).withColumn("v", F.explode(F.sequence("_lov", "_hiv")))
    place = [F.col("u").cast("double").alias("x"), F.col("v").cast("double").alias("y"), F.lit(0.0).alias("z")]
    empty = grid.join(known, [*by, "u", "v"], "left_anti").select(*by, F.struct("u", "v").alias("_to"), *place)
    nn = nearest_neighbours(empty, known.select(*by, F.struct("u", "v").alias("_from"), *place), by, 1, 2.0, "_to", "_from")
    filled = nn.select(*by, F.col("_to.u").alias("_u"), F.col("_to.v").alias("_v"), F.col("_from.u").alias("u"), F.col("_from.v").alias("v")).join(known, [*by, "u", "v"])
    whole = cut_lineage(known.unionByName(filled.select(*by, F.col("_u").alias("u"), F.col("_v").alias("v"), "level")))
    steps = F.sequence(F.lit(-1), F.lit(1))
    around = grid.withColumn("_a", F.explode(steps)).withColumn("_b", F.explode(steps))
    at = {a: F.greatest(f"_lo{a}", F.least(f"_hi{a}", F.col(a) + F.col(o))) for a, o in (("u", "_a"), ("v", "_b"))}
    around = around.select(*by, F.struct("u", "v").alias("_to"), at["u"].alias("u"), at["v"].alias("v"))
    nine = around.join(whole, [*by, "u", "v"]).groupBy(*by, "_to").agg(F.array_sort(F.collect_list("level")).alias("_l"))  # nine values
    return nine.select(*by, "_to.u", "_to.v", F.col("_l")[4].alias("level"))


def spatial_clusters(points: DataFrame, row_id: str, k: int, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(rows with cluster, medoids): k-means over positions and the row nearest to each centre."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    v = VectorAssembler(inputCols=list(AXES), outputCol="_v", handleInvalid="skip").transform(points)
    model = KMeans(k=k, seed=seed, featuresCol="_v", predictionCol="cluster").fit(v)
    rows = model.transform(v).drop("_v")
    centres = points.sparkSession.createDataFrame([(i, *map(float, c)) for i, c in enumerate(model.clusterCenters())], "cluster int, cx double, cy double, cz double")  # k rows
    d = (F.col("x") - F.col("cx")) ** 2 + (F.col("y") - F.col("cy")) ** 2 + (F.col("z") - F.col("cz")) ** 2
    j = rows.join(F.broadcast(centres), "cluster")
    return rows, j.groupBy("cluster").agg(F.count("*").alias("n"), F.min_by(row_id, F.struct(d.alias("d"), row_id)).alias(row_id))


def inside_ellipsoid(rows: DataFrame, cameras: DataFrame, by: list[str], row_id: str, sigmas: float, reach: float) -> DataFrame:
    """Rows (q, x, y, z, sx, sy, sz) whose ellipsoid of `sigmas` holds a camera; reach bounds the largest axis.

    Cameras and rows meet by cells of `reach`, an equi-join; rows with a longer axis should be removed beforehand.
    """
    from sensorloom.functions.geometry import quat_to_rotation
    from sensorloom.operators.spatial import radius_join

    near = radius_join(rows, cameras.withColumnRenamed(row_id, "_cam") if row_id in cameras.columns else cameras.withColumn("_cam", F.monotonically_increasing_id()), by, reach, row_id, "_cam")
    c = cameras.withColumnRenamed(row_id, "_cam") if row_id in cameras.columns else cameras
    j = near.join(rows, [*by, row_id]).join(c.select(*by, "_cam", *[F.col(a).alias(f"c{a}") for a in AXES]), [*by, "_cam"]).withColumn("_r", quat_to_rotation(F.col("q")))
    d = [F.col(f"c{a}") - F.col(a) for a in AXES]
    own = [sum((F.col("_r")[3 * i + k] * d[i] for i in range(1, 3)), F.col("_r")[k] * d[0]) for k in range(3)]
    m = sum(((own[k] / (sigmas * F.col(f"s{AXES[k]}"))) ** 2 for k in range(1, 3)), (own[0] / (sigmas * F.col("sx"))) ** 2)
    return j.where(m <= 1).select(*by, row_id).distinct()

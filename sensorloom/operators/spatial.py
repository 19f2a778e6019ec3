"""Voxel and grid aggregation, and exact distance joins by cell.

Distance joins are equi-joins on (partition columns, cell): one side is copied to the cells
its reach touches (27, a fixed factor), so no pair further apart than two cells is formed.
Where a radius is not given, the cell doubles from round to round for the queries that are
not settled yet, which keeps results exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sensorloom.functions.keys import cell
from sensorloom.session import cut_lineage

XYZ = ("x", "y", "z")


def with_cells(df: DataFrame, size: float | Column, axes: Sequence[str] = XYZ, origin: Sequence[str] | None = None) -> DataFrame:
    """df with ix, iy, iz: the voxel of each point; origin names columns to count from."""
    for i, a in enumerate(axes):
        v = F.col(a) - F.col(origin[i]) if origin else F.col(a)
        df = df.withColumn("i" + "xyz"[i], F.floor(v / size).cast("bigint"))
    return df


def voxel_mean(df: DataFrame, by: list[str], size: float, values: Sequence[str] = (), axes: Sequence[str] = XYZ) -> DataFrame:
    """Per voxel the mean position, the means of `values`, and the number of points."""
    return with_cells(df, size, axes).groupBy(*by, "ix", "iy", "iz").agg(*[F.avg(a).alias(a) for a in (*axes, *values)], F.count("*").alias("n"))


def voxel_first(df: DataFrame, by: list[str], size: float, row_id: str) -> DataFrame:
    """The row with the smallest id of each voxel."""
    names = [c for c in df.columns if c not in by]
    g = with_cells(df, size).groupBy(*by, "ix", "iy", "iz").agg(F.min_by(F.struct(*names), row_id).alias("_r"))
    return g.select(*by, "ix", "iy", "iz", "_r.*")


def voxel_mean_from_bound(df: DataFrame, by: list[str], size: float) -> DataFrame:
    """voxel_mean on a grid that starts half a voxel below the cloud's own lowest coordinates."""
    low = df.groupBy(*by).agg(*[(F.min(a) - size / 2).alias(f"_lo_{a}") for a in XYZ])
    j = with_cells(df.join(low, by), size, XYZ, [f"_lo_{a}" for a in XYZ])
    return j.groupBy(*by, "ix", "iy", "iz").agg(*[F.avg(a).alias(a) for a in XYZ], F.count("*").alias("n"))


def votes(df: DataFrame, by: list[str], voter: str) -> DataFrame:
    """Per key the number of distinct voters, each counted once: two aggregations, the first map-side."""
    return df.groupBy(*by, voter).agg(F.lit(1).alias("_v")).groupBy(*by).agg(F.count("*").alias("votes"))


def neighbour_cells(df: DataFrame, axes: Sequence[str] = ("ix", "iy", "iz"), reach: int = 1, cross: bool = False) -> DataFrame:
    """Each row copied to the cells within `reach` along every axis; cross: only along one axis at a time."""
    steps = [[0] * len(axes)]
    for k in range(len(axes)):
        steps = [[*s[:k], o, *s[k + 1 :]] for s in steps for o in range(-reach, reach + 1)]
    if cross:
        steps = [s for s in steps if sum(1 for o in s if o) <= 1]
    moves = F.explode(F.array(*[F.struct(*[F.lit(o).alias(a) for a, o in zip(axes, s)]) for s in steps]))
    out = df.withColumn("_m", moves)
    for a in axes:
        out = out.withColumn(a, F.col(a) + F.col(f"_m.{a}"))
    return out.drop("_m")


def dilate(cells: DataFrame, by: list[str], axes: Sequence[str] = ("ix", "iy"), cross: bool = True) -> DataFrame:
    return neighbour_cells(cells.select(*by, *axes), axes, 1, cross).distinct()


def erode(cells: DataFrame, by: list[str], axes: Sequence[str] = ("ix", "iy"), cross: bool = True) -> DataFrame:
    """Cells whose whole neighbourhood is set."""
    full = 2 * len(axes) + 1 if cross else 3 ** len(axes)
    c = cells.select(*by, *axes).distinct()
    return neighbour_cells(c, axes, 1, cross).groupBy(*by, *axes).agg(F.count("*").alias("_k")).where(F.col("_k") == full).drop("_k")


def close(cells: DataFrame, by: list[str], axes: Sequence[str] = ("ix", "iy"), cross: bool = True) -> DataFrame:
    return erode(dilate(cells, by, axes, cross), by, axes, cross)


def open_(cells: DataFrame, by: list[str], axes: Sequence[str] = ("ix", "iy"), cross: bool = True) -> DataFrame:
    return dilate(erode(cells, by, axes, cross), by, axes, cross)


def _square(a: Sequence[str], b: Sequence[str]) -> Column:
    d = [(F.col(p) - F.col(q)) * (F.col(p) - F.col(q)) for p, q in zip(a, b)]
    return sum(d[1:], d[0])


def radius_join(queries: DataFrame, points: DataFrame, by: list[str], radius: float, query_id: str, point_id: str, apart: bool = False) -> DataFrame:
    """(by, query_id, point_id, distance) of all pairs within the radius; apart: without pairs of equal ids."""
    q = with_cells(queries.select(*by, F.col(query_id).alias("_q"), *[F.col(a).alias(f"q{a}") for a in XYZ]), radius, ["qx", "qy", "qz"])
    p = with_cells(points.select(*by, F.col(point_id).alias("_p"), *XYZ), radius)
    pairs = neighbour_cells(q).join(p, [*by, "ix", "iy", "iz"])
    d2 = _square(["qx", "qy", "qz"], XYZ)
    near = pairs.where((d2 <= radius * radius) & (F.col("_q") != F.col("_p") if apart else F.lit(True)))
    a, b = (query_id, point_id) if query_id != point_id else (query_id, f"near_{point_id}")
    return near.select(*by, F.col("_q").alias(a), F.col("_p").alias(b), F.sqrt(d2).alias("distance"))


def nearest_neighbours(queries: DataFrame, points: DataFrame, by: list[str], k: int, size: float, query_id: str, point_id: str, apart: bool = False) -> DataFrame:
    """(by, query_id, near_id, distance, rank): exactly the k nearest points of each query, of equally near ones the smaller ids.

    Starts with cells of `size`; queries with under k points within one cell's size go on
    with twice the size, until the size passes the cloud's extent. Points of a cell are met
    only by queries beside it; where the data are far denser than `size`, choose a smaller one.
    """
    pts = points.select(*by, F.col(point_id).alias("_p"), *XYZ)
    open_q = queries.select(*by, F.col(query_id).alias("_q"), *[F.col(a).alias(f"q{a}") for a in XYZ])
    ends = pts.agg(*[(F.max(a) - F.min(a)).alias(a) for a in XYZ]).first()
    qe = open_q.agg(*[F.max(F.abs(f"q{a}")).alias(a) for a in XYZ]).first()
    pe = pts.agg(*[F.max(F.abs(a)).alias(a) for a in XYZ]).first()
    extent = 2 * sum((ends[a] or 0) + (qe[a] or 0) + (pe[a] or 0) for a in XYZ) + size
    parts = []
    while True:
        last = size > extent
        q, p = with_cells(open_q, size, ["qx", "qy", "qz"]), with_cells(pts, size)
        pairs = neighbour_cells(q).join(p, [*by, "ix", "iy", "iz"])
        d2 = _square(["qx", "qy", "qz"], XYZ)
        keep = (F.lit(True) if last else d2 <= size * size) & (F.col("_q") != F.col("_p") if apart else F.lit(True))
        near = pairs.where(keep).select(*by, "_q", "_p", d2.alias("_d2"))
        w = Window.partitionBy(*by, "_q").orderBy("_d2", "_p")
        top = near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
        if last:
            parts.append(top)
            break
        top = cut_lineage(top)
        full = top.where(F.col("rank") == k).select(*by, "_q")
        parts.append(top.join(full, [*by, "_q"], "left_semi"))
        open_q = cut_lineage(open_q.join(full, [*by, "_q"], "left_anti"))
        if open_q.isEmpty():
            break
        size *= 2
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    near_name = f"near_{point_id}" if query_id == point_id else point_id
    return out.select(*by, F.col("_q").alias(query_id), F.col("_p").alias(near_name), F.sqrt("_d2").alias("distance"), "rank")


def outliers(points: DataFrame, by: list[str], k: int, size: float, row_id: str, sigmas: float, queries: DataFrame | None = None) -> DataFrame:
    """(by, row_id, mean_distance, kept): mean distance to the k nearest others, kept up to mean + sigmas population deviations of its `by` group."""
    nn = nearest_neighbours(queries if queries is not None else points, points, by, k, size, row_id, row_id, apart=True)
    m = nn.groupBy(*by, row_id).agg(F.avg("distance").alias("mean_distance"))
    s = m.groupBy(*by).agg(F.avg("mean_distance").alias("_mu"), F.stddev_pop("mean_distance").alias("_sd"))
    return m.join(s, by).select(*by, row_id, "mean_distance", (F.col("mean_distance") <= F.col("_mu") + sigmas * F.col("_sd")).alias("kept"))


def cell_iou(left: DataFrame, right: DataFrame, by: list[str], group_l: str, group_r: str, axes: Sequence[str] = ("ix", "iy")) -> DataFrame:
    """(by, group_l, group_r, iou) of cell sets that share a cell."""
    a, b = left.select(*by, group_l, *axes).distinct(), right.select(*by, group_r, *axes).distinct()
    na = a.groupBy(*by, group_l).agg(F.count("*").alias("_na"))
    nb = b.groupBy(*by, group_r).agg(F.count("*").alias("_nb"))
    both = a.join(b, [*by, *axes]).groupBy(*by, group_l, group_r).agg(F.count("*").alias("_n"))
    j = both.join(na, [*by, group_l]).join(nb, [*by, group_r])
    return j.select(*by, group_l, group_r, (F.col("_n") / (F.col("_na") + F.col("_nb") - F.col("_n"))).alias("iou"))


def member_of_levels(points: DataFrame, levels: DataFrame, by: list[str], size: float, depths: Sequence[int], top: int) -> DataFrame:
    """points with `known`: whether any level's leaf (depth, kx, ky, kz) holds the point; keys shift by the depths above the finest."""
    p = with_cells(points, size)
    hit = None
    for depth in depths:
        s = top - depth
        q = p.select(*by, "ix", "iy", "iz", F.shiftright("ix", s).alias("kx"), F.shiftright("iy", s).alias("ky"), F.shiftright("iz", s).alias("kz")).distinct()
        h = q.join(levels.where(F.col("depth") == depth).select(*by, "kx", "ky", "kz"), [*by, "kx", "ky", "kz"], "left_semi").select(*by, "ix", "iy", "iz")
        hit = h if hit is None else hit.unionByName(h)
    hit = hit.distinct().withColumn("known", F.lit(True))
    return p.join(hit, [*by, "ix", "iy", "iz"], "left").withColumn("known", F.coalesce("known", F.lit(False))).drop("ix", "iy", "iz")


def components(cells: DataFrame, by: list[str], axes: Sequence[str] = ("ix", "iy"), diagonal: bool = False) -> DataFrame:
    """cells with component: the smallest cell (as a struct) of its connected component.

    Labels run along links and jump to their label's label each round, so rounds grow with
    the logarithm of the longest chain; each round is written out and only changed counts
    come to the driver.
    """
    node = F.struct(*axes)
    c = cells.select(*by, *axes).distinct().withColumn("node", node)
    moved = neighbour_cells(c.select(*by, *axes, F.col("node").alias("from")), axes, 1, cross=not diagonal).withColumn("node", node)
    edges = cut_lineage(moved.join(c.select(*by, "node"), [*by, "node"], "left_semi").select(*by, F.col("from").alias("a"), F.col("node").alias("b")).where("a <> b"))
    labels = cut_lineage(c.select(*by, "node", F.col("node").alias("label")))
    while True:
        near = edges.join(labels.withColumnRenamed("node", "b"), [*by, "b"]).groupBy(*by, F.col("a").alias("node")).agg(F.min("label").alias("_m"))
        low = labels.join(near, [*by, "node"], "left").select(*by, "node", F.col("label").alias("_old"), F.least("label", "_m").alias("label"))
        hooked = low.groupBy(*by, F.col("_old").alias("node")).agg(F.min("label").alias("_h"))  # a label takes the best of its members
        low = low.join(hooked, [*by, "node"], "left").select(*by, "node", "_old", F.least("label", "_h").alias("label"))
        jump = low.select(*by, F.col("node").alias("label"), F.col("label").alias("_j"))
        next_ = cut_lineage(low.join(jump, [*by, "label"], "left").select(*by, "node", "_old", F.least("_j", "label").alias("label")))
        labels = next_.select(*by, "node", "label")
        if next_.where("label <> _old").isEmpty():
            break
    return labels.select(*by, *[F.col(f"node.{a}").alias(a) for a in axes], F.col("label").alias("component"))


def curve_order(points: DataFrame, by: list[str], row_id: str, crowded: int = 256) -> DataFrame:
    """points with rank: the order along a space-filling curve of 1024 cells an axis over the group's box, from 1.

    Rows that share a cell with more than `crowded` others are ordered along a curve of their
    own box, and so on; rows that stay together (all in one place) are in order of row_id.
    Every round writes the rows with one more code; only whether crowded cells are left comes
    to the driver.
    """
    from sensorloom.functions.keys import morton
    from sensorloom.operators.ordered import running

    rows = points.select(*by, row_id, *XYZ).withColumn("_path", F.array().cast("array<bigint>"))
    least = 0
    while True:
        ends = [f(c).alias(f"_{e}{c}") for c in XYZ for e, f in (("lo", F.min), ("hi", F.max))]
        boxes = rows.groupBy(*by, "_path").agg(F.count("*").alias("_n"), *ends).where((F.col("_n") > least) & F.greatest(*[F.col(f"_hi{c}") > F.col(f"_lo{c}") for c in XYZ]))
        boxes = cut_lineage(boxes.drop("_n"))
        if boxes.isEmpty():
            break
        j = rows.join(boxes, [*by, "_path"], "left")
        cells = []
        for c in XYZ:
            wide = F.col(f"_hi{c}") - F.col(f"_lo{c}")
            cells.append(F.when(wide > 0, F.least(F.lit(1023), F.floor((F.col(c) - F.col(f"_lo{c}")) * (1024.0 / wide)))).otherwise(0).cast("bigint"))
        code = F.when(F.col("_lox").isNotNull(), F.concat("_path", F.array(morton(*cells)))).otherwise(F.col("_path"))
        rows = cut_lineage(j.select(*by, row_id, *XYZ, code.alias("_path")))
        least = crowded
    ordered = rows.withColumn("_at", F.coalesce(F.get("_path", F.lit(0)), F.lit(0).cast("bigint")))
    r = running(ordered, by, "_at", ["_path", row_id], name="rank", block=1 << 15)
    return r.select(*by, row_id, *XYZ, (F.col("rank") + 1).cast("bigint").alias("rank"))


def bucket(x: Column, size: float) -> Column:
    return cell(x, size)

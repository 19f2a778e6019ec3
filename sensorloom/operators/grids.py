"""Neighbourhood predicates on pixel and cell tables, votes, histograms and box merging."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorloom.operators.spatial import neighbour_cells


def depth_edges(pixels: DataFrame, image: list[str], value: str, jump: float, grow: bool = True) -> DataFrame:
    """(image, u, v) of valid pixels whose value differs from a valid 4-neighbour's by more than jump times the smaller one; grow adds their 4-neighbours."""
    p = pixels.where(F.col(value).isNotNull() & (F.col(value) > 0)).select(*image, "u", "v", F.col(value).alias("_d"))
    n = neighbour_cells(p.withColumnRenamed("_d", "_n"), ("u", "v"), 1, cross=True)
    j = p.join(n, [*image, "u", "v"])
    edge = j.where(F.abs(F.col("_d") - F.col("_n")) > jump * F.least("_d", "_n")).select(*image, "u", "v").distinct()
    if not grow:
        return edge
    return neighbour_cells(edge, ("u", "v"), 1, cross=True).join(p.select(*image, "u", "v"), [*image, "u", "v"], "left_semi").distinct()


def not_isolated(cells: DataFrame, by: list[str], axes: tuple[str, str], least: int) -> DataFrame:
    """Cells with at least `least` set cells among their eight neighbours."""
    c = cells.select(*by, *axes).distinct()
    n = neighbour_cells(c, axes, 1).groupBy(*by, *axes).agg((F.count("*") - 1).alias("_n"))
    return c.join(n, [*by, *axes]).where(F.col("_n") >= least).drop("_n")


def label_vote(df: DataFrame, by: list[str], label: str, score: str) -> DataFrame:
    """(by, label, score): the label with the largest sum; of equal sums the first by name. Null labels take no part."""
    s = df.where(F.col(label).isNotNull()).groupBy(*by, label).agg(F.sum(score).alias(score))
    return s.groupBy(*by).agg(F.min(F.struct((-F.col(score)).alias("m"), F.col(label).alias("l"))).alias("_b")).select(*by, F.col("_b.l").alias(label), (-F.col("_b.m")).alias(score))


def histogram(df: DataFrame, by: list[str], value: Column, edges: list[float]) -> DataFrame:
    """(by, bin, n): counts between the edges; the last bin is closed, values outside and null are left out."""
    last = len(edges) - 2
    b = F.lit(None).cast("int")
    for i in range(last, -1, -1):
        b = F.when((value >= edges[i]) & ((value < edges[i + 1]) if i < last else (value <= edges[i + 1])), i).otherwise(b)
    return df.select(*by, b.alias("bin")).where("bin is not null").groupBy(*by, "bin").agg(F.count("*").alias("n"))


def merge_boxes(boxes: DataFrame, by: list[str], box_id: str, axes: tuple[str, ...], gap: float, reach: float) -> DataFrame:
    """(by, box_id, near_id) of boxes (lo_axis, hi_axis) closer than gap on every axis.

    Boxes are copied to the cells of size `reach` that they touch when widened by the gap, and meet
    in cells; a pair is kept in the cell of its common low corner only, so once.
    """
    cells = []
    for a in axes:
        cells.append(F.sequence(F.floor((F.col(f"lo_{a}") - gap) / reach).cast("bigint"), F.floor((F.col(f"hi_{a}") + gap) / reach).cast("bigint")))
    c = boxes.select(*by, F.col(box_id).alias("_i"), *[F.col(f"{e}_{a}") for a in axes for e in ("lo", "hi")])
    for a, s in zip(axes, cells):
        c = c.withColumn(f"_c{a}", F.explode(s))
    keys = [*by, *[f"_c{a}" for a in axes]]
    other = c.select(*keys, F.col("_i").alias("_j"), *[F.col(f"{e}_{a}").alias(f"o{e}_{a}") for a in axes for e in ("lo", "hi")])
    j = c.join(other, keys).where("_i < _j")
    for a in axes:
        j = j.where((F.col(f"lo_{a}") - F.col(f"ohi_{a}") < gap) & (F.col(f"olo_{a}") - F.col(f"hi_{a}") < gap))
        j = j.where(F.col(f"_c{a}") == F.floor((F.greatest(f"lo_{a}", f"olo_{a}") - gap) / reach))
    return j.select(*by, F.col("_i").alias(box_id), F.col("_j").alias("near_id"))


def absorb_boxes(boxes: DataFrame, by: list[str], box_id: str, partial: str, axes: tuple[str, ...], gap: float, reach: float) -> DataFrame:
    """(by, box_id, into): boxes taken up by a partial one that they are closer to than gap (straight distance between the boxes).

    In order of id, a partial box that is still there takes up all that are still there. Only
    pairs within the gap reach the sequential step, one `by` group a task.
    """
    b = boxes.select(*by, F.col(box_id).alias("_i"), F.col(partial).alias("_part"), *[F.col(f"{e}_{a}") for a in axes for e in ("lo", "hi")])
    near = merge_boxes(boxes, by, box_id, axes, gap, reach).select(*by, F.col(box_id).alias("_a"), F.col("near_id").alias("_b"))
    both = near.unionByName(near.select(*by, F.col("_b").alias("_a"), F.col("_a").alias("_b")))
    other = b.select(*by, F.col("_i").alias("_b"), *[F.col(f"{e}_{a}").alias(f"o{e}_{a}") for a in axes for e in ("lo", "hi")])
    j = both.join(b.withColumnRenamed("_i", "_a"), [*by, "_a"]).where("_part").join(other, [*by, "_b"])
    apart = [F.greatest(F.lit(0.0), F.col(f"lo_{a}") - F.col(f"ohi_{a}"), F.col(f"olo_{a}") - F.col(f"hi_{a}")) for a in axes]
    pairs = j.where(sum((d * d for d in apart[1:]), apart[0] * apart[0]) < gap * gap).select(*by, "_a", "_b")

    def run(g: pd.DataFrame) -> pd.DataFrame:
        gone: dict = {}
        for a, rows in g.sort_values(["_a", "_b"]).groupby("_a", sort=True):
            if a not in gone:
                gone |= {x: a for x in rows["_b"] if x not in gone}
        return pd.DataFrame([(*[g[c].iloc[0] for c in by], k, v) for k, v in gone.items()], columns=[*by, box_id, "into"])

    kind = boxes.schema[box_id].dataType.simpleString()
    out = ", ".join([*(f"{c} {boxes.schema[c].dataType.simpleString()}" for c in by), f"{box_id} {kind}", f"into {kind}"])
    return pairs.groupBy(*by).applyInPandas(run, out)


def sharpness(pixels: DataFrame, image: list[str], width: int, height: int, value: str = "gray") -> DataFrame:
    """(image, sharp, mean): variance of the Laplacian over all pixels, the border mirrored without repeating it, and the mean.

    pixels has u, v and a value for every pixel; each is sent to the pixels whose Laplacian it
    counts in, so an image's rows are summed map-side and no image meets in one task.
    """

    def targets(at: Column, size: int) -> Column:
        mirrored = F.when(at == 1, F.array(F.lit(0))).otherwise(F.array().cast("array<int>"))
        far = F.when(at == size - 2, F.array(F.lit(size - 1))).otherwise(F.array().cast("array<int>"))
        return F.filter(F.concat(F.array(at - 1, at + 1), mirrored, far), lambda x: (x >= 0) & (x < size))

    u, v = F.col("u").cast("int"), F.col("v").cast("int")
    own = F.array(F.struct(u.alias("u"), v.alias("v"), F.lit(-4.0).alias("w")))
    aside = F.transform(targets(u, width), lambda x: F.struct(x.alias("u"), v.alias("v"), F.lit(1.0).alias("w")))
    along = F.transform(targets(v, height), lambda x: F.struct(u.alias("u"), x.alias("v"), F.lit(1.0).alias("w")))
    spread = pixels.select(*image, F.col(value).alias("_g"), F.explode(F.concat(own, aside, along)).alias("t"))
    lap = spread.groupBy(*image, "t.u", "t.v").agg(F.sum(F.col("t.w") * F.col("_g")).alias("_l"), F.sum(F.when(F.col("t.w") < 0, F.col("_g"))).alias("_g"))
    return lap.groupBy(*image).agg(F.var_pop("_l").alias("sharp"), F.avg("_g").alias("mean"))


# The four directions in which gradients are summed.
DIRECTIONS = {"right": (1, 0), "down": (0, 1), "falling": (1, 1), "rising": (1, -1)}


def directional_energies(pixels: DataFrame, image: list[str], tile_width: int, tile_height: int, value: str = "gray") -> DataFrame:
    """(image, tile_u, tile_v, direction, energy): mean squared difference of neighbours in each direction over a tile.

    A pair belongs to the tile of its upper left corner; pairs whose corner is in a tile's last
    row or column are left out, so that no pair reaches over an edge.
    """
    u, v = F.col("u").cast("int"), F.col("v").cast("int")
    ends = []
    for name, (du, dv) in DIRECTIONS.items():
        up = max(-dv, 0)
        ends.append(F.struct(F.lit(name).alias("d"), u.alias("u"), (v - up).alias("v"), F.lit(-1.0).alias("w")))
        ends.append(F.struct(F.lit(name).alias("d"), (u - du).alias("u"), (v - up - dv).alias("v"), F.lit(1.0).alias("w")))
    spread = pixels.select(*image, F.col(value).alias("_g"), F.explode(F.array(*ends)).alias("e"))
    pair = spread.groupBy(*image, "e.d", "e.u", "e.v").agg(F.sum(F.col("e.w") * F.col("_g")).alias("_s"), F.count("*").alias("_n")).where("_n = 2")
    pair = pair.where((F.pmod("u", F.lit(tile_width)) < tile_width - 1) & (F.pmod("v", F.lit(tile_height)) < tile_height - 1))
    tile = (F.floor(F.col("u") / tile_width).cast("int").alias("tile_u"), F.floor(F.col("v") / tile_height).cast("int").alias("tile_v"))
    return pair.groupBy(*image, *tile, F.col("d").alias("direction")).agg(F.avg(F.col("_s") * F.col("_s")).alias("energy"))


def markdown_rows(board: DataFrame, columns: list[str]) -> DataFrame:
    """(seq, n, set_name, rank, line): table lines of a leaderboard, the best marked with a star."""
    cells = [F.when(F.col(c).isNull(), "").otherwise(F.format_string("%.4f", F.col(c)) if dict(board.dtypes)[c] == "double" else F.col(c).cast("string")) for c in columns]
    star = F.when(F.col("best"), " *").otherwise("")
    return board.select("seq", "n", "set_name", "rank", F.concat(F.lit("| "), F.concat_ws(" | ", *cells), star, F.lit(" |")).alias("line"))

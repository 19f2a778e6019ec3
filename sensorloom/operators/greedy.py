"""Order-dependent greedy selection, which is sequential within a group."""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_GROUP_ROWS = 5_000_000


def spaced(
    df: DataFrame, by: list[str], order: list[str], row_id: str, min_apart: float, min_turn_deg: float | None = None, accepted: DataFrame | None = None,
    most: int | None = None, max_group_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """(by, row_id) of the rows kept in order: a row goes if an accepted one is closer than min_apart (and, where given, turned less than min_turn_deg).

    df has x, y, z (and tmat for turns); `accepted` holds rows that count as accepted from the
    start; most is the number kept at the most. Only the needed columns of a group reach its
    task, kept rows are looked up by cell, and a group of more than max_group_rows rows is an
    error rather than an unbounded task. Rows without a position are left out.
    """
    turn = min_turn_deg is not None
    cols = [*by, row_id, *order, "x", "y", "z", *(["tmat"] if turn else [])]
    d = df.where("x is not null and y is not null and z is not null").select(*dict.fromkeys(cols)).withColumn("_old", F.lit(False))
    if accepted is not None:
        a = accepted.select(*by, "x", "y", "z", *(["tmat"] if turn else [])).withColumn("_old", F.lit(True))
        d = d.unionByName(a, allowMissingColumns=True)
    cos = 1 + 2 * math.cos(math.radians(min_turn_deg)) if turn else 0.0

    def run(g: pd.DataFrame) -> pd.DataFrame:
        if len(g) > max_group_rows:
            raise ValueError(f"a group has {len(g)} rows, over max_group_rows")
        g = g.sort_values(["_old", *order], ascending=[False, *[True] * len(order)], kind="stable")
        p = g[["x", "y", "z"]].to_numpy(float)
        old = g["_old"].to_numpy()
        rots = np.stack([np.asarray(m, float)[[0, 1, 2, 4, 5, 6, 8, 9, 10]] for m in g["tmat"]]) if turn else None
        cells = np.floor(p / min_apart).astype(np.int64)
        grid: dict[tuple, list[int]] = defaultdict(list)
        kept = []
        for i in range(len(p)):
            if most is not None and len(kept) >= most:
                break
            c = cells[i]
            clash = False
            if not old[i]:
                for dx in (-1, 0, 1):
                    for dy in (-1, 0, 1):
                        for dz in (-1, 0, 1):
                            for j in grid.get((c[0] + dx, c[1] + dy, c[2] + dz), ()):
                                if ((p[i] - p[j]) ** 2).sum() < min_apart**2 and (not turn or rots[i] @ rots[j] > cos):
                                    clash = True
                                    break
                            if clash:
                                break
                        if clash:
                            break
                    if clash:
                        break
            if not clash:
                grid[tuple(c)].append(i)
                if not old[i]:
                    kept.append(i)
        return g.iloc[kept][[*by, row_id]]

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in [*by, row_id])
    return d.groupBy(*by).applyInPandas(run, kinds)


def rotating_pool(df: DataFrame, row_id: str, draws: int, seed: int = 0) -> DataFrame:
    """(draw, row_id): draws from a pool that is refilled, in a new order, when it is empty; every row once before any again."""
    n = df.count()
    if not n:
        return df.select(F.lit(0).cast("bigint").alias("draw"), row_id).where("false")
    from pyspark.sql.window import Window

    epochs = -(-draws // n)
    e = df.select(row_id, F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))).alias("epoch"))
    rank = F.row_number().over(Window.partitionBy("epoch").orderBy(F.xxhash64(row_id, "epoch", F.lit(seed)), row_id)) - 1
    return e.select((F.col("epoch").cast("bigint") * n + rank).alias("draw"), row_id).where(F.col("draw") < draws)

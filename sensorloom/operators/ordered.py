"""Ordered analytics that never bring an entity's rows into one task.

Rows are ordered by a whole-number column `at` (then `tie`) within (entity, block of at).
What crosses a block's edge is found from one row a block: its first and last row, its
count or its partial sum, combined by a window over the blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sensorloom.operators.regular_grid import floor_div

BLOCK = 60_000_000


def _blocked(df: DataFrame, entity: list[str], at: str, block: int) -> DataFrame:
    return df.where(F.col(at).isNotNull()).withColumn("_b", floor_div(F.col(at), block))


def adjacent(df: DataFrame, entity: list[str], at: str, tie: list[str], values: list[str], block: int = BLOCK) -> DataFrame:
    """df with `prev` and `next`: structs of `values` of the neighbouring rows of the entity, null at its ends. Rows with a null `at` are dropped."""
    r = _blocked(df, entity, at, block)
    key, pay = F.struct(at, *tie), F.struct(*values)
    w = Window.partitionBy(*entity, "_b").orderBy(at, *tie)
    inner = r.select("*", F.lag(pay).over(w).alias("_p"), F.lead(pay).over(w).alias("_n"))
    edges = r.groupBy(*entity, "_b").agg(F.min_by(pay, key).alias("_lo"), F.max_by(pay, key).alias("_hi"))
    bw = Window.partitionBy(*entity).orderBy("_b")
    edges = edges.select(*entity, "_b", F.lag("_hi").over(bw).alias("_earlier"), F.lead("_lo").over(bw).alias("_later"))
    on = [F.col(f"l.{e}").eqNullSafe(F.col(f"r.{e}")) for e in entity] + [F.col("l._b") == F.col("r._b")]
    j = inner.alias("l").join(edges.alias("r"), on, "left")
    return j.select(*[F.col(f"l.`{c}`") for c in df.columns], F.coalesce("l._p", "r._earlier").alias("prev"), F.coalesce("l._n", "r._later").alias("next"))


def running(df: DataFrame, entity: list[str], at: str, tie: list[str], value: Column | None = None, name: str = "rn", block: int = BLOCK) -> DataFrame:
    """df with the sum of `value` (default: a count) over the rows before each one of its entity, itself left out: a 0-based row number by default."""
    r = _blocked(df, entity, at, block).withColumn("_v", F.lit(1).cast("bigint") if value is None else F.coalesce(value, F.lit(0)))
    w = Window.partitionBy(*entity, "_b").orderBy(at, *tie).rowsBetween(Window.unboundedPreceding, -1)
    inner = r.select("*", F.coalesce(F.sum("_v").over(w), F.lit(0)).alias("_s"))
    bw = Window.partitionBy(*entity).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = r.groupBy(*entity, "_b").agg(F.sum("_v").alias("_t")).select(*entity, "_b", F.coalesce(F.sum("_t").over(bw), F.lit(0)).alias("_base"))
    on = [F.col(f"l.{e}").eqNullSafe(F.col(f"r.{e}")) for e in entity] + [F.col("l._b") == F.col("r._b")]
    j = inner.alias("l").join(sums.alias("r"), on)
    return j.select(*[F.col(f"l.`{c}`") for c in df.columns], (F.col("l._s") + F.col("r._base")).alias(name))


def holdout(df: DataFrame, entity: list[str], at: str, tie: list[str], every: int) -> DataFrame:
    """df with split: 'val' for every N-th row in order, counted from the first, else 'train'; all 'train' for every <= 0."""
    if every <= 0:
        return df.withColumn("split", F.lit("train"))
    n = running(df, entity, at, tie)
    return n.withColumn("split", F.when(F.col("rn") % every == 0, "val").otherwise("train")).drop("rn")


def gap_segments(df: DataFrame, entity: list[str], at: str, tie: list[str], factor: float, min_rows: int = 1) -> DataFrame:
    """df with segment: 0-based, a new one where the step is over `factor` times the entity's median step; segments under min_rows are dropped."""
    a = adjacent(df, entity, at, tie, [at]).drop("next").withColumn("_step", F.col(at) - F.col(f"prev.{at}")).drop("prev")
    m = a.groupBy(*entity).agg((F.percentile("_step", 0.5) * factor).alias("_limit"))
    flagged = a.join(m, entity).withColumn("_new", (F.coalesce(F.col("_step") > F.col("_limit"), F.lit(False))).cast("bigint"))
    s = running(flagged, entity, at, tie, F.col("_new"), "_before").withColumn("segment", F.col("_before") + F.col("_new")).drop("_before", "_new", "_step", "_limit")
    if min_rows <= 1:
        return s
    big = s.groupBy(*entity, "segment").agg(F.count("*").alias("_k")).where(F.col("_k") >= min_rows).select(*entity, "segment")
    return s.join(big, [*entity, "segment"], "left_semi")


def merge_close(df: DataFrame, entity: list[str], value: str, eps: float, block: float = 3600.0) -> DataFrame:
    """(entity, group, n, mean): sorted values chained while each is closer than eps to the one before."""
    scaled = df.withColumn("_at", F.floor(F.col(value) * 1e6).cast("bigint")).withColumn("_x", F.col(value))
    a = adjacent(scaled, entity, "_at", ["_x"], ["_x"]).withColumn("_new", F.coalesce((F.col("_x") - F.col("prev._x") >= eps), F.lit(False)).cast("bigint")).drop("prev", "next")
    s = running(a, entity, "_at", ["_x"], F.col("_new"), "_before")
    return s.groupBy(*entity, (F.col("_before") + F.col("_new")).alias("group")).agg(F.count("*").alias("n"), F.avg("_x").alias("mean"))


def rolling(df: DataFrame, entity: list[str], at: str, tie: list[str], value: str, half: int, fn: str = "median", edges: str = "truncate", block: int = BLOCK) -> DataFrame:
    """df with `rolled`: median, min or mean over the rows half before to half after.

    edges: truncate the frame at the ends of the entity, or nearest: repeat the end row.
    Rows within `half` of a block's edge are copied to the block beside it, so only that
    fixed number of rows a block is replicated (blocks should hold more than `half` rows;
    a frame reaching over a whole block is completed from row numbers).
    """
    n = running(df, entity, at, tie)
    size = max(4096, 8 * half)
    total = n.groupBy(*entity).agg((F.max("rn") + 1).alias("_n"))
    n = n.join(total, entity)
    rn = F.col("rn")
    copies = F.array_distinct(F.array(*[floor_div(F.greatest(F.lit(0), F.least(F.col("_n") - 1, rn + s)), size) for s in (-half, 0, half)]))
    spread = n.select("*", F.explode(copies).alias("_c"))
    w = Window.partitionBy(*entity, "_c").orderBy("rn").rowsBetween(-half, half)
    v = F.col(value)
    if edges == "nearest":
        vals = F.collect_list(F.struct("rn", v.alias("v"))).over(w)
        first, last = F.element_at(vals, 1), F.element_at(vals, -1)
        head = F.array_repeat(first["v"], F.greatest(F.lit(0), half - rn).cast("int"))
        tail = F.array_repeat(last["v"], F.greatest(F.lit(0), half - (F.col("_n") - 1 - rn)).cast("int"))
        arr = F.concat(head, vals["v"], tail)
    else:
        arr = F.collect_list(v).over(w)
    if fn == "median":
        s = F.array_sort(arr)
        k = F.size(s)
        out = (F.element_at(s, ((k + 1) / 2).cast("int")) + F.element_at(s, (k / 2).cast("int") + 1)) / 2
    elif fn == "min":
        out = F.array_min(arr)
    else:
        out = F.aggregate(arr, F.lit(0.0), lambda a, x: a + x) / F.size(arr)
    own = spread.select("*", out.alias("rolled")).where(F.col("_c") == floor_div(rn, size))
    return own.drop("_c", "_n", "rn")


def tumbling(df: DataFrame, entity: list[str], at: str, width: int, origin: str | None = None) -> Column:
    """Number of the tumbling window of `at`, from the column `origin` (default 0)."""
    start = F.col(origin) if origin else F.lit(0)
    return floor_div(F.col(at) - start, width)


def best_per_slot(df: DataFrame, entity: list[str], at: str, width: int, score: str, row_id: str, highest: bool = True) -> DataFrame:
    """(entity, slot, row_id, score): the best row of each slot counted from the entity's first row; of equal scores the smallest id."""
    first = df.groupBy(*entity).agg(F.min(at).alias("_t0"))
    s = df.join(first, entity).withColumn("slot", floor_div(F.col(at) - F.col("_t0"), width))
    key = F.struct((-F.col(score) if highest else F.col(score)).alias("s"), F.col(row_id).alias("i"))
    g = s.where(F.col(score).isNotNull()).groupBy(*entity, "slot").agg(F.min(key).alias("b"))
    return g.select(*entity, "slot", F.col("b.i").alias(row_id), ((-F.col("b.s")) if highest else F.col("b.s")).alias(score))


def lagged_pairs(df: DataFrame, entity: list[str], at: str, tie: list[str], row_id: str, lag: int, n_pairs: int) -> DataFrame:
    """(entity, first, second): rows i and i+lag for up to n_pairs starts spread evenly (rounded down) over the entity."""
    n = running(df, entity, at, tie).select(*entity, "rn", row_id)
    last = n.groupBy(*entity).agg((F.max("rn") - lag).alias("_last")).where("_last >= 0")
    if n_pairs > 1:
        starts = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(n_pairs - 1)), lambda i: F.floor(i * F.col("_last") / (n_pairs - 1)).cast("bigint")))
    else:
        starts = F.array(F.lit(0).cast("bigint"))
    s = last.select(*entity, F.explode(starts).alias("rn"))
    a = s.join(n.withColumnRenamed(row_id, "first"), [*entity, "rn"]).withColumn("rn", F.col("rn") + lag)
    return a.join(n.withColumnRenamed(row_id, "second"), [*entity, "rn"]).select(*entity, "first", "second")

"""As-of joins over irregular tracks: bracketing, interpolating, clamped, tolerant and nearest.

All rest on `bracket`, which gives every left row the right readings before and after it.
Order is taken within (entity, block of time), so no entity's rows meet in one task; a
bracket that reaches over a block's edge comes from the blocks' first and last readings,
one row a block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sensorloom.operators.regular_grid import floor_div

BLOCK_US = 60_000_000


def unique_times(right: DataFrame, entity: str, at: str, order: str) -> DataFrame:
    """One row per (entity, time): the one with the smallest `order`."""
    names = [c for c in right.columns if c not in (entity, at)]
    g = right.groupBy(entity, at).agg(F.min_by(F.struct(*names), order).alias("_row"))
    return g.select(entity, at, "_row.*")


def bracket(left: DataFrame, right: DataFrame, entity: str, left_at: str, right_at: str, values: list[str], block_us: int = BLOCK_US, tie: str | None = None) -> DataFrame:
    """left with `before` and `after`: structs (at, *values) of the last right row at or before, and the first at or after.

    Times are whole microseconds. Null entities or times on the right take no part; on the
    left they get null brackets. Of right rows with equal times the one with the smallest
    `tie` counts (by default the smallest values). Left columns are kept whatever their names.

    Both directions are running lasts over the same exchange, one by rising and one by falling
    time, so a block costs its rows once each way.
    """
    pay = F.struct(F.col(right_at).alias("at"), *[F.col(v).alias(v) for v in values])
    r = right.where(F.col(entity).isNotNull() & F.col(right_at).isNotNull()).select(
        F.col(entity).alias("_e"), F.col(right_at).alias("_t"), (F.col(tie) if tie else pay).alias("_o"), pay.alias("_p")
    )
    r = r.withColumn("_b", floor_div(F.col("_t"), block_us))
    ls = left.select(F.struct(*[F.col(f"`{c}`").alias(c) for c in left.columns]).alias("_l"), F.col(entity).alias("_e"), F.col(left_at).alias("_t"))
    # Rows without a time or entity are spread over blocks that no reading has.
    nowhere = F.pmod(F.xxhash64("_l"), F.lit(1 << 20)) + (1 << 50)
    ls = ls.withColumn("_b", F.when(F.col("_e").isNull() | F.col("_t").isNull(), nowhere).otherwise(floor_div(F.col("_t"), block_us)))
    kinds = {c: r.schema[c].dataType for c in ("_o", "_p")}
    both = ls.select("_e", "_b", "_t", F.lit(1).alias("_side"), "_l", *[F.lit(None).cast(k).alias(c) for c, k in kinds.items()]).unionByName(
        r.select("_e", "_b", "_t", F.lit(0).alias("_side"), F.lit(None).cast(ls.schema["_l"].dataType).alias("_l"), "_o", "_p")
    )
    # Readings come before the left rows of their time; of equal times the smallest tie comes last.
    w = Window.partitionBy("_e", "_b")
    upto = (Window.unboundedPreceding, Window.currentRow)
    prev = F.last("_p", ignorenulls=True).over(w.orderBy(F.asc("_t"), F.asc("_side"), F.desc("_o")).rowsBetween(*upto))
    next_ = F.last("_p", ignorenulls=True).over(w.orderBy(F.desc("_t"), F.asc("_side"), F.desc("_o")).rowsBetween(*upto))
    inner = both.select("_e", "_b", "_t", "_l", prev.alias("_prev"), next_.alias("_next")).where("_l is not null")

    reading = F.col("_p").isNotNull()
    blocks = both.groupBy("_e", "_b").agg(
        F.min_by("_p", F.when(reading, F.struct("_t", "_o"))).alias("lo"), F.min_by("_p", F.when(reading, F.struct((-F.col("_t")).alias("back"), "_o"))).alias("hi")
    )
    bw, before = Window.partitionBy("_e"), (Window.unboundedPreceding, -1)  # one row a block
    reach = blocks.where(F.col("_b") < 1 << 50).select(
        "_e", "_b", F.last("hi", ignorenulls=True).over(bw.orderBy(F.asc("_b")).rowsBetween(*before)).alias("_earlier"),
        F.last("lo", ignorenulls=True).over(bw.orderBy(F.desc("_b")).rowsBetween(*before)).alias("_later"),
    )
    out = inner.join(reach, ["_e", "_b"], "left")
    return out.select("_l.*", F.coalesce("_prev", "_earlier").alias("before"), F.coalesce("_next", "_later").alias("after"))


def weight(at: Column) -> Column:
    """How far `at` is from before to after, 0 where both are one reading."""
    b, a = F.col("before.at"), F.col("after.at")
    return F.when(a > b, (at - b) / (a - b)).otherwise(0.0)


def interpolate(df: DataFrame, at: str, values: list[str], outside: str = "null") -> DataFrame:
    """Linear interpolation of bracketed values. outside: null, clamp (nearest end) or error."""
    before, after = F.col("before"), F.col("after")
    w = weight(F.col(at))
    out = df
    for v in values:
        mixed = before[v] + (after[v] - before[v]) * w
        ends = F.coalesce(before[v], after[v])
        if outside == "clamp":
            e = F.when(before.isNotNull() & after.isNotNull(), mixed).otherwise(ends)
        elif outside == "error":
            e = F.when(before.isNotNull() & after.isNotNull(), mixed).otherwise(F.raise_error(F.lit("time outside of the track")))
        else:
            e = F.when(before.isNotNull() & after.isNotNull(), mixed)
        out = out.withColumn(f"at_{v}", e)
    return out


def within(df: DataFrame, at: str, tolerance_us: int) -> DataFrame:
    """Rows whose nearer bracket is at most tolerance_us away."""
    near = F.least(F.col(at) - F.col("before.at"), F.col("after.at") - F.col(at))
    return df.where(near <= tolerance_us)


def nearest(df: DataFrame, at: str) -> Column:
    """The nearer of both brackets, the earlier of equally near ones; null without any."""
    b, a = F.col("before"), F.col("after")
    take_after = a.isNotNull() & (b.isNull() | (F.col("after.at") - F.col(at) < F.col(at) - F.col("before.at")))
    return F.when(take_after, a).otherwise(b)


def complete_sets(readings: DataFrame, entity: str, member: str, at: str, row_id: str, reference: str, members: list[str], tolerance_us: int) -> DataFrame:
    """(entity, at, ids): per reference row the nearest row of every other member, only where all are near enough.

    ids is an array in the order of `members`; of equally near rows the earlier is taken.
    """
    ref = readings.where(F.col(member) == reference).select(F.col(entity).alias("entity"), F.col(at).alias("at"), F.col(row_id).alias("ref_id"))
    asked = ref.select("*", F.explode(F.array(*[F.lit(m) for m in members if m != reference])).alias("member"))
    left = asked.withColumn("key", F.struct("entity", "member"))
    right = readings.where(F.col(member) != reference).select(F.struct(F.col(entity).alias("entity"), F.col(member).alias("member")).alias("key"), F.col(at).alias("r_at"), F.col(row_id).alias("rid"))
    b = bracket(left, right, "key", "at", "r_at", ["rid"])
    hit = b.select("entity", "at", "ref_id", "member", nearest(b, "at").alias("n")).where(F.abs(F.col("n.at") - F.col("at")) <= tolerance_us)
    g = hit.groupBy("entity", "at", "ref_id").agg(F.map_from_entries(F.collect_list(F.struct("member", "n.rid"))).alias("found"), F.count("*").alias("k"))
    ids = F.array(*[F.col("ref_id") if m == reference else F.col("found")[m] for m in members])
    return g.where(F.col("k") == len(members) - 1).select("entity", "at", ids.alias("ids"))

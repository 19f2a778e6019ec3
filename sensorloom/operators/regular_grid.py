"""Irregular readings onto a regular grid (problem 2), by validity intervals.

A valid reading holds its value from its time to the next valid reading's, if that comes
within the longest gap. These intervals are intersected with the grid's cells: a cell's
average is weighted by the time each value holds in it, its coverage is the share of the
cell under any interval, and a cell under an interval without a reading of its own is
filled. Times are whole microseconds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SLOT_US = 100_000
MAX_GAP_US = 60_000_000


def micros(t: Column) -> Column:
    """Seconds as whole microseconds; null for null, NaN and infinite times."""
    return F.when(t.isNotNull() & ~F.isnan(t) & (F.abs(t) < 9e12), F.round(t * 1e6).cast("bigint"))


def floor_div(a: Column, b: int) -> Column:
    """Whole quotient, rounded down, of whole numbers; exact where a double's quotient is not."""
    return ((a - F.pmod(a, F.lit(b))) / b).cast("bigint")


def present(*values: Column) -> Column:
    """All values are neither null nor NaN."""
    out = F.lit(True)
    for v in values:
        out = out & v.isNotNull() & ~F.isnan(v)
    return out


def validity_intervals(readings: DataFrame, max_gap_us: int = MAX_GAP_US) -> DataFrame:
    """(source, line, at, until, values): each reading with the time of the next one of its source.

    readings has source, line, at (µs) and values (one array of doubles, or null), valid
    rows only. until is null where the next reading is further than max_gap_us or missing.
    Rows repeated with the same (source, at, line) count once; of different lines with equal
    times all but the last get an empty interval.

    The order is taken within (source, block) where a block is as long as the largest gap,
    so the next reading is in the same block or is the first of the next one: that first
    reading is found by a map-side minimum and added to the block before as its end mark.
    """
    block = floor_div(F.col("at"), max_gap_us)
    r = readings.withColumn("block", block)
    marks = r.groupBy("source", "block").agg(F.min("at").alias("at")).select(
        "source", F.lit(None).cast("bigint").alias("line"), "at", F.lit(None).cast("array<double>").alias("values"), (F.col("block") - 1).alias("block")
    )
    both = r.select("source", "line", "at", "values", "block").unionByName(marks)
    w = Window.partitionBy("source", "block").orderBy("at", F.col("line").asc_nulls_last())
    seen = both.select("*", F.lead("at").over(w).alias("next_at"), F.lead("line").over(w).alias("next_line"))
    once = seen.where(F.col("line").isNotNull() & ~F.coalesce((F.col("next_at") == F.col("at")) & (F.col("next_line") == F.col("line")), F.lit(False)))
    until = F.when(F.col("next_at") - F.col("at") <= max_gap_us, F.col("next_at"))
    return once.select("source", "line", "at", until.alias("until"), "values")


def intersect_cells(intervals: DataFrame, slot_us: int = SLOT_US) -> DataFrame:
    """(source, slot, own, held_us, values): each interval cut at the grid's cells.

    own: the cell holds the interval's reading. A cell that an interval covers whole without
    holding a reading appears exactly once, as intervals of a source do not overlap. The cell
    an interval ends in is kept even when it ends at that cell's first microsecond.
    """
    first = floor_div(F.col("at"), slot_us)
    last = floor_div(F.coalesce("until", "at"), slot_us)
    cut = intervals.withColumn("slot", F.explode(F.sequence(first, last)))
    lo = F.greatest("at", F.col("slot") * slot_us)
    hi = F.least(F.coalesce("until", "at"), (F.col("slot") + 1) * slot_us)
    inner = (F.col("slot") > first) & (F.col("slot") < last)
    return cut.select("source", "slot", (F.col("slot") == first).alias("own"), inner.alias("inner"), (hi - lo).alias("held_us"), "values")


def filled_slots(intervals: DataFrame, slot_us: int = SLOT_US) -> DataFrame:
    """(source, slot) of the cells without a reading between two successive readings; no shuffle."""
    return intersect_cells(intervals, slot_us).where("inner").select("source", "slot")


def regular_series(intervals: DataFrame, slot_us: int = SLOT_US, width: int = 3) -> DataFrame:
    """(source, slot, readings, coverage, averages, state) with a row for every cell under or beside a reading.

    averages: `width` time-weighted means; where a cell has a reading but no time is held in
    it (the reading before a longer gap, at the cell's last microsecond), the plain mean of
    its readings. state: measured (a reading, covered whole), partial (a reading, not whole)
    or filled. Cells beyond the longest gap have no row here (whole_series marks them).
    """
    cells = intersect_cells(intervals, slot_us)
    v = F.col("values")
    sums = [F.sum(F.col("held_us") * v[i]).alias(f"w{i}") for i in range(width)] + [F.avg(F.when(F.col("own"), v[i])).alias(f"p{i}") for i in range(width)]
    g = cells.groupBy("source", "slot").agg(F.count_if("own").alias("readings"), F.sum("held_us").alias("held"), *sums)
    means = F.array(*[F.when(F.col("held") > 0, F.col(f"w{i}") / F.col("held")).otherwise(F.col(f"p{i}")) for i in range(width)])
    coverage = F.least(F.lit(1.0), F.col("held") / F.lit(float(slot_us)))
    state = F.when(F.col("readings") == 0, "filled").when(F.col("held") >= slot_us, "measured").otherwise("partial")
    return g.select("source", "slot", "readings", coverage.alias("coverage"), means.alias("averages"), state.alias("state"))


def missing_slots(readings: DataFrame, slot_us: int = SLOT_US, max_gap_us: int = MAX_GAP_US) -> DataFrame:
    """(source, slot) of the cells strictly between two successive readings that are further apart than max_gap_us.

    Such readings lie in different blocks, so the last and first readings of the blocks tell
    the gaps; a gap is cut into spans first, which spread a long one over tasks.
    """
    edges = readings.groupBy("source", floor_div(F.col("at"), max_gap_us).alias("block")).agg(F.min("at").alias("first"), F.max("at").alias("last"))
    w = Window.partitionBy("source").orderBy("block")  # one row a block
    gaps = edges.select("source", F.col("last").alias("lo"), F.lead("first").over(w).alias("hi")).where(F.col("hi") - F.col("lo") > max_gap_us)
    lo, hi, span = floor_div(F.col("lo"), slot_us) + 1, floor_div(F.col("hi"), slot_us) - 1, 100_000
    spans = gaps.select("source", lo.alias("lo"), hi.alias("hi")).where("hi >= lo").withColumn("from", F.explode(F.sequence("lo", "hi", F.lit(span).cast("bigint"))))
    spans = spans.repartition("source", "from")
    return spans.select("source", F.explode(F.sequence("from", F.least(F.col("from") + span - 1, "hi"))).alias("slot"))


def whole_series(readings: DataFrame, slot_us: int = SLOT_US, width: int = 3, max_gap_us: int = MAX_GAP_US) -> DataFrame:
    """regular_series with a row, state missing, for every cell of the periods longer than max_gap_us too."""
    s = regular_series(validity_intervals(readings, max_gap_us), slot_us, width)
    gone = missing_slots(readings, slot_us, max_gap_us)
    return s.unionByName(
        gone.select("source", "slot", F.lit(0).cast("bigint").alias("readings"), F.lit(0.0).alias("coverage"), F.lit(None).cast("array<double>").alias("averages"), F.lit("missing").alias("state"))
    )


def imu_readings(imu: DataFrame) -> DataFrame:
    """Valid gyro readings: t and all three values present. Null sources and lines take no part."""
    o = [F.col(f"omega.{a}") for a in "xyz"]
    return imu.where(F.col("seq").isNotNull() & F.col("line").isNotNull() & present(F.col("t"), *o)).select(
        F.col("seq").alias("source"), "line", micros(F.col("t")).alias("at"), F.array(*o).alias("values")
    )


def pose_readings(pose: DataFrame) -> DataFrame:
    """Valid pose readings: t and the first twelve entries present; the values are the position."""
    m = F.col("tmat")
    whole = (F.size(m) >= 12) & F.forall(F.slice(m, 1, 12), lambda v: v.isNotNull() & ~F.isnan(v))
    return pose.where(F.col("seq").isNotNull() & F.col("line").isNotNull() & present(F.col("t")) & whole).select(
        F.col("seq").alias("source"), "line", micros(F.col("t")).alias("at"), F.array(m[3], m[7], m[11]).alias("values")
    )

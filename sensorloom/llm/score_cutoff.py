"""Cutoff per source that keeps a target fraction of its scores (problem 3).

The smallest c with at least q·n scores <= c minimises the pinball loss
sum(q·(x-c)+ + (1-q)·(c-x)+), which is convex. Each pass cuts with the tangents at both
ends of a source's bracket: their crossing, and a ladder of points around it, become
pivots; one aggregation of counts and sums between pivots gives loss and subgradient at
the score below each of them. The bracket closes in on the two neighbouring scores
between which the subgradient changes its sign, where the loss is least. Every source
takes at least one pass; when a pass has left few scores in a source's bracket, the
exact neighbouring score is taken from them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sensorloom.session import cut_lineage


def _pivots():
    """Tangent crossing, ladders of shrinking steps around it, and even and geometric steps over the bracket."""
    lo, hi, n, q = F.col("lo"), F.col("hi"), F.col("n"), F.col("q")
    at_most_lo, sum_lo, below_hi, sum_below_hi = F.col("n_lo"), F.col("s_lo"), F.col("n_below_hi"), F.col("s_below_hi")
    total = F.col("total")

    g_lo, g_hi = at_most_lo - q * n, below_hi - q * n
    slope = g_hi - g_lo
    cross = F.when(slope > 0, (_loss(lo, q, n, total, at_most_lo, sum_lo) - _loss(hi, q, n, total, below_hi, sum_below_hi) + g_hi * hi - g_lo * lo) / slope)
    middle = lo + (hi - lo) / 2
    start = F.when((cross > lo) & (cross < hi), cross).otherwise(middle)
    width = hi - lo
    steps = [start, *(lo + width * (i / 16) for i in range(1, 16)), *(lo + width * 10.0**-e for e in (2, 4, 8, 16, 32, 64, 128, 256))]
    steps += [start + width * sign * 2.0**-e for e in range(5, 12) for sign in (-1, 1)]
    return F.array_sort(F.array_distinct(F.filter(F.array(*steps), lambda p: p.isNotNull() & ~F.isnan(p) & (p > lo) & (p < hi))))


def _loss(c, q, n, total, count, part):
    """Pinball loss at c of n scores, `count` of them up to c with the sum `part`."""
    return q * (total - part - c * (n - count)) + (1 - q) * (c * count - part)


#: Rows of state (about 0.5 kB each, pivots included) up to which it is broadcast: 64 MB.
SMALL_SOURCES = (64 << 20) // 512


def score_cutoffs(
    scores: DataFrame, fractions: DataFrame, source_col: str = "seq", item_col: str = "name", score_col: str = "rate_px_per_ms_med",
    fraction_col: str = "keep_fraction", snap_rows: int = 64, small_sources: int = SMALL_SOURCES,
) -> tuple[DataFrame, DataFrame]:
    """(cutoffs, items): cutoffs has (source, n, need, cutoff, loss, passes), items the distinct valid (source, item, score).

    Scores that are null, NaN, infinite or negative take no part, nor do null sources; a
    (source, item) counts once, with its smallest valid score; a null item is an item.
    Sources without a fraction in (0, 1] have no cutoff; of repeated fractions of a source
    the largest holds. Ties at the cutoff are all kept. Empty tables give empty results;
    further columns are dropped. Every pass reduces all scores map-side to at most about
    forty rows a source and task; the state has a row a source and is broadcast only while
    there are at most `small_sources` of them. A bracket of at most `snap_rows` scores is
    read off exactly after its pass, so no source's scores ever meet in one task.
    """
    x = F.col(score_col).cast("double")
    valid = scores.where(F.col(source_col).isNotNull() & x.isNotNull() & ~F.isnan(x) & (x >= 0) & (x < float("inf")))
    items = cut_lineage(
        valid.select(F.col(source_col).alias("source"), F.col(item_col).alias("item"), x.alias("score")).groupBy("source", "item").agg(F.min("score").alias("score"))
    )
    wanted = fractions.where(F.col(source_col).isNotNull() & (F.col(fraction_col) > 0) & (F.col(fraction_col) <= 1))
    wanted = wanted.groupBy(F.col(source_col).alias("source")).agg(F.max(F.col(fraction_col).cast("double")).alias("q"))

    first = items.groupBy("source").agg(F.count("*").alias("n"), F.sum("score").alias("total"), F.max("score").alias("hi"))
    state = first.join(wanted, "source").select(
        "source", "n", "q", "total",
        F.lit(-1.0).alias("lo"), F.lit(0).cast("bigint").alias("n_lo"), F.lit(0.0).alias("s_lo"),
        "hi", F.col("n").alias("n_hi"), F.col("total").alias("s_hi"), (F.col("n") - 1).alias("n_below_hi"), (F.col("total") - F.col("hi")).alias("s_below_hi"), F.lit(0).alias("passes"), F.lit(False).alias("done"),
    )
    state = cut_lineage(state)
    few = state.count() <= small_sources
    wide = ~F.col("done") & ((F.col("passes") == 0) | (F.col("n_hi") - F.col("n_lo") > snap_rows))

    def beside(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if few else df

    while True:
        open_ = state.where(wide)
        if open_.isEmpty():
            break
        cuts = open_.select("source", "lo", "hi", _pivots().alias("pivots"))
        inside = items.join(beside(cuts), "source").where((F.col("score") > F.col("lo")) & (F.col("score") <= F.col("hi")))
        part = inside.withColumn("bin", F.size(F.filter("pivots", lambda p: p < F.col("score"))))
        bins = part.groupBy("source", "bin").agg(F.count("*").alias("k"), F.sum("score").alias("s"), F.min("score").alias("low"), F.max("score").alias("high"))
        # Bins of a source are bounded by the number of pivots.
        w = Window.partitionBy("source").orderBy("bin")
        sofar = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        at = bins.join(beside(open_), "source").withColumn("upto", F.col("n_lo") + F.sum("k").over(sofar)).withColumn("s_upto", F.col("s_lo") + F.sum("s").over(sofar))
        # Subgradient to the right of the bin's highest score: the loss falls on while it is negative.
        at = at.withColumn("slope", F.col("upto") - F.col("q") * F.col("n"))
        at = at.select("*", F.lag("high").over(w).alias("prev_high"), F.lag("slope").over(w).alias("prev_slope"))
        hit = at.where((F.col("slope") >= 0) & (F.coalesce("prev_slope", F.lit(-1.0)) < 0))
        next_ = hit.select(
            "source", "n", "q", "total", F.coalesce("prev_high", "lo").alias("lo"), (F.col("upto") - F.col("k")).alias("n_lo"), (F.col("s_upto") - F.col("s")).alias("s_lo"),
            F.col("high").alias("hi"), F.col("upto").alias("n_hi"), F.col("s_upto").alias("s_hi"), (F.col("upto") - 1).alias("n_below_hi"), (F.col("s_upto") - F.col("high")).alias("s_below_hi"),
            (F.col("passes") + 1).alias("passes"), (F.col("low") == F.col("high")).alias("done"),
        )
        state = cut_lineage(state.where(~wide).unionByName(next_))

    rest = state.where(~F.col("done"))
    near = items.join(beside(rest.select("source", "lo", "hi", "n_lo", "s_lo", "n", "q")), "source").where((F.col("score") > F.col("lo")) & (F.col("score") <= F.col("hi")))
    near = near.groupBy("source", "score", "n_lo", "s_lo", "n", "q").agg(F.count("*").alias("k"))
    w = Window.partitionBy("source").orderBy("score").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # at most snap_rows scores
    run = near.withColumn("upto", F.col("n_lo") + F.sum("k").over(w)).withColumn("s_upto", F.col("s_lo") + F.sum(F.col("k") * F.col("score")).over(w))
    goal = F.col("q") * F.col("n")
    snapped = run.where((F.col("upto") >= goal) & (F.col("upto") - F.col("k") < goal))
    exact = snapped.select("source", F.col("score").alias("cutoff"), "upto", "s_upto").unionByName(
        state.where("done").select("source", F.col("hi").alias("cutoff"), F.col("n_hi").alias("upto"), F.col("s_hi").alias("s_upto"))
    )
    out = state.select("source", "n", "q", "total", "passes").join(exact, "source")
    loss = _loss(F.col("cutoff"), F.col("q"), F.col("n"), F.col("total"), F.col("upto"), F.col("s_upto"))
    return out.select("source", "n", F.ceil(goal).cast("bigint").alias("need"), "cutoff", loss.alias("loss"), "passes"), items


def kept_items(cutoffs: DataFrame, items: DataFrame) -> DataFrame:
    """The (source, item, score) at or below their source's cutoff; an equi-join that adaptive execution may broadcast by size."""
    return items.join(cutoffs.select("source", "cutoff"), "source").where(F.col("score") <= F.col("cutoff")).drop("cutoff")

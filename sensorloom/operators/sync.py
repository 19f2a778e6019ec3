"""Clock alignment between a gyro and a pose track: preamble, lag and drift.

Every step works on grids or windows of time, so the rows of a recording are reduced
map-side before anything is ordered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sensorloom.functions import geometry as geo
from sensorloom.operators import asof
from sensorloom.operators.ordered import adjacent
from sensorloom.operators.regular_grid import floor_div
from sensorloom.session import cut_lineage

WINDOW_US = 1_000_000
STEP_US = 5_000
MAX_LAG = 10
GRID_BLOCK = 4096


def motion_windows(imu: DataFrame) -> DataFrame:
    """(seq, win, rows, level, share): per second from the first stamp the mean rate and the dominant axis' share of the spread.

    Windows with under three rows have level and share 0; the window at the very last stamp is left out if it starts there.
    """
    ends = imu.groupBy("seq").agg(F.min("us").alias("t0"), F.max("us").alias("t1"), F.count("*").alias("total"))
    j = imu.join(ends, "seq").withColumn("win", floor_div(F.col("us") - F.col("t0"), WINDOW_US))
    sd = [F.stddev_pop(c).alias(f"s_{c}") for c in ("ox", "oy", "oz")]
    w = j.groupBy("seq", "win", "t0", "t1", "total").agg(F.count("*").alias("rows"), F.avg(F.sqrt(F.col("ox") ** 2 + F.col("oy") ** 2 + F.col("oz") ** 2)).alias("level"), *sd)
    few = F.col("rows") < 3
    share = F.greatest("s_ox", "s_oy", "s_oz") / (F.col("s_ox") + F.col("s_oy") + F.col("s_oz") + 1e-9)
    n_win = F.ceil((F.col("t1") - F.col("t0")) / WINDOW_US).cast("bigint")
    return w.where(F.col("win") < n_win).select(
        "seq", "win", "total", "rows", n_win.alias("windows"), F.when(few, 0.0).otherwise(F.col("level")).alias("level"), F.when(few, 0.0).otherwise(share).alias("share")
    )


def preamble_end(windows: DataFrame, search: int = 25, swing_share: float = 0.6, calm_share: float = 0.55) -> DataFrame:
    """(seq, swings, end_window): end of a swinging start; null where there is none.

    A swing is a window over half the median level whose motion is on one axis, among the
    first `search`. The end is the first later window from which three in a row are over
    half the median and not on one axis, else the one after the last swing. Under 30
    readings or four windows there is no preamble. Windows without readings have level 0.
    """
    level = windows.where(F.col("level") > 1e-6).groupBy("seq").agg((F.percentile("level", 0.5) / 2).alias("thr"))
    j = windows.where((F.col("total") >= 30) & (F.col("windows") >= 4)).join(level, "seq")
    by_win = Window.partitionBy("seq").orderBy("win")  # one row a second

    def ahead(k: int):
        return F.when(F.lead("win", k).over(by_win) == F.col("win") + k, F.lead("level", k).over(by_win)).otherwise(0.0)

    over = F.col("level") > F.col("thr")
    s = j.select(
        "seq", "win", "windows", (over & (F.col("share") > swing_share) & (F.col("win") < F.least(F.lit(search), F.col("windows")))).alias("swing"),
        (over & (ahead(1) > F.col("thr")) & (ahead(2) > F.col("thr")) & (F.col("share") < calm_share) & (F.col("win") < F.col("windows") - 3)).alias("calm"),
    )
    g = s.groupBy("seq", "windows").agg(
        F.count_if("swing").alias("swings"), F.min(F.when(F.col("swing"), F.col("win"))).alias("first"), F.max(F.when(F.col("swing"), F.col("win"))).alias("last"),
        F.array_sort(F.collect_list(F.when(F.col("calm"), F.col("win")))).alias("calm"),
    )
    start = F.array_min(F.filter("calm", lambda c: c > F.col("first")))
    fallback = F.least(F.col("last") + 1, F.col("windows") - 1)
    return g.select("seq", "swings", F.when(F.col("swings") > 0, F.coalesce(start, fallback)).alias("end_window"))


def common_grid(poses: DataFrame, imu: DataFrame, ends: DataFrame, step: int = STEP_US) -> DataFrame:
    """(seq, i, n, a, b): the gyro's rate (a) and the pose track's (b) on the grid lo, lo + step, .. below hi of each recording.

    ends has seq, lo, hi. a is the gyro's length interpolated, its end values outside of the
    track. b is the angle between the poses interpolated at a grid point and at the next, over
    the step; the last point of the track repeats the one before, points outside have 0.
    """
    n = F.ceil((F.col("hi") - F.col("lo")) / step).cast("bigint")
    g = ends.where("hi > lo").select("seq", "lo", n.alias("n")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), floor_div(F.col("n") - 1, GRID_BLOCK))))
    last = F.least((F.col("block") + 1) * GRID_BLOCK, F.col("n")) - 1
    g = g.withColumn("i", F.explode(F.sequence(F.col("block") * GRID_BLOCK, last))).select("seq", "i", "n", (F.col("lo") + F.col("i") * step).alias("us"))
    rated = imu.select("seq", "us", "line", F.sqrt(F.col("ox") ** 2 + F.col("oy") ** 2 + F.col("oz") ** 2).alias("rate"))
    a = asof.interpolate(asof.bracket(g, rated, "seq", "us", "us", ["rate"], tie="line"), "us", ["rate"], "clamp").select("seq", "i", "n", "us", F.col("at_rate").alias("a"))
    a = cut_lineage(a)  # the join below reads its left side twice, and so does `adjacent`
    turned = poses.select("seq", "us", "line", geo.rotation_to_quat(geo.rotation(F.col("tmat"))).alias("q"))
    b = asof.bracket(a, turned, "seq", "us", "us", ["q"], tie="line")
    inside = F.col("before").isNotNull() & F.col("after").isNotNull()
    b = b.select("seq", "i", "n", "a", F.when(inside, geo.slerp(F.col("before.q"), F.col("after.q"), asof.weight(F.col("us")))).alias("q"))
    b = cut_lineage(b)
    steps = adjacent(b, ["seq"], "i", [], ["q"], block=GRID_BLOCK)

    def rate(p, q):
        dot = F.abs(sum((p[c] * q[c] for c in "xyz"), p["w"] * q["w"]))
        return 2 * F.acos(F.least(F.lit(1.0), dot)) / (step / 1e6)

    ahead, behind = rate(F.col("q"), F.col("next.q")), rate(F.col("prev.q"), F.col("q"))
    out = F.when(F.col("q").isNull(), 0.0).when(F.col("next.q").isNotNull(), ahead).otherwise(F.coalesce(behind, F.lit(0.0)))
    return steps.select("seq", "i", "n", "a", out.alias("b"))


def circular_products(grid: DataFrame, max_lag: int = MAX_LAG, block: int = GRID_BLOCK) -> DataFrame:
    """(seq, c): sums of a[i - lag]·b[i] for the lags -max_lag..max_lag, the recording taken as a ring; both centred.

    Rows are put into blocks with max_lag neighbours on both sides (the first and last rows
    stand at both ends), ordered there, and summed map-side: 1 + 2·max_lag / block copies.
    """
    m = grid.groupBy("seq").agg(F.avg("a").alias("ma"), F.avg("b").alias("mb"))
    j = grid.join(m, "seq").select("seq", "i", "n", (F.col("a") - F.col("ma")).alias("a"), (F.col("b") - F.col("mb")).alias("b"))
    turns = F.explode(F.array(*[F.lit(t) for t in (-1, 0, 1)]))
    p = j.withColumn("turn", turns).withColumn("p", F.col("i") + F.col("turn") * F.col("n")).where((F.col("p") >= -max_lag) & (F.col("p") < F.col("n") + max_lag))
    top = floor_div(F.col("n") - 1, block)
    first, last = F.greatest(F.lit(0).cast("bigint"), floor_div(F.col("p") - max_lag, block)), F.least(top, floor_div(F.col("p") + max_lag, block))
    p = p.where(first <= last).withColumn("block", F.explode(F.sequence(first, last)))
    w = Window.partitionBy("seq", "block").orderBy("p")
    lags = [(F.lag("a", k) if k >= 0 else F.lead("a", -k)).over(w).alias(f"a{k + max_lag}") for k in range(-max_lag, max_lag + 1)]
    own = p.select("*", *lags).where((F.col("turn") == 0) & (floor_div(F.col("i"), block) == F.col("block")))
    return own.groupBy("seq").agg(F.array(*[F.sum(F.col(f"a{k}") * F.col("b")) for k in range(2 * max_lag + 1)]).alias("c"), F.stddev_pop("a").alias("sa"), F.stddev_pop("b").alias("sb"))


def stream_lag(poses: DataFrame, imu: DataFrame, ends: DataFrame, step: int = STEP_US, max_lag: int = MAX_LAG) -> DataFrame:
    """(seq, lag, lag_ms): shift of the gyro's rate, in steps, at which it correlates most with the pose track's, on [lo, hi) of `ends`.

    Of equal correlations the smallest shift holds; an inner peak is refined by a parabola; a
    flat signal has lag 0. Recordings without a grid point have no row.
    """
    c = circular_products(common_grid(poses, imu, ends, step), max_lag)
    at = (F.array_position("c", F.array_max("c")) - 1).cast("int")
    c = c.withColumn("at", at)
    low, mid, high = F.col("c")[F.col("at") - 1], F.col("c")[F.col("at")], F.col("c")[F.col("at") + 1]
    curve = low - 2 * mid + high
    inner = (F.col("at") > 0) & (F.col("at") < 2 * max_lag)
    fine = F.when(inner & (F.abs(curve) > 1e-12), F.col("at") + 0.5 * (low - high) / curve).otherwise(F.col("at"))
    flat = (F.col("sa") < 1e-9) | (F.col("sb") < 1e-9)
    return c.select("seq", F.when(flat, 0).otherwise(F.col("at") - max_lag).alias("lag"), F.when(flat, 0.0).otherwise((fine - max_lag) * step / 1e3).alias("lag_ms"))


def track_ends(imu: DataFrame) -> DataFrame:
    """(seq, lo, hi): first and last reading."""
    return imu.groupBy("seq").agg(F.min("us").alias("lo"), F.max("us").alias("hi"))


def clock_drift(poses: DataFrame, imu: DataFrame, starts: DataFrame | None = None, window_us: int = 10_000_000, least_us: int = 3_000_000) -> DataFrame:
    """(seq, first_ms, last_ms, drift_ms): lags of the first and the last window; null where a window would be under least_us.

    A window is at most a third of what follows the start: the first reading, or that of
    `starts` (seq, start_us), the end of a preamble.
    """
    e = track_ends(imu)
    if starts is not None:
        e = e.join(starts.select("seq", "start_us"), "seq", "left").withColumn("lo", F.coalesce("start_us", "lo"))
    e = e.withColumn("w", F.least(F.lit(window_us), floor_div(F.col("hi") - F.col("lo"), 3)))
    long = e.where(F.col("w") >= least_us)
    first = stream_lag(poses, imu, long.select("seq", "lo", (F.col("lo") + F.col("w")).alias("hi"))).select("seq", F.col("lag_ms").alias("first_ms"))
    last = stream_lag(poses, imu, long.select("seq", (F.col("hi") - F.col("w")).alias("lo"), "hi")).select("seq", F.col("lag_ms").alias("last_ms"))
    return e.select("seq").join(first, "seq", "left").join(last, "seq", "left").select("seq", "first_ms", "last_ms", (F.col("last_ms") - F.col("first_ms")).alias("drift_ms"))
